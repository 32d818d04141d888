"""Forests whose nodes are a table: grown by groups, scored by shuffles."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnkit.operators import forest as FO
from churnkit.operators.explain import forest_shapley_values, shapley_values
from churnkit.operators.models import random_forest
from churnkit.operators.tree_tables import read_trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i == 7 else i % 590, int(x[0] + x[1] > 1 or rng.random() < 0.1), "train" if i % 4 else "test", [float(v) for v in x])
            for i, x in enumerate(np.column_stack([rng.random(600), rng.random(600), rng.integers(0, 2, 600)]))]
    return (spark.createDataFrame(rows, "row_id long, label int, split string, x array<double>")
            .withColumn("features", array_to_vector("x")).withColumn("n", F.monotonically_increasing_id()).repartition(3).persist())


@pytest.mark.parametrize("group", [200_000, 40])
def test_scores_are_those_of_the_nodes(table, group):
    """Also where nodes above the groups come from histograms; every row, with its null or repeated id, is scored once."""
    forest = FO.fit_forest(table.where("split = 'train'"), trees=6, seed=1, group=group)
    assert (len(forest.top.tree) > 6) == (group == 40)
    rows = table.select("n", "x").collect()
    want = dict(zip([r.n for r in rows], read_trees(forest).predict(np.array([r.x for r in rows])), strict=True))
    got = forest.score(table, ["n", "row_id"]).collect()
    assert len(got) == 600 and all(abs(want[r.n] - r.score) < 1e-12 for r in got)
    assert sum(v.score > 0.5 for v in got) > 100
    assert abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9 and forest.featureImportances[2] < 0.2


def test_model_stays_a_table(table):
    """A forest's nodes are rows of a table in the shared folder, not objects of the driver."""
    model, rows = random_forest(table, n_trees=4)
    assert model.nodes.count() == 4 and len(model.top.tree) == 4
    assert rows.columns == ["row_id", "label", "split", "model", "score", "prediction"] and rows.count() == 600


def test_full_tree_separates_its_rows():
    """Unlimited depth: a row's value is the label share of the rows of equal bins."""
    rng = np.random.default_rng(0)
    b, y = rng.integers(0, 4, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300).astype(np.uint8)
    a = FO.grown(b, np.ones(300, np.uint8), y, np.random.default_rng(1), 3, 1, 30)
    for row in range(300):
        node = 0
        while a["left"][node] >= 0:
            node = a["left"][node] + int(b[row, a["feature"][node]] > a["cut"][node])
        same = (b == b[row]).all(axis=1)
        assert a["value"][node] == pytest.approx(y[same].mean()) or a["rows"][node] > same.sum()
    assert a["rows"][a["left"] < 0].sum() == 300


def test_shapley_values_of_scored_points(table):
    forest = FO.fit_forest(table.where("split = 'train'"), trees=5, seed=2)
    rows = table.where("split = 'test' and row_id < 40").select("row_id", "features")
    back = table.where("split = 'train' and row_id is not null").dropDuplicates(["row_id"])
    read = lambda df: {(r.row_id, r.feature): r.phi for r in df.collect()}      # noqa: E731
    want = read(shapley_values(rows, back, read_trees(forest).predict, NAMES, n_background=5))
    got = read(forest_shapley_values(rows, back, forest, NAMES, n_background=5))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
