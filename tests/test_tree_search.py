"""The grid of decision trees against Spark's own fits, read as prefixes and scored row by row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from churnkit.operators import tuning
from churnkit.operators.metrics import roc_auc
from churnkit.operators.tree_tables import Prefix, read_trees, score_prefixes

GRID = {"depth": (2, 4, 30), "min_split": (2, 10), "min_leaf": (1, 4), "criterion": ("gini", "entropy")}


def _table(spark, positives):
    """A column of many values, one of few, one of two, a constant; keys repeat or are null; positives rare or not."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 7, 500), rng.integers(0, 2, 500), np.ones(500)])
    y = (x[:, 0] * (x[:, 1] - 3) + rng.normal(size=500) > positives).astype(int)
    rows = [(None if i == 9 else i % 495, int(y[i]), "train" if i % 5 else "test", [float(v) for v in x[i]]) for i in range(500)]
    return (spark.createDataFrame(rows, "row_id long, label int, split string, a array<double>")
            .select("row_id", "label", "split", array_to_vector("a").alias("features")).repartition(3).persist())


@pytest.mark.parametrize("positives", [0.0, 5.0])
@pytest.mark.parametrize("group", [50_000, 30, 4])
def test_grid_is_that_of_sparks_trees(spark, monkeypatch, positives, group):
    """Also where nodes above the groups come from histograms, and where these join to leaves."""
    from churnkit.operators import tree_search
    monkeypatch.setattr(tree_search, "GROUP", group)
    df, folds = _table(spark, positives), 3
    got = {(r.criterion, r.max_depth, r.min_samples_split, r.min_samples_leaf): r.fold_auc for r in tuning.tree_grid(df, GRID, folds=folds).collect()}
    tr = tuning.with_folds(df, folds).persist()
    want: dict = {}
    for k in range(folds):
        for c in GRID["criterion"]:
            for leaf in GRID["min_leaf"]:
                kind = DecisionTreeRegressor(maxDepth=30, minInstancesPerNode=leaf) if c == "gini" else DecisionTreeClassifier(maxDepth=30, minInstancesPerNode=leaf, impurity="entropy")
                deep = read_trees(kind.fit(tr.where(F.col("fold") != k)))
                every = [Prefix(f"{d}/{s}", "t", 1, d, s) for d in GRID["depth"] for s in GRID["min_split"]]
                for r in roc_auc(score_prefixes(tr.where(F.col("fold") == k), {"t": deep}, every, ["label"])).collect():
                    d, s = map(int, r.model.split("/"))
                    want.setdefault((c, d, s, leaf), []).append(r.auc)
    tr.unpersist()
    assert got.keys() == want.keys() and len(got) == 24
    assert max(abs(a - b) for key in want for a, b in zip(got[key], want[key], strict=True)) < 1e-12


def test_grid_takes_few_jobs(spark):
    """Trees and depths share their passes; Spark's fits took jobs for every level of every tree."""
    df = _table(spark, 0.0)
    df.count()
    spark.sparkContext.setJobGroup("grid", "grid")
    try:
        assert tuning.tree_grid(df, GRID, folds=3).count() == 24
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_where_values_are_many(spark, monkeypatch):
    from churnkit.operators import tree_search
    df = _table(spark, 0.0)
    whole = {tuple(r)[:4]: r.mean_auc for r in tuning.tree_grid(df, GRID, folds=3).collect()}
    monkeypatch.setattr(tree_search, "VALUES", 50)
    near = {tuple(r)[:4]: r.mean_auc for r in tuning.tree_grid(df, GRID, folds=3).collect()}
    assert max(abs(near[key] - whole[key]) for key in whole) < 0.08
