"""C6, Euclidean M14 and M12 against brute force and closed forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnkit.operators import cluster_quality as Q
from churnkit.operators.explain import attribution_table, shapley_values
from churnkit.operators.linear_many import LinearFit, Problem
from churnkit.operators.models import random_forest
from churnkit.operators.spectral import spectral
from churnkit.operators.tree_tables import read_trees


def _table(spark, x, extra=()):
    rows = [(i, *e, [float(v) for v in p]) for i, (p, e) in enumerate(zip(x, extra or [()] * len(x)))]
    fields = ", label int, split string" if extra else ""
    df = spark.createDataFrame(rows, f"row_id long{fields}, a array<double>")
    return df.withColumn("features", array_to_vector("a")).drop("a").repartition(3)


def test_two_rings_are_separated(spark):
    rng = np.random.default_rng(1)
    angle = rng.uniform(0, 2 * np.pi, 400)
    radius = np.where(np.arange(400) % 2, 1.0, 4.0) + rng.normal(0, 0.05, 400)
    df = _table(spark, np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]))
    got = {r.row_id: r.cluster for r in spectral(df, 2, gamma=2.0, m=150).collect()}
    assert len(got) == 400 and len({got[i] for i in range(0, 400, 2)}) == 1 and len({got[i] for i in range(1, 400, 2)}) == 1
    assert got[0] != got[1]
    assert spectral(df.limit(0), 2).count() == 0


def test_euclidean_silhouette(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, 2)) * 2, rng.integers(-1, 4, 300)
    x[:60] = x[0]
    c[299] = 9                                  # a cluster of one row
    rows = [(i, float(x[i, 0]), float(x[i, 1]), int(c[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, cluster int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in (i for i in range(300) if i % 10 == 9 and c[i] != -1):
        same = (c == c[i]) & (np.arange(300) != i)
        a = far[i, same].mean() if same.any() else None
        b = min(far[i, c == k].mean() for k in set(c) - {-1, c[i]})
        want.append(0.0 if a is None else (b - a) / max(a, b))
    for block, piece in ((16384, 4096), (70, 9)):
        monkeypatch.setattr(Q, "BLOCK", block)
        monkeypatch.setattr(Q, "SLICE", piece)
        got = Q.silhouette_euclidean(df, ["x", "y"], F.col("row_id") % 10 == 9).first()
        assert got.n_rows == len(want) and got.silhouette == pytest.approx(np.mean(want), abs=1e-12)
    one = Q.silhouette_euclidean(df.where("cluster = 2"), ["x", "y"], F.lit(True)).first()
    assert one.silhouette is None


def test_shapley_values_add_up_and_equal_the_linear_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    df = _table(spark, x, [(int(y[i]), "train" if i % 3 else "test") for i in range(300)])
    names = ["a", "b", "c", "d"]
    train, rows = df.where("split = 'train'"), df.where("row_id < 12")
    base = [r.row_id for r in train.select("row_id", F.md5(F.concat_ws("-", "row_id", F.lit(42))).alias("h")).orderBy("h", "row_id").limit(50).collect()]
    w = np.array([1.0, -2.0, 0.5, 0.0])
    linear = LinearFit(Problem("m"), w, 0.3, 1, True, 0.0)
    got = {(r.row_id, r.feature): r.phi for r in shapley_values(rows, train, linear.margin, names).collect()}
    for i in range(12):
        for j, n in enumerate(names):
            assert got[i, n] == pytest.approx(w[j] * (x[i, j] - x[base, j].mean()), abs=1e-9)
    trees = read_trees(random_forest(df, n_trees=8, max_depth=6)[0])
    values = shapley_values(rows, train, trees.predict, names)
    total = {r.row_id: r.t for r in values.groupBy("row_id").agg(F.sum("phi").alias("t")).collect()}
    for i in range(12):
        assert total[i] == pytest.approx(float(trees.predict(x[i:i + 1])[0] - trees.predict(x[base]).mean()), abs=1e-9)
    assert [r.rank for r in attribution_table(values, "m").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_bisecting_equals_spark_and_ends_early(spark):
    """Spark's clusters of the same seed, and no passes after the centres rest."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    from churnkit.operators.clustering import hierarchical
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in rng.normal(size=3) + (4 * (i % 3), i % 3, 1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a array<double>").select("row_id", array_to_vector("a").alias("features")).repartition(3)
    for k in (2, 3):
        model, got = hierarchical(df, k)
        want = {r.row_id: r.prediction for r in BisectingKMeans(k=k, seed=42, maxIter=100).fit(df).transform(df).collect()}
        assert {r.row_id: r.cluster for r in got.collect()} == want and 2 < model.passes < 60
    model, got = hierarchical(df.where("row_id = 5").union(df.where("row_id = 5")), 2)      # one distinct row is not split
    assert {r.cluster for r in got.collect()} == {0} and hierarchical(df.limit(0), 2)[1].count() == 0
