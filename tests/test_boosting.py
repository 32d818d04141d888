"""Boosted trees and stumps from shared histogram passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from churnkit.operators import models as MD
from churnkit.operators.boosting import Boost, fit_boosts, score_boosts
from churnkit.operators.stumps import fit_stumps


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(900, 4))
    y = (x[:, 0] + 2 * (x[:, 1] > 5) * x[:, 2] + rng.normal(scale=5, size=900) > 12).astype(int)
    data = [(i, int(y[i]), i % 3, "train", [float(v) for v in x[i]]) for i in range(900)]
    df = spark.createDataFrame(data, "row_id long, label int, fold int, split string, a array<double>")
    return df.select("row_id", "label", "fold", "split", array_to_vector("a").alias("features")).repartition(3).persist(), x, y


def scores(df):
    return np.array([r.score for r in df.orderBy("row_id").select("score").collect()])


def test_shared_passes_equal_sparks_boosting(rows):
    """Rounds past a write of the margins, two depths and a left-out fold, all in the same passes."""
    df, _, _ = rows
    fits = fit_boosts(df, [Boost("a", 13, 3), Boost("b", 5, 4, rate=0.3, min_leaf=20), Boost("c", 4, 2, leave_fold=1)], "fold")
    assert [len(f.trees) for f in fits] == [13, 5, 4]
    p = score_boosts(df, fits)
    for name, part, kw in (("a", df, {"maxIter": 13, "maxDepth": 3}), ("b", df, {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 20}),
                           ("c", df.where("fold <> 1"), {"maxIter": 4, "maxDepth": 2})):
        want = GBTClassifier(seed=42, **kw).fit(part).transform(df).withColumn("score", vector_to_array("probability")[1])
        assert np.abs(scores(p.where(F.col("model") == name)) - scores(want)).max() < 1e-9


def test_folds_are_scored_by_fits_without_them(rows):
    df, _, _ = rows
    p = MD.gradient_boosting_folds(df, 3, n_trees=3, max_depth=2, name="m")
    assert p.count() == 900
    own = MD.gradient_boosting(df.where("fold <> 2").unionByName(df.where("fold = 2").withColumn("split", F.lit("held"))), n_trees=3, max_depth=2)[1]
    assert np.allclose(scores(p.where("row_id % 3 = 2")), scores(own.where("split = 'held'")))
    assert fit_boosts(df.limit(0), [Boost("m", 2)])[0].trees[0].value == [0.0]


def test_stumps_equal_samme_by_hand(rows):
    df, x, y = rows
    fit = fit_stumps(df, 6)
    w, acc = np.full(900, 1 / 900), np.zeros(900)
    for tree, alpha in fit.stumps:
        best = max(((f, t) for f in range(4) for t in np.arange(11) + 0.5), key=lambda c: sum(
            (w[s] @ y[s]) ** 2 / w[s].sum() for s in (x[:, c[0]] <= c[1], x[:, c[0]] > c[1])))
        left = x[:, best[0]] <= best[1]
        assert (tree.feature[0], tree.threshold[0]) == best
        h = np.where(left, w[left] @ y[left] / w[left].sum() >= 0.5, w[~left] @ y[~left] / w[~left].sum() >= 0.5)
        e = w[h != y].sum() / w.sum()
        assert abs(alpha - np.log((1 - e) / e)) < 1e-9
        w, acc = np.where(h != y, w * np.exp(alpha), w), acc + np.where(h, alpha, -alpha)
    got = scores(fit.score(df, ["row_id"]))
    assert len(fit.stumps) == 6 and np.allclose(got, (acc / sum(a for _, a in fit.stumps) + 1) / 2)
