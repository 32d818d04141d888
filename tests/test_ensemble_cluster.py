import math

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from churnkit.operators.cluster_quality import segments, silhouette_sqeuclidean
from churnkit.operators.ensemble import disagreement, soft_vote


def test_disagreement_threshold(spark):
    # one model out of 19 disagrees: std 0.229 (not high); one out of 7: 0.378 (high)
    rows = [(1, f"m{i}", 1 if i == 0 else 0) for i in range(19)] + [(2, f"m{i}", 1 if i == 0 else 0) for i in range(7)]
    df = spark.createDataFrame(rows, "row_id long, model string, prediction int")
    r = disagreement(df, [f"m{i}" for i in range(19)]).first()
    assert r["n_rows"] == 2 and r["n_high"] == 1


def test_soft_vote_within_range(spark):
    rows = [(1, 1, "a", 0.2), (1, 1, "b", 0.9), (2, 0, "a", 0.4), (2, 0, "b", 0.5)]
    df = spark.createDataFrame(rows, "row_id long, label int, model string, score double")
    for r in soft_vote(df, ["a", "b"]).collect():
        assert 0.2 <= r["score"] <= 0.9


def test_isotonic_four_points(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 0.0), (4.0, 1.0)], "x double, label double")
    m = IsotonicRegression(featuresCol="x").fit(df)
    got = [r["prediction"] for r in m.transform(df).orderBy("x").collect()]
    assert np.allclose(got, [0.0, 0.5, 0.5, 1.0])


def test_segments_strict_thresholds(spark):
    rows = ([(0, 1 if i < 40 else 0, 1.0, 1.0, 1.0) for i in range(100)]
            + [(1, 1 if i < 25 else 0, 1.0, 1.0, 5.0) for i in range(100)] + [(-1, 0, 1.0, 1.0, 1.0)])
    df = spark.createDataFrame(rows, "cluster int, label int, tenure double, MonthlyCharges double, TotalCharges double")
    got = {r["Segment"]: r for r in segments(df).collect()}
    assert got["Segment_0"]["Risk_Level"] == "Medium" and got["Segment_1"]["Risk_Level"] == "Low"
    assert math.isclose(got["Segment_0"]["Percentage"], 100 * 100 / 201)
    assert got["Segment_1"]["Value"] == "High Value"


def test_silhouette_decomposition_matches_pairs(spark):
    pts = [(0, 0.0, 0.0), (0, 0.0, 1.0), (0, 1.0, 0.0), (1, 5.0, 5.0), (1, 6.0, 5.0)]
    df = spark.createDataFrame(pts, "cluster int, a double, b double")
    got = silhouette_sqeuclidean(df, ["a", "b"]).first()[0]
    x = np.array([[p[1], p[2]] for p in pts]); c = np.array([p[0] for p in pts])
    s = []
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        own = c == c[i]
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(got, float(np.mean(s)))
