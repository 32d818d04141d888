import math

from pyspark.sql import functions as F

from churnkit.operators.metrics import (average_precision, calibration_curve, classification_metrics, roc_auc,
                                        roc_curve)


def _preds(spark, rows):
    return spark.createDataFrame(rows, "row_id long, model string, label int, score double").withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int"))


def test_confusion_counts_reproduce_published_row(spark):
    rows = ([(i, "m", 1, 0.9) for i in range(198)] + [(1000 + i, "m", 0, 0.9) for i in range(99)]
            + [(2000 + i, "m", 1, 0.1) for i in range(176)] + [(3000 + i, "m", 0, 0.1) for i in range(936)])
    r = classification_metrics(_preds(spark, rows)).first()
    assert round(r["accuracy"], 5) == 0.80483 and round(r["precision"], 4) == 0.6667
    assert round(r["recall"], 4) == 0.5294 and round(r["f1"], 4) == 0.5902


def test_auc_ties_and_brute_force(spark):
    rows = [(0, "m", 1, 0.8), (1, "m", 0, 0.8), (2, "m", 1, 0.3), (3, "m", 0, 0.1), (4, "m", 0, 0.3), (5, "m", 1, 0.9)]
    pos = [s for _, _, y, s in rows if y == 1]
    neg = [s for _, _, y, s in rows if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = roc_auc(_preds(spark, rows)).first()["auc"]
    assert math.isclose(got, brute)
    mono = _preds(spark, [(i, m, y, s * 10 - 3) for i, m, y, s in rows])
    assert math.isclose(roc_auc(mono).first()["auc"], brute)


def test_auc_one_class_is_null(spark):
    assert roc_auc(_preds(spark, [(0, "m", 1, 0.2), (1, "m", 1, 0.4)])).first()["auc"] is None


def test_roc_drops_collinear_points(spark):
    rows = [(i, "m", 0, s) for i, s in enumerate([0.1, 0.2, 0.3])] + [(9, "m", 1, 0.9)]
    pts = sorted((r["fpr"], r["tpr"]) for r in roc_curve(_preds(spark, rows)).collect())
    assert pts == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_average_precision_step_rule(spark):
    rows = [(0, "m", 1, 0.9), (1, "m", 0, 0.8), (2, "m", 1, 0.7), (3, "m", 0, 0.1)]
    ap = average_precision(_preds(spark, rows)).first()["average_precision"]
    assert math.isclose(ap, 0.5 * 1.0 + 0.5 * (2 / 3))


def test_calibration_edges_right_closed(spark):
    rows = [(i, "m", 0, s) for i, s in enumerate([0.0, 0.1, 0.5, 1.0])]
    bins = sorted(r["bin"] for r in calibration_curve(_preds(spark, rows)).collect())
    assert bins == [0, 4, 9]
