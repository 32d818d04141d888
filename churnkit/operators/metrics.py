"""Evaluation metrics and curves as DataFrame aggregations.

Input is the long predictions table ``(row_id, <by>..., label, prediction, score)``.
Counting metrics are one grouped aggregate. Rank metrics (AUC, ROC, PR, AP)
first reduce rows to one row per (group, distinct score) — ties and hot
scores collapse map-side — then use the two-level running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import attach, monotone_bucket, running_totals


def _div(a, b):
    """a / b with 0/0 (and x/0) -> 0, as scikit-learn's zero_division default."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return preds.groupBy(*by).agg(cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 1)).alias("fp"),
                                  cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 0) & (p == 0)).alias("tn"))


def _from_counts(cc: DataFrame, by) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cc.select(*by, _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                     _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                     _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_metrics(preds: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """M1: accuracy, precision, recall, F1 of class 1."""
    by = list(by)
    return _from_counts(confusion_counts(preds, by, **kw), by)


def confusion_matrix(preds: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """M2: (by..., actual, predicted, n), all four cells present (zeros kept)."""
    by = list(by)
    cc = confusion_counts(preds, by, **kw)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
                      for a, p, c in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))])
    return cc.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def classification_report(preds: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """M3: per class precision/recall/F1/support, accuracy, macro and weighted averages."""
    by = list(by)
    cc = confusion_counts(preds, by, **kw)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, f1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    w1, w0 = s1 / n, s0 / n
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _div(tp + tn, n), n),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            ("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n)]
    arr = F.array(*[F.struct(F.lit(k).alias("class"), a.alias("precision"), b.alias("recall"),
                             c.alias("f1"), d.cast("long").alias("support")) for k, a, b, c, d in rows])
    return cc.select(*by, F.explode(arr).alias("r")).select(*by, "r.*")


def score_table(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
                score: str = "score") -> DataFrame:
    """(by..., score, pos, neg): one row per distinct score, partial-aggregated."""
    y = F.col(label)
    return (preds.filter(F.col(score).isNotNull())
            .groupBy(*by, score).agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                     F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg")))


def _ranked(preds, by, label, score, descending, with_next=False, n_buckets=64):
    st = score_table(preds, by, label, score)
    return running_totals(st, by, [score], ["pos", "neg"], monotone_bucket(F.col(score).cast("double")),
                          descending=descending, with_next=with_next)


def roc_auc(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
            score: str = "score") -> DataFrame:
    """M5: exact ROC AUC with ties (Mann-Whitney). Null when a group has one class."""
    by = list(by)
    r = _ranked(preds, by, label, score, descending=False)
    below = F.col("cum_neg") - F.col("neg")
    g = r.groupBy(*by).agg(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("_u"),
                           F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*by, (F.col("_u") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0))).alias("auc"))


def roc_curve(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
              score: str = "score", drop_intermediate: bool = True) -> DataFrame:
    """M4: (by..., threshold, fpr, tpr). Starts at (0, 0) with a null threshold
    (scikit-learn writes +inf there). With ``drop_intermediate`` a point is kept
    only where the slope changes (second difference non-zero) or at the ends."""
    by = list(by)
    r = _ranked(preds, by, label, score, descending=True, with_next=drop_intermediate)
    tot = r.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    r = attach(r, tot, by)
    if drop_intermediate:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        last = F.col("next_pos").isNull()
        change = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        r = r.filter(first | last | change)
    pts = r.select(*by, F.col(score).cast("double").alias("threshold"),
                   _div(F.col("cum_neg"), F.col("_N")).alias("fpr"), _div(F.col("cum_pos"), F.col("_P")).alias("tpr"))
    origin = tot.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
             score: str = "score") -> DataFrame:
    """M6: (by..., threshold, precision, recall) at every distinct score, plus
    the end point (precision 1, recall 0) with a null threshold."""
    by = list(by)
    r = _ranked(preds, by, label, score, descending=True)
    tot = r.groupBy(*by).agg(F.sum("pos").alias("_P"))
    r = attach(r, tot, by)
    rec = F.when(F.col("_P") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("_P"))
    pts = r.select(*by, F.col(score).cast("double").alias("threshold"),
                   _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                   rec.alias("recall"))
    end = tot.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
                      score: str = "score") -> DataFrame:
    """M7: AP = sum over thresholds of (R_i - R_{i-1}) * P_i (step rule, not trapezoid)."""
    by = list(by)
    r = _ranked(preds, by, label, score, descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    g = r.groupBy(*by).agg(F.sum(F.col("pos") * prec).alias("_s"), F.sum("pos").alias("_P"))
    return g.select(*by, (F.col("_s") / F.nullif(F.col("_P"), F.lit(0))).alias("average_precision"))


def calibration_curve(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
                      score: str = "score", n_bins: int = 10) -> DataFrame:
    """M8: uniform bins on [0, 1], right-closed inner edges, empty bins dropped.

    bin = number of inner edges ``i / n_bins`` strictly below the score.
    """
    step = F.lit(1.0) / F.lit(float(n_bins))
    edges = F.sequence(F.lit(1), F.lit(n_bins - 1))
    b = F.size(F.filter(edges, lambda i: i * step < F.col(score)))
    return (preds.filter(F.col(score).isNotNull())
            .groupBy(*by, b.alias("bin"))
            .agg(F.avg(F.col(score).cast("double")).alias("mean_predicted"),
                 F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def margin_summary(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
                   score: str = "score") -> DataFrame:
    """M9: per class, rows inside the margin (|m| < 1), on the wrong side, and shares."""
    by = list(by)
    m = F.col(score)
    inside = F.sum(F.when(F.abs(m) < 1, 1).otherwise(0)).cast("long")
    wrong = F.sum(F.when((m >= 0) != (F.col(label) == 1), 1).otherwise(0)).cast("long")
    return (preds.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), inside.alias("inside_margin"),
                                          wrong.alias("wrong_side"))
            .withColumn("inside_share", F.col("inside_margin") / F.col("n")))


def model_table(preds: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    """One row per model: accuracy, precision, recall, F1, AUC (null without scores)."""
    by = list(by)
    m = classification_metrics(preds, by)
    a = roc_auc(preds, by)
    return m.join(a, by, "left")


def val_test_table(preds: DataFrame, split: str = "split") -> DataFrame:
    """Validation AUC next to the test metrics, one row per model."""
    t = model_table(preds.filter(F.col(split) == "test"))
    v = roc_auc(preds.filter(F.col(split) == "val")).withColumnRenamed("auc", "val_auc")
    return t.join(v, "model", "left").select(
        "model", "val_auc", F.col("auc").alias("test_auc"), F.col("accuracy").alias("test_accuracy"),
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
        F.col("f1").alias("test_f1"))
