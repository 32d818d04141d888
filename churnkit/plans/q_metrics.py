"""Registered queries: metrics and curves (M1-M9, M20, M21) on deterministic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .fixtures import PSEUDO_SCORES_SQL, cb_sql, churn_base, pseudo_scores
from .pipeline import churn_features
from .registry import register, round_doubles
from .sqltext import features_cte

PS = ", ps AS (" + PSEUDO_SCORES_SQL + ")"
# Pseudo scores with the split of the feature table attached.
PSS = features_cte(scale=False) + PS + ", pss AS (SELECT ps.*, sp.split FROM ps JOIN sp USING (row_id))"


def scores(spark, sf_dir):
    return pseudo_scores(churn_base(spark, sf_dir))


def split_scores(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False).select("row_id", "split")
    return scores(spark, sf_dir).join(f, "row_id")


def D(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


def counts_sql(src, by="model"):
    return (f", cm AS (SELECT {by}, "
            "CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,"
            " CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,"
            " CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,"
            f" CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {src} GROUP BY {by})")


def metrics_select(by="model"):
    return (f"SELECT {by}, round({D('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,"
            f" round({D('tp', 'tp + fp')}, 6) AS precision, round({D('tp', 'tp + fn')}, 6) AS recall,"
            f" round({D('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM cm")


def st_sql(src, by="model"):
    return (f", st AS (SELECT {by}, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,"
            f" CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg FROM {src}"
            f" WHERE score IS NOT NULL GROUP BY {by}, score)")


def auc_sql(src, by="model", name="auc_t"):
    return (st_sql(src, by) +
            f", cu AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM st)"
            f", {name} AS (SELECT {by}, sum(pos * (cum_neg - neg + CAST(0.5 AS DOUBLE) * neg))"
            f" / nullif(sum(pos) * sum(neg), 0) AS auc FROM cu GROUP BY {by})")


def desc_cum_sql(src, by="model"):
    return (st_sql(src, by) +
            f", cu AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,"
            f" lead(pos) OVER w2 AS next_pos, lead(neg) OVER w2 AS next_neg,"
            f" sum(pos) OVER (PARTITION BY {by}) AS P_, sum(neg) OVER (PARTITION BY {by}) AS N_ FROM st"
            f" WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" w2 AS (PARTITION BY {by} ORDER BY score DESC))")


@register("m1_classification_metrics", cb_sql(PS + counts_sql("ps") + " " + metrics_select()))
def m1(spark, sf_dir):
    return round_doubles(M.classification_metrics(scores(spark, sf_dir)))


@register("m2_confusion_matrix", cb_sql(
    PS + counts_sql("ps") + " SELECT model, 1 AS actual, 1 AS predicted, tp AS n FROM cm UNION ALL"
    " SELECT model, 0, 1, fp FROM cm UNION ALL SELECT model, 1, 0, fn FROM cm UNION ALL SELECT model, 0, 0, tn FROM cm"))
def m2(spark, sf_dir):
    return M.confusion_matrix(scores(spark, sf_dir))


def _report_sql():
    n = "(tp + fp + fn + tn)"
    p1, r1, f1 = D("tp", "tp + fp"), D("tp", "tp + fn"), D("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = D("tn", "tn + fn"), D("tn", "tn + fp"), D("2 * tn", "2 * tn + fn + fp")
    w1, w0 = f"((tp + fn) / {n})", f"((tn + fp) / {n})"
    rows = [("'0'", p0, r0, f0, "tn + fp"), ("'1'", p1, r1, f1, "tp + fn"),
            ("'accuracy'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", D("tp + tn", n), n),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", f"{p0} * {w0} + {p1} * {w1}", f"{r0} * {w0} + {r1} * {w1}",
             f"{f0} * {w0} + {f1} * {w1}", n)]
    return " UNION ALL ".join(
        f"SELECT model, {k} AS class, round({a}, 6) AS precision, round({b}, 6) AS recall, round({c}, 6) AS f1,"
        f" CAST({d} AS BIGINT) AS support FROM cm" for k, a, b, c, d in rows)


@register("m3_classification_report", cb_sql(PS + counts_sql("ps") + " " + _report_sql()))
def m3(spark, sf_dir):
    return round_doubles(M.classification_report(scores(spark, sf_dir)))


@register("m4_roc_curve", cb_sql(
    PS + desc_cum_sql("ps") +
    f" SELECT model, round(score, 6) AS threshold, round({D('cum_neg', 'N_')}, 6) AS fpr,"
    f" round({D('cum_pos', 'P_')}, 6) AS tpr FROM cu WHERE (cum_pos = pos AND cum_neg = neg)"
    " OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"
    " UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM st"))
def m4(spark, sf_dir):
    return round_doubles(M.roc_curve(scores(spark, sf_dir)))


@register("m4_roc_curve_all_points", cb_sql(
    PS + desc_cum_sql("ps") +
    f" SELECT model, round(score, 6) AS threshold, round({D('cum_neg', 'N_')}, 6) AS fpr,"
    f" round({D('cum_pos', 'P_')}, 6) AS tpr FROM cu"
    " UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM st"))
def m4_all(spark, sf_dir):
    return round_doubles(M.roc_curve(scores(spark, sf_dir), drop_intermediate=False))


@register("m5_roc_auc", cb_sql(PS + auc_sql("ps") + " SELECT model, round(auc, 6) AS auc FROM auc_t"))
def m5(spark, sf_dir):
    return round_doubles(M.roc_auc(scores(spark, sf_dir)))


@register("m6_pr_curve", cb_sql(
    PS + desc_cum_sql("ps") +
    f" SELECT model, round(score, 6) AS threshold, round({D('cum_pos', 'cum_pos + cum_neg')}, 6) AS precision,"
    " round(CASE WHEN P_ = 0 THEN 1.0 ELSE CAST(cum_pos AS DOUBLE) / P_ END, 6) AS recall FROM cu"
    " UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM st"))
def m6(spark, sf_dir):
    return round_doubles(M.pr_curve(scores(spark, sf_dir)))


@register("m7_average_precision", cb_sql(
    PS + desc_cum_sql("ps") +
    " SELECT model, round(sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / nullif(sum(pos), 0), 6)"
    " AS average_precision FROM cu GROUP BY model"))
def m7(spark, sf_dir):
    return round_doubles(M.average_precision(scores(spark, sf_dir)))


@register("m8_calibration_curve", cb_sql(
    PS + " SELECT model, CAST(len(list_filter(range(1, 10), lambda i: i * (CAST(1 AS DOUBLE) / 10) < score))"
    " AS INTEGER) AS bin, round(avg(score), 6) AS mean_predicted,"
    " round(avg(CAST(label AS DOUBLE)), 6) AS fraction_positive, count(*) AS n FROM ps"
    " WHERE score IS NOT NULL GROUP BY ALL"))
def m8(spark, sf_dir):
    return round_doubles(M.calibration_curve(scores(spark, sf_dir)))


@register("m9_margin_summary", cb_sql(
    PS + ", mg AS (SELECT model, label, score * 4 - 2 AS m FROM ps)"
    " SELECT model, label, count(*) AS n, CAST(sum(CASE WHEN abs(m) < 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside_margin,"
    " CAST(sum(CASE WHEN (m >= 0) <> (label = 1) THEN 1 ELSE 0 END) AS BIGINT) AS wrong_side,"
    " round(sum(CASE WHEN abs(m) < 1 THEN 1 ELSE 0 END) / count(*), 6) AS inside_share FROM mg GROUP BY model, label"))
def m9(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("score", F.col("score") * 4 - 2)
    return round_doubles(M.margin_summary(s))


@register("m20_model_table", cb_sql(
    PSS + ", te AS (SELECT * FROM pss WHERE split = 'test')" + counts_sql("te") + auc_sql("te") +
    ", mt AS (" + metrics_select() + ")"
    " SELECT mt.*, round(auc_t.auc, 6) AS auc FROM mt LEFT JOIN auc_t USING (model)"))
def m20(spark, sf_dir):
    s = split_scores(spark, sf_dir).filter(F.col("split") == "test")
    return round_doubles(M.model_table(s))


@register("m21_val_test_table", cb_sql(
    PSS + ", te AS (SELECT * FROM pss WHERE split = 'test'), va AS (SELECT * FROM pss WHERE split = 'val')"
    + counts_sql("te") + auc_sql("te") + ", mt AS (" + metrics_select() + ")"
    + auc_sql("va", name="auc_v").replace(", st AS", ", st2 AS").replace("FROM st)", "FROM st2)")
    .replace(", cu AS", ", cu2 AS").replace("FROM cu GROUP", "FROM cu2 GROUP") +
    " SELECT mt.model, round(auc_v.auc, 6) AS val_auc, round(auc_t.auc, 6) AS test_auc,"
    " mt.accuracy AS test_accuracy, mt.precision AS test_precision, mt.recall AS test_recall, mt.f1 AS test_f1"
    " FROM mt LEFT JOIN auc_t USING (model) LEFT JOIN auc_v USING (model)"))
def m21(spark, sf_dir):
    return round_doubles(M.val_test_table(split_scores(spark, sf_dir)))
