"""Registered queries: ensembles and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as E
from .fixtures import cb_sql
from .q_metrics import D, PS, PSS, auc_sql, counts_sql, metrics_select, scores, split_scores
from .registry import register, round_doubles

MODELS = ["s1", "s2", "s3"]


@register("j3_prediction_matrix", cb_sql(
    PS + " SELECT row_id, label, " + ", ".join(
        f"max(CASE WHEN model = '{m}' THEN prediction END) AS {m}" for m in MODELS) + " FROM ps GROUP BY row_id, label"))
def j3(spark, sf_dir):
    return E.pivot_predictions(scores(spark, sf_dir), MODELS)


@register("e1_soft_vote", cb_sql(
    PS + " SELECT row_id, label, 'Voting Ensemble' AS model, round(avg(score), 6) AS score,"
    " CAST(avg(score) >= 0.5 AS INTEGER) AS prediction FROM ps WHERE score IS NOT NULL GROUP BY row_id, label"))
def e1_soft(spark, sf_dir):
    return round_doubles(E.soft_vote(scores(spark, sf_dir), MODELS))


@register("e1_hard_vote", cb_sql(
    PS + " SELECT row_id, label, 'Hard Voting Ensemble' AS model, CAST(NULL AS DOUBLE) AS score,"
    " CAST(sum(prediction) * 2 > count(*) AS INTEGER) AS prediction FROM ps GROUP BY row_id, label"))
def e1_hard(spark, sf_dir):
    return E.hard_vote(scores(spark, sf_dir), MODELS)


_W = (PSS + ", va AS (SELECT * FROM pss WHERE split = 'val')" + auc_sql("va", name="auc_v") +
      ", w AS (SELECT model, auc / sum(auc) OVER () AS weight FROM auc_v WHERE auc IS NOT NULL)"
      ", wa AS (SELECT row_id, label, 'Weighted Average Ensemble' AS model, sum(weight * score) AS score"
      " FROM pss JOIN w USING (model) WHERE split = 'test' GROUP BY row_id, label)")


def _weighted(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    w = E.auc_weights(s.filter(F.col("split") == "val"))
    return E.weighted_average(s.filter(F.col("split") == "test"), w)


@register("e3_weighted_average", cb_sql(
    _W + " SELECT row_id, label, model, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM wa"))
def e3(spark, sf_dir):
    return round_doubles(_weighted(spark, sf_dir))


@register("e4_agreement_matrix", cb_sql(
    PS + " SELECT a.model AS model_a, b.model AS model_b,"
    " round(avg(CASE WHEN a.prediction = b.prediction THEN 1.0 ELSE 0.0 END), 6) AS agreement"
    " FROM ps a JOIN ps b USING (row_id) GROUP BY ALL"))
def e4(spark, sf_dir):
    return round_doubles(E.agreement_matrix(scores(spark, sf_dir), MODELS))


@register("e4_high_disagreement", cb_sql(
    PS + ", sd AS (SELECT row_id, stddev_samp(CAST(prediction AS DOUBLE)) AS sd FROM ps GROUP BY row_id)"
    " SELECT count(*) AS n_rows, CAST(sum(CASE WHEN sd > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS n_high,"
    " round(avg(CASE WHEN sd > 0.3 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_high FROM sd"))
def e4_high(spark, sf_dir):
    return round_doubles(E.disagreement(scores(spark, sf_dir), MODELS))


def _comparison(spark, sf_dir):
    s = split_scores(spark, sf_dir)
    test = s.filter(F.col("split") == "test").select("row_id", "label", "model", "score", "prediction")
    vote = E.soft_vote(test, MODELS)
    wavg = _weighted(spark, sf_dir)
    return E.comparison_table(test.unionByName(vote).unionByName(wavg))


_CMP = (_W + ", te AS (SELECT row_id, label, model, score, prediction FROM pss WHERE split = 'test')"
        ", vt AS (SELECT row_id, label, 'Voting Ensemble' AS model, avg(score) AS score,"
        " CAST(avg(score) >= 0.5 AS INTEGER) AS prediction FROM te GROUP BY row_id, label)"
        ", al AS (SELECT * FROM te UNION ALL SELECT * FROM vt UNION ALL"
        " SELECT row_id, label, model, score, CAST(score >= 0.5 AS INTEGER) FROM wa)"
        + counts_sql("al") + auc_sql("al", name="auc_a").replace(", st AS", ", st3 AS").replace("FROM st)", "FROM st3)")
        .replace(", cu AS", ", cu3 AS").replace("FROM cu GROUP", "FROM cu3 GROUP") +
        ", mt AS (" + metrics_select() + ")"
        ", cmp AS (SELECT mt.*, round(auc_a.auc, 6) AS auc, CAST(contains(mt.model, 'Ensemble') AS INTEGER) AS is_ensemble"
        " FROM mt LEFT JOIN auc_a USING (model))")


@register("e6_comparison_table", cb_sql(_CMP + " SELECT * FROM cmp"))
def e6(spark, sf_dir):
    return round_doubles(_comparison(spark, sf_dir))


@register("e7_final_report", cb_sql(
    _CMP + ", rnk AS (SELECT *, row_number() OVER (ORDER BY auc DESC NULLS LAST, model) AS rank_,"
    " row_number() OVER (PARTITION BY is_ensemble ORDER BY auc DESC NULLS LAST, model) AS rk_ FROM cmp)"
    " SELECT CASE WHEN is_ensemble = 1 THEN 'best ensemble' ELSE 'best single' END AS section, 1 AS rank,"
    " model, auc, f1, accuracy FROM rnk WHERE rk_ = 1 UNION ALL"
    " SELECT 'top', CAST(rank_ AS INTEGER), model, auc, f1, accuracy FROM rnk WHERE rank_ <= 5"))
def e7(spark, sf_dir):
    return round_doubles(E.final_report(_comparison(spark, sf_dir)))
