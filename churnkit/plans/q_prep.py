"""Registered queries: sources, projections, split, scaling (IO*, P*, W*, T*, F*, U1, J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.prep import clean, encode, feature_columns
from ..operators.scale import minmax
from ..operators.split import growing_prefixes, hash_sample, stratified_folds
from ..operators.ordered import dense_index
from .fixtures import PSEUDO_SCORES_SQL, cb_sql, churn_base, pseudo_scores
from .pipeline import churn_features, scaled_columns
from .registry import register, round_doubles
from .sqltext import encoded_cte, feature_select, features_cte, number_sql, q

RAW_COLS = ("customerID, row_id, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, "
            "MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, "
            "StreamingTV, StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, "
            "TotalCharges, Churn")


@register("io1_churn_base", cb_sql(f"SELECT {RAW_COLS} FROM cb"))
def io1_churn_base(spark, sf_dir):
    return churn_base(spark, sf_dir)


@register("p1_total_charges_numeric", cb_sql(
    f"SELECT row_id, TotalCharges AS raw_text, {number_sql('TotalCharges')} AS parsed, "
    f"coalesce({number_sql('TotalCharges')}, 0.0) AS filled FROM cb"))
def p1_total_charges(spark, sf_dir):
    b = churn_base(spark, sf_dir)
    return round_doubles(b.select("row_id", F.col("TotalCharges").alias("raw_text"),
                                  C.to_number("TotalCharges").alias("parsed"),
                                  F.coalesce(C.to_number("TotalCharges"), F.lit(0.0)).alias("filled")))


_ENC_COLS = ("row_id, label, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, "
             "MultipleLines, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, "
             "StreamingMovies, PaperlessBilling, MonthlyCharges, round(TotalCharges, 6) AS TotalCharges, "
             '"InternetService_DSL", "InternetService_Fiber optic", "InternetService_No", '
             '"Contract_Month-to-month", "Contract_One year", "Contract_Two year", '
             '"PaymentMethod_Bank transfer (automatic)", "PaymentMethod_Credit card (automatic)", '
             '"PaymentMethod_Electronic check", "PaymentMethod_Mailed check"')


@register("p4_p11_encoded", cb_sql(encoded_cte() + " SELECT " + _ENC_COLS
                                   + ', round("AvgChargePerMonth", 6) AS "AvgChargePerMonth"'
                                   + ', round("ChargeDifference", 6) AS "ChargeDifference"'
                                   + ', "TenureGroup_0-1yr", "TenureGroup_1-2yr", "TenureGroup_2-4yr"'
                                   + ', "TenureGroup_4-6yr", "ServiceCount", "HasBothServices" FROM der'))
def p4_p11_encoded(spark, sf_dir):
    """P2-P11 in one projection: recodes, dummies, derived columns, unscaled."""
    from ..operators.prep import encoded
    e = encoded(churn_base(spark, sf_dir))
    return round_doubles(e.select("row_id", "label", *feature_columns()))


@register("f2_feature_table", cb_sql(features_cte() + " SELECT row_id, label, split, "
                                     + feature_select() + " FROM fs"))
def f2_feature_table(spark, sf_dir):
    """F1+F2+W1: the whole preprocessing chain, scaled on the train rows."""
    return round_doubles(churn_features(spark, sf_dir))


@register("w1_split_counts", cb_sql(features_cte(scale=False) +
                                    " SELECT split, label, count(*) AS n FROM sp GROUP BY split, label"))
def w1_split_counts(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False)
    return f.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("w2_stratified_folds", cb_sql(
    features_cte(scale=False) +
    " SELECT row_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || '-42'),"
    " row_id) - 1 AS INTEGER) AS fold FROM sp WHERE split = 'train'"))
def w2_stratified_folds(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False).filter(F.col("split") == "train")
    return stratified_folds(f.select("row_id", "label"), "label", k=5, seed=42)


@register("t4_hash_sample", cb_sql(
    "SELECT row_id, label, tenure FROM cb ORDER BY md5(CAST(row_id AS VARCHAR) || '-7'), row_id LIMIT 200"))
def t4_hash_sample(spark, sf_dir):
    b = churn_base(spark, sf_dir).withColumn("label", C.indicator(F.col("Churn") == "Yes"))
    return hash_sample(b.select("row_id", "label", "tenure"), 200, seed=7)


@register("t5_growing_prefixes", cb_sql(
    features_cte(scale=False) +
    ", tr AS (SELECT row_id, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || '-42'), row_id) AS r,"
    " count(*) OVER () AS n FROM sp WHERE split = 'train')"
    ", fr AS (SELECT i, CAST(i AS DOUBLE) / 10 AS fraction FROM range(1, 11) t(i))"
    " SELECT fraction, count(*) AS n_rows, sum(row_id) AS key_sum FROM tr JOIN fr ON r <= (n * i) // 10"
    " GROUP BY fraction"))
def t5_growing_prefixes(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False).filter(F.col("split") == "train")
    p = growing_prefixes(f.select("row_id"), seed=42)
    return p.groupBy("fraction").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("key_sum"))


@register("p9_p11_tenure_bands", cb_sql(
    "SELECT tenure, CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-1yr' WHEN tenure > 12 AND tenure <= 24 "
    "THEN '1-2yr' WHEN tenure > 24 AND tenure <= 48 THEN '2-4yr' WHEN tenure > 48 AND tenure <= 72 THEN '4-6yr' "
    "END AS band, count(*) AS n FROM cb GROUP BY ALL"))
def p9_tenure_bands(spark, sf_dir):
    b = churn_base(spark, sf_dir)
    return b.groupBy("tenure", C.tenure_band("tenure").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("p12_p15_score_filters", cb_sql(
    ", ps AS (" + PSEUDO_SCORES_SQL + ")"
    ", mm AS (SELECT model, min(score) AS mn, max(score) AS mx FROM ps GROUP BY model)"
    " SELECT ps.row_id, ps.model, round(1 / (1 + exp(-(score * 4 - 2))), 6) AS sig,"
    " round((score - mn) / nullif(mx - mn, 0), 6) AS scaled, CAST(score >= 0.5 AS INTEGER) AS pred"
    " FROM ps JOIN mm USING (model) WHERE label = 1 AND score > 0.1"))
def p12_p15(spark, sf_dir):
    """P12 filter, P13 sigmoid, P14 min-max per model, P15 threshold."""
    b = churn_base(spark, sf_dir)
    s = minmax(pseudo_scores(b), "score", "scaled", by=["model"])
    s = s.filter((F.col("label") == 1) & (F.col("score") > 0.1))
    return round_doubles(s.select("row_id", "model", C.sigmoid(F.col("score") * 4 - 2).alias("sig"),
                                  "scaled", C.threshold("score").alias("pred")))


@register("p16_model_names", cb_sql(
    ", names AS (SELECT DISTINCT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'random_forest.pkl'"
    " WHEN 'MACHINERY' THEN 'weighted_average_ensemble.pkl' WHEN 'BUILDING' THEN 'logistic_regression.pkl'"
    " WHEN 'AUTOMOBILE' THEN 'x_g_boost.pkl' ELSE 'voting_ensemble.pkl' END AS file FROM customer)"
    " SELECT file, pretty, lower(pretty) AS low, CAST(contains(pretty, 'Ensemble') AS INTEGER) AS is_ensemble,"
    " substring(pretty, 1, 10) AS short FROM (SELECT file, "
    " array_to_string(list_transform(string_split(replace(replace(file, '.pkl', ''), '_', ' '), ' '),"
    " lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS pretty FROM names)"))
def p16_model_names(spark, sf_dir):
    from ..sources.tables import read_table
    c = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    file = (F.when(seg == "HOUSEHOLD", "random_forest.pkl").when(seg == "MACHINERY", "weighted_average_ensemble.pkl")
            .when(seg == "BUILDING", "logistic_regression.pkl").when(seg == "AUTOMOBILE", "x_g_boost.pkl")
            .otherwise("voting_ensemble.pkl"))
    n = c.select(file.alias("file")).distinct().withColumn("pretty", C.pretty_name("file"))
    return n.select("file", "pretty", F.lower("pretty").alias("low"),
                    F.col("pretty").contains("Ensemble").cast("int").alias("is_ensemble"),
                    F.substring("pretty", 1, 10).alias("short"))


@register("p18_dense_index", cb_sql(
    "SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS idx FROM cb"))
def p18_dense_index(spark, sf_dir):
    b = churn_base(spark, sf_dir).select("row_id")
    return dense_index(b, "row_id", "idx")


@register("u1_train_val_union", cb_sql(
    features_cte(scale=False) + " SELECT split, count(*) AS n, sum(row_id) AS key_sum FROM "
    "(SELECT row_id, split FROM sp WHERE split = 'train' UNION ALL SELECT row_id, split FROM sp WHERE split = 'val')"
    " GROUP BY split"))
def u1_union(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False)
    u = (f.filter(F.col("split") == "train").select("row_id", "split")
         .unionByName(f.filter(F.col("split") == "val").select("row_id", "split")))
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum"))
