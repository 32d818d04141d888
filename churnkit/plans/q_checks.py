"""Registered queries: files written and read back (IO1, IO2, IO4, IO6) and closed forms of fits."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators.linear_many import Problem, fit_many, polynomial
from ..operators.panel import train_blocks
from ..operators.profile import histogram
from ..operators.tuning import isotonic_curve
from ..session import ensure_checkpoint_dir
from ..sources import tables as T
from .fixtures import cb_sql, churn_base
from .pipeline import churn_features, with_vector
from .registry import register, round_doubles
from .sqltext import features_cte

RAW = [f.name for f in T.RAW_SCHEMA.fields]


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("io1_csv_round_trip", cb_sql("SELECT " + ", ".join(RAW) + " FROM cb"))
def io1_csv(spark, sf_dir):
    """IO1: the base table as a headed CSV file, read with the declared schema; blanks of TotalCharges survive."""
    path = _folder(spark, "csv")
    churn_base(spark, sf_dir).select(*RAW).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return T.read_csv(spark, path)


@register("io2_folder_stack", cb_sql(
    "SELECT row_id, tenure, CASE WHEN row_id % 3 <> 1 THEN Contract END AS Contract, CASE WHEN row_id % 3 = 2 THEN Churn END AS Churn FROM cb"))
def io2_folder(spark, sf_dir):
    """IO2: three files of different columns in one folder, stacked by name."""
    path = _folder(spark, "folder")
    base = churn_base(spark, sf_dir)
    for k, cols in enumerate((["row_id", "tenure", "Contract"], ["tenure", "row_id"], ["row_id", "Churn", "tenure", "Contract"])):
        part = base.where(F.col("row_id") % 3 == k).select(*cols).coalesce(1)
        part.write.option("header", True).mode("append").csv(path)
    out = T.read_folder(spark, path, "csv")
    return out.select(F.col("row_id").cast("long").alias("row_id"), F.col("tenure").cast("int").alias("tenure"), "Contract", "Churn")


@register("io4_split_round_trip", cb_sql(features_cte(scale=False) + " SELECT row_id, label, split, tenure, round(MonthlyCharges, 6) AS MonthlyCharges FROM sp"))
def io4_split(spark, sf_dir):
    """IO4: the split table, one directory per split, read back."""
    path = _folder(spark, "split")
    T.write_split(churn_features(spark, sf_dir, scale=False).select("row_id", "label", "split", "tenure", "MonthlyCharges"), path)
    return round_doubles(spark.read.parquet(path).select("row_id", "label", "split", "tenure", "MonthlyCharges"))


@register("io6_result_round_trip", cb_sql("SELECT Contract, label, count(*) AS n, round(avg(MonthlyCharges), 6) AS mean_charges FROM cb GROUP BY Contract, label"))
def io6_result(spark, sf_dir):
    """IO6: a result table as CSV, read back."""
    path = _folder(spark, "result")
    b = churn_base(spark, sf_dir).withColumn("label", F.when(F.col("Churn") == "Yes", 1).otherwise(0))
    T.write_result(b.groupBy("Contract", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("MonthlyCharges").alias("mean_charges")), path)
    return round_doubles(spark.read.option("header", True).schema("Contract string, label int, n long, mean_charges double").csv(path))


@register("m9_margin_histogram", cb_sql(
    ", x AS (SELECT label, (MonthlyCharges / 120 - 0.5) * 4 AS x FROM cb), rng AS (SELECT label, min(x) AS mn, max(x) AS mx FROM x GROUP BY label)"
    ", b AS (SELECT x.label, CAST(least(floor((x - mn) * (30.0::DOUBLE / (mx - mn))), 29) AS INTEGER) AS bin, count(*) AS n FROM x JOIN rng USING (label) GROUP BY ALL)"
    ", g AS (SELECT label, mn, mx, CAST(unnest(range(30)) AS INTEGER) AS bin FROM rng)"
    " SELECT label, bin, round(mn + bin * ((mx - mn) / 30), 6) AS lo, round(mn + (bin + 1) * ((mx - mn) / 30), 6) AS hi, coalesce(n, 0) AS n"
    " FROM g LEFT JOIN b USING (label, bin)"))
def m9_histogram(spark, sf_dir):
    """M9: 30-bin histogram of a decision value by class."""
    b = churn_base(spark, sf_dir).select(F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"), ((F.col("MonthlyCharges") / 120 - 0.5) * 4).alias("margin"))
    return round_doubles(histogram(b, "margin", 30, ["label"]))


def _two(spark, sf_dir, *cols):
    f = churn_features(spark, sf_dir, scale=False)
    return with_vector(f.select("row_id", "label", "split", *[F.col(c).cast("double").alias(c) for c in cols]), cols)


_TERMS = {"a": "x", "b": "z", "aa": "x * x", "ab": "x * z", "bb": "z * z"}


@register("f3_polynomial_terms", cb_sql(
    features_cte(scale=False) + ", d AS (SELECT CAST(tenure AS DOUBLE) AS x, MonthlyCharges AS z FROM sp WHERE split = 'train')" +
    " UNION ALL ".join(f" SELECT '{n}' AS term, round(avg({e}), 4) AS mean, round(stddev_pop({e}), 4) AS std FROM d" for n, e in _TERMS.items())))
def f3_terms(spark, sf_dir):
    """the terms of degree two and the mean and population std that standardise them."""
    blocks = train_blocks(_two(spark, sf_dir, "tenure", "MonthlyCharges"))
    terms, _ = polynomial(blocks, 2)
    blocks.close()
    rows = [(n, round(float(m), 4), round(float(s), 4)) for n, m, s in zip(_TERMS, terms.mean, terms.std, strict=True)]
    return spark.createDataFrame(rows, "term string, mean double, std double")


@register("l2_l1_large_penalty", cb_sql(
    features_cte(scale=False) + " SELECT 0.0::DOUBLE AS coef, round(ln(p / (1 - p)), 5) AS intercept FROM (SELECT avg(CAST(label AS DOUBLE)) AS p FROM sp WHERE split = 'train')"))
def l2_large_penalty(spark, sf_dir):
    """L2 under a very large L1 penalty: no weight is left, the intercept is the logit of the class share."""
    blocks = train_blocks(_two(spark, sf_dir, "tenure", "MonthlyCharges"))
    fit = fit_many(blocks, [Problem("l1", C=1e-9, l1_ratio=1.0)])[0]
    blocks.close()
    return spark.createDataFrame([(float(abs(fit.weights).max()), round(fit.intercept, 5))], "coef double, intercept double")


@register("l12_adaboost_first_round", cb_sql(
    features_cte(scale=False) +
    ", d AS (SELECT CAST(ServiceCount AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM sp WHERE split = 'train')"
    ", v AS (SELECT DISTINCT x FROM d), t AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2.0 AS t FROM v)"
    ", s AS (SELECT t, count(*) FILTER (WHERE x <= t) AS nl, sum(y) FILTER (WHERE x <= t) AS sl,"
    " count(*) FILTER (WHERE x > t) AS nr, sum(y) FILTER (WHERE x > t) AS sr FROM t, d WHERE t IS NOT NULL GROUP BY t)"
    ", g AS (SELECT * FROM s ORDER BY sl * sl / nl + sr * sr / nr DESC, t LIMIT 1)"
    ", e AS (SELECT (CASE WHEN 2 * sl >= nl THEN nl - sl ELSE sl END + CASE WHEN 2 * sr >= nr THEN nr - sr ELSE sr END) / (nl + nr) AS e FROM g)"
    " SELECT round(e, 6) AS error, round(ln((1 - e) / e), 6) AS alpha FROM e"))
def l12_first_round(spark, sf_dir):
    """L12, one round on one feature: the stump's error and its weight."""
    f = _two(spark, sf_dir, "ServiceCount")
    stumps, _ = MD.adaboost(f, rounds=1)
    alpha = stumps[0][1]
    return spark.createDataFrame([(round(1 / (1 + math.exp(alpha)), 6), round(alpha, 6))], "error double, alpha double")


@register("e5_isotonic_bins", cb_sql(
    ", p AS (SELECT CAST(tenure % 12 AS DOUBLE) AS score, avg(CAST(label AS DOUBLE)) AS y, count(*) AS w FROM cb GROUP BY tenure % 12)"
    ", m AS (SELECT a.score AS lo, b.score AS hi, sum(c.y * c.w) / sum(c.w) AS mean FROM p a JOIN p b ON a.score <= b.score"
    " JOIN p c ON c.score BETWEEN a.score AND b.score GROUP BY a.score, b.score)"
    ", n AS (SELECT p.score, m.lo, min(m.mean) AS least FROM p JOIN m ON m.lo <= p.score AND m.hi >= p.score GROUP BY p.score, m.lo)"
    " SELECT score, round(max(least), 6) AS calibrated FROM n GROUP BY score"))
def e5_bins(spark, sf_dir):
    """E5: the isotonic curve over binned scores, by the max-min formula in SQL."""
    b = churn_base(spark, sf_dir).select((F.col("tenure") % 12).cast("double").alias("score"), F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"))
    curve = isotonic_curve(b)
    return round_doubles(curve.transform(b.select("score").distinct()).select("score", F.col("cal_score").alias("calibrated")))
