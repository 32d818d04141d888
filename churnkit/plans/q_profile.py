"""Registered queries: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile as P
from .fixtures import PSEUDO_CLUSTER_SQL, cb_sql, churn_base, pseudo_clusters
from .pipeline import churn_features
from .registry import register, round_doubles
from .sqltext import features_cte, number_sql, q

NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL = ["customerID", "gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
               "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
               "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "Churn"]
VS_CHURN = ["gender", "Contract", "PaymentMethod", "InternetService"]


def eda_table(spark, sf_dir):
    """The EDA view of the raw table: TotalCharges numeric, blanks kept as null."""
    b = churn_base(spark, sf_dir)
    return b.withColumn("TotalCharges", C.to_number("TotalCharges"))


_EDA = f", e AS (SELECT * REPLACE ({number_sql('TotalCharges')} AS TotalCharges) FROM cb)"


def _long_sql(cols, src="e", cast="DOUBLE", name="column", value="value", keep=""):
    k = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS {q(name)}, CAST({q(c)} AS {cast}) AS {value} FROM {src}" for c in cols)


@register("a1_numeric_summary", cb_sql(
    _EDA + ", l AS (" + _long_sql(NUMERIC) + ")"
    " SELECT \"column\", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,"
    " round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,"
    " round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,"
    " round(max(value), 6) AS max FROM l WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY \"column\""))
def a1_numeric_summary(spark, sf_dir):
    return round_doubles(P.numeric_summary(eda_table(spark, sf_dir), NUMERIC))


@register("a2_categorical_summary", cb_sql(
    ", l AS (" + _long_sql(CATEGORICAL, src="cb", cast="VARCHAR") + ")"
    ", vc AS (SELECT \"column\", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)"
    " SELECT \"column\", CAST(sum(n) AS BIGINT) AS count, count(value) AS unique,"
    " first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM vc GROUP BY \"column\""))
def a2_categorical_summary(spark, sf_dir):
    return P.categorical_summary(churn_base(spark, sf_dir), CATEGORICAL)


@register("a3_class_counts", cb_sql("SELECT Churn, count(*) AS n FROM cb GROUP BY Churn"))
def a3_class_counts(spark, sf_dir):
    return churn_base(spark, sf_dir).groupBy("Churn").agg(F.count(F.lit(1)).alias("n"))


@register("a4_churn_by_contract", cb_sql(
    ", l AS (" + _long_sql(VS_CHURN, src="cb", cast="VARCHAR", name="variable", value="level", keep="label") + ")"
    " SELECT variable, level, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_flag,"
    " round(sum(label) / count(*), 6) AS rate FROM l GROUP BY variable, level"))
def a4_churn_by_contract(spark, sf_dir):
    """A4: churn count and rate for every level of gender, Contract, PaymentMethod, InternetService."""
    b = churn_base(spark, sf_dir)
    return round_doubles(P.rate_by(b, VS_CHURN, F.col("Churn") == "Yes").withColumnRenamed("n_flag", "n_flag"))


@register("a4_crosstab_counts", cb_sql(
    ", l AS (" + _long_sql(VS_CHURN, src="cb", cast="VARCHAR", name="variable", value="level", keep="Churn") + ")"
    " SELECT variable, level, Churn, count(*) AS n FROM l GROUP BY ALL"))
def a4_crosstab(spark, sf_dir):
    return P.crosstab_with(churn_base(spark, sf_dir), VS_CHURN, "Churn")


def _hist_sql(xexpr, src, bins, by=None):
    g = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    return (f", x AS (SELECT {g}CAST({xexpr} AS DOUBLE) AS x FROM {src})"
            f", x2 AS (SELECT * FROM x WHERE x IS NOT NULL)"
            f", r AS (SELECT {g}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS mn,"
            f" CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS mx FROM x2"
            f"{' GROUP BY ' + by if by else ''})"
            f", c AS (SELECT {g}CAST(least(floor((x - mn) * (CAST({bins} AS DOUBLE) / (mx - mn))), {bins - 1}) AS INTEGER)"
            f" AS bin, count(*) AS n FROM x2 JOIN r {j} GROUP BY ALL)"
            f", gr AS (SELECT r.*, CAST(i AS INTEGER) AS bin FROM r, range(0, {bins}) t(i))"
            f" SELECT {g}bin, round(mn + bin * ((mx - mn) / {bins}), 6) AS lo,"
            f" round(mn + (bin + 1) * ((mx - mn) / {bins}), 6) AS hi, coalesce(n, 0) AS n"
            f" FROM gr LEFT JOIN c USING ({g}bin)")


@register("a5_tenure_histogram", cb_sql(_hist_sql("tenure", "cb", 30)))
def a5_tenure_histogram(spark, sf_dir):
    return round_doubles(P.histogram(churn_base(spark, sf_dir), "tenure", 30))


@register("a5_charges_histogram_by_churn", cb_sql(_hist_sql("MonthlyCharges", "cb", 30, by="Churn")))
def a5_charges_histogram_by_churn(spark, sf_dir):
    return round_doubles(P.histogram(churn_base(spark, sf_dir), "MonthlyCharges", 30, by=["Churn"]))


def _kde_sql(xexpr, by=None, grid=200, cut=3.0, norm=True, counts_bins=None):
    g = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    tot = "(SELECT count(*) FROM x2)"
    dens = "sum(c * exp(-0.5 * z * z) / (bw * sqrt(2 * pi()))) / any_value(n)"
    if norm and by:
        dens = f"{dens} * any_value(share)"
    if counts_bins:
        dens = f"{dens} * any_value(n) * (any_value(g1) - any_value(g0)) / {counts_bins}"
    return (f", x AS (SELECT {g}CAST({xexpr} AS DOUBLE) AS x FROM cb)"
            f", x2 AS (SELECT * FROM x WHERE x IS NOT NULL AND NOT isnan(x))"
            f", st0 AS (SELECT {g}count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM x2"
            f"{' GROUP BY ' + by if by else ''})"
            f", st AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, n / {tot} AS share FROM st0)"
            f", st2 AS (SELECT *, mn - {cut} * bw AS g0, mx + {cut} * bw AS g1 FROM st)"
            f", vc AS (SELECT {g}x, count(*) AS c FROM x2 GROUP BY ALL)"
            f", e AS (SELECT vc.*, st2.* EXCLUDE ({by + ', ' if by else ''}n, sd, mn, mx), st2.n,"
            f" CAST(i AS INTEGER) AS i, (g0 + i * ((g1 - g0) / {grid - 1}) - x) / bw AS z"
            f" FROM vc JOIN st2 {j}, range(0, {grid}) t(i))"
            f" SELECT {g}i AS point, round(any_value(g0) + i * ((any_value(g1) - any_value(g0)) / {grid - 1}), 6) AS x,"
            f" round({dens}, 6) AS density FROM e GROUP BY {g}i")


@register("a6_charges_kde_by_churn", cb_sql(_kde_sql("MonthlyCharges", by="Churn")))
def a6_charges_kde(spark, sf_dir):
    return round_doubles(P.kde(churn_base(spark, sf_dir), "MonthlyCharges", by=["Churn"]))


@register("a6_tenure_kde_counts", cb_sql(_kde_sql("tenure", cut=0.0, counts_bins=30)))
def a6_tenure_kde(spark, sf_dir):
    return round_doubles(P.kde(churn_base(spark, sf_dir), "tenure", cut=0.0, scale_to_counts_bins=30))


@register("a7_correlation_matrix", cb_sql(
    _EDA + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM e"
        for a in NUMERIC for b in NUMERIC)))
def a7_correlation(spark, sf_dir):
    return round_doubles(P.correlation_matrix(eda_table(spark, sf_dir), NUMERIC))


@register("a8_scatter_projection", cb_sql("SELECT row_id, tenure, MonthlyCharges, Churn FROM cb"))
def a8_scatter(spark, sf_dir):
    return churn_base(spark, sf_dir).select("row_id", "tenure", "MonthlyCharges", "Churn")


_RAW = ["customerID", "row_id", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
        "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
        "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "MonthlyCharges",
        "TotalCharges", "Churn"]


@register("a9_null_counts", cb_sql(
    _EDA + " SELECT CAST(" + " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _RAW)
    + f" AS BIGINT) AS null_cells, count(*) AS n_rows, {len(_RAW)} AS n_cols FROM e"))
def a9_null_counts(spark, sf_dir):
    return P.null_counts(eda_table(spark, sf_dir).select(*_RAW))


def clustered(spark, sf_dir):
    """Train + val rows of the unscaled feature table with pseudo cluster labels."""
    f = churn_features(spark, sf_dir, scale=False).filter(F.col("split").isin("train", "val"))
    return pseudo_clusters(f)


_CL = (features_cte(scale=False) + f", cl AS (SELECT *, {PSEUDO_CLUSTER_SQL} AS cluster FROM sp"
       " WHERE split IN ('train', 'val'))")


@register("a10_cluster_churn", cb_sql(
    _CL + " SELECT cluster, round(avg(CAST(label AS DOUBLE)), 6) AS churn_rate, count(*) AS n FROM cl"
    " GROUP BY cluster HAVING count(*) > 10"))
def a10_cluster_churn(spark, sf_dir):
    return round_doubles(P.cluster_churn(clustered(spark, sf_dir)))


_PROFILE = ["tenure", "MonthlyCharges", "TotalCharges"]


@register("a11_cluster_feature_profile", cb_sql(
    _CL + ", m AS (SELECT cluster, " + ", ".join(f"avg({c}) AS {c}" for c in _PROFILE) + " FROM cl GROUP BY cluster)"
    ", l AS (" + " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, CAST({c} AS DOUBLE) AS mean FROM m"
                                  for c in _PROFILE) + ")"
    " SELECT cluster, feature, round(mean, 6) AS mean, round((mean - min(mean) OVER (PARTITION BY feature)) /"
    " nullif(max(mean) OVER (PARTITION BY feature) - min(mean) OVER (PARTITION BY feature), 0), 6) AS normalized"
    " FROM l"))
def a11_cluster_feature_profile(spark, sf_dir):
    return round_doubles(P.cluster_feature_profile(clustered(spark, sf_dir), _PROFILE))


@register("a12_cluster_profile", cb_sql(
    _CL + " SELECT cluster, count(*) AS size, round(avg(CAST(label AS DOUBLE)) * 100, 6) AS churn_rate, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _PROFILE)
    + ", round(count(*) * 100.0 / (SELECT count(*) FROM cl), 6) AS size_percentage"
    " FROM cl GROUP BY cluster HAVING cluster <> -1"))
def a12_cluster_profile(spark, sf_dir):
    return round_doubles(P.cluster_profile(clustered(spark, sf_dir), means=_PROFILE))
