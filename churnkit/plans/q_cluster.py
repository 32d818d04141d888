"""Registered queries: cluster quality and segments (M14-M18, C7-C9, C11) on deterministic clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster_quality as Q
from .fixtures import PSEUDO_CLUSTER_SQL, cb_sql, churn_base, pseudo_clusters
from .pipeline import churn_features
from .registry import register, round_doubles
from .sqltext import features_cte

XY = ["x1", "x2"]
CHARGE_CLUSTER_SQL = ("CASE WHEN row_id % 20 = 0 THEN -1 "
                      "ELSE CAST(floor(MonthlyCharges / 40) AS INTEGER) END")


def points(spark, sf_dir):
    """2-D points (tenure/10, MonthlyCharges/10) with label and two clusterings."""
    b = pseudo_clusters(churn_base(spark, sf_dir))
    return b.select("row_id", F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"),
                    (F.col("tenure").cast("double") / 10).alias("x1"), (F.col("MonthlyCharges") / 10).alias("x2"),
                    "cluster",
                    F.when(F.col("row_id") % 20 == 0, F.lit(-1))
                    .otherwise(F.floor(F.col("MonthlyCharges") / 40).cast("int")).alias("cluster_b"))


PT = (f", pt AS (SELECT row_id, label, CAST(tenure AS DOUBLE) / 10 AS x1, MonthlyCharges / 10 AS x2,"
      f" {PSEUDO_CLUSTER_SQL} AS cluster, {CHARGE_CLUSTER_SQL} AS cluster_b FROM cb)")


def v_sql(col="cluster"):
    return f", v AS (SELECT row_id, label, x1, x2, {col} AS cluster FROM pt WHERE {col} <> -1)"


SIL = (", pr AS (SELECT a.row_id, a.cluster AS ca, b.cluster AS cb2,"
       " sum((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d, count(*) AS n"
       " FROM v a JOIN v b ON a.row_id <> b.row_id GROUP BY a.row_id, a.cluster, b.cluster)"
       ", sl AS (SELECT row_id, max(CASE WHEN ca = cb2 THEN d / n END) AS a,"
       " min(CASE WHEN ca <> cb2 THEN d / n END) AS b FROM pr GROUP BY row_id)"
       ", sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq FROM sl)")
CEN = ", cen AS (SELECT cluster, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2 FROM v GROUP BY cluster)"
DB = (CEN + ", sc AS (SELECT cluster, avg(sqrt((x1 - m1) * (x1 - m1) + (x2 - m2) * (x2 - m2))) AS S,"
      " any_value(m1) AS m1, any_value(m2) AS m2 FROM v JOIN cen USING (cluster) GROUP BY cluster)"
      ", rr AS (SELECT a.cluster, max(CASE WHEN sqrt((a.m1 - b.m1) * (a.m1 - b.m1) + (a.m2 - b.m2) * (a.m2 - b.m2)) = 0"
      " THEN 0.0 ELSE (a.S + b.S) / sqrt((a.m1 - b.m1) * (a.m1 - b.m1) + (a.m2 - b.m2) * (a.m2 - b.m2)) END) AS r"
      " FROM sc a JOIN sc b ON a.cluster <> b.cluster GROUP BY a.cluster)"
      ", dbi AS (SELECT avg(r) AS davies_bouldin FROM rr)")
CH = (", ww AS (SELECT sum((x1 - m1) * (x1 - m1) + (x2 - m2) * (x2 - m2)) AS W, count(*) AS N"
      " FROM v JOIN cen USING (cluster))"
      ", gm AS (SELECT avg(x1) AS g1, avg(x2) AS g2 FROM v)"
      ", bb AS (SELECT sum(n * ((m1 - g1) * (m1 - g1) + (m2 - g2) * (m2 - g2))) AS B, count(*) AS K FROM cen, gm)"
      ", chi AS (SELECT CASE WHEN W = 0 THEN 1.0 ELSE (B / (K - 1)) / (W / (N - K)) END AS calinski_harabasz FROM bb, ww)")
CT = ", ct AS (SELECT cluster, label, count(*) AS nij FROM v GROUP BY cluster, label)"
ARI = (CT + ", sa AS (SELECT sum(a * (a - 1) / 2.0) AS sa FROM (SELECT cluster, sum(nij) AS a FROM ct GROUP BY cluster))"
       ", sb AS (SELECT sum(b * (b - 1) / 2.0) AS sb FROM (SELECT label, sum(nij) AS b FROM ct GROUP BY label))"
       ", tt AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM ct)"
       ", arix AS (SELECT CASE WHEN (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0 ELSE"
       " (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) END AS ari FROM tt, sa, sb)")
NMI = (", nn AS (SELECT CAST(sum(nij) AS DOUBLE) AS n FROM ct)"
       ", ca AS (SELECT cluster, sum(nij) AS a FROM ct GROUP BY cluster)"
       ", cbb AS (SELECT label, sum(nij) AS b FROM ct GROUP BY label)"
       ", mi AS (SELECT sum(nij / n * ln(n * nij / (a * b))) AS mi FROM ct JOIN ca USING (cluster) JOIN cbb USING (label), nn)"
       ", ha AS (SELECT -sum(a / n * ln(a / n)) AS h, count(*) AS k FROM ca, nn)"
       ", hb AS (SELECT -sum(b / n * ln(b / n)) AS h, count(*) AS k FROM cbb, nn)"
       ", nmix AS (SELECT CASE WHEN ha.k = 1 AND hb.k = 1 THEN 1.0 ELSE mi / greatest((ha.h + hb.h) / 2, 2.220446049250313e-16)"
       " END AS nmi FROM mi, ha, hb)")


@register("m14_silhouette_sqeuclidean", cb_sql(PT + v_sql() + SIL + " SELECT round(silhouette_sq, 6) AS silhouette_sq FROM sil"))
def m14(spark, sf_dir):
    return round_doubles(Q.silhouette_sqeuclidean(points(spark, sf_dir), XY))


@register("m15_davies_bouldin", cb_sql(PT + v_sql() + DB + " SELECT round(davies_bouldin, 6) AS davies_bouldin FROM dbi"))
def m15(spark, sf_dir):
    return round_doubles(Q.davies_bouldin(points(spark, sf_dir), XY))


@register("m16_calinski_harabasz", cb_sql(
    PT + v_sql() + CEN + CH + " SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM chi"))
def m16(spark, sf_dir):
    return round_doubles(Q.calinski_harabasz(points(spark, sf_dir), XY))


@register("m17_adjusted_rand", cb_sql(PT + v_sql() + ARI + " SELECT round(ari, 6) AS ari FROM arix"))
def m17(spark, sf_dir):
    return round_doubles(Q.adjusted_rand(points(spark, sf_dir)))


@register("m18_normalized_mutual_info", cb_sql(PT + v_sql() + CT + NMI + " SELECT round(nmi, 6) AS nmi FROM nmix"))
def m18(spark, sf_dir):
    return round_doubles(Q.normalized_mutual_info(points(spark, sf_dir)))


def _quality_sql(col, name):
    body = v_sql(col) + SIL + DB + CH + ARI + NMI
    return (body + f", q_{name} AS (SELECT '{name}' AS model, round(silhouette_sq, 6) AS silhouette_sq,"
            " round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 6) AS calinski_harabasz,"
            " round(ari, 6) AS ari, round(nmi, 6) AS nmi, (SELECT count(DISTINCT cluster) FROM v) AS n_clusters"
            " FROM sil, dbi, chi, arix, nmix)")


@register("c7_quality_row", cb_sql(PT + _quality_sql("cluster", "tenure_bands") + " SELECT * FROM q_tenure_bands"))
def c7(spark, sf_dir):
    return round_doubles(Q.quality_row(points(spark, sf_dir), XY, "tenure_bands"))


def _quality_sub(col, name):
    """The quality row as a self-contained subquery (its CTE names stay local)."""
    return f"(WITH {_quality_sql(col, name)[2:]} SELECT * FROM q_{name})"


@register("c8_compare_methods", cb_sql(
    PT + ", u AS (SELECT * FROM " + _quality_sub("cluster", "tenure_bands") + " UNION ALL SELECT * FROM "
    + _quality_sub("cluster_b", "charge_bands") + ")"
    " SELECT u.*, CAST(model = (SELECT first(model ORDER BY silhouette_sq DESC, model) FROM u) AS INTEGER) AS is_best FROM u"))
def c8(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = [Q.quality_row(p, XY, "tenure_bands"),
            Q.quality_row(p.withColumn("cluster", F.col("cluster_b")), XY, "charge_bands")]
    return round_doubles(Q.compare_methods(rows))


_SEG = (features_cte(scale=False) + f", cl AS (SELECT *, {PSEUDO_CLUSTER_SQL} AS cluster FROM sp"
        " WHERE split IN ('train', 'val'))"
        ", med AS (SELECT quantile_cont(TotalCharges, 0.5) AS m FROM cl)"
        ", g AS (SELECT cluster, count(*) AS Size, avg(CAST(label AS DOUBLE)) * 100 AS Churn_Rate,"
        " avg(tenure) AS Avg_Tenure, avg(MonthlyCharges) AS Avg_MonthlyCharges, avg(TotalCharges) AS Avg_TotalCharges"
        " FROM cl WHERE cluster <> -1 GROUP BY cluster)")


@register("c9_customer_segments", cb_sql(
    _SEG + " SELECT 'Segment_' || CAST(cluster AS VARCHAR) AS Segment, Size,"
    " round(Size * 100.0 / (SELECT count(*) FROM cl), 6) AS Percentage, round(Churn_Rate, 6) AS Churn_Rate,"
    " round(Avg_Tenure, 6) AS Avg_Tenure, round(Avg_MonthlyCharges, 6) AS Avg_MonthlyCharges,"
    " round(Avg_TotalCharges, 6) AS Avg_TotalCharges,"
    " CASE WHEN Churn_Rate > 40 THEN 'High' WHEN Churn_Rate > 25 THEN 'Medium' ELSE 'Low' END AS Risk_Level,"
    " CASE WHEN Churn_Rate > 40 THEN 'Immediate retention campaign' WHEN Churn_Rate > 25 THEN 'Proactive engagement'"
    " ELSE 'Maintain service quality' END AS Recommendation,"
    " CASE WHEN Avg_TotalCharges > (SELECT m FROM med) THEN 'High Value' ELSE 'Standard Value' END AS Value FROM g"))
def c9(spark, sf_dir):
    f = churn_features(spark, sf_dir, scale=False).filter(F.col("split").isin("train", "val"))
    return round_doubles(Q.segments(pseudo_clusters(f)))


@register("c11_assignments", cb_sql(
    PT + " SELECT row_id, 'tenure_bands' AS method, cluster FROM pt UNION ALL"
    " SELECT row_id, 'charge_bands', cluster_b FROM pt"))
def c11(spark, sf_dir):
    p = points(spark, sf_dir)
    return (p.select("row_id", F.lit("tenure_bands").alias("method"), "cluster")
            .unionByName(p.select("row_id", F.lit("charge_bands").alias("method"), F.col("cluster_b").alias("cluster"))))


@register("m14_silhouette_euclidean", cb_sql(
    PT + v_sql() +
    ", pr AS (SELECT a.row_id, a.cluster AS ca, b.cluster AS cb2, sum(sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))) AS d, count(*) AS n"
    " FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.row_id % 100 = 1 GROUP BY a.row_id, a.cluster, b.cluster)"
    ", sl AS (SELECT row_id, max(CASE WHEN ca = cb2 THEN d / n END) AS a, min(CASE WHEN ca <> cb2 THEN d / n END) AS b FROM pr GROUP BY row_id)"
    " SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(b) AS n_rows FROM sl"))
def m14_euclidean(spark, sf_dir):
    """Euclidean silhouette of every hundredth row (row_id mod 100 = 1; multiples of 100 are noise here) against all rows."""
    return round_doubles(Q.silhouette_euclidean(points(spark, sf_dir), XY, F.col("row_id") % 100 == 1))


@register("c3_dbscan", cb_sql(
    PT + ", nb AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM pt a JOIN pt b"
    " ON (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= 0.25 * 0.25)"
    ", core AS MATERIALIZED (SELECT a FROM nb GROUP BY a HAVING count(*) >= 5)"
    ", e AS MATERIALIZED (SELECT nb.a, nb.b FROM nb JOIN core ca ON nb.a = ca.a JOIN core cb3 ON nb.b = cb3.a)"
    ", lab AS MATERIALIZED (WITH RECURSIVE r AS (SELECT a AS node, a AS l FROM core UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.node AND r.l < e.b)"
    " SELECT node, min(l) AS l FROM r GROUP BY node)"
    ", num AS (SELECT l, CAST(row_number() OVER (ORDER BY l) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT l FROM lab))"
    ", nodes AS (SELECT node, cluster FROM lab JOIN num USING (l))"
    ", bo AS (SELECT nb.a, min(cluster) AS cluster FROM nb JOIN nodes ON nb.b = node GROUP BY nb.a)"
    " SELECT row_id, coalesce(nodes.cluster, bo.cluster, -1) AS cluster, CAST(nodes.cluster IS NOT NULL AS INTEGER) AS is_core"
    " FROM pt LEFT JOIN nodes ON row_id = node LEFT JOIN bo ON row_id = bo.a"))
def c3_dbscan(spark, sf_dir):
    """C3 on the 2-D points: eps 0.25, five rows make a core."""
    from ..operators.dbscan import dbscan
    return dbscan(points(spark, sf_dir), XY, 0.25, 5)
