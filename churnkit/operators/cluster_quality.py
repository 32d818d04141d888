"""Cluster quality and segments.

Points are rows with numeric feature columns and a ``cluster`` label
(-1 = noise, excluded from the quality metrics). Per-cluster statistics are
one grouped aggregate; the few cluster rows are then packed into one array
that every point reads as a scalar subquery, so no point-by-point pairs and
no cross join are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import attach
from .profile import exact_quantiles


def _vec(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def cluster_stats(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, n, s: per-dimension sums, q: sum of squared norms), noise excluded."""
    cols = list(cols)
    pts = df.filter(F.col(cluster) != -1)
    sq = sum((F.col(f"`{c}`").cast("double") * F.col(f"`{c}`").cast("double") for c in cols), F.lit(0.0))
    g = pts.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.sum(F.col(f"`{c}`").cast("double")).alias(f"_s{i}") for i, c in enumerate(cols)],
                                 F.sum(sq).alias("q"))
    return g.select(F.col(cluster).alias("cluster"), "n",
                    F.array(*[F.col(f"_s{i}") for i in range(len(cols))]).alias("s"), "q")


def silhouette_sqeuclidean(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """M14 (scalable form): mean silhouette with squared Euclidean distance.

    Mean squared distance from x to cluster C is (n_C |x|^2 - 2 x.S_C + Q_C) / n_C,
    so each point needs only the per-cluster (n, S, Q). Own cluster divides by
    n - 1 (self excluded); a singleton cluster scores 0. This is the measure
    Spark's ClusteringEvaluator computes; the Euclidean form needs all pairs.
    """
    cols = list(cols)
    stats = cluster_stats(df, cols, cluster)
    allc = stats.agg(F.collect_list(F.struct("cluster", "n", "s", "q")).alias("cs")).scalar()
    pts = df.filter(F.col(cluster) != -1).select(F.col(cluster).alias("_c"), _vec(cols).alias("x"))
    pts = pts.withColumn("xx", _dot(F.col("x"), F.col("x"))).withColumn("cs", allc)
    tot = lambda c: c["n"] * F.col("xx") - 2 * _dot(F.col("x"), c["s"]) + c["q"]
    own = F.filter("cs", lambda c: c["cluster"] == F.col("_c"))[0]
    others = F.transform(F.filter("cs", lambda c: c["cluster"] != F.col("_c")), lambda c: tot(c) / c["n"])
    a = tot(own) / (own["n"] - 1)
    b = F.array_min(others)
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return pts.agg(F.avg(s).alias("silhouette_sq"))


#: Rows in a block of points, and query rows that meet it at a time.
BLOCK, SLICE = 16384, 4096


def silhouette_euclidean(df: DataFrame, cols: Sequence[str], is_query: Column, cluster: str = "cluster", row_id: str = "row_id") -> DataFrame:
    """M14 (Euclidean form): mean silhouette of the rows that ``is_query`` selects, against all rows, noise excluded.

    Blocks of points meet slices of query rows in grouped tasks; what leaves a task is one sum of distances
    for each query row and cluster. A cluster of one row scores 0; with one cluster the result is null.
    """
    rows = df.where(F.col(cluster) != -1).select(F.col(row_id).alias("id"), F.col(cluster).cast("int").alias("c"), _vec(cols).alias("x"))
    asked = df.where((F.col(cluster) != -1) & is_query).select(F.col(row_id).alias("id"), F.col(cluster).cast("int").alias("c"), _vec(cols).alias("x"))
    blocks, slices = (max(1, -(-part.count() // size)) for part, size in ((rows, BLOCK), (asked, SLICE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))         # noqa: E731
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")        # noqa: E731

    def sums(points: pa.Table, queries: pa.Table) -> pa.Table:
        matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)       # noqa: E731
        out = {"id": [], "c": [], "other": [], "total": [], "n": []}
        if len(points) and len(queries):
            p, q, c = matrix(points), matrix(queries), points["c"].to_numpy()
            kinds, of = np.unique(c, return_inverse=True)
            own = np.eye(len(kinds))[of]
            count = own.sum(axis=0)
            for i in range(0, len(q), 64):
                far = np.sqrt(((q[i:i + 64, None, :] - p[None, :, :]) ** 2).sum(axis=2)) @ own
                k = len(far)
                out["id"] += np.repeat(queries["id"].to_numpy()[i:i + k], len(kinds)).tolist()
                out["c"] += np.repeat(queries["c"].to_numpy()[i:i + k], len(kinds)).tolist()
                out["other"] += np.tile(kinds, k).tolist()
                out["total"] += far.ravel().tolist()
                out["n"] += np.tile(count, k).tolist()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "c": pa.array(out["c"], pa.int32()), "other": pa.array(out["other"], pa.int32()),
                         "total": pa.array(out["total"], pa.float64()), "n": pa.array(out["n"], pa.float64())})

    left = rows.select("id", "c", "x", dealt(blocks).alias("b"), every(slices).alias("s")).groupBy("b", "s")
    right = asked.select("id", "c", "x", every(blocks).alias("b"), dealt(slices).alias("s")).groupBy("b", "s")
    near = left.cogroup(right).applyInArrow(sums, "id long, c int, other int, total double, n double")
    each = near.groupBy("id", "c", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    inside = F.col("c") == F.col("other")
    per = each.groupBy("id").agg(F.max(F.when(inside, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0.0)))).alias("a"), F.max(F.when(inside, F.col("n"))).alias("own"),
                                 F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("own") <= 1, F.lit(0.0)).when(F.greatest("a", "b") == 0, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(s).alias("silhouette"), F.count(s).alias("n_rows"))


def centroids(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    st = cluster_stats(df, cols, cluster)
    return st.select("cluster", "n", F.transform("s", lambda v: v / F.col("n")).alias("mu"))


def davies_bouldin(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of max_{l != k} (S_k + S_l) / |mu_k - mu_l| (Euclidean)."""
    cen = centroids(df, cols, cluster)
    pts = df.filter(F.col(cluster) != -1).select(F.col(cluster).alias("cluster"), _vec(cols).alias("x"))
    scat = (attach(pts, cen.select("cluster", "mu"), ["cluster"])
            .groupBy("cluster").agg(F.avg(F.sqrt(_sqdist(F.col("x"), F.col("mu")))).alias("S"),
                                    F.first("mu").alias("mu")))
    allc = scat.agg(F.collect_list(F.struct("cluster", "S", "mu")).alias("cs")).scalar()
    k = scat.withColumn("cs", allc)
    r = F.transform(F.filter("cs", lambda c: c["cluster"] != F.col("cluster")),
                    lambda c: F.when(F.sqrt(_sqdist(F.col("mu"), c["mu"])) == 0, F.lit(0.0))
                    .otherwise((F.col("S") + c["S"]) / F.sqrt(_sqdist(F.col("mu"), c["mu"]))))
    return k.agg(F.avg(F.array_max(r)).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(B / (K - 1)) / (W / (n - K)); W from distances to the own centroid."""
    cols = list(cols)
    cen = centroids(df, cols, cluster)
    pts = df.filter(F.col(cluster) != -1).select(F.col(cluster).alias("cluster"), _vec(cols).alias("x"))
    w = attach(pts, cen.select("cluster", "mu"), ["cluster"]).agg(F.sum(_sqdist(F.col("x"), F.col("mu"))).alias("W"),
                                     F.count(F.lit(1)).alias("N"))
    mvec = pts.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(cols))]).alias("m")).scalar()
    b = cen.withColumn("_g", mvec).agg(F.sum(F.col("n") * _sqdist(F.col("mu"), F.col("_g"))).alias("B"),
                                       F.count(F.lit(1)).alias("K"))
    j = b.withColumns({"W": w.select("W").scalar(), "N": w.select("N").scalar()})
    ch = F.when(F.col("W") == 0, F.lit(1.0)).otherwise(
        (F.col("B") / (F.col("K") - 1)) / (F.col("W") / (F.col("N") - F.col("K"))))
    return j.select(ch.alias("calinski_harabasz"))


def contingency(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return df.filter(F.col(cluster) != -1).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("nij"))


def adjusted_rand(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """ARI from the contingency table (pair counts as doubles)."""
    ct = contingency(df, cluster, label)
    c2 = lambda x: x * (x - 1) / 2.0
    a = ct.groupBy(cluster).agg(F.sum("nij").alias("a")).agg(F.sum(c2(F.col("a"))).alias("sa"))
    b = ct.groupBy(label).agg(F.sum("nij").alias("b")).agg(F.sum(c2(F.col("b"))).alias("sb"))
    t = ct.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    j = t.withColumns({"sa": a.scalar(), "sb": b.scalar()})
    exp = F.col("sa") * F.col("sb") / c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp))
    return j.select(ari.alias("ari"))


def normalized_mutual_info(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """NMI with the arithmetic-mean normaliser; 1.0 when both sides are one class."""
    ct = contingency(df, cluster, label)
    n = ct.agg(F.sum("nij")).scalar()
    a = ct.groupBy(cluster).agg(F.sum("nij").alias("a"))
    b = ct.groupBy(label).agg(F.sum("nij").alias("b"))
    j = ct.join(a, cluster).join(b, label)
    mi = j.agg(F.sum(F.col("nij") / n * F.log(n * F.col("nij") / (F.col("a") * F.col("b")))).alias("mi"))
    ha = a.agg((-F.sum(F.col("a") / n * F.log(F.col("a") / n))).alias("h"), F.count(F.lit(1)).alias("k"))
    hb = b.agg((-F.sum(F.col("b") / n * F.log(F.col("b") / n))).alias("h"), F.count(F.lit(1)).alias("k"))
    r = mi.withColumns({"ha": ha.select("h").scalar(), "hb": hb.select("h").scalar(),
                        "ka": ha.select("k").scalar(), "kb": hb.select("k").scalar()})
    norm = F.greatest((F.col("ha") + F.col("hb")) / 2, F.lit(float(2.220446049250313e-16)))
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(1.0)).otherwise(F.col("mi") / norm)
    return r.select(nmi.alias("nmi"))


def quality_row(df: DataFrame, cols: Sequence[str], method: str, cluster: str = "cluster",
                label: str = "label") -> DataFrame:
    """Silhouette (squared distances), Davies-Bouldin, Calinski-Harabasz, ARI, NMI, number of clusters."""
    k = df.filter(F.col(cluster) != -1).agg(F.countDistinct(cluster).alias("n_clusters"))
    parts = {
        "silhouette_sq": silhouette_sqeuclidean(df, cols, cluster),
        "davies_bouldin": davies_bouldin(df, cols, cluster),
        "calinski_harabasz": calinski_harabasz(df, cols, cluster),
        "ari": adjusted_rand(df, cluster, label),
        "nmi": normalized_mutual_info(df, cluster, label),
    }
    # Metrics are defined only with at least two clusters.
    row = k.withColumns({name: F.when(F.col("n_clusters") > 1, p.scalar()) for name, p in parts.items()})
    return row.select(F.lit(method).alias("model"), *parts.keys(), "n_clusters")


def compare_methods(rows: Sequence[DataFrame]) -> DataFrame:
    """Union of quality rows, with the best method by silhouette (ties -> name)."""
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    best = u.agg(F.min_by("model", F.struct(-F.col("silhouette_sq"), F.col("model"))).alias("b")).scalar()
    return u.withColumn("is_best", (F.col("model") == best).cast("int"))


def segments(df: DataFrame, cluster: str = "cluster", label: str = "label", tenure: str = "tenure",
             monthly: str = "MonthlyCharges", total: str = "TotalCharges") -> DataFrame:
    """Per cluster (noise skipped) size, %, churn %, averages, risk, advice and value.

    Percentages use all rows (noise included). Value compares the segment's
    average total charges to the exact median of all rows.
    """
    n_all = df.agg(F.count(F.lit(1))).scalar()
    med = exact_quantiles(df, [total], [0.5]).select("q_0").scalar()
    g = df.filter(F.col(cluster) != -1).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("Size"), (F.avg(F.col(label).cast("double")) * 100).alias("Churn_Rate"),
        F.avg(tenure).alias("Avg_Tenure"), F.avg(monthly).alias("Avg_MonthlyCharges"),
        F.avg(total).alias("Avg_TotalCharges"))
    risk = F.when(F.col("Churn_Rate") > 40, "High").when(F.col("Churn_Rate") > 25, "Medium").otherwise("Low")
    # Fixed advice text per risk level (values of the reference).
    advice = (F.when(F.col("Churn_Rate") > 40, "Immediate retention campaign")
              .when(F.col("Churn_Rate") > 25, "Proactive engagement").otherwise("Maintain service quality"))
    value = F.when(F.col("Avg_TotalCharges") > med, "High Value").otherwise("Standard Value")
    return g.select(F.concat(F.lit("Segment_"), F.col(cluster).cast("string")).alias("Segment"), "Size",
                    (F.col("Size") * 100.0 / n_all).alias("Percentage"), "Churn_Rate", "Avg_Tenure",
                    "Avg_MonthlyCharges", "Avg_TotalCharges", risk.alias("Risk_Level"),
                    advice.alias("Recommendation"), value.alias("Value"))

