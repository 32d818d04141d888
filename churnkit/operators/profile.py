"""Profiling aggregates.

Wide-to-long stacking is an ``explode`` followed by a grouped aggregate, so
all columns are profiled in one scan with map-side partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import attach, monotone_bucket, running_totals


def stack(df: DataFrame, cols: Sequence[str], cast: str | None = "double", keep: Sequence[str] = (),
          name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long (keep..., column, value), one output row per input cell."""
    cells = [F.struct(F.lit(c).alias(name), (F.col(f"`{c}`").cast(cast) if cast else F.col(f"`{c}`")).alias(value))
             for c in cols]
    e = df.select(*keep, F.explode(F.array(*cells)).alias("_c"))
    return e.select(*keep, f"_c.{name}", f"_c.{value}")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    n_buckets: int = 64) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/numpy 'linear').

    Values are first reduced to (column, value, count); ranks come from the
    two-level running sum, so no group is collected into one task and memory
    does not grow with the number of distinct values per column.
    Result: (column, q_<i>) with one column per prob.
    """
    long = stack(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(vc, ["column"], ["value"], ["n"], monotone_bucket("value"))
    tot = vc.groupBy("column").agg(F.sum("n").alias("_total"))
    r = attach(r, tot, ["column"])
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("_total") - 1)
        covers = lambda k: (F.col("cum_n") - F.col("n") <= k) & (k < F.col("cum_n"))
        aggs += [F.max(F.when(covers(lo), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(covers(hi), F.col("value"))).alias(f"_hi{i}"),
                 F.first(pos - lo).alias(f"_fr{i}")]
    g = r.groupBy("column").agg(*aggs)
    out = [F.col("column")]
    for i, _ in enumerate(probs):
        a, bb, t = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        out.append(F.when(t >= 0.5, bb - (bb - a) * (1 - t)).otherwise(a + (bb - a) * t).alias(f"q_{i}"))
    return g.select(*out)


def numeric_summary(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """A1: count, mean, std (ddof 1), min, 25/50/75 %, max; one row per column."""
    long = stack(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    probs = [0.25, 0.5, 0.75]
    if exact:
        qs = exact_quantiles(df, cols, probs).toDF("column", "p25", "p50", "p75")
    else:
        qs = long.groupBy("column").agg(F.percentile_approx("value", probs, 10000).alias("_q")) \
            .select("column", *[F.col("_q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])])
    return stats.join(qs, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def categorical_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: count, unique, top (most frequent, ties -> smallest value), freq."""
    vc = (stack(df, cols, cast="string").filter(F.col("value").isNotNull())
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return vc.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("value").alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def crosstab_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """A4: counts of (variable, level, target) for several variables in one pass."""
    long = stack(df, cols, cast="string", keep=[target], name="variable", value="level")
    return long.groupBy("variable", "level", target).agg(F.count(F.lit(1)).alias("n"))


def rate_by(df: DataFrame, cols: Sequence[str], flag) -> DataFrame:
    """A4 as rates: per (variable, level) row count, flagged count and share."""
    long = stack(df.withColumn("_f", flag.cast("int")), cols, cast="string", keep=["_f"],
                 name="variable", value="level")
    return (long.groupBy("variable", "level")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("n_flag"))
            .withColumn("rate", F.col("n_flag") / F.col("n")))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """A5: equal-width bins over [min, max], last bin closed; empty bins kept.

    Output (by..., bin, lo, hi, n). Edges are ``min + i * ((max - min) / bins)``.
    """
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    rng = x.groupBy(*by).agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    rng = rng.select(*by, F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("mn"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("mx"))
    xb = attach(x, rng, by)
    b = F.least(F.floor((F.col("x") - F.col("mn")) * (F.lit(float(bins)) / (F.col("mx") - F.col("mn")))),
                F.lit(bins - 1)).cast("int")
    counts = xb.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("mx") - F.col("mn")) / bins
    out = grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("mn") + F.col("bin") * w).alias("lo"),
        (F.col("mn") + (F.col("bin") + 1) * w).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out


def kde(df: DataFrame, col: str, by: Sequence[str] = (), gridsize: int = 200, cut: float = 3.0,
        common_norm: bool = True, scale_to_counts_bins: int | None = None) -> DataFrame:
    """Gaussian kernel density, Scott bandwidth std * n^(-1/5), on a grid.

    Grid per group from ``min - cut*bw`` to ``max + cut*bw``. With
    ``common_norm`` each group's density is multiplied by its share of rows.
    With ``scale_to_counts_bins`` (histogram overlay) the density is scaled to
    counts: n * bin width. The data are reduced to (group, value, count) first;
    each distinct value then contributes to ``gridsize`` points, summed with a
    partial aggregate, so only gridsize rows per group leave each task.
    """
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                            F.min("x").alias("mn"), F.max("x").alias("mx"))
    total = x.agg(F.count(F.lit(1))).scalar()
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    st = st.withColumn("bw", bw).withColumn("share", F.col("n") / total)
    st = st.withColumn("g0", F.col("mn") - cut * F.col("bw")).withColumn("g1", F.col("mx") + cut * F.col("bw"))
    vc = x.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    j = attach(vc, st, by)
    step = (F.col("g1") - F.col("g0")) / (gridsize - 1)  # same expression for the output x
    pts = F.sequence(F.lit(0), F.lit(gridsize - 1))
    e = j.select(*by, "c", "x", "bw", "n", "share", "g0", "g1", F.explode(pts).alias("i"))
    z = (F.col("g0") + F.col("i") * step - F.col("x")) / F.col("bw")
    contrib = F.col("c") * F.exp(-0.5 * z * z) / (F.col("bw") * math.sqrt(2 * math.pi))
    dens = e.groupBy(*by, "i").agg((F.sum(contrib) / F.first("n")).alias("density"),
                                   F.first("g0").alias("g0"), F.first("g1").alias("g1"),
                                   F.first("share").alias("share"), F.first("n").alias("n"))
    out = dens.withColumn("x", F.col("g0") + F.col("i") * ((F.col("g1") - F.col("g0")) / (gridsize - 1)))
    if common_norm and by:
        out = out.withColumn("density", F.col("density") * F.col("share"))
    if scale_to_counts_bins:
        out = out.withColumn("density", F.col("density") * F.col("n")
                             * (F.col("g1") - F.col("g0")) / scale_to_counts_bins)
    return out.select(*by, F.col("i").alias("point"), "x", "density")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered pair, pairwise-complete, in one aggregate."""
    cols = list(cols)
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Total null cells, rows and columns in one aggregate."""
    cells = [F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return df.agg(total.alias("null_cells"), F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("n_cols", F.lit(len(df.columns)))


def cluster_churn(df: DataFrame, cluster: str = "cluster", label: str = "label", min_size: int = 10) -> DataFrame:
    """A10: churn rate and size per cluster (noise included), size > min_size (HAVING)."""
    return (df.groupBy(cluster).agg(F.avg(F.col(label).cast("double")).alias("churn_rate"),
                                    F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > min_size))


def cluster_feature_profile(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean per cluster, then min-max scaled across clusters (long form).

    The window runs over the per-cluster table (one row per cluster and
    feature), never over input rows.
    """
    means = df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])
    long = stack(means, features, keep=[cluster], name="feature", value="mean")
    w = Window.partitionBy("feature")
    mn, mx = F.min("mean").over(w), F.max("mean").over(w)
    return long.withColumn("normalized", (F.col("mean") - mn) / F.nullif(mx - mn, F.lit(0.0)))


def cluster_profile(df: DataFrame, cluster: str = "cluster", label: str = "label",
                    means: Sequence[str] = ("tenure", "MonthlyCharges", "TotalCharges")) -> DataFrame:
    """Size, % of all rows (noise in the denominator), churn %, feature means; noise row dropped."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"),
                                (F.avg(F.col(label).cast("double")) * 100).alias("churn_rate"),
                                *[F.avg(m).alias(f"mean_{m}") for m in means])
    return (g.filter(F.col(cluster) != -1)
            .withColumn("size_percentage", F.col("size") * 100.0 / total))
