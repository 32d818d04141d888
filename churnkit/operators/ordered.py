"""Running sums in a global order without a one-task window.

A window ``OVER (PARTITION BY g ORDER BY x)`` puts every row of group ``g``
into one task. Here the order is cut into buckets that are monotone in
``x``: level 1 sums each bucket (a partial/final aggregate), level 2 turns
the small bucket table into offsets, and the final window runs per
``(g, bucket)`` in parallel. The result equals the one-window result exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of a per-group aggregate (one row per group) without moving ``df``.

    The aggregate becomes one map, read as a scalar subquery, so the rows of a
    group with a third of all rows stay where they are. Meant for groups that
    are few by nature (models, classes, clusters, columns); rows whose group is
    missing are dropped, as in an inner join.
    """
    by = list(by)
    values = [c for c in small.columns if c not in by]
    if not by:
        return df.withColumns({c: small.select(c).scalar() for c in values})
    entry = F.struct(F.struct(*by).alias("k"), F.struct(*values).alias("v"))
    table = small.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    out = df.withColumn("_group", F.element_at(table, F.struct(*[F.col(c).alias(c) for c in by])))
    return out.where(F.col("_group").isNotNull()).withColumns({c: F.col("_group")[c] for c in values}).drop("_group")


def quantile_bucket(df: DataFrame, by: Sequence[str], col: str, n_buckets: int = 64,
                    accuracy: int = 10000) -> DataFrame:
    """Adds ``_qbk`` = number of approximate quantile cuts of ``col`` below the value.

    The cuts only decide the work split, never the result: any cuts give a
    bucket that is monotone in ``col``.
    """
    by = list(by)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(col, probs, accuracy).alias("_qb"))
    d = attach(df, cuts, by)
    return d.withColumn("_qbk", F.size(F.filter("_qb", lambda q: q < F.col(col)))).drop("_qb")


def monotone_bucket(c, sub_bits: int = 8) -> Column:
    """Data-independent bucket that never decreases as the value grows.

    Positive x: binary exponent e = floor(log2 x) and the top ``sub_bits`` bits
    of the mantissa; negatives mirror it; zero sits in between. Clamping the
    mantissa part keeps the key monotone even where log2 rounds at a power
    of two. No pass over the data is needed to find the cuts.
    """
    x = F.col(c) if isinstance(c, str) else c
    k = 1 << sub_bits

    def pos_key(v):
        e = F.floor(F.log2(v))
        frac = F.floor((v / F.pow(F.lit(2.0), e) - 1.0) * k)
        return (e + 1100) * k + F.least(F.greatest(frac, F.lit(0)), F.lit(k - 1))
    return (F.when(x > 0, pos_key(x) + 1).when(x < 0, -pos_key(-x) - 1).otherwise(F.lit(0))).cast("long")


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str],
                   bucket: Column, descending: bool = False, with_next: bool = False) -> DataFrame:
    """Adds ``cum_<v>``: inclusive running sum of ``v`` within ``by`` in ``order``.

    ``order`` must be unique within ``by`` (pre-aggregate ties, or add the key).
    ``bucket`` must be non-decreasing in ``order``. With ``with_next`` also adds
    ``next_<v>``: ``v`` of the following row (null after the last row).
    """
    by, order, values = list(by), list(order), list(values)
    d = df.withColumn("_bk", bucket)
    ostruct = F.struct(*[F.col(c) for c in order])
    aggs = [F.sum(v).alias(f"_t_{v}") for v in values]
    if with_next:
        vstruct = F.struct(*[F.col(v).alias(v) for v in values])
        first = F.max_by(vstruct, ostruct) if descending else F.min_by(vstruct, ostruct)
        aggs.append(first.alias("_first"))
    bt = d.groupBy(*by, "_bk").agg(*aggs)
    bo = F.col("_bk").desc() if descending else F.col("_bk").asc()
    wb = Window.partitionBy(*by).orderBy(bo)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    sel = [*by, "_bk"] + [F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                          for v in values]
    if with_next:
        sel.append(F.lead("_first").over(wb).alias("_nf"))
    offsets = bt.select(*sel)
    # offsets has one row per (group, bucket): AQE broadcasts it when small.
    j = d.join(offsets, [*by, "_bk"])
    ords = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w = Window.partitionBy(*by, "_bk").orderBy(*ords)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = [(F.col(f"_o_{v}") + F.sum(v).over(upto)).alias(f"cum_{v}") for v in values]
    if with_next:
        extra += [F.coalesce(F.lead(v).over(w), F.col(f"_nf.{v}")).alias(f"next_{v}") for v in values]
    out = j.select("*", *extra)
    return out.drop("_bk", *[f"_o_{v}" for v in values], *(["_nf"] if with_next else []))


def dense_index(df: DataFrame, key: str, name: str = "index", n_buckets: int = 64) -> DataFrame:
    """0..n-1 in key order, computed in parallel (no single-task row_number)."""
    d = df.withColumn("_one", F.lit(1))
    r = running_totals(d, [], [key], ["_one"], monotone_bucket(F.col(key).cast("double")))
    return r.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one")
