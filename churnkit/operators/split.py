"""Stratified exact split, folds, samples and growing prefixes.

Order inside a class is the md5 text of ``'<row_id>-<seed>'`` (then row_id),
which both Spark and DuckDB compute identically. The rank inside a class is
built in two levels (``ordered.running_totals``) with the first hex digits of
the hash as bucket, so no class ever sits in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key
from .ordered import running_totals


def class_rank(df: DataFrame, label: str | None, seed: int = 42, row_id: str = "row_id",
               hex_digits: int = 3, name: str = "_rank") -> DataFrame:
    """1-based rank inside the class (or overall when ``label`` is None) in hash order."""
    by = [label] if label else []
    d = df.withColumn("_h", hash_key(row_id, seed)).withColumn("_one", F.lit(1))
    bucket = F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int")
    r = running_totals(d, by, ["_h", row_id], ["_one"], bucket)
    return r.withColumnRenamed("cum__one", name).drop("_one", "_h")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class: one number per class of a target, however many classes it has."""
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def allocate(counts: Mapping, n_take: int) -> dict:
    """Per-class seats: floor of the proportional share, leftovers to the
    largest remainders (ties to the lower label). Exact integer arithmetic."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (c * n_take) // n for k, c in counts.items()}
    rem = {k: (c * n_take) % n for k, c in counts.items()}
    left = n_take - sum(base.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:left]:
        base[k] += 1
    return base


def split_sizes(counts: Mapping, test_size=Fraction(1, 5), val_size=Fraction(1, 10)):
    """(test seats, val seats) per class, as the reference's two splits."""
    test_size, val_size = Fraction(str(test_size)), Fraction(str(val_size))
    n = sum(counts.values())
    n_test = ceil(test_size * n)
    test = allocate(counts, n_test)
    rest = {k: counts[k] - test[k] for k in counts}
    n_val = ceil(val_size / (1 - test_size) * sum(rest.values()))
    val = allocate(rest, n_val)
    return test, val


def rank_cuts(df: DataFrame, label: str, counts: Mapping, ranks: Mapping, seed: int = 42, row_id: str = "row_id") -> dict:
    """(hash, row id) of the rows at the given 1-based ``ranks`` of each class in hash order: {class: [key or None, ...]}.

    Only class, hash and id are read. Bucket counts find the bucket that holds a rank; the rows of those few buckets alone
    are ranked. A rank of 0 has no key. The buckets follow the number of rows (about 100,000 in each).
    """
    n = sum(counts.values())
    digits = min(5, max(2, ceil(log(max(n, 1) / 1e5, 16)) if n > 1e5 else 2))
    keyed = df.select(F.col(label).alias("c"), hash_key(row_id, seed).alias("h"), F.col(row_id).alias("id"))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, digits))
    sizes = keyed.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("bucket"))       # over the buckets, not the rows
    want = [(k, int(r)) for k, rs in ranks.items() for r in sorted({r for r in rs if r > 0})]
    if not want:
        return {k: [None] * len(rs) for k, rs in ranks.items()}
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).cast("long").alias("r")) for k, r in want])
    ends = sizes.withColumn("upto", upto).withColumn("ask", F.explode(F.filter(asked, lambda a: (a["k"] == F.col("c")) & (a["r"] <= F.col("upto"))
                                                                              & (a["r"] > F.col("upto") - F.col("n")))))
    spots = [(r.c, r.bucket, r.rank, r.place) for r in ends.select("c", "bucket", F.col("ask.r").alias("rank"),
                                                                  (F.col("ask.r") - F.col("upto") + F.col("n")).alias("place")).collect()]
    held = F.lit(False)
    for k, bucket in sorted({(k, b) for k, b, _, _ in spots}, key=repr):
        held = held | ((F.col("c") == F.lit(k)) & (F.col("bucket") == bucket))
    place = F.row_number().over(Window.partitionBy("c", "bucket").orderBy("h", "id"))
    wanted = F.lit(False)
    for k, bucket, _, at in spots:
        wanted = wanted | ((F.col("c") == F.lit(k)) & (F.col("bucket") == bucket) & (F.col("place") == at))
    rows = {(r.c, r.bucket, r.place): (r.h, r.id) for r in keyed.where(held).withColumn("place", place).where(wanted).collect()}
    found = {(k, rank): rows[k, bucket, at] for k, bucket, rank, at in spots}
    return {k: [found[k, int(r)] if r > 0 else None for r in rs] for k, rs in ranks.items()}


def _beyond(cuts: Mapping, which: int, label: str, seed: int, row_id: str) -> Column:
    """Whether a row comes after its class's cut number ``which`` in hash order (always, where there is none)."""
    pairs = [x for k, keys in cuts.items() if keys[which] is not None
             for x in (F.lit(k), F.struct(F.lit(keys[which][0]).alias("h"), F.lit(keys[which][1]).alias("id")))]
    if not pairs:
        return F.lit(True)
    cut = F.create_map(*pairs)[F.col(label)]
    h, i = hash_key(row_id, seed), F.col(row_id)
    return F.coalesce((h > cut["h"]) | ((h == cut["h"]) & (i > cut["id"])), F.lit(True))


def stratified_split(df: DataFrame, label: str = "label", test_size=0.2, val_size=0.1,
                     seed: int = 42, row_id: str = "row_id", name: str = "split") -> DataFrame:
    """Adds ``split`` in {train, val, test} with exact per-class sizes, by comparing each row's key with its
    class's two cuts: no row is moved."""
    counts = class_counts(df, label)
    test, val = split_sizes(counts, test_size, val_size)
    cuts = rank_cuts(df, label, counts, {k: [test[k], test[k] + val[k]] for k in counts}, seed, row_id)
    after_test, after_val = (_beyond(cuts, i, label, seed, row_id) for i in (0, 1))
    return df.withColumn(name, F.when(~after_test, "test").when(~after_val, "val").otherwise("train"))


def fold_sizes(n: int, k: int) -> list[int]:
    """Group sizes of SQL ``ntile(k)`` over n rows."""
    return [n // k + (i < n % k) for i in range(k)]


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42,
                     row_id: str = "row_id", name: str = "fold") -> DataFrame:
    """Fold 0..k-1 = ntile(k) inside each class in hash order, as the number of the class's k - 1 cuts before the row."""
    counts = class_counts(df, label)
    ends = {c: list(accumulate(fold_sizes(n, k)))[:-1] for c, n in counts.items()}
    cuts = rank_cuts(df, label, counts, ends, seed, row_id)
    fold = F.lit(0)
    for i in range(k - 1):
        fold = fold + _beyond(cuts, i, label, seed, row_id).cast("int")
    return df.withColumn(name, fold)


def hash_sample(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """T4: exactly ``n`` rows (all if fewer), chosen by hash order: top-n, not a full sort."""
    return (df.withColumn("_h", hash_key(row_id, seed))
            .orderBy("_h", row_id).limit(n).drop("_h"))


def growing_prefixes(df: DataFrame, fractions=tuple(Fraction(i, 10) for i in range(1, 11)),
                     seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """T5: rows of each prefix floor(f*n) in hash order, tagged with ``fraction``.

    One row per (input row, prefix it belongs to): the larger prefixes
    contain the smaller ones, as in a learning curve.
    """
    n = df.count()
    r = class_rank(df, None, seed, row_id)
    sizes = [(float(f), int(Fraction(str(f)) * n)) for f in fractions]
    tags = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(m).alias("m")) for f, m in sizes])
    e = r.withColumn("_p", F.explode(F.filter(tags, lambda s: F.col("_rank") <= s["m"])))
    return e.select(*[c for c in df.columns], F.col("_p.fraction").alias("fraction"))
