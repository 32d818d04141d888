"""Exact ROC AUC of many linear fits over packed rows (H1, H3, H4, H5, L3).

Scores of all fits are nearly as many as rows times fits, so they are never rows of a table: a task sorts its scores and sends
them as binary pieces, one for each fit and bucket of scores (``bits`` of the order-preserving integer of a double). The scores of a bucket
meet in one task, which counts positives, negatives and pairs in the right order (ties half); running sums over the
buckets give the AUC (Mann-Whitney). More rows give finer buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear_many import LinearFit
from .vector_blocks import Blocks, unpacked

#: Scores a task holds before it sends them.
BUFFER = 1 << 20
PIECES = "g int, bucket long, keys binary, positive binary"


def ordered_key(score: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles (0 and -0 alike, NaN last)."""
    raw = np.where(np.isnan(score), np.nan, score + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64((1 << 63) - 1), raw)


def concordant(key: np.ndarray, positive: np.ndarray) -> tuple[int, int, float]:
    """Positives, negatives, and pairs of both with the positive above, ties half."""
    order = np.argsort(key, kind="stable")
    key, positive = key[order], positive[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    pos = np.add.reduceat(positive.astype(np.int64), first)
    neg = np.diff(np.r_[first, len(key)]) - pos
    return int(pos.sum()), int(neg.sum()), float((pos * (neg.cumsum() - neg + 0.5 * neg)).sum())


def pieces(parts: list[tuple[int, np.ndarray, np.ndarray]], shift: int) -> pa.RecordBatch:
    """Binary pieces by group and bucket of (group, keys, positive)."""
    group = np.concatenate([np.full(len(k), g) for g, k, _ in parts])
    key, positive = np.concatenate([k for _, k, _ in parts]), np.concatenate([p for _, _, p in parts])
    bucket = key >> shift
    order = np.lexsort((bucket, group))
    group, bucket, key, positive = group[order], bucket[order], key[order], positive[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])])
    at = np.r_[first, len(key)]
    return pa.RecordBatch.from_pydict({
        "g": pa.array(group[first], pa.int32()), "bucket": pa.array(bucket[first], pa.int64()),
        "keys": pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(key))]),
        "positive": pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(positive))])})


def bucket_shift(rows: int) -> int:
    return 52 - max(0, min(12, int(max(rows, 1)).bit_length() - 17))


def group_aucs(sent: DataFrame) -> list[tuple[int, float | None]]:
    """(group, AUC) from ``pieces``; None where a group has one class."""
    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("keys")])
        positive = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("positive")])
        pos, neg, pairs = concordant(keys, positive)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int64()),
                         "pos": pa.array([pos], pa.int64()), "neg": pa.array([neg], pa.int64()), "pairs": pa.array([pairs])})

    counts = sent.groupBy("g", "bucket").applyInArrow(count, "g int, bucket long, pos long, neg long, pairs double")
    below = F.sum("neg").over(Window.partitionBy("g").orderBy("bucket")) - F.col("neg")
    total = counts.withColumn("pairs", F.col("pairs") + F.col("pos") * below).groupBy("g").agg(
        F.sum("pairs").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = total.select("g", (F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc")).collect()      # one row per group
    return sorted((r.g, r.auc) for r in rows)


def scored_parts(x: np.ndarray, d: int, fits: Sequence[LinearFit], seen: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(2 * fit, rows, margins) of the fold each fit left out and, with ``seen``, (2 * fit + 1, ...) of its own training rows."""
    alike: dict = {}
    for g, q in enumerate(fits):
        alike.setdefault((id(q.expand), q.problem.leave_fold), []).append(g)
    for (_, fold), members in alike.items():
        rows = np.arange(len(x)) if seen else np.flatnonzero(x[:, d + 1] == fold)
        if not len(rows):
            continue
        part = x[rows, :d]
        part = fits[members[0]].expand(part) if fits[members[0]].expand else part
        margins = part @ np.column_stack([fits[g].weights for g in members]) + [fits[g].intercept for g in members]
        held = x[rows, d + 1] == fold
        for k, g in enumerate(members):
            yield 2 * g, rows[held], margins[held, k]
            if seen:
                own = ~held & (x[rows, d + 2] <= fits[g].problem.max_rank)
                yield 2 * g + 1, rows[own], margins[own, k]


def fit_aucs(blocks: Blocks, fits: Sequence[LinearFit], seen: bool = False) -> DataFrame:
    """(model, fold, part, auc) of every fit on the rows of the fold it left out (``held``) and, with ``seen``, on its training
    rows (``train``). ``blocks`` hold (features..., label, fold, rank). Null where a part has one class."""
    spark, d, width = blocks.df.sparkSession, blocks.width - 3, blocks.width
    shift = bucket_shift(blocks.rows)
    shared = spark.sparkContext.broadcast(list(fits))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for x in unpacked(batches, width):
            for g, rows, margin in scored_parts(x, d, shared.value, seen):
                if len(rows):
                    parts.append((g, ordered_key(margin), (x[rows, d] == 1).astype(np.uint8)))
                    size += len(rows)
                if size >= BUFFER:
                    yield pieces(parts, shift)
                    parts, size = [], 0
        if parts:
            yield pieces(parts, shift)

    rows = group_aucs(blocks.df.mapInArrow(local, PIECES))
    named = [(fits[g // 2].problem.name, fits[g // 2].problem.leave_fold, "train" if g % 2 else "held", auc) for g, auc in rows]
    return spark.createDataFrame(named, "model string, fold int, part string, auc double")
