"""Numeric rows packed to blocks, and sums over all of them.

Iterative fits read the same numbers again and again. ``pack`` writes the feature
vector and some numeric columns of a few thousand rows at a time into one binary value
(row-major doubles) and keeps these in executor memory, spilling to disk; a
lost block is rebuilt from its lineage. ``Blocks.sums`` runs a NumPy function on
every block and adds up the vectors it returns: once per task, then per group of
tasks, so that at most ``GROUPS`` vectors of fixed length (fewer where they are long) reach the driver. Many
fits share one such pass: their parameters are columns of one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a block, groups of tasks whose sums reach the driver, and doubles that all their sums may hold (two groups at least).
ROWS, GROUPS, TO_DRIVER = 4096, 32, 2_000_000


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def unpacked(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The (rows, width) matrices of the blocks in ``batches``."""
    for batch in batches:
        for raw in batch.column(0):
            yield np.frombuffer(raw.as_buffer()).reshape(-1, width)


@dataclass
class Blocks:
    """``rows`` rows of ``width`` doubles in ``df`` (numbers binary), held by ``parts`` partitions."""
    df: DataFrame
    width: int
    rows: int
    parts: int
    held: DataFrame

    def sums(self, fn: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """Sum of ``fn(block)``, vectors of ``length`` doubles, over all blocks."""
        width, groups = self.width, max(2, min(GROUPS, TO_DRIVER // max(length, 1)))

        def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for x in unpacked(batches, width):
                total += fn(x)
            yield pa.RecordBatch.from_pydict({"salt": pa.array([TaskContext.get().partitionId() % groups], pa.int32()),
                                              "numbers": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(length)
            for batch in batches:
                for raw in batch.column("numbers"):
                    total += np.frombuffer(raw.as_buffer())
            yield pa.RecordBatch.from_pydict({"salt": pa.array([0], pa.int32()), "numbers": pa.array([total.tobytes()], pa.binary())})

        schema = "salt int, numbers binary"
        sums = self.df.mapInArrow(local, schema)
        if self.parts > groups:
            sums = sums.groupBy("salt").applyInArrow(add, schema)
        parts = sorted((r.salt, bytes(r.numbers)) for r in sums.collect())
        return np.sum([np.frombuffer(raw) for _, raw in parts], axis=0) if parts else np.zeros(length)

    def rows_of(self, fn: Callable[[np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
        """The rows that ``fn(block)`` returns, of all blocks."""
        width = self.width

        def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in unpacked(batches, width):
                out = fn(x)
                if out is not None:
                    yield out
        return self.df.mapInArrow(local, schema)

    def close(self) -> None:
        self.held.unpersist()


def held(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` persisted, and the same rows in partitions of at least ``ROWS`` rows (as far as there are so many): fits of many
    short jobs pay for every task. The first is for ``unpersist``."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows, parts = kept.count(), kept.rdd.getNumPartitions()
    tasks = max(1, min(parts, -(-rows // ROWS)))
    return kept, kept if tasks == parts else kept.coalesce(tasks)


def pack(df: DataFrame, extra: Sequence[str | Column] = (), vec: str | Column = "features") -> Blocks:
    """Blocks of the vector column ``vec`` (or array of doubles) followed by the ``extra`` numeric columns; null counts as NaN."""
    values = vec if isinstance(vec, Column) else vector_to_array(vec)
    more = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(float("nan"))) for c in extra]
    flat = df.select((F.concat(values, F.array(*more)) if more else values).alias("x"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.RecordBatch.from_pydict({"numbers": pa.array([np.ascontiguousarray(x[i:i + ROWS]).tobytes() for i in range(0, len(x), ROWS)],
                                                                  pa.binary()),
                                              "n": pa.array([len(x[i:i + ROWS]) for i in range(0, len(x), ROWS)], pa.int64()),
                                              "width": pa.array([x.shape[1]] * len(range(0, len(x), ROWS)), pa.int32())})

    packed = flat.mapInArrow(cut, "numbers binary, n long, width int").persist(StorageLevel.MEMORY_AND_DISK)
    size = packed.agg(F.sum("n"), F.max("width")).first()
    rows, parts = size[0] or 0, packed.rdd.getNumPartitions()
    tasks = max(1, min(parts, -(-rows // ROWS)))        # a task is worth a full block
    numbers = packed.select("numbers")
    return Blocks(numbers if tasks == parts else numbers.coalesce(tasks), size[1] or 0, rows, tasks, packed)
