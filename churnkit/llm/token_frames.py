"""Operator 3: token ids as independent zstandard frames with a trailing seek table.

One file holds the documents of one range of ids in ascending order:

* one zstandard frame per document (its ids, little-endian, 2 or 4 bytes each,
  with a content checksum), so any frame can be decompressed alone;
* a skippable frame (magic 0x184D2A50) with the directory: bytes per id and the
  document ids;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public
  zstandard seekable format: compressed size, decompressed size and the low
  32 bits of XXH64 of every data frame, then frame count, descriptor and the
  magic 0x8F92EAB1.

Any zstandard reader decompresses such a file whole; ``read_documents`` fetches
the tail and then only the frames asked for. A task writes to a name of its own
attempt, and only names in the written manifest count, so a lost executor or a
second attempt leaves no half-written data in the result.

Cases: a null text is an empty document (only the end id, or nothing without
one); null ids sort first and come back null; repeated rows are written as
often as they occur; an empty table gives no file and no rows; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import buffers
from .shared import texts
from .tokens import encoder

DIRECTORY_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -2**63
#: Tokens put together before a batch of rows leaves a task.
BATCH_TOKENS = 2_000_000


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes frames one by one to a stream, then directory and seek table."""

    def __init__(self, stream, width: int, level: int):
        import zstandard
        self.stream, self.width = stream, width
        self.kind = np.dtype(f"<u{width}")
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids: list[int] = []
        self.table = bytearray()

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        import xxhash
        raw = tokens.astype(self.kind).tobytes()
        packed = self.zip.compress(raw)
        self.stream.write(packed)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.table += struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)

    def close(self) -> None:
        head = struct.pack("<B", self.width) + np.asarray(self.ids, "<i8").tobytes()
        self.stream.write(struct.pack("<II", DIRECTORY_MAGIC, len(head)) + head)
        tail = bytes(self.table) + struct.pack("<IBI", len(self.ids), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(tail)) + tail)


class FrameFile:
    """Reads the tail of a file; ``tokens(i)`` decompresses and checks frame i alone."""

    def __init__(self, path: str):
        import zstandard
        system, inner = _open(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        at = size - 9 - 12 * count - 8
        head = self.file.read_at(8 + 12 * count, at)
        if struct.unpack("<II", head[:8]) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError(f"{path}: broken seek table")
        self.table = np.frombuffer(head, "<u4", 3 * count, 8).reshape(count, 3).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        directory = self.file.read_at(at - int(self.begin[-1]), int(self.begin[-1]))
        if struct.unpack("<II", directory[:8]) != (DIRECTORY_MAGIC, 1 + 8 * count):
            raise ValueError(f"{path}: broken directory")
        self.width = directory[8]
        self.ids = np.frombuffer(directory, "<i8", count, 9)
        self.counts = self.table[:, 1] // self.width
        self.unzip = zstandard.ZstdDecompressor()

    def frames(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Tokens of frames first to last - 1, fetched in one read."""
        import xxhash
        base = int(self.begin[first])
        block = memoryview(self.file.read_at(int(self.begin[last]) - base, base))
        for i in range(first, last):
            a, b = int(self.begin[i]) - base, int(self.begin[i + 1]) - base
            raw = self.unzip.decompress(block[a:b])
            if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i}: checksum does not match")
            yield np.frombuffer(raw, f"<u{self.width}")

    def tokens(self, i: int) -> np.ndarray:
        return next(self.frames(i, i + 1))


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int | None = None, *,
                      id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Encode every whole text and write one file per range of ids; returns the manifest (one row a file).

    The manifest is itself written below ``out_dir``, which must be a folder that all executors share.
    """
    spark = docs.sparkSession
    ordered = (texts(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        width = 2 if max(enc.vocab_size, (end_id or 0) + 1) <= 1 << 16 else 4
        path, out, stream, n, total = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex}.zst", None, None, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                system, inner = _open(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(inner, compression=None)
                out = FrameWriter(stream, width, level)
            tokens, off = enc.encode(*buffers(batch.column(1)), end_id)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                out.add(doc_id, tokens[off[i]:off[i + 1]])
            n, total = n + batch.num_rows, total + int(off[-1])
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": n, "n_tokens": total}], pa.schema(
                [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (tokens before it over all files), n_tokens, ids (u32 bytes)."""
    files = manifest.count()
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = (manifest.withColumn("start", F.coalesce(before, F.lit(0)))  # a row per file, not per document
              .repartitionByRange(max(1, files), "part").select("path", "start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = FrameFile(row["path"])
                start = row["start"] + np.concatenate(([0], np.cumsum(f.counts)))
                i, n = 0, len(f.ids)
                while i < n:
                    j = max(i + 1, int(np.searchsorted(start, start[i] + BATCH_TOKENS, side="right")) - 1)
                    j = min(j, n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(f.ids[i:j], mask=f.ids[i:j] == NULL_ID), pa.array(start[i:j]), pa.array(f.counts[i:j]),
                        pa.array([t.astype("<u4").tobytes() for t in f.frames(i, j)], pa.binary())], schema=schema)
                    i = j

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Tokens of the wanted documents of one file; only their frames are fetched and decompressed."""
    f = FrameFile(path)
    out = {}
    for d in doc_ids:
        at = np.flatnonzero(f.ids == d)
        if len(at):
            out[d] = f.tokens(int(at[0]))
    return out
