"""Operator 2: exact repeated byte strings by a distributed, sparse suffix array.

A byte is removed when it lies in a string of ``span`` bytes (100) that also
starts earlier: in a smaller document, or in the same one at an earlier place.
Texts are UTF-8 bytes; strings never cross documents.

0. *Copies.* A text equal to one of a smaller id (by SHA-256) repeats whole, so
   its suffixes need no sorting.
1. *Anchors.* In every window of ``span`` bytes the k-gram with the smallest
   hash is the anchor (k = ``gram``), so equal windows have equal anchors at
   equal places. Neighbouring windows share anchors; about one byte in 35 is one.
2. *Candidates.* Anchors whose k-gram is found once in the corpus are dropped.
   Each map task first settles what it can: of segments that are equal byte for
   byte only the earliest goes on, so a passage that a third of all documents
   hold costs one row a batch.
3. *Suffix sort.* The suffixes that start at candidate anchors are range
   partitioned by their leading bytes and then by their left context (Spark
   samples the splitters). A bucket sorts them by multikey quicksort, eight bytes
   a step; neighbours' common prefixes, and likewise common left contexts, give
   the classes of equal windows for every place of the anchor in its window. In
   a class all but the earliest window are repeats.
4. *Across boundaries.* A class can go on in a neighbour bucket only if it holds
   the bucket's first or last suffix to that depth. The earliest windows of
   such classes, and no others, are compared once more by their whole content.
5. Repeats go back to their documents, which drop the union of the windows.

No step compares all members of a class in pairs, and nothing is capped.

Cases: null text is empty; documents shorter than ``span`` keep everything; a
null id sorts before all others; rows with the same id are separate documents,
ordered by text (of equal texts the first stays); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import blocks, buffers, mix, prefix_sums, runs, span_hashes
from .shared import row_id, staged

#: What a row of the candidate exchange stands for.
COUNT, REPEATED, SETTLED, RUN = range(4)
_KIND_BIT, _ROW_BIT = 40, 44
_LOW = (1 << _KIND_BIT) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """(anchor, first window, number of windows, document, hash, hash of the segment) of the texts
    data[offsets[i]:offsets[i + 1]]; a segment is all bytes of an anchor's windows.

    Places are indices into ``data``; the rows of a document are in order of its text.
    """
    parts = []
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part, off = data[lo:hi], offsets[i:j + 1] - lo
        n = hi - lo
        if n < span:
            continue
        sums = prefix_sums(part)
        at = np.arange(n - gram + 1)
        value = span_hashes(sums, at, at + gram)
        bits, low = np.uint64(31), np.uint64(2**31 - 1)         # the same cut everywhere, so equal windows agree
        packed = (value >> bits << bits) | at.astype(np.uint64)   # of equal hashes the leftmost wins
        width, best = 1, packed
        want = span - gram + 1
        while width * 2 <= want:
            best = np.minimum(best[:len(best) - width], best[width:])
            width *= 2
        rest = want - width
        if rest:
            best = np.minimum(best[:len(best) - rest], best[rest:])
        size = np.diff(off)
        inside = np.ones(len(best), bool)          # windows that lie in one document
        tail = np.minimum(size, span - 1)
        cross = np.repeat(off[1:] - tail, tail) + np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
        inside[cross[cross < len(best)]] = False
        start = np.flatnonzero(inside)
        if len(start) == 0:
            continue
        anchor = (best[start] & low).astype(np.int64)
        first = runs(anchor)
        begin = start[first]
        anchor = anchor[first]
        count = np.diff(np.append(first, len(start)))
        doc = np.searchsorted(off, begin, side="right") - 1
        whole = span_hashes(sums, begin, begin + count + span - 1)
        parts.append((anchor + lo, begin + lo, count, doc + i, value[anchor], whole))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _same_bytes(data, a, b, size) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], row by row."""
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), 4096):
        s = size[lo:lo + 4096]
        width = int(s.max())
        step = np.arange(width)
        x = np.minimum(a[lo:lo + 4096, None] + step, len(data) - 1)
        y = np.minimum(b[lo:lo + 4096, None] + step, len(data) - 1)
        out[lo:lo + 4096] = ((data[x] == data[y]) | (step >= s[:, None])).all(axis=1)
    return out


def _candidate_rows(data, offsets, did, rank, span, gram):
    """(h, did, code) of one batch, with what the batch can settle already settled."""
    anchor, begin, count, doc, value, whole = anchors(data, offsets, span, gram)
    if len(anchor) == 0:
        return None
    ordinal = np.arange(len(anchor)) - np.searchsorted(doc, doc, side="left")
    in_order = bool((np.diff(did) >= 0).all())                  # as Spark's window delivers them
    order = np.arange(len(doc)) if in_order else np.lexsort((begin, rank[doc], did[doc]))
    group = order[np.argsort(value[order], kind="stable")]      # equal k-grams together, earliest first
    new = np.ones(len(group), bool)
    new[1:] = value[group[1:]] != value[group[:-1]]
    member = np.cumsum(new) - 1
    many = np.bincount(member)[member] > 1
    kind = np.empty(len(anchor), np.int64)
    kind[group] = np.where(many, np.where(new, REPEATED, SETTLED), COUNT)
    # equal segments of a repeated k-gram: all but the earliest are repeats from end to end
    done = np.zeros(len(anchor), bool)
    rows = group[many]
    if len(rows):
        shape = (anchor[rows] - begin[rows]) * 65536 + count[rows]
        again = np.lexsort((np.arange(len(rows)), whole[rows], shape, member[many]))
        rows, shape = rows[again], shape[again]
        same = np.zeros(len(rows), bool)
        same[1:] = (value[rows[1:]] == value[rows[:-1]]) & (shape[1:] == shape[:-1]) & (whole[rows[1:]] == whole[rows[:-1]])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rows))))
        later = np.flatnonzero(same)
        if len(later):
            x, y = rows[later], rows[head[later]]
            done[x[_same_bytes(data, begin[x], begin[y], count[x] + span - 1)]] = True
        left_over = np.bincount(member, weights=~done[group])
        lone = new & many & (left_over[member] == 1)            # its only partners were copies: count it once
        kind[group[lone]] = COUNT
    start = begin - offsets[doc]
    code = (rank[doc] << _ROW_BIT) | (kind << _KIND_BIT) | ordinal
    h = np.where(kind == SETTLED, mix((did[doc] * 1_000_003 + ordinal).view(np.uint64)).view(np.int64), value.view(np.int64))
    live = ~done
    out = [(h[live], did[doc[live]], code[live])]
    gone = np.flatnonzero(done)
    if len(gone):       # neighbouring repeated segments become one run of window starts
        joined = np.zeros(len(gone), bool)
        joined[1:] = (gone[1:] == gone[:-1] + 1) & (doc[gone[1:]] == doc[gone[:-1]])
        first = gone[~joined]
        last = gone[np.append(~joined[1:], True)]
        out.append(((start[first] << 32) | (start[last] + count[last] - 1), did[doc[first]],
                    (rank[doc[first]] << _ROW_BIT) | (RUN << _KIND_BIT)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _gather(data, first, size, step=1) -> pa.Array:
    """Binary column of data[first], data[first + step] ... of the given sizes."""
    size = size.astype(np.int64)
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    index = np.repeat(first - step * (stop - size), size) + step * np.arange(total)
    off = np.concatenate(([0], stop)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data[index].tobytes())])


SEGMENTS = "did long, rank int, place int, low int, high int, right binary, left binary"
_SEGMENT_SCHEMA = pa.schema([("did", pa.int64()), ("rank", pa.int32()), ("place", pa.int32()), ("low", pa.int32()),
                             ("high", pa.int32()), ("right", pa.binary()), ("left", pa.binary())])


def _segment_rows(batch: pa.RecordBatch, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Suffix and reversed left context of every candidate anchor; settled runs pass with low = -1."""
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    data, offsets = buffers(column["text"])
    did = column["did"].to_numpy()
    rank = column["rank"].to_numpy().astype(np.int64)
    lists = column["candidates"]
    at = lists.offsets.to_numpy().astype(np.int64)
    held = lists.values
    owner = np.repeat(np.arange(len(did)), np.diff(at))
    h = held.field("h").to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    code = held.field("code").to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    mine = (code >> _ROW_BIT) == rank[owner]
    owner, h, code = owner[mine], h[mine], code[mine]
    kind = (code >> _KIND_BIT) & 15
    seg = np.flatnonzero(kind != RUN)
    anchor, begin, count, doc, _, _ = anchors(data, offsets, span, gram)
    pick = np.searchsorted(doc, owner[seg], side="left") + (code[seg] & _LOW)
    a, b, n, d = anchor[pick], begin[pick], count[pick], doc[pick]
    for lo in range(0, len(pick), 50_000):
        k = slice(lo, lo + 50_000)
        low, high = a[k] - b[k] - n[k] + 1, a[k] - b[k]
        yield pa.RecordBatch.from_arrays([
            pa.array(did[d[k]]), pa.array(rank[d[k]].astype(np.int32)), pa.array((a[k] - offsets[d[k]]).astype(np.int32)),
            pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
            _gather(data, a[k], span - low), _gather(data, a[k] - 1, high, -1)], schema=_SEGMENT_SCHEMA)
    run = np.flatnonzero(kind == RUN)
    if len(run):
        s, e = h[run] >> 32, h[run] & 0xFFFFFFFF
        spread = mix((did[owner[run]] ^ (s << 20)).view(np.uint64)).tobytes()
        right = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(np.arange(len(run) + 1, dtype=np.int32) * 8), pa.py_buffer(spread)])
        yield pa.RecordBatch.from_arrays([
            pa.array(did[owner[run]]), pa.array(rank[owner[run]].astype(np.int32)), pa.array(s.astype(np.int32)),
            pa.array(np.full(len(run), -1, np.int32)), pa.array(e.astype(np.int32)), right,
            pa.array([b""] * len(run), pa.binary())], schema=_SEGMENT_SCHEMA)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes padded with zeros."""
    data, off = buffers(column)
    out = np.zeros((len(column), width), np.uint8)
    size = np.diff(off)
    total = int(size.sum())
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = data[off[0]:off[0] + total]
    return out


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and each row's common prefix (bytes) with the row before it in that order.

    Multikey quicksort with eight bytes as the key of a step: only rows that are still tied go on to the next.
    """
    m, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.arange(m)
    common = np.full(m, -1, np.int64)       # -1: tied with the row before, so far
    if m:
        common[0] = 0
    for depth in range(words.shape[1]):
        tied = common < 0
        active = tied.copy()
        active[:-1] |= tied[1:]
        at = np.flatnonzero(active)
        if len(at) == 0:
            break
        group = np.cumsum(~tied)[at]
        key = words[order[at], depth]
        sort = np.lexsort((key, group))
        order[at], key = order[at][sort], key[sort]
        differ = (key[1:] ^ key[:-1]) * (group[1:] == group[:-1]).astype(np.uint64)
        hit = np.flatnonzero(differ)
        if len(hit):
            x = differ[hit]
            lead = sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
            common[at[hit + 1]] = 8 * depth + lead
    common[common < 0] = width
    return order, common


FOUND = "did long, rank int, start int, stop int, content binary"
_FOUND_SCHEMA = pa.schema([("did", pa.int64()), ("rank", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
                           ("content", pa.binary())])


def _found(did, rank, start, stop, content=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(did), pa.array(rank), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)),
        pa.nulls(len(did), pa.binary()) if content is None else content], schema=_FOUND_SCHEMA)


def _bucket(batches: Iterable[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of one bucket: (start, stop) first and last window start of a run, or an open
    window with its content, to be compared across boundaries."""
    held = []
    for batch in batches:
        low = batch.column(3).to_numpy()
        settled = np.flatnonzero(low < 0)
        if len(settled):
            part = batch.take(pa.array(settled))
            yield _found(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(4).to_numpy())
        if len(settled) < batch.num_rows:
            held.append(batch.take(pa.array(np.flatnonzero(low >= 0))) if len(settled) else batch)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    number = [table.column(i).to_numpy() for i in range(5)]
    early = np.lexsort((number[2], number[1], number[0]))       # rows in order of document and place
    did, rank, place, low, high = (x[early] for x in number)
    pad = lambda n: -(-n // 8) * 8                               # noqa: E731
    right = _matrix(table.column(5), pad(span))[early]
    left = _matrix(table.column(6), pad(span - gram + 1))[early]
    del table, held
    m = len(did)
    by_right, right_common = multikey_sort(right)
    by_left, left_common = multikey_sort(left)
    repeat = np.zeros((m, span - gram + 3), bool)               # column 1 + l: window l bytes before the anchor
    class_right, class_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for back in range(int(low.min()), int(high.max()) + 1):
        rows = np.flatnonzero((low <= back) & (back <= high))
        if len(rows) == 0:
            continue
        class_right[by_right] = np.cumsum(right_common < span - back)
        class_left[by_left] = np.cumsum(left_common < back)
        pair = class_right[rows] * (m + 1) + class_left[rows]
        _, first = np.unique(pair, return_index=True)           # the first of a class is its earliest window
        mark = np.ones(len(rows), bool)
        mark[first] = False
        repeat[rows[mark], back + 1] = True
        edge = rows[first]
        edge = edge[np.isin(class_right[edge], class_right[by_right[[0, -1]]])]
        if len(edge):
            content = np.concatenate([left[edge, :back][:, ::-1], right[edge, :span - back]], axis=1)
            off = np.arange(len(edge) + 1, dtype=np.int32) * span
            yield _found(did[edge], rank[edge], place[edge] - back, place[edge] - back, pa.Array.from_buffers(
                pa.binary(), len(edge), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(content).tobytes())]))
    change = np.diff(repeat[:, ::-1].astype(np.int8), axis=1)    # columns now in order of the window's start
    row, col = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    if len(row):
        # reversed column c + 1 is window back = span - gram + 2 - (c + 1) - 1
        back_first, back_last = span - gram - col, span - gram + 1 - end
        yield _found(did[row], rank[row], place[row] - back_first, place[row] - back_last)


def later_copies(base: DataFrame) -> DataFrame:
    """(did, copied): for each id the digests of its texts that a smaller id has too."""
    held = base.select("did", "digest")
    first = held.groupBy("digest").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    later = held.join(first, "digest").where(F.col("did") > F.col("first"))
    return later.groupBy("did").agg(F.collect_set("digest").alias("copied"))


def repeated_windows(numbered: DataFrame, span: int, gram: int) -> DataFrame:
    """Runs (did, rank, start, stop) of window starts whose ``span`` bytes also start earlier; copies are left out."""

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("code", pa.int64())])
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            got = _candidate_rows(*buffers(column["text"]), column["did"].to_numpy(),
                                  column["rank"].to_numpy().astype(np.int64), span, gram)
            if got is not None:
                for lo in range(0, len(got[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + 100_000]) for x in got], schema=schema)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _segment_rows(batch, span, gram)

    kind = F.shiftright("code", _KIND_BIT).bitwiseAND(15)
    weight = F.when(kind == COUNT, 1).when(kind == REPEATED, 2).otherwise(0)
    found = numbered.where(~F.col("copy")).mapInArrow(candidates, "h long, did long, code long")
    found = (found.withColumn("times", F.sum(weight).over(Window.partitionBy("h")))
             .where((kind >= SETTLED) | (F.col("times") > 1)))
    per_doc = found.groupBy("did").agg(F.collect_list(F.struct("h", "code")).alias("candidates"))
    suffixes = numbered.join(per_doc, "did").mapInArrow(segments, SEGMENTS)
    buckets = suffixes.repartitionByRange("right", "left")
    local = buckets.mapInArrow(lambda batches: _bucket(batches, span, gram), FOUND)
    # windows that could have a partner in another bucket meet by content; all others pass alone
    alone = F.concat_ws(":", "did", "rank", "start").cast("binary")
    earlier = F.row_number().over(Window.partitionBy("key").orderBy("did", "rank", "start"))
    return (local.withColumn("key", F.coalesce("content", alone)).withColumn("nth", earlier)
            .where(F.col("content").isNull() | (F.col("nth") > 1)).select("did", "rank", "start", "stop"))


def remove_repeats(docs: DataFrame, span: int = 100, gram: int = 24, *, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (bytes), spans (removed [start, stop) runs) and, where
    columns are carried, ``extra`` (a struct of them). With ``as_text`` kept is text, without the characters that a cut splits."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *([F.struct(*carry).alias("extra")] if carry else []))
    # used three times below with all its columns, so its exchange is written once and reused
    base = base.withColumn("did", row_id("doc_id", "text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = staged(later_copies(base), "copies")
    numbered = (base.withColumn("rank", F.row_number().over(Window.partitionBy("did").orderBy("text")))
                .join(copies, "did", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False)))
                .drop("copied"))
    runs_found = repeated_windows(numbered, span, gram)
    per_doc = runs_found.groupBy("did").agg(F.collect_list(F.struct("rank", "start", "stop")).alias("runs"))
    kept_type = pa.string() if as_text else pa.binary()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for raw, rank, copy, held in zip(column["text"].cast(pa.binary()).to_pylist(), column["rank"].to_pylist(),
                                             column["copy"].to_pylist(), column["runs"].to_pylist(), strict=True):
                spans = [[0, len(raw)]] if copy and len(raw) >= span else []
                for start, stop in sorted((r["start"], r["stop"] + span) for r in held or () if r["rank"] == rank and not copy):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([start, stop])
                if spans:
                    cuts = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[cuts[k]:cuts[k + 1]] for k in range(0, len(cuts), 2))
                else:
                    kept = raw
                if as_text:
                    kept = kept.decode("utf-8", "ignore")
                out.append((len(raw), kept, [{"start": a, "stop": b} for a, b in spans]))
            n, kept, spans = map(list, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([column["doc_id"], pa.array(n, pa.int64()), pa.array(kept, kept_type),
                                              pa.array(spans, span_type), *([column["extra"]] if carry else [])],
                                             ["doc_id", "n_bytes", "kept", "spans", *(["extra"] if carry else [])])

    result = numbered.join(per_doc, "did", "left")
    passed = f", extra {numbered.schema['extra'].dataType.simpleString()}" if carry else ""
    return result.mapInArrow(cut, f"doc_id long, n_bytes long, kept {'string' if as_text else 'binary'}, "
                                  f"spans array<struct<start:bigint,stop:bigint>>{passed}")
