"""Operator 8: documents packed into sequences of fixed length, best fit and then local search.

Every text is encoded, an end id appended, and only documents longer than a
sequence are cut: the first piece takes the remainder, all others are full. A
full piece is a sequence of its own. The other pieces are dealt by a hash into
groups of about ``GROUP_ITEMS`` (the unit of work of a task), and each group is
packed by best fit, largest first, and improved by local search: the emptiest
bins give pieces to other underfull bins by moving one, swapping one for one, or
swapping two for one. Every step makes the fuller bin fuller, so the sum of
squared fills rises and bins run empty. Pieces of bins that stay clearly
underfull are dealt anew into as many groups as they need, until one group is
left or a round leaves (within a hundredth) as many such bins as it was given; so
the number of groups costs next to nothing, and no group is larger than the others.

Cases: a null text is empty (only the end id); a null id is kept; repeated rows
are packed as often as they occur; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import buffers
from .shared import staged, texts
from .tokens import encoder

#: Pieces packed together by one task.
GROUP_ITEMS = 32_768
#: Bins filled less than this share go on to the next round.
FULL_ENOUGH = 0.99

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as u32 bytes) of the pieces of each row of (doc_id, text)."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                tokens, off = enc.encode(*buffers(batch.column(1)), end_id)
                size = np.diff(off)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (size - (n - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                raw = memoryview(tokens.astype("<u4").tobytes())
                a = (off[doc] + start) * 4
                parts = [raw[x:y] for x, y in zip(a.tolist(), (a + length * 4).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): items from the largest, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0                                            # bit g: some bin has gap g
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = gaps >> sizes[i]
        if fits:
            gap = sizes[i] + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        gap -= sizes[i]
        by_gap[gap].append(b)
        gaps |= 1 << gap
    return bins


class _Loose:
    """Bins with room, indexed so that the best step for a piece is found without looking at all of them.

    ``reach`` of a piece is its size plus the gap of its bin: the largest piece that can take its place. An
    empty place has size 0, so its reach is the bin's gap; it is kept as the negative number of the bin.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.gap = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.home = {i: b for b, members in enumerate(bins) for i in members}
        self.at: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.some = 0                                    # bit r: there is a piece or an empty place of reach r
        for b in range(len(bins)):
            self.show(b)

    def _keys(self, b: int):
        if self.bins[b] and self.gap[b]:
            yield -1 - b, self.gap[b]
            for i in self.bins[b]:
                yield i, self.sizes[i] + self.gap[b]

    def show(self, b: int) -> None:
        for key, reach in self._keys(b):
            self.at[reach].add(key)
            self.some |= 1 << reach

    def hide(self, b: int) -> None:
        for key, reach in self._keys(b):
            self.at[reach].discard(key)
            if not self.at[reach]:
                self.some &= ~(1 << reach)

    def best(self, weight: int, u: int, limit: int) -> tuple[int, int] | None:
        """(gap left, piece or empty place) where ``weight`` from bin u fits with the least gap left, below limit."""
        left = self.some >> weight
        while left:
            gap_left = (left & -left).bit_length() - 1
            if gap_left >= limit:
                return None
            for key in self.at[weight + gap_left]:
                b = -1 - key if key < 0 else self.home[key]
                if b != u and (key < 0 or self.sizes[key] < weight):
                    return gap_left, key
            left &= left - 1
        return None

    def improve(self, u: int) -> bool:
        """Move one piece, or swap one or two for one, so that a bin becomes fuller than u is now."""
        own = sorted(self.bins[u], key=lambda i: -self.sizes[i])
        limit = self.gap[u]                              # the other bin must end fuller: the squares then rise
        step = None
        def gives():                                     # equal sizes are the same step
            yield from ((i,) for i in {self.sizes[i]: i for i in own}.values())
            yield from {(self.sizes[a], self.sizes[b]): (a, b) for x, a in enumerate(own) for b in own[:x]}.values()

        for give in gives():
            weight = sum(self.sizes[i] for i in give)
            if weight > self.capacity:
                continue
            found = self.best(weight, u, limit)
            if found and not (len(give) == 2 and found[1] < 0):
                limit, step = found[0], (give, found[1])
                if limit == 0:
                    break
        if step is None:
            return False
        give, key = step
        t = -1 - key if key < 0 else self.home[key]
        self.hide(u)
        self.hide(t)
        for moved, source, target in [(i, u, t) for i in give] + ([(key, t, u)] if key >= 0 else []):
            self.bins[source].remove(moved)
            self.bins[target].append(moved)
            self.home[moved] = target
            self.gap[source] += self.sizes[moved]
            self.gap[target] -= self.sizes[moved]
        self.show(u)
        self.show(t)
        return True


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one swaps; returns the bins that are left."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)                    # no packing has fewer bins
    full = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    loose = _Loose([list(b) for b, f in zip(bins, fill, strict=True) if f < capacity], sizes, capacity)
    left = len(loose.bins)
    emptied = True
    while emptied and len(full) + left > least:
        emptied = False
        for u in sorted(range(len(loose.bins)), key=lambda b: -loose.gap[b]):
            if not loose.bins[u] or loose.gap[u] <= (1 - FULL_ENOUGH) * capacity:
                continue
            while loose.bins[u] and loose.improve(u):
                pass
            if not loose.bins[u]:
                emptied, left = True, left - 1
                if len(full) + left <= least:
                    break
    return full + [b for b in loose.bins if b]


def pack_lengths(items: DataFrame, capacity: int) -> DataFrame:
    """(key, sequence_id, place) for items (key long, length long), 0 < length < capacity; odd sequence ids."""
    schema = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("loose", pa.bool_())])
    done, todo, round_no, before, loose_before = None, items, 0, None, None
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    while True:

        def pack(table: pa.Table) -> pa.Table:
            sizes = table["length"].to_pylist()
            found = local_search(best_fit(sizes, capacity), sizes, capacity)
            out = np.zeros((len(sizes), 3), np.int64)
            for b, members in enumerate(found):
                at = 0
                for i in members:
                    out[i, :2] = b, at
                    at += sizes[i]
                out[members, 2] = at < FULL_ENOUGH * capacity
            number = (table["group"][0].as_py() << 20) + out[:, 0]
            return pa.Table.from_arrays([table["key"].combine_chunks(), table["length"].combine_chunks(), pa.array(number),
                                         pa.array(out[:, 1]), pa.array(out[:, 2] > 0)], schema=schema)

        dealt = todo.select("key", "length", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(groups)).alias("group"))
        got = staged(dealt.groupBy("group").applyInArrow(pack, "key long, length long, bin long, place long, loose boolean"), "packed")
        number = (F.col("bin") * 1024 + round_no) * 2 + 1
        placed = got.select("key", "length", "loose", number.alias("sequence_id"), F.col("place").alias("offset"))
        n, bins, loose = got.agg(F.count_if("loose"), F.count_distinct("bin"), F.count_distinct(F.when(F.col("loose"), F.col("bin")))).first()
        if before is not None and bins > loose_before:          # dealt anew they need more bins: the last round's stay
            return done.union(before.select(*done.columns))
        last = groups == 1 or round_no == 1023 or (loose_before is not None and loose > 0.99 * loose_before)
        kept = (placed if last or not n else placed.where(~F.col("loose"))).select("key", "sequence_id", "offset")
        done = kept if done is None else done.union(kept)
        if last or not n:
            return done
        before, loose_before = placed.where("loose"), loose
        todo = before.select("key", "length")
        groups = -(-n // GROUP_ITEMS)
        round_no += 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, *, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, u32 bytes)."""
    pieces = cut_pieces(texts(docs, id_col, text_col), tokenizer, capacity, end_id, with_ids)
    pieces = staged(pieces.where("length > 0").withColumn("key", F.monotonically_increasing_id()), "pieces")
    plan = pack_lengths(pieces.where(F.col("length") < capacity).select("key", "length"), capacity)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("key") * 2).withColumn("offset", F.lit(0).cast("long"))
    packed = pieces.where(F.col("length") < capacity).join(plan, "key")
    return packed.select(*full.columns).unionByName(full).drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids (u32 bytes) of every sequence, from rows with ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"))
