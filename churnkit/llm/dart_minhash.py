"""Operator 1: near-duplicate classes by DartMinHash (Christiani, 2020).

*Signatures.* Every shingle owns a fixed random set of darts, points of a unit
Poisson process in the plane (weight, rank), made cell by cell from hashes of
the shingle. A document of total weight W keeps the darts that lie below the
weights of its shingles and below rank t / W, about t = k (ln k + 2) of them
whatever its length. A dart also carries one of k coordinates; the earliest
dart of each coordinate is the signature. Documents agree in a coordinate with
a probability equal to their weighted Jaccard similarity. Where a coordinate
stays empty the rank limit is doubled for that document.

*Bands.* 40 bands of 6 coordinates: a pair of similarity 0.8 shares no band
with a probability of 5e-6.

*Links.* Equal texts are one node. First every node of a bucket is compared
exactly (Jaccard of the five-word shingle sets) with the bucket's least node,
and classes are formed: a group of copies costs one hub instead of all its
pairs. Then, in buckets that still hold several classes, the signatures of nodes
of different classes are compared, a byte a coordinate, and only pairs that agree
in enough of them (five standard deviations below the threshold: a true link is
missed with a probability of 3e-7), and then in their hashed shingle sets, become
rows and are compared exactly. Buckets
of more than ``BLOCK`` nodes are dealt out as pairs of blocks, so no task holds
more than two blocks, and no bucket is cut.

*Classes* are connected components of the links, by alternating star steps over
written edge tables.

Cases: null text is empty; equal texts (also empty ones) are one class; a text
without words has no other partner; rows that share an id count as one document;
a null id gets a negative stand-in, which can show as ``class_id``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, buffers, mix, runs, seeded, unit
from .shared import row_id, staged, texts
from .shingles import jaccard, shingle_blocks

#: Height of the lowest band of ranks; the others double.
LOWEST_RANK = 2.0**-6
_RANK_BITS = 44
#: Nodes of a bucket whose signatures are compared in one task, at most twice as many.
BLOCK = 2000


@lru_cache(maxsize=512)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... events."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    logs = -mean + np.arange(top) * math.log(mean) - np.array([math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


def _darts(element, weight, doc, limit, k: int):
    """(document, coordinate, rank) of all darts below the weights and below the document's rank limit."""
    out = []
    height, low = LOWEST_RANK, 0.0
    cell = 0
    while True:
        live = np.flatnonzero(limit[doc] > low)
        if len(live) == 0:
            break
        wide, left, column = 1.0, 0.0, 0
        while len(live):
            seed = 1 + cell * 64 + column
            own = seeded(element[live], seed)
            n = np.searchsorted(_poisson(wide * height), unit(own), side="right")
            hit = np.flatnonzero(n)
            if len(hit):
                n = n[hit]
                at = np.repeat(live[hit], n)
                nth = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(U64)
                dart = mix(np.repeat(own[hit], n) + (nth + U64(1)) * U64(0x9E3779B97F4A7C15))
                rank = low + height * unit(dart)
                other = mix(dart ^ U64(0xD6E8FEB86659FD93))
                inside = (rank <= limit[doc[at]]) & (left + wide * unit(other) < weight[at])
                at = at[inside]
                out.append((doc[at], ((other[inside] & U64(0x7FF)) % U64(k)).astype(np.int64), rank[inside]))
            left, wide, column = left + wide, left + wide, column + 1
            live = live[weight[live] > left]
        low, height, cell = low + height, low + height, cell + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(element, weight, doc, n_docs: int, k: int = 128) -> np.ndarray:
    """(n_docs, k) signature; rows of documents without elements are 0. n_docs * k must be below 2**20."""
    sig = np.zeros(n_docs * k, U64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.where(total > 0, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        d, c, rank = _darts(element[mine], weight[mine], doc[mine], limit, k)
        packed = ((d * k + c).astype(U64) << U64(_RANK_BITS)) | (rank.view(U64) >> U64(63 - _RANK_BITS))
        packed.sort()
        key = (packed >> U64(_RANK_BITS)).astype(np.int64)
        first = runs(key)
        sig[key[first]] = packed[first] & U64((1 << _RANK_BITS) - 1)
        found = np.bincount(key[first] // k, minlength=n_docs)
        todo = todo & (found < k)
        limit = np.where(todo, limit * 2, limit)
    return sig.reshape(n_docs, k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    rows = sig.shape[1] // bands
    out = np.empty((len(sig), bands), np.int64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, U64)
        for r in range(rows):
            h = mix(h * U64(0x2545F4914F6CDD1D) + sig[:, b * rows + r])
        out[:, b] = h.view(np.int64)
    return out


def _signed(docs: DataFrame, k: int, bands: int, size: int, counted: bool) -> DataFrame:
    """did, digest of the text, and for a text with words its band keys and a byte of each coordinate."""
    schema = pa.schema([("did", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(2))
            keys = np.zeros((batch.num_rows, bands), np.int64)
            short = np.zeros((batch.num_rows, k), np.uint8)
            filled = np.zeros(batch.num_rows, bool)
            for i, j, (h, d, n) in shingle_blocks(data, off, size, max_docs=256):
                weight = n.astype(float) if counted else np.ones(len(n))
                sig = signatures(h, weight, d, j - i, k)
                keys[i:j] = band_keys(sig, bands)
                short[i:j] = (mix(sig) >> U64(56)).astype(np.uint8)
                filled[i + d] = True
            raw = memoryview(data)
            digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
            ends = np.concatenate(([0], np.cumsum(np.where(filled, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[filled].reshape(-1))),
                pa.array([row.tobytes() for row in short], pa.binary())], schema=schema)

    return docs.mapInArrow(sign, "did long, doc_id long, digest binary, bands array<bigint>, sig binary")


def _sets(held: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the distinct shingles of each text as sorted 32-bit hashes."""
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            out = [b""] * batch.num_rows
            for i, j, (h, d, _) in shingle_blocks(data, off, size):
                cut = np.searchsorted(d, np.arange(j - i + 1))
                short = (h >> U64(32)).astype(np.uint32)
                for k in range(j - i):
                    out[i + k] = np.unique(short[cut[k]:cut[k + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "shingles"])

    return held.select("node", "text").mapInArrow(make, "node long, shingles binary").dropDuplicates(["node"])


def _alike(state: DataFrame, facts: DataFrame, least: int, threshold: float) -> DataFrame:
    """(a, b), a > b: nodes of one bucket and different classes that pass two tests in the bucket's task.

    Their signatures agree in ``least`` coordinates, and the similarity of their 32-bit shingle sets is not
    below the threshold (less a little for collisions of the short hashes), so few rows leave the task.
    """
    count = state.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (state.join(count, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "node", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
             .join(facts, "node"))
    enough = threshold - 0.005

    def compare(table: pa.Table) -> pa.Table:
        node, root, own = (table[c].to_numpy() for c in ("node", "root", "own"))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint32) for x in table["shingles"].to_pylist()]
        rows = np.flatnonzero(own == low)
        out = []
        for lo in range(0, len(rows), 32):
            i = rows[lo:lo + 32]
            agree = (sig[i][:, None, :] == sig[None, :, :]).sum(axis=2)
            hit = (agree >= least) & (root[i][:, None] != root[None, :]) & (own == high)[None, :]
            for x, y in zip(*np.nonzero(hit), strict=True):
                p, q = i[x], y
                if low == high and p > q:
                    continue                            # the pair comes the other way round too
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if both >= enough * (len(sets[p]) + len(sets[q]) - both):
                    out.append((max(node[p], node[q]), min(node[p], node[q])))
        pairs = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "classes") -> DataFrame:
    """(node, root) of every node of the links (a, b), a > b, root being the class's least node."""
    before, stars = None, staged(edges.select("a", "b").distinct(), name)
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        stars = staged(small, name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _linked(pairs: DataFrame, held: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough, compared exactly."""
    one = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                good = jaccard(*buffers(column["text_a"]), *buffers(column["text_b"]), size) >= threshold
                yield pa.RecordBatch.from_arrays([column["a"].filter(pa.array(good)), column["b"].filter(pa.array(good))], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, *, k: int = 240, bands: int = 40, size: int = 5,
                    weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, did (the id, or its stand-in), class_id (least did of the class).

    ``weights``: "set" draws signatures for plain Jaccard similarity, "count" weights a shingle by how often
    the text has it (candidates only; links are decided by the sets).
    """
    base = texts(docs, id_col, text_col).select(row_id("doc_id", "text").alias("did"), "doc_id", "text")
    signed = staged(_signed(base, k, bands, size, weights == "count"), "signed")
    nodes = signed.groupBy("digest").agg(F.min("did").alias("node"), F.first(F.struct("bands", "sig")).alias("own"))
    spread = nodes.select("node", F.explode("own.bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    buckets = staged(spread.join(shared, "key").select("key", "node", "hub").distinct(), "buckets")
    wanted = buckets.select("node").distinct()
    held = staged(base.withColumnRenamed("did", "node").join(wanted, "node", "left_semi").select("node", "text").distinct(), "held")
    sigs = nodes.select("node", F.col("own.sig").alias("sig")).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    first = staged(buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = staged(_linked(first, held, size, threshold), "links")
    classes = components(links)
    state = buckets.join(classes, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = state.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    state = staged(state.join(several, "key"), "state")
    least = int(k * threshold - 5 * math.sqrt(k * threshold * (1 - threshold)))
    facts = sigs.join(_sets(held.join(state.select("node").distinct(), "node", "left_semi"), size), "node")
    rest = staged(_alike(state, facts, least, threshold).join(first, ["a", "b"], "left_anti"), "pairs")
    more = staged(_linked(rest, held, size, threshold), "links")
    if not more.isEmpty():
        classes = components(links.union(more))

    member = signed.join(nodes.select("digest", "node"), "digest").select("did", "doc_id", "node")
    return (member.join(classes, "node", "left")
            .select("doc_id", "did", F.coalesce("root", "node").alias("class_id")))
