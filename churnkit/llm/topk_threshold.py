"""Operator 12: exact top-k search by inner product, three-phase uniform threshold.

A vector's components become integers floor(scale * x); the score of a pair is their
integer inner product. The components are dealt to ``SHARDS`` shards, each of which
has a score list per query (the products over its own components); a score is the
sum of a vector's entries in all lists.

1. Every shard gives its best entries per query (in every block of candidates); their
   scores are resolved. The k-th best of them is a safe cutoff: at least k candidates reach it.
2. The cutoff goes to all blocks with the queries. A score that reaches it has an entry of
   at least cutoff / SHARDS in some list, so exactly the candidates with such an entry are collected.
3. The scores of the collected ones are resolved over all shards; those that reach the cutoff
   compete, a block's best k for each query first, then those of all blocks.

Candidates are all rows: rows of equal integers form a class that is scored once and
carries its k + 1 least ids (one more than k, as a query never meets its own row), found by
a ranked window whose limit works before the shuffle, so a class of any size costs k + 1 rows
a task. Queries of equal integers are one query. Blocks of candidates (at most ``MAX_BLOCK``)
meet slices of queries (``SLICE``) in grouped tasks: a task's memory is bounded at every size, no
pairs become rows, and only k + 1 classes of a block and query are ever shuffled. The search
is exact, so the work is queries x candidates by its nature. Results are joined back to the
queries' rows under a salt, since a third of them may be one vector.

Cases: null vectors and vectors with null, NaN or infinite components take no part, nor do
null ids; rows alike in id and integers are one row; rows that share only the id are
different rows (each is a candidate of the other); vectors of different lengths count as filled
up with zeros, an empty one scores 0; integers beyond 64 bits, and scores, are clipped to them,
other arithmetic is exact; fewer candidates than k give fewer rows; an empty table gives no
rows; other columns are ignored. A very long vector is a row of a block like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

SHARDS = 4
SLICE = 4096
MIN_BLOCK, MAX_BLOCK = 4096, 65536
SALTS = 8
#: Entries of one shard's score list that are held at once.
CELLS = 1 << 21


def vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, ints (array of long) and a key of the ints, for the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(~bad)
    df = df.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints"))
    return df.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("ints", lambda x: x.cast("string")), ",").cast("binary"), 256)))


def classes(df: DataFrame, k: int) -> DataFrame:
    """key, ints and ids (at most k, ascending) of every class of equal integers."""
    rows = df.groupBy("key", "id").agg(F.first("ints").alias("ints"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k)
    return few.groupBy("key").agg(F.first("ints").alias("ints"), F.array_sort(F.collect_list("id")).alias("ids"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the lists, filled up with zeros."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in column.chunks if len(c)), default=0)


def _shards(candidates: pa.Table, queries: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(queries, transposed candidates) of each shard, as doubles where these hold every score exactly, else as integers
    without bound."""
    width = max(_widest(candidates["ints"]), _widest(queries["ints"]))
    c, q = matrix(candidates["ints"], width), matrix(queries["ints"], width)
    most = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0       # noqa: E731
    kind = np.float64 if max(width, 1) * most(c) * most(q) < 2**52 else object
    parts = min(SHARDS, max(width, 1))
    return [(np.ascontiguousarray(a.astype(kind)), np.ascontiguousarray(b.astype(kind).T))
            for a, b in zip(np.array_split(q, parts, axis=1), np.array_split(c, parts, axis=1), strict=True)]


def _lists(shards, n_queries: int, n_candidates: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """The score lists of all shards for a few queries at a time."""
    step = max(1, CELLS // max(n_candidates, 1))
    for i in range(0, n_queries, step):
        yield i, min(i + step, n_queries), [q[i:i + step] @ c for q, c in shards]


def _as_long(scores) -> list[int]:
    return [min(max(int(s), -2**63), 2**63 - 1) for s in scores]


def first_entries(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Phase 1 in a block: scores of the candidates that lead a shard's list, the best k of them for each query."""
    n_q, n_c = len(queries), len(candidates)
    copies = np.diff(candidates["ids"].combine_chunks().offsets.to_numpy())
    at, out = [], []
    for i, _, lists in _lists(_shards(candidates, queries), n_q, n_c):
        lead = [np.argpartition(-part, k - 1, axis=1)[:, :k] if n_c > k else np.tile(np.arange(n_c), (len(part), 1)) for part in lists]
        for row in range(len(lists[0])):
            seen = np.unique(np.concatenate([x[row] for x in lead]))
            score = sum(part[row, seen] for part in lists)
            order = np.argsort(-score, kind="stable")[:k]
            best = np.repeat(score[order], copies[seen[order]])[:k]
            at += [i + row] * len(best)
            out += _as_long(best)
    return pa.table({"key": queries["key"].take(pa.array(at, pa.int64())), "score": pa.array(out, pa.int64())})


def sufficient_entries(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Phases 2 and 3 in a block: candidates with an entry of cutoff / shards in some list, their scores resolved,
    the best k classes of each query that reach the cutoff."""
    n_q, n_c = len(queries), len(candidates)
    shards = _shards(candidates, queries)
    whole = shards[0][0].dtype == object
    cutoff = queries["cutoff"].to_pylist()
    least = np.array([ids[0] for ids in candidates["ids"].to_pylist()], np.int64)
    at, place, out = [], [], []
    for i, j, lists in _lists(shards, n_q, n_c):
        # no cutoff without k candidates, nor where the k-th score was clipped from below
        need = np.array([-np.inf if c is None or c == -2**63 else c for c in cutoff[i:j]], object if whole else np.float64)[:, None]
        enough = np.zeros(lists[0].shape, bool)
        for part in lists:
            enough |= (part * len(shards) >= need).astype(bool)
        for row in range(j - i):
            some = np.flatnonzero(enough[row])
            score = sum(part[row, some] for part in lists)
            reach = (score >= need[row, 0]).astype(bool)
            some, score = some[reach], score[reach]
            if len(some) > k:       # of scores that tie with the k-th, the least ids
                edge = -np.partition(-score, k - 1)[k - 1]
                near = (score >= edge).astype(bool)
                some, score = some[near], score[near]
            order = np.lexsort((least[some], -score))[:k] if not whole else sorted(range(len(some)), key=lambda x: (-score[x], least[some[x]]))[:k]
            at += [i + row] * len(order)
            place += some[order].tolist()
            out += _as_long(score[order])
    where = pa.array(at, pa.int64())
    keys, found = queries["key"].take(where), candidates.take(pa.array(place, pa.int64()))
    own = [a == b for a, b in zip(keys.to_pylist(), found["key"].to_pylist(), strict=True)]
    return pa.table({"key": keys, "score": pa.array(out, pa.int64()), "ids": found["ids"], "own": pa.array(own, pa.bool_())})


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, *, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` best other rows of every row that ``is_query`` (a condition
    on the columns of ``rows``) selects; equal scores rank by the smaller id."""
    found = staged(classes(vectors(rows, scale, id_col, vec_col), k + 1), "topk-classes")
    asked = staged(vectors(rows.where(is_query), scale, id_col, vec_col), "topk-queries")
    kinds = staged(asked.groupBy("key").agg(F.first("ints").alias("ints")), "topk-kinds")
    n = found.count()
    blocks = max(1, -(-n // min(MAX_BLOCK, max(MIN_BLOCK, n // 64))))
    slices = max(1, -(-kinds.count() // SLICE))

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))     # noqa: E731
    dealt = lambda count: F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    left = found.select("key", "ints", "ids", dealt(blocks).alias("b"), every(slices).alias("s")).groupBy("b", "s")

    def blocked(queries: DataFrame):
        return queries.withColumn("s", dealt(slices)).withColumn("b", every(blocks)).groupBy("b", "s")

    def met(fn, schema: pa.Schema):
        def pair(candidates: pa.Table, queries: pa.Table) -> pa.Table:
            if len(candidates) == 0 or len(queries) == 0:
                return schema.empty_table()
            return fn(candidates, queries, k + 1).cast(schema)
        return pair

    one = pa.schema([("key", pa.binary()), ("score", pa.int64())])
    two = pa.schema([("key", pa.binary()), ("score", pa.int64()), ("ids", pa.list_(pa.int64())), ("own", pa.bool_())])
    entries = left.cogroup(blocked(kinds)).applyInArrow(met(first_entries, one), "key binary, score long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc()))
    cutoffs = entries.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("key").agg(
        F.max(F.when(F.col("n") == k + 1, F.col("score"))).alias("cutoff"))
    armed = staged(kinds.join(cutoffs, "key", "left"), "topk-cutoffs")
    better = left.cogroup(blocked(armed)).applyInArrow(met(sufficient_entries, two), "key binary, score long, ids array<long>, own boolean")
    each = better.select("key", "score", "own", F.explode("ids").alias("id"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "id"))
    best = each.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("nth", "id", "score", "own"))).alias("best"))

    salted = best.withColumn("salt", every(SALTS))
    back = asked.select("id", "key").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    others = F.filter("best", lambda r: ~(r["own"] & (r["id"] == F.col("query_id"))))
    return (back.withColumnRenamed("id", "query_id").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit")["id"].alias("id"), F.col("hit")["score"].alias("score")))
