"""Operator 12 against all scores by brute force, and its SQL."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from churnkit.llm import topk_threshold as TK
from churnkit.llm.queries import ORACLES, QUERIES


def brute(rows, is_query, k):
    """[(query, rank, id, score)] over distinct (id, ints) rows."""
    kept = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, tuple(math.floor(256 * float(x)) for x in v)))
    kept = sorted(kept)
    out = []
    for q in kept:
        if not is_query(q[0]):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q[1], c[1])), c[0]) for c in kept if c != q)    # zip: filled up with zeros
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def _rows(rng, n, width=16):
    rows = []
    hot = [rng.gauss(0, 0.3) for _ in range(width)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            v = hot                                                      # a third of all rows
        elif kind < 0.4:
            v = [x + rng.choice([0.0, 1e-6]) for x in hot]               # other floats, mostly equal integers
        elif kind < 0.5:
            v = [float(rng.choice([0, 1, -1])) / 256 for _ in range(width)]  # many ties
        else:
            v = [rng.gauss(0, 0.2) for _ in range(width)]
        rows.append((i, v))
    return rows


def _search(spark, rows, k=5, parts=6):
    df = spark.createDataFrame([(i, v, i, 0) for i, v in rows], "vec_id long, embedding array<double>, key long, id int").repartition(parts)
    got = TK.top_k(df, F.col("vec_id") % 10 == 0, k).collect()
    return sorted((r.query_id, r.rank, r.id, r.score) for r in got)


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    rng = random.Random(12)
    rows = _rows(rng, 400)
    rows += [(1000, [0.0] * 16), (1001, None), (1010, [None] + [0.1] * 15), (1020, [float("nan")] * 16), (1030, [float("inf")] * 16),
             (None, [0.5] * 16), (1040, [0.25] * 16), (1040, [0.25] * 16), (1050, [-0.25] * 16), (1050, [0.1] * 16)]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert _search(spark, rows) == want
    monkeypatch.setattr(TK, "MIN_BLOCK", 40)
    monkeypatch.setattr(TK, "MAX_BLOCK", 40)
    monkeypatch.setattr(TK, "SLICE", 7)
    assert _search(spark, rows, parts=3) == want


def test_few_rows_lengths_and_large_integers(spark):
    assert _search(spark, []) == []
    assert _search(spark, [(10, [0.5, 0.5])]) == []
    few = [(10, [0.5, 0.5]), (11, [1.0]), (20, []), (30, [0.5, 0.5, 2.0])]
    assert _search(spark, few) == brute(few, lambda i: i % 10 == 0, 5)
    large = [(10 * i, [2.0**18 * (i + 1) + i / 256, -3.0 * i, 2.0**16]) for i in range(12)]
    assert _search(spark, large, k=3) == brute(large, lambda i: True, 3)
    huge = [(10, [2.0**40]), (20, [2.0**41]), (30, [-2.0**41]), (40, [1.0])]
    assert [r for r in _search(spark, huge, k=3) if r[0] == 10] == [(10, 1, 20, 2**63 - 1), (10, 2, 40, 2**56), (10, 3, 30, -2**63)]


def test_cutoff_collects_every_candidate_that_reaches_it():
    """The phases on one block: fewer candidates are resolved than stand in it, and none that counts is missed."""
    rng = np.random.default_rng(3)
    c, q = rng.integers(-60, 60, (500, 32)), rng.integers(-60, 60, (9, 32))
    table = lambda m, **more: pa.table({"key": pa.array([bytes([i % 256, i // 256]) for i in range(len(m))]), "ints": pa.array(m.tolist()), **more})
    cand = table(c, ids=pa.array([[i] for i in range(500)]))
    first = TK.first_entries(cand, table(q), 6).to_pydict()
    scores = q @ c.T
    cut = []
    for i in range(9):
        mine = sorted((s for key, s in zip(first["key"], first["score"]) if key == bytes([i, 0])), reverse=True)
        assert len(mine) == 6 and set(mine) <= set(scores[i].tolist())      # a safe cutoff: real scores of k candidates
        cut.append(mine[5])
    got = TK.sufficient_entries(cand, table(q, cutoff=pa.array(cut)), 6).to_pydict()
    for i in range(9):
        mine = [(s, ids[0]) for key, s, ids in zip(got["key"], got["score"], got["ids"]) if key == bytes([i, 0])]
        assert mine == sorted(((int(s), n) for n, s in enumerate(scores[i])), key=lambda x: (-x[0], x[1]))[:6]


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in _rows(rng, 300, 8)] + [(301, None), (350, [None] * 8)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op12_topk_threshold"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op12_topk_threshold']})").fetchall())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
