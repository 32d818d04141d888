"""Operator 11 against a search of all lags, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from churnkit.llm import periodic_runs as PR
from churnkit.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period): every lag, then the smallest period of each stretch."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)       # lags ascend: the first is the smallest period
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_collapsed(words, runs) -> str:
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _periodic(rng, letters, period, length):
    unit = [rng.choice(letters) for _ in range(period)]
    return (unit * (length // period + 1))[:length]


def _texts(rng):
    out = []
    for _ in range(150):
        letters = [chr(97 + i) for i in range(rng.choice([1, 2, 3, 26]))] + ["né"]
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [rng.choice(letters) for _ in range(rng.randint(0, 60))]
            q = rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 14, 16, 17, 18, 23, 24, 25, 31, 40, 57, 80])
            words += _periodic(rng, letters, q, rng.randint(q, 5 * q + 30))
        out.append(words)
    return out


def test_runs_equal_all_lags_brute_force(spark):
    rng = random.Random(11)
    docs = _texts(rng)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w) + rng.choice(["", " ", "\x0b"]), 7) for i, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(5)
    got = PR.periodic_runs(df).collect()
    assert len(got) == len(docs)
    n_runs = 0
    for r in got:
        want = brute(docs[r.doc_id])
        assert [(x.start, x.length, x.period) for x in r.runs] == want, r.doc_id
        assert r.n_words == len(docs[r.doc_id])
        assert r.collapsed == brute_collapsed(docs[r.doc_id], want)
        n_runs += len(want)
        if want:
            best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.strongest.start, r.strongest.length, r.strongest.period) == best
        else:
            assert r.strongest is None
    assert n_runs > 150


def test_every_period_is_found_at_three_repeats():
    """The shortest run that counts, at every period of the first scales, alone and between other words."""
    for q in range(1, 200):
        length = max(24, 3 * q)
        ids = np.concatenate([np.arange(10**6, 10**6 + 7), np.tile(np.arange(1, q + 1), length // q + 1)[:length],
                              np.arange(2 * 10**6, 2 * 10**6 + 9)]).astype(np.uint64)
        ids = PR.mix(ids)
        assert PR.find_runs(ids, np.array([len(ids)])).tolist() == [[7, 7 + length, q]]
        assert PR.find_runs(ids[:-10], np.array([len(ids) - 10])).tolist() == []


def test_misleading_hashes_fall_back_to_a_scan(monkeypatch):
    ids = PR.mix(np.concatenate([np.tile(np.arange(1, 21), 5), np.arange(50, 90)]).astype(np.uint64))
    wrong = np.array([[0, 110, 20]])
    assert PR._exact(ids, wrong, np.array([len(ids)]), np.array([len(ids)]), 24, 3).tolist() == [[0, 100, 20]]


def test_edge_rows_and_a_very_long_text(spark):
    long = " ".join(["x"] * 300_000 + [f"w{i}" for i in range(5000)] + [f"u{i % 7000}" for i in range(21_000)])
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 30), (4, "a " * 23), (4, "a " * 24), (4, "a " * 24), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS start", "text AS word")
    got = PR.periodic_runs(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 4}
    for i in (1, 2, 3):
        assert (by[i].n_words, by[i].runs, by[i].strongest, by[i].collapsed) == (0, [], None, "")
    assert (by[None].n_words, by[None].collapsed) == (30, "a")
    assert sorted((r.n_words, len(r.runs)) for r in got if r.doc_id == 4) == [(23, 0), (24, 1), (24, 1)]
    assert [tuple(x) for x in by[5].runs] == [(0, 300_000, 1), (305_000, 21_000, 7000)]
    assert by[5].strongest.period == 1 and len(by[5].collapsed.split()) == 1 + 5000 + 7000
    assert PR.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs = {i: " ".join(w) for i, w in enumerate(_texts(rng))}
    for i in range(150, 400):
        docs[i] = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 120)))
    docs[400] = None
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        words = brute_planted(i, WORD.findall(text or ""))
        runs, r = brute(words), got[i]
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
