"""Operator 13 against a plain Python form of its contract, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from churnkit.llm import fill_in_middle as FM
from churnkit.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    parts = UNIT.findall(text)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _rows():
    rng = random.Random(13)
    letters = list("ab<>PSM") + ["é", "漢", "😀", " ", " ", "\x85", "\x00", "\x1c", "\\1", "<", "<P", "M>"]
    blanks = [" ", "\n", "\t", "\r\n", "\x0b", "\x0c", "  "]
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 30))]
        text = rng.choice(["", " ", "\n"]) + "".join(w + rng.choice(blanks) for w in words)
        rows.append((i, text if rng.random() < 0.5 else text.strip(), i % 3))
    rows += [(600, None, 0), (601, "", 0), (602, "  \n ", 0), (603, "a <P> b", 0), (None, "null id text", 1), (604, "same", 0), (604, "same", 0)]
    rows.append((605, "word " * 400_000 + "\n\n", 0))
    rows += [(k, f"  some ünits of {k}\n", 0) for k in range(700, 900)]
    return rows


def test_equals_brute_force_and_round_trips(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, form int").repartition(4)
    got = FM.fill_in_middle(df).withColumn("back", FM.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)        # noqa: E731
    want = sorted(((i, *brute(i, t), t or "") for i, t, _ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert FM.fill_in_middle(df.limit(0)).count() == 0


def test_rates_and_other_sentinels(spark):
    df = spark.createDataFrame([(i, f"one two three {i}") for i in range(300)], "doc_id long, text string")
    every = FM.fill_in_middle(df, seed=7, fim_percent=100, spm_percent=0, sentinels=("[p]", "[s]", "[m]"))
    back = every.withColumn("back", FM.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()
    assert {r.form for r in back} == {"psm"} and all(r.back == f"one two three {r.doc_id}" for r in back)
    assert {r.form for r in FM.fill_in_middle(df, fim_percent=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            FM.fill_in_middle(df, sentinels=bad)


def test_query_digests(spark, tmp_path):
    rows = [r[:2] for r in _rows() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_fill_in_middle"](spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()      # noqa: E731
    want = []
    for i, t in rows:
        n, form, p, m, out = brute(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(tuple(r) for r in got) == sorted(want)
