import random

import numpy as np

from churnkit.llm.bytesops import U64
from churnkit.llm.dart_minhash import near_duplicates, signatures


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((rows[i][0], rows[find(i)][0]) for i in range(len(rows)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randint(6, 90))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [texts[0]] * 3 + [texts[1].upper(), "one two", "one two", "One Two", "", None, "  "]
    return list(enumerate(texts))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    return sorted((r.doc_id, r.class_id) for r in near_duplicates(df).collect())


def test_classes_match_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert run(spark, []) == []
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (3, "x")], "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert len(got) == 4 and len({r.class_id for r in got}) == 2
    assert all(r.class_id < 0 for r in got if r.doc_id != 3)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 2**62, 300).astype(U64)
    wa, wb = rng.integers(0, 6, 300).astype(float), rng.integers(0, 6, 300).astype(float)
    e = np.concatenate([element, element])
    doc = np.repeat([0, 1], 300)
    w = np.concatenate([wa, wb])
    keep = w > 0
    sig = signatures(e[keep], w[keep], doc[keep], 2, 2048 // 4)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.09


def test_signature_does_not_depend_on_block_or_order():
    rng = np.random.default_rng(5)
    e = rng.integers(1, 2**62, 50).astype(U64)
    one = signatures(e, np.ones(50), np.zeros(50, int), 1)
    two = signatures(e[::-1].copy(), np.ones(50), np.full(50, 2), 3)
    assert (one[0] == two[2]).all() and (two[0] == 0).all()
