import random
import zlib

import numpy as np
import pyarrow as pa

from churnkit.llm.bytesops import buffers
from churnkit.llm.fm_classifier import DIMENSION, FactorisationMachine, classify, features, fit, train


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    m = FactorisationMachine(0.3, rng.standard_normal(DIMENSION).astype(np.float32), rng.standard_normal((DIMENSION, 4)).astype(np.float32))
    texts = ["one two two three", "", "Zed é ###"]
    doc, index, value = features(*buffers(pa.array(texts)))
    got = m.margin(doc, index, value, 3)
    for d in range(3):
        i, x = index[doc == d], value[doc == d].astype(float)
        want = 0.3 + (m.linear[i] * x).sum()
        for a in range(len(i)):
            for b in range(a):
                want += float(m.vectors[i[a]] @ m.vectors[i[b]]) * x[a] * x[b]
        assert abs(got[d] - want) < 1e-3


def test_interactions_are_learnt():
    """Two words that only together mean label 1: no linear model can tell."""
    rng = random.Random(2)
    texts, label = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(("red " if a else "blue ") + ("round" if b else "square"))
        label.append(float(a == b))
    doc, index, value = features(*buffers(pa.array(texts)))
    m = fit(doc, index, value, np.array(label), epochs=40, rate=0.3)
    z = m.margin(doc, index, value, len(texts))
    assert ((z > 0) == (np.array(label) > 0)).mean() > 0.98


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(800):
        good = i % 3 > 0
        w = [word() for _ in range(rng.randint(8, 60))]
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), "src", i))
        labels.append((i, int(good), 0))
    rows += [(9001, None, "x", 0), (9002, "", "x", 0), (None, "some words here", "x", 0), (5, rows[5][1], "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score long")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, marks, max_rows=300).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: q for i, q, _ in labels}
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    none = classify(docs, marks.where("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert classify(docs.where("false"), marks).collect() == []


def test_training_rows_do_not_depend_on_repeated_ids_or_partitions(spark):
    """Every labelled id gives one text, whatever the order of its rows, and no other id loses its place."""
    rows = [(i, f"word{i} and more words {i % 7}") for i in range(60)]
    copies = [(7, f"another text {k}") for k in range(300)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(9, 1 - 9 % 2), (9, 9 % 2)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    models = [train(d, marks, max_rows=100, epochs=3) for d in (docs.repartition(7), docs.orderBy(docs.text.desc()).coalesce(1))]
    assert np.array_equal(models[0].linear, models[1].linear) and np.array_equal(models[0].vectors, models[1].vectors)
    texts = dict(rows)
    texts[7] = min((t for i, t in rows + copies if i == 7), key=lambda t: features(*buffers(pa.array([t])))[1].astype("<i4").tobytes())
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    both = sorted((i, float(y)) for i in ids for y in ({0, 1} if i == 9 else {i % 2}))
    doc, index, value = features(*buffers(pa.array([texts[i] for i, _ in both])))
    want = fit(doc, index, value, np.array([y for _, y in both]), epochs=3)
    assert np.array_equal(want.linear, models[0].linear) and np.array_equal(want.vectors, models[0].vectors)
