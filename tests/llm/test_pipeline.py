import random

import pytest

from tests.llm.test_dart_minhash import brute as brute_classes
from tests.llm.test_suffix_dedup import brute as brute_repeats
from tests.llm.test_winnow_decontam import brute as brute_hits

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    shared = text(70)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        t = text(rng.randint(30, 120))
        if not good:
            t = " ".join(w + "%%%" for w in t.split())
        elif i % 10 == 1:
            t = t + " " + shared + " " + text(20)
        elif i % 10 == 3:
            t = items[i % 5][1] + " " + text(30)
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), 0))
    for k, i in enumerate((5, 6, 7, 5, 9)):
        w = rows[i][1].split()
        if k % 2:
            w[3] = "changed"
        rows.append((400 + k, " ".join(w), "en", "s", 1))
    rows += [(500, None, None, None, None), (None, text(40), "en", "s", 3), (501, "", "en", "s", 0), (7, rows[7][1], "en", "s", 2)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def test_stages_one_by_one(spark, folder):
    path, rows, labels, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    truth = {i: q for i, q, _ in labels}

    kept = pipeline.quality(spark, docs, path)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    wrong = [i for i, q in truth.items() if (i in ids) != bool(q)]
    assert len(wrong) <= 3, wrong

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    good = docs.where("doc_id is null or doc_id % 4 > 0 or doc_id >= 400 or text is null").persist()
    one = pipeline.near_dedup(spark, good, path)
    assert one.columns == columns
    have = pairs(good.where("doc_id is not null"))
    classes = brute_classes(sorted(have, key=lambda r: r[0]))
    least = {}
    for i, c in classes:
        least[c] = min(i, least.get(c, i))
    assert sorted(r[0] for r in pairs(one) if r[0] is not None) == sorted(set(least.values()))
    assert sum(r[0] is None for r in pairs(one)) == 1

    one = one.persist()
    two = pipeline.suffix_dedup(spark, one, path)
    assert two.columns == columns
    want = sorted(((i, kept.decode("utf-8", "ignore")) for i, kept, _ in brute_repeats(pairs(one), 100)), key=repr)
    assert sorted(pairs(two), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = pipeline.decontamination(spark, one, path)
    assert three.columns == columns
    bad = {(d, n) for d, n, _, _, c in brute_hits(pairs(one), items) if c}
    dirty = {d for d, _ in bad}
    assert dirty and {r[0] for r in pairs(three)} == {r[0] for r in pairs(one)} - dirty

    packed = pipeline.packing(spark, three, path)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in pairs(three)}


def test_run_and_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    out = pipeline.run(spark, path)
    assert out.count() > 150 and "sequence_id" in out.columns
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
