import random
import re

from churnkit.llm.winnow_decontam import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(t)


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        if w:
            k = min(13, len(w))
            for i in range(len(w) - k + 1):
                wins.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = wins.get(tuple(w[i:i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, place int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, print int")
    got = contamination(d, b).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr)


def corpus(seed, short):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcé") + rng.choice(["", "x", "Y", "9"])
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 40)))) for i in range(12)]
    items += [(50, None), (51, " ..!"), (None, " ".join(word() for _ in range(20)))]
    if short:
        items += [(60, "b x c"), (61, "a"), (62, "cx cx cx cx cx cx aY"), (62, "é9 é9 É9 é9 a b c a b c a b"), (63, "q " * 30)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            src = words(rng.choice(items)[1] or "z z")
            a = rng.randint(0, max(0, len(src) - 14))
            at = rng.randint(0, len(w))
            w[at:at] = src[a:a + rng.randint(10, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(70, None), (71, ""), (None, items[0][1]), (72, items[1][1]), (72, items[2][1]), (72, items[2][1]), (73, "q " * 500)]
    return docs, items


def test_matches_brute_force(spark):
    for seed, short in ((1, False), (2, True)):
        docs, items = corpus(seed, short)
        assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3, False)
    assert run(spark, [], items) == []
    assert all(r[2] == 0 and not r[4] for r in run(spark, docs[:5], []))


def test_repeated_words_and_long_shared_passages_are_linear(spark):
    """A word repeated 4,000 times against 400 times, and a passage of 60,000 shared words: each within seconds, not the square."""
    import time
    rng = random.Random(7)
    passage = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60_000))
    docs = [(1, "same " * 4000), (2, "clean words here " * 10), (3, "before " * 3 + passage + " after" * 3)]
    items = [(1, "same " * 400), (2, passage), (3, "same")]
    began = time.time()
    got = {r[0]: r for r in run(spark, docs, items)}
    assert time.time() - began < 60
    assert got[1] == (1, 4000, 4000, ["1", "3"], True)
    assert got[2] == (2, 30, 0, [], False)
    assert got[3] == (3, 60_006, 60_000, ["2"], True)
