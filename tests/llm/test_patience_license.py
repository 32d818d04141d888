import random
import re
from collections import Counter

from churnkit.llm.patience_license import TEMPLATES, patience, scan_licenses


def brute(a, b):
    """The same alignment by definition: recursive, longest increasing subsequence in quadratic time."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + brute(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + brute(a[:-1], b[:-1])
    ca, cb = Counter(a), Counter(b)
    both = [(i, b.index(w)) for i, w in enumerate(a) if ca[w] == 1 and cb[w] == 1]
    if not both:
        return 0
    best = []
    for k, (i, j) in enumerate(both):
        best.append(1 + max([best[x] for x in range(k) if both[x][1] < j], default=0))
    return max(best)


def test_patience_is_a_common_subsequence_at_least_as_long_as_its_anchors():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(25) for _ in range(rng.randint(0, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.randrange(40))
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) >= min(brute(a, b), len(a))
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and patience([], [1]) == []


def test_finds_planted_texts(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    mit, gpl = TEMPLATES["MIT"], TEMPLATES["GPL-3.0"]
    broken = " ".join(w if k % 12 else "changed" for k, w in enumerate(mit.split()))
    words = mit.split()
    rng.shuffle(words)
    rows = [(1, filler(50) + "\n" + mit.upper() + " " + filler(900)), (2, filler(20) + " " + broken), (3, " ".join(words)), (4, filler(400)),
            (5, "Text. Released under the MIT License."), (6, None), (7, ""), (None, gpl), (8, mit + "\n\n" + gpl), (8, "x"), (9, "the " * 3000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, license string").repartition(3)
    got = scan_licenses(df).collect()
    names = sorted(((r.doc_id, sorted(f["license"] for f in r.found)) for r in got), key=repr)
    assert names == sorted([(1, ["MIT"]), (2, ["MIT"]), (3, []), (4, []), (5, ["MIT notice"]), (6, []), (7, []), (None, ["GPL-3.0"]),
                            (8, ["GPL-3.0", "MIT"]), (8, []), (9, [])], key=repr)
    one = next(r for r in got if r.doc_id == 1)
    assert one.found[0]["coverage"] == 1.0 and one.found[0]["start"] == 50
    assert one.found[0]["stop"] - 50 == len(re.findall(r"[A-Za-z0-9]+", mit)) and one.n_words == 950 + one.found[0]["matched"]
    assert scan_licenses(df, {"empty": "..."}).where("size(found) > 0").count() == 0
    assert scan_licenses(df.where("false")).collect() == []


def test_finds_repeated_and_distant_texts(spark):
    """Licences that stand twice, stand late behind ordinary English, or have a stray word far away."""
    rng = random.Random(5)
    common = "this the of to and is a work software in for with that be or any as by on license under".split()
    english = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "w%d" % rng.randrange(5000) for _ in range(n))
    mit, gpl, notice = TEMPLATES["MIT"], TEMPLATES["GPL-3.0"], TEMPLATES["GPL-3.0 notice"]
    changed = " ".join(w if k % 15 else "changed" for k, w in enumerate(mit.split()))
    rows = [(1, f"{english(300)} {mit} {english(2000)} {mit} {english(100)}"), (2, f"This {english(2000)} {notice} {english(50)}"),
            (3, f"{english(200)} {gpl} {english(900)} merchantability {english(40)}"), (4, english(3000)), (5, f"{changed} {changed}"),
            (6, f"{english(50)} {notice} {notice} {english(50)}")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    names = {k: sorted(f["license"] for f in r.found) for k, r in got.items()}
    assert names == {1: ["MIT", "MIT"], 2: ["GPL-3.0 notice"], 3: ["GPL-3.0"], 4: [], 5: ["MIT", "MIT"], 6: ["GPL-3.0 notice"] * 2}
    size = len(re.findall(r"[A-Za-z0-9]+", mit))
    assert sorted(f["start"] for f in got[1].found) == [300, 2300 + size] and all(f["coverage"] == 1 for f in got[1].found)
