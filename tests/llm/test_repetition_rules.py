import random
import re

from churnkit.llm.repetition_rules import repetition_rules


def brute(text, min_words=8):
    raw = (text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", raw)
    n = len(w)
    reach = [0] * n
    for p in range(n):
        for q in range(n):
            if p != q:
                k = 0
                while max(p, q) + k < n and w[p + k] == w[q + k]:
                    k += 1
                reach[p] = max(reach[p], k)

    def cover(m):
        hit = [False] * n
        for p in range(n):
            if reach[p] >= m:
                hit[p:p + reach[p]] = [True] * reach[p]
        return hit
    seen, dup = set(), 0
    for line in raw.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    rep = sum(cover(5))
    cov = cover(min_words)
    spans = sum(c and not (k and cov[k - 1]) for k, c in enumerate(cov))
    failed = n < 10 or 100 * rep > 20 * n
    chars = sum(map(len, w))
    cc = sum(len(x) for x, c in zip(w, cov) if c)
    longest = max(reach, default=0)
    covers = 100 * cc > 15 * chars and (cc > 200 or 100 * cc > 25 * chars)      # the production rule
    kept = not failed and not (covers or longest > 40)
    return (n, chars, len(re.findall(r"[#*$%&|<>]", raw)), dup, rep, cc, longest, spans, failed, kept)


def test_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(80):
        words = [rng.choice(["a", "bé", "c#", "d", "x|y"]) if rng.random() < 0.5 else str(rng.randrange(1000)) for _ in range(rng.randint(0, 70))]
        if words and rng.random() < 0.5:
            words = words + words[: rng.randint(1, len(words))] * rng.randint(1, 3)
        rows.append((i, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in words), i))
    rows += [(90, None, 0), (91, "", 0), (92, "the " * 600, 0), (92, "the " * 600, 0), (None, "one\n\none\n two\none", 0), (93, "a b\x1cc d\xa0e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = repetition_rules(df).collect()
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars,
                    r.longest_repeat, len(r.spans), r.base_failed, r.kept) for r in got), key=repr)
    assert have == want


def test_covered_fraction_alone_rejects(spark):
    """18% of a long text in repeats of 30 words goes by the covered fraction; one repeated notice of a short text stays."""
    word = iter(range(100000, 200000))
    fresh = lambda n: " ".join("w%d" % next(word) for _ in range(n))
    passages = [fresh(30) for _ in range(3)]
    long = " ".join([fresh(300), *passages, fresh(520), *passages[::-1]])
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, long), (2, f"{fresh(60)} {notice} {fresh(60)} {notice}"), (3, f"{fresh(1000)} {passages[0]} {passages[0]}")]
    got = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values()) and max(r.longest_repeat for r in got.values()) <= 40
    assert 15 * got[1].word_chars < 100 * got[1].covered_chars < 20 * got[1].word_chars
    assert {k: r.kept for k, r in got.items()} == {1: False, 2: True, 3: True}


def test_empty_table(spark):
    assert repetition_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_that_only_the_covered_share_rejects(spark):
    """A passage of 20 to 30 words that stands twice in a long text, over 15% of its characters but under 20% of its words."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))     # noqa: E731
    rows, want = [], {}
    for i in range(40):
        passage = [word(12) for _ in range(rng.randint(20, 30))]
        rest = [word(5) for _ in range(rng.randint(280, 400))]
        at = len(rest) // 2
        rows.append((i, " ".join(passage + rest[:at] + passage + rest[at:])))
        want[i] = brute(rows[-1][1])
    got = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, b in want.items():
        assert (got[i].base_failed, got[i].kept) == b[-2:]
    assert sum(not r.base_failed and not r.kept for r in got.values()) >= 20
