import random

from churnkit.llm.suffix_dedup import remove_repeats


def brute(rows, span):
    """(id, kept, spans) by a dictionary of all windows, documents in order of id (null first), then text."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - span + 1):
            w = raw[s:s + span]
            if w in seen:
                gone[s:s + span] = [True] * span
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((rows[i][0], bytes(b for b, g in zip(raw, gone) if not g), spans))
    return sorted(out, key=repr)


def run(spark, rows, span, gram, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, did string").repartition(parts)
    got = remove_repeats(df, span, gram).collect()
    return sorted(((r.doc_id, bytes(r.kept), len(r.spans)) for r in got), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            piece = rng.choice(shared)
            a = rng.randint(0, 60)
            t = t[:at] + piece[a:a + rng.randint(20, 200)] + t[at:]
        rows.append((i, t))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 400), (103, ""), (104, None), (105, "ab" * 150), (106, "b" * 99)]
    return rows


def test_matches_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        assert run(spark, rows, 100, 24) == brute(rows, 100)
        assert run(spark, rows, 24, 8) == brute(rows, 24)


def test_ties_nulls_and_repeats(spark):
    t = corpus(9, 5)[0][1] * 3 + "x" * 120
    rows = [(5, t), (5, t), (5, t + "z"), (2, t[7:]), (9, None), (9, "")]
    assert run(spark, rows, 100, 24) == brute(rows, 100)


def test_empty_table(spark):
    assert run(spark, [], 100, 32) == []


def test_hot_phrase_over_many_buckets(spark):
    """One phrase in every document, with other words around it: classes cross bucket boundaries."""
    rng = random.Random(4)
    phrase = "".join(rng.choice("abcdef ") for _ in range(90))
    rows = [(i, f"{rng.choice('xyz')}{i % 7}" + phrase + f"{rng.choice('uvw')}{i % 5} tail " + phrase[:50] + str(i)) for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set(adaptive, "false")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    try:
        assert run(spark, rows, 80, 24, 9) == brute(rows, 80)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set(adaptive, "true")
        spark.conf.set(batch, before)
