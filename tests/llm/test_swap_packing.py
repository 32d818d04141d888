import random
import zlib

import numpy as np
import pytest

from churnkit.llm import swap_packing
from churnkit.llm.swap_packing import best_fit, local_search, pack_documents, pack_lengths, sequences

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_local_search_keeps_items_and_never_needs_more_bins():
    rng = random.Random(1)
    better = 0
    for n, top in ((50, 60), (400, 60), (400, 99), (300, 40)):
        sizes = [rng.randint(1, top) for _ in range(n)]
        first = best_fit(sizes, 100)
        second = local_search([list(b) for b in first], sizes, 100)
        assert sorted(i for b in second for i in b) == list(range(n))
        assert all(0 < sum(sizes[i] for i in b) <= 100 for b in second)
        assert len(second) <= len(first)
        better += len(first) - len(second)
    rng = random.Random(5)
    sizes = [rng.randint(250, 400) for _ in range(1200)]        # three or four in a bin: swaps must find the fours
    first = best_fit(sizes, 1024)
    second = local_search([list(b) for b in first], sizes, 1024)
    better += len(first) - len(second)
    assert better > 5
    sizes = [51, 27, 26, 23, 25, 25, 23, 51, 26, 23] * 20      # best fit leaves bins that swaps can empty
    first = best_fit(sizes, 100)
    second = local_search([list(b) for b in first], sizes, 100)
    assert len(second) <= len(first) and sorted(i for b in second for i in b) == list(range(len(sizes)))


def test_pieces_and_sequences(spark):
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["foo", "bar,", "Baz.", "qux\nx", "é l"]) for _ in range(rng.randint(0, 90))), "x") for i in range(60)]
    rows += [(60, None, "y"), (60, "same", "y"), (60, "same", "y"), (None, "lost id", "z"), (61, "word " * 800, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    packed = pack_documents(df, path, 64, 2, with_ids=True)
    got = packed.collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.piece == 0), []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text, _ in rows[:60] + rows[-1:]:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == np.asarray(ids, "<u4").tobytes()
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
        assert all(r.length == 64 for r in mine[1:]) and len(mine) == -(-len(ids) // 64)
    assert len([r for r in got if r.doc_id == 60]) == 3 and len([r for r in got if r.doc_id is None]) == 1
    seq = {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(seq) <= 1.05 * total / 64 + 2
    built = {r.sequence_id: len(r.ids) // 4 for r in sequences(packed).collect()}
    assert sum(built.values()) == total and len(built) == len(seq)


def test_no_group_takes_all_loose_pieces(spark, monkeypatch):
    """Pieces that no swap can bring together stay in groups of the usual size, and a group's search sees all pairs."""
    monkeypatch.setattr(swap_packing, "GROUP_ITEMS", 64)
    items = spark.range(640).selectExpr("id key", "if(id % 10 < 9, 60, 45) length")
    rows = pack_lengths(items, 100).collect()
    assert sorted(r.key for r in rows) == list(range(640))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, 60 if r.key % 10 < 9 else 45))
    assert all(sum(n for _, n in b) <= 100 for b in bins.values()) and len(bins) <= 576 + 32 + 10
    assert len({(s >> 11) >> 20 for s in bins}) > 1      # the last round still has several groups


def test_swaps_try_every_pair():
    """Ten pieces in a bin, of which only the two smallest fill the gap that one piece of the other bin leaves."""
    sizes = [9, 9, 9, 9, 9, 9, 9, 9, 3, 2, 4, 94]
    bins = [list(range(10)), [10, 11]]
    loose = swap_packing._Loose(bins, sizes, 99)
    assert loose.improve(0) and sorted(loose.gap) != [1, 22]
    assert loose.gap[1] == 0 and sorted(bins[1]) == [8, 9, 11]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(df, public.path("byte_bpe_50k.json")).count() == 0
