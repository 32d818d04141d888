"""Operator 3: files against the tokenizers library, read back frame by frame and byte by byte."""

from __future__ import annotations

import glob
import random
import struct
import zlib

import numpy as np
import pytest

from churnkit.llm.queries import QUERIES
from churnkit.llm.token_frames import FrameFile, read_documents, read_token_files, write_token_files

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
END = 2


@pytest.fixture(scope="module")
def path():
    return public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode(path):
    known = tokenizers.Tokenizer.from_file(path)
    return lambda text: [*known.encode(text or "", add_special_tokens=False).ids, END]


def _rows():
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "42", "漢字", "😀", "x" * 30, "don't", "\t", "\n\n", "<P>", "  "]
    rows = [(i * 7 % 211, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "x", 5) for i in range(200)]
    rows += [(300, None, None, 1), (301, "", "", 1), (None, "no id", "", 1), (302, "same", "", 1), (302, "same", "", 1), (302, "other", "", 1)]
    rows.append((400, "many words of a long text " * 50_000, "", 1))        # 1.3 MB
    return rows


def _written(spark, rows, path, folder, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start long").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")        # several small files
    try:
        return write_token_files(df, str(folder), path, end_id=END)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_round_trip_equals_the_library(spark, path, encode, tmp_path):
    rows = _rows()
    manifest = _written(spark, rows, path, tmp_path / "a", 5)
    assert manifest.count() > 1
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in read_token_files(spark, manifest).collect()]
    got.sort(key=lambda r: r[1])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))        # null ids first, then ids ascending
    assert [r[0] for r in got] == [r[0] for r in want]
    at = 0
    for (doc_id, start, ids, n), row in zip(got, want):
        assert start == at and n == len(ids) and ids == encode(row[1]), doc_id
        at += n
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == at


def test_seek_table_by_hand_and_single_frames(spark, path, encode, tmp_path):
    import xxhash
    import zstandard
    rows = [r for r in _rows() if r[0] is not None and r[0] < 300]
    manifest = _written(spark, rows, path, tmp_path / "b", 3).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    for part in manifest:
        raw = open(part.path.removeprefix("file:"), "rb").read()
        count, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert (count, flags, magic) == (part.n_docs, 0x80, 0x8F92EAB1)
        table = np.frombuffer(raw[-9 - 12 * count:-9], "<u4").reshape(count, 3)
        f, begin = FrameFile(part.path), 0
        for i, (packed, size, check) in enumerate(table.tolist()):
            frame = zstandard.ZstdDecompressor().decompress(raw[begin:begin + packed])
            assert len(frame) == size and xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF == check
            assert np.frombuffer(frame, f"<u{f.width}").tolist() == encode(texts[int(f.ids[i])])
            begin += packed
        middle = int(f.ids[count // 2])
        assert read_documents(part.path, [middle, -5])[middle].tolist() == encode(texts[middle])
        # the whole file is valid zstandard: directory and seek table are skippable frames
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(whole) == int(table[:, 1].sum())


def test_damage_is_detected(spark, path, tmp_path):
    rows = [(i, f"text number {i} with words") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    write_token_files(df, str(tmp_path / "c"), path, end_id=END).collect()
    for name in glob.glob(str(tmp_path / "c" / "*.zst")):
        raw = bytearray(open(name, "rb").read())
        f = FrameFile(name)
        spot = int(f.begin[len(f.ids) // 2 + 1]) - 6                # inside a frame
        raw[spot] ^= 0x10
        broken = name + ".broken"
        open(broken, "wb").write(raw)
        with pytest.raises(Exception):
            for i in range(len(f.ids)):
                FrameFile(broken).tokens(i)
        assert FrameFile(broken).tokens(0).tolist() == f.tokens(0).tolist()         # other frames stay readable
        raw[-1] ^= 1
        open(broken, "wb").write(raw)
        with pytest.raises(ValueError):
            FrameFile(broken)


def test_empty_table_and_query(spark, path, encode, tmp_path):
    empty = write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "d"), path, end_id=END)
    assert empty.count() == 0 and read_token_files(spark, empty).count() == 0
    rows = [(r[0], r[1]) for r in _rows() if r[0] is not None and r[0] < 302]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op3_token_frames"](spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(encode(text), "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
