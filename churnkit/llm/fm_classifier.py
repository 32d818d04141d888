"""Operator 7: quality classifier, a factorisation machine.

A document's features are its hashed words (log counts, scaled to length 1) and
the bins of statistics of its structure (shares of symbols, capitals, digits,
repeated words, shingles and lines, word length ...) and of its metadata
(characters and lines). All pairs of features interact through vectors of rank
``rank``; a document is scored in time linear in its features by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Training uses at most ``max_rows`` labelled rows, those with the least hash of
their id, each with one text (of rows that share the id, the one whose features
come first in byte order), which bounds what reaches the driver; it is logistic
regression on the score by Adagrad in NumPy. Labels come only from rows whose
crc32(id as text) mod 4 is not 2; labels, id, language and source are no inputs.
Scoring covers every whole text, in tasks.

Cases: a null text is scored as an empty one; a null id is scored and not held
out; repeated rows score alike; without usable labels every score is 0.5; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import BYTE_TABLE, U64, blocks, buffers, prefix_sums, span_hashes, word_spans
from .shared import texts
from .shingles import shingle_block

WORD_BITS = 16
#: Upper ends of the bins of a share, and the number of bins of each statistic.
SHARE_BINS = np.array([0.0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
BINS = 24
STATISTICS = ("symbols", "capitals", "digits", "signs", "exclamations", "other", "newlines", "blanks", "distinct words",
              "neighbours alike", "repeated shingles", "repeated lines", "capital words", "word length", "words", "characters", "lines")
DIMENSION = (1 << WORD_BITS) + BINS * len(STATISTICS)


def _byte_flags() -> dict[str, np.ndarray]:
    """Flag of each byte value, by statistic."""
    out = {}
    for name, members in (("symbols", b"#*$%&|<>"), ("capitals", bytes(range(65, 91))), ("digits", b"0123456789"),
                          ("signs", b".,;:?-()'\"/"), ("exclamations", b"!"), ("newlines", b"\n"), ("blanks", b" ")):
        out[name] = np.isin(np.arange(256), list(members))
    out["other"] = (np.arange(256) < 32) & ~out["newlines"]
    return out


_FLAGS = _byte_flags()


def features(data: np.ndarray, offsets: np.ndarray):
    """(document, feature, value) of the texts data[offsets[i]:offsets[i + 1]]; offsets start at 0."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])     # noqa: E731
    share = lambda count, whole: count / np.maximum(whole, 1)                          # noqa: E731
    start, end, doc = word_spans(data, offsets)
    words = np.bincount(doc, minlength=n)
    key = span_hashes(prefix_sums(data, BYTE_TABLE), start, end)
    # distinct words of each document, with their counts
    bucket = (key >> U64(64 - WORD_BITS)).astype(np.int64)
    pair, count = np.unique(doc * (1 << WORD_BITS) + bucket, return_counts=True)
    of, word = pair >> WORD_BITS, pair & ((1 << WORD_BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(of, weights=value * value, minlength=n))
    value = value / np.maximum(norm[of], 1e-12)

    stats: dict[str, np.ndarray] = {name: share(per(flag[data]), size) for name, flag in _FLAGS.items()}
    alike = np.zeros(len(doc), bool)
    alike[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    stats["distinct words"] = share(np.bincount(of, minlength=n), words)
    stats["neighbours alike"] = share(np.bincount(doc, weights=alike, minlength=n), words)
    _, shingle_doc, shingle_count = shingle_block(data, offsets)
    again = np.bincount(shingle_doc, weights=shingle_count - 1, minlength=n)
    stats["repeated shingles"] = share(again, np.bincount(shingle_doc, weights=shingle_count, minlength=n))
    line_byte = np.ones(256, bool)
    line_byte[10] = False
    a, b, line_doc = word_spans(data, offsets, line_byte)
    lines = np.bincount(line_doc, minlength=n)
    line_key = span_hashes(prefix_sums(data, BYTE_TABLE), a, b)
    order = np.lexsort((line_key, line_doc))
    same = (line_key[order][1:] == line_key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    stats["repeated lines"] = share(np.bincount(line_doc[order][1:][same], minlength=n), lines)
    upper = np.concatenate(([0], np.cumsum(_FLAGS["capitals"][data])))
    stats["capital words"] = share(np.bincount(doc, weights=(upper[end] - upper[start]) * 2 > end - start, minlength=n), words)
    log2 = lambda x: np.minimum(np.floor(np.log2(np.maximum(x, 0) + 1)), BINS - 1).astype(np.int64)
    bins = {name: np.searchsorted(SHARE_BINS, x, side="left") for name, x in stats.items()}
    bins["word length"] = np.minimum(share(np.bincount(doc, weights=end - start, minlength=n), words), BINS - 1).astype(np.int64)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bins["words"], bins["characters"], bins["lines"] = log2(words), log2(np.diff(heads[offsets])), log2(lines)
    fixed = [(1 << WORD_BITS) + BINS * k + bins[name] for k, name in enumerate(STATISTICS)]
    docs = np.arange(n)
    at = np.concatenate([of, *[docs] * len(fixed)])
    index = np.concatenate([word, *fixed])
    weight = np.concatenate([value, np.full(n * len(fixed), 1.0 / np.sqrt(len(fixed)))])
    order = np.argsort(at, kind="stable")
    return at[order], index[order], weight[order].astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray      # (DIMENSION,)
    vectors: np.ndarray     # (DIMENSION, rank)

    def margin(self, doc, index, value, n: int) -> np.ndarray:
        """Score before the logistic function, by the sum-of-squares identity; ``doc`` ascends."""
        out = np.full(n, self.bias)
        if len(doc) == 0:
            return out
        begin = np.searchsorted(doc, np.arange(n))
        has = np.diff(np.append(begin, len(doc))) > 0
        rows = self.vectors[index] * value[:, None]
        total = np.add.reduceat(rows, begin[has], axis=0)
        squares = np.add.reduceat((rows * rows).sum(axis=1), begin[has])
        linear = np.add.reduceat(self.linear[index] * value, begin[has])
        out[has] += linear + 0.5 * ((total * total).sum(axis=1) - squares)
        return out


def fit(doc, index, value, label, rank: int = 8, epochs: int = 12, rate: float = 0.15, penalty: float = 1e-5,
        batch: int = 128, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adagrad over minibatches of documents."""
    rng = np.random.default_rng(seed)
    n = len(label)
    m = FactorisationMachine(0.0, np.zeros(DIMENSION, np.float32), (rng.standard_normal((DIMENSION, rank)) * 0.05).astype(np.float32))
    if n == 0:
        m.vectors[:] = 0
        return m
    begin = np.searchsorted(doc, np.arange(n + 1))
    sum_linear, sum_vectors, sum_bias = np.full(DIMENSION, 1e-6), np.full((DIMENSION, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            part = order[lo:lo + batch]
            sizes = begin[part + 1] - begin[part]
            at = np.repeat(begin[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            row = np.repeat(np.arange(len(part)), sizes)
            i, x = index[at], value[at]
            own = m.vectors[i] * x[:, None]
            first = np.cumsum(sizes) - sizes
            total = np.add.reduceat(own, first, axis=0)
            margin = (m.bias + np.add.reduceat(m.linear[i] * x, first)
                      + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((own * own).sum(axis=1), first)))
            error = (1 / (1 + np.exp(-margin)) - label[part]) / len(part)
            ex = error[row] * x
            touched, inverse = np.unique(i, return_inverse=True)
            g = np.bincount(inverse, weights=ex) + penalty * m.linear[touched]
            sum_linear[touched] += g * g
            m.linear[touched] -= (rate * g / np.sqrt(sum_linear[touched])).astype(np.float32)
            rest = (total[row] - own) * ex[:, None]
            for f in range(rank):
                g = np.bincount(inverse, weights=rest[:, f]) + penalty * m.vectors[touched, f]
                sum_vectors[touched, f] += g * g
                m.vectors[touched, f] -= (rate * 0.3 * g / np.sqrt(sum_vectors[touched, f])).astype(np.float32)
            g = float(error.sum())
            sum_bias += g * g
            m.bias -= rate * g / np.sqrt(sum_bias)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 8000, *, id_col: str = "doc_id",
          text_col: str = "text", **options) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    usable = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("double").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))
    rows = texts(docs, id_col, text_col).join(F.broadcast(usable), "doc_id")     # at most max_rows rows of two numbers
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("feature", pa.binary()), ("value", pa.binary())])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            data, off = buffers(column["text"])
            for i, j in blocks(off):
                doc, index, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                cut = np.searchsorted(doc, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays([
                    column["doc_id"].slice(i, j - i), column["label"].slice(i, j - i),
                    pa.array([x.astype("<i4").tobytes() for x in np.split(index, cut)], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for x in np.split(value, cut)], pa.binary())], schema=schema)

    extracted = rows.mapInArrow(extract, "doc_id long, label double, feature binary, value binary")
    first = extracted.groupBy("doc_id", "label").agg(F.min(F.struct("feature", "value")).alias("row"))   # features move, not texts
    got = first.select("doc_id", "label", "row.*").collect()      # at most max_rows rows
    got.sort(key=lambda r: (r.doc_id, r.label))
    index = [np.frombuffer(r.feature, "<i4") for r in got]
    value = [np.frombuffer(r.value, "<f4") for r in got]
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(got)), [len(x) for x in index]) if got else none
    return fit(doc, np.concatenate(index).astype(np.int64) if got else none,
               np.concatenate(value) if got else none.astype(np.float32), np.array([r.label for r in got]), **options)


def score(docs: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text",
          carry: list[str] | None = None) -> DataFrame:
    """doc_id and score of every row; with ``carry`` also text as it stands and ``extra``, a struct of those columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # of fixed size: DIMENSION x (rank + 1) numbers
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.struct(*carry).alias("extra")] if carry else []))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = buffers(batch.column(1))                  # a null has no bytes
            out = [np.zeros(0)]
            for i, j in blocks(off):
                z = m.margin(*features(data[off[i]:off[j]], off[i:j + 1] - off[i]), j - i)
                out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
            score_column = pa.array(np.concatenate(out))
            if carry:
                yield pa.RecordBatch.from_arrays([batch.column(0), score_column, batch.column(1), batch.column(2)], ["doc_id", "score", "text", "extra"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), score_column], ["doc_id", "score"])

    passed = f", text string, extra {base.schema['extra'].dataType.simpleString()}" if carry else ""
    return base.mapInArrow(judge, f"doc_id long, score double{passed}")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000, *, id_col: str = "doc_id",
             text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (text and extra too with ``carry``), by a model fitted on ``labels``."""
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    scored = score(docs, model, id_col=id_col, text_col=text_col, carry=carry)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), *(["text", "extra"] if carry else []))
