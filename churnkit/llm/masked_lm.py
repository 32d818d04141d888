"""Operator 4: documents scored by a masked pseudo-likelihood.

A word is predicted from the two words on either side of it:

    P(word | neighbours) = P(class | neighbours) * P(bucket | class)

Words (A-Z lower-cased) fall into ``BUCKETS`` hash buckets. The most frequent
buckets are classes of their own, the others share classes by hash. The second
factor is the buckets' smoothed counts over all documents. The first is a small
network: one embedding table for each place of the window, a tanh layer, a
softmax over the classes; places outside the text have a class of their own.
A document's score is the sum over its words.

Counts and training cover every word of the corpus; the network itself has a fixed
size. Each task counts its documents and trains on their words, starting from the
common weights: round r of ``rounds`` takes the words whose place in the document
is r modulo ``stride``, by default the number of rounds, so that every word is a
target exactly once. Vectors of counts and weights are added up in pieces by key in
two levels, and only sums of fixed size reach the driver. The weights of the tasks
are averaged by the number of words they saw (local SGD).

Cases: a null text is empty; without words the sum is 0 and the mean null; a null
id is kept; repeated rows are scored alike, to the last digit (fixed-point products); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, blocks, buffers, runs
from .shared import texts
from .shingles import word_hashes

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
CLASSES, OWN = 128, 96          # classes 1..OWN are single buckets, class 0 is outside the text
SIDES = (-2, -1, 1, 2)
HIDDEN = 24
#: Numbers of a vector that travel together, and the first level's groups of tasks.
PIECE, GROUPS = 4096, 64
_SIZES = (len(SIDES) * CLASSES * HIDDEN, HIDDEN, HIDDEN * CLASSES, CLASSES)


def summed(rows: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """Sum over all tasks of the float64 vector that ``make`` gives for a task's batches."""
    schema = pa.schema([("piece", pa.int32()), ("salt", pa.int32()), ("numbers", pa.binary())])

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = make(batches)
        salt = TaskContext.get().partitionId() % GROUPS
        cut = range(0, length, PIECE)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(cut)), pa.int32()), pa.array([salt] * len(cut), pa.int32()),
            pa.array([whole[i:i + PIECE].tobytes() for i in cut], pa.binary())], schema=schema)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in parts:
            for piece, salt, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(raw)
                total, key = (own.copy() if total is None else total + own), (piece, salt)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], schema=schema)

    kind = "piece int, salt int, numbers binary"
    one = rows.mapInArrow(local, kind).groupBy("piece", "salt").applyInArrow(add, kind)
    got = {r.piece: np.frombuffer(r.numbers) for r in one.groupBy("piece").applyInArrow(add, kind).collect()}   # length / PIECE rows
    return np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(length)


def _bucket_blocks(batches: Iterable[pa.RecordBatch], column: int = 1):
    """(ids' batch, first document, end document, bucket of every word, its document) of each block."""
    for batch in batches:
        data, off = buffers(batch.column(column))
        for i, j in blocks(off):
            h, doc = word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
            yield batch, i, j, (h >> U64(64 - BUCKET_BITS)).astype(np.int64), doc


@dataclass
class Vocabulary:
    of_bucket: np.ndarray       # class of each bucket
    log_share: np.ndarray       # log P(bucket | class)


def vocabulary(counts: np.ndarray, smooth: float = 0.5) -> Vocabulary:
    order = np.lexsort((np.arange(BUCKETS), -counts))
    of_bucket = 1 + OWN + np.arange(BUCKETS) % (CLASSES - 1 - OWN)
    of_bucket[order[:OWN]] = 1 + np.arange(OWN)
    weight = counts + smooth
    total = np.bincount(of_bucket, weights=weight, minlength=CLASSES)
    return Vocabulary(of_bucket.astype(np.int64), np.log(weight / total[of_bucket]))


def neighbours(classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(words, places) classes around each word; 0 outside its document."""
    n = len(classes)
    out = np.zeros((n, len(SIDES)), np.int64)
    at = np.arange(n)
    for k, side in enumerate(SIDES):
        other = at + side
        ok = (other >= 0) & (other < n)
        ok[ok] = doc[other[ok]] == doc[ok]
        out[ok, k] = classes[other[ok]]
    return out


def whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for |a| <= 1 in fixed point: sums of whole numbers below 2**53 are exact in any order of adding,
    so a row's result does not depend on the rows beside it."""
    size = 2.0**26 / max(float(np.abs(b).max(initial=0)), 1e-30)
    return (np.rint(a * 2.0**20) @ np.rint(b * size)) * (2.0**-20 / size)


class Network:
    """Parameters in one float32 vector: embeddings, hidden bias, output weights, output bias."""

    def __init__(self, vector: np.ndarray):
        self.vector = vector.astype(np.float32)
        e, b, w, c = np.split(self.vector, np.cumsum(_SIZES)[:-1])
        self.embed, self.hidden_bias = e.reshape(len(SIDES), CLASSES, HIDDEN), b
        self.out, self.out_bias = w.reshape(HIDDEN, CLASSES), c

    @classmethod
    def start(cls, class_counts: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        vector = np.concatenate([rng.standard_normal(_SIZES[0]) * 0.1, np.zeros(HIDDEN), rng.standard_normal(_SIZES[2]) * 0.1,
                                 np.log((class_counts + 1) / (class_counts + 1).sum())])
        return cls(vector)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.hidden_bias + sum(self.embed[k][around[:, k]] for k in range(len(SIDES)))
        return np.tanh(total)

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(class | neighbours) of each row."""
        logits = whole_product(self.hidden(around).astype(np.float64), self.out.astype(np.float64))
        logits += self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(target)), target]
        return own - np.log(np.exp(logits, out=logits).sum(axis=1))

    def train(self, around: np.ndarray, target: np.ndarray, memory: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean cross-entropy; ``memory`` keeps the sums of squares."""
        n = len(target)
        h = self.hidden(around)
        p = h @ self.out
        p += self.out_bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= 1 / (n * p.sum(axis=1, keepdims=True))
        p[np.arange(n), target] -= np.float32(1 / n)
        back = (p @ self.out.T) * (1 - h * h)
        row = (around + np.arange(len(SIDES)) * CLASSES).astype(np.int16).ravel()
        order = np.argsort(row, kind="stable")
        first = runs(row[order])
        embed = np.zeros((len(SIDES) * CLASSES, HIDDEN), np.float32)
        embed[row[order[first]]] = np.add.reduceat(back[order // len(SIDES)], first, axis=0)
        g = np.concatenate([embed.reshape(-1), back.sum(axis=0), (h.T @ p).reshape(-1), p.sum(axis=0)])
        memory += g * g
        self.vector -= rate * g / np.sqrt(memory)


@dataclass
class MaskedModel:
    words: Vocabulary
    network: Network

    def score(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Sum of log P(word | neighbours) of each of n documents."""
        target = self.words.of_bucket[bucket]
        around = neighbours(target, doc)
        out = self.words.log_share[bucket].copy()
        for i in range(0, len(target), 4096):
            out[i:i + 4096] += self.network.log_probability(around[i:i + 4096], target[i:i + 4096])
        return np.bincount(doc, weights=out, minlength=n)


def fit(docs: DataFrame, rounds: int = 2, stride: int | None = None, rate: float = 0.15, step: int = 512) -> MaskedModel:
    """Count and train over every row of (doc_id, text); without ``stride`` every word is a target once."""
    stride = stride or rounds
    sc = docs.sparkSession.sparkContext

    def count(batches):
        out = np.zeros(BUCKETS)
        for _, _, _, bucket, _ in _bucket_blocks(batches):
            out += np.bincount(bucket, minlength=BUCKETS)
        return out

    counts = summed(docs, count, BUCKETS)
    words = vocabulary(counts)
    network = Network.start(np.bincount(words.of_bucket, weights=counts, minlength=CLASSES))
    for r in range(rounds):
        shared = sc.broadcast((words, network.vector))       # of fixed size

        def learn(batches, r=r, shared=shared):
            known, vector = shared.value
            own, memory, seen = Network(vector.copy()), np.full(len(vector), 1e-3, np.float32), 0
            for _, _, _, bucket, doc in _bucket_blocks(batches):
                target = known.of_bucket[bucket]
                pick = np.flatnonzero((np.arange(len(target)) - np.searchsorted(doc, doc)) % stride == r % stride)
                around = neighbours(target, doc)[pick]
                for i in range(0, len(pick), step):
                    own.train(around[i:i + step], target[pick[i:i + step]], memory, rate)
                seen += len(pick)
            return np.append(own.vector.astype(np.float64) * seen, seen)

        total = summed(docs, learn, sum(_SIZES) + 1)
        if total[-1] > 0:
            network = Network(total[:-1] / total[-1])
    return MaskedModel(words, network)


def pseudo_likelihood(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum) and mean_log_likelihood of every document."""
    base = texts(docs, id_col, text_col)
    shared = base.sparkSession.sparkContext.broadcast(fit(base, **options))
    names = ["doc_id", "n_words", "log_likelihood"]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, i, j, bucket, doc in _bucket_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.bincount(doc, minlength=j - i)),
                                              pa.array(model.score(bucket, doc, j - i))], names)

    scored = base.mapInArrow(judge, "doc_id long, n_words long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
