"""SAMME boosting of weighted depth-1 trees in one pass a round.

A vote of stumps is a sum over features: each stump adds its signed weight to the bins of one feature. So a row's vote V is the sum
of a table (feature, bin) over its bins, its weight is exp(-yV/2) with y = -1 or 1 (SAMME's, up to a common factor), and a round
needs no column of weights: one pass sums the weights by (feature, bin, label), from which the best split, its leaves and its
error follow. Passes cost the same in every round; only the sums, of fixed size, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boosting import Tree
from .forest import BINS, binned, cut_points
from .vector_blocks import Blocks, _matrix, pack


def best_stump(weight: np.ndarray, cuts: Sequence[np.ndarray]) -> tuple[Tree, float, np.ndarray]:
    """The split of least variance of the weights (feature, bin, label), its weighted error, and its votes (-1, 1) as (feature, bin)."""
    low = weight.cumsum(axis=1)[:, :-1]
    whole = weight[0].sum(axis=0)
    high = whole - low
    lw, rw = low.sum(axis=2), high.sum(axis=2)
    valid = (lw > 0) & (rw > 1e-12 * whole.sum()) & (np.arange(BINS - 1) < np.array([len(c) for c in cuts])[:, None])
    with np.errstate(all="ignore"):
        gain = low[:, :, 1] ** 2 / lw + high[:, :, 1] ** 2 / rw - whole[1] ** 2 / whole.sum()
    gain = np.where(valid, gain, -1.0)
    f, c = divmod(int(gain.argmax()), BINS - 1)
    tree, votes = Tree(), np.zeros(weight.shape[:2])
    tree.value[0] = whole[1] / whole.sum()
    if gain[f, c] <= 1e-12 * whole.sum():       # no split: one leaf
        h = 1 if tree.value[0] >= 0.5 else -1
        votes[0] = h
        return tree, float(whole[0 if h > 0 else 1] / whole.sum()), votes
    tree.feature[0], tree.cut[0], tree.threshold[0], tree.left[0] = f, c, float(cuts[f][c]), 1
    wrong = 0.0
    for side, bins in ((low[f, c], slice(0, c + 1)), (high[f, c], slice(c + 1, None))):
        p = side[1] / side.sum()
        tree.feature.append(-1), tree.cut.append(0), tree.threshold.append(0.0), tree.left.append(-1), tree.value.append(p), tree.rows.append(0.0)
        votes[f, bins] = 1 if p >= 0.5 else -1
        wrong += side[0 if p >= 0.5 else 1]
    return tree, float(wrong / whole.sum()), votes


@dataclass
class Stumps:
    """The stumps with their weights, and the votes by (feature, bin)."""
    stumps: list[tuple[Tree, float]]
    cuts: list[np.ndarray]
    votes: np.ndarray

    def score(self, df: DataFrame, keep: Sequence[str], vec: str = "features") -> DataFrame:
        """``keep``... and score, (V / sum of weights + 1) / 2, of every row."""
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        total = sum(a for _, a in self.stumps) or 1.0
        shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.votes))

        def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, votes = shared.value
            for batch in batches:
                if len(batch):
                    v = votes[np.arange(len(cuts)), binned(_matrix(batch), cuts)].sum(axis=1) if len(cuts) else np.zeros(len(batch))
                    yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array((v / total + 1) / 2)], [*keep, "score"])

        return df.select(vector_to_array(vec).alias("x"), *keep).mapInArrow(local, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", score double")


def _binned_blocks(blocks: Blocks, cuts, d: int) -> tuple[Blocks, int]:
    """Rows of (bins, eight to a double; label, fold, key), and the doubles that hold the bins."""
    q = -(-d // 8)

    def make(x: np.ndarray) -> pa.RecordBatch:
        bins = np.zeros((len(x), 8 * q), np.uint8)
        bins[:, :d] = binned(x[:, :d], cuts)
        out = np.zeros((len(x), q + 3))
        out[:, :q] = bins.view(np.float64)
        out[:, q:] = x[:, d:]
        return pa.RecordBatch.from_pydict({"numbers": pa.array([out.tobytes()], pa.binary())})

    held = written(blocks.rows_of(make, "numbers binary")).persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(held, q + 3, blocks.rows, held.rdd.getNumPartitions(), held), q


def fit_stumps(df: DataFrame, rounds: int = 100, rate: float = 1.0) -> Stumps:
    """SAMME on the rows of ``df`` (label 0/1, features); ends where the error is 0 or no less than 1/2."""
    blocks = pack(df, ["label", F.lit(-2), F.lit(0)])
    d = max(blocks.width - 3, 0)
    cuts, votes, stumps = cut_points(blocks, d), np.zeros((d, BINS)), []
    if not d or not blocks.rows:
        blocks.close()
        return Stumps(stumps, cuts, votes)
    state, q = _binned_blocks(blocks, cuts, d)
    blocks.close()
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(votes.copy())

        def weights(x, shared=shared):
            b = np.ascontiguousarray(x[:, :q]).view(np.uint8)[:, :d]
            y, table = x[:, q], shared.value
            used = np.flatnonzero(table.any(axis=1))
            w = np.exp(-(y - 0.5) * table[used, b[:, used]].sum(axis=1))
            cell = (b + np.arange(d) * BINS) * 2 + (y[:, None] == 1)
            return np.bincount(cell.ravel(), np.repeat(w, d), 2 * d * BINS)

        sums = state.sums(weights, 2 * d * BINS).reshape(d, BINS, 2)
        shared.unpersist()
        tree, e, vote = best_stump(sums, cuts)
        if e <= 0 or e >= 0.5:
            if e <= 0:
                stumps.append((tree, 1.0))
                votes += vote
            break
        alpha = rate * math.log((1 - e) / e)
        stumps.append((tree, alpha))
        votes += alpha * vote
    state.close()
    return Stumps(stumps, cuts, votes)
