"""Bisecting k-means over packed rows.

Spark ML's method step by step: clusters of more than one distinct row are split, the largest first where fewer are needed, each from
two centres beside its mean (mean -+ 1e-4 |mean| times a random vector, ``java.util.Random`` of the seed) by at most
``max_iter`` Lloyd steps; all clusters of a level are split in the same passes. Spark ML runs all ``max_iter`` passes, each over rows as
objects; here a pass is a matrix product over blocks (vector_blocks) and the passes of a level end once its centres rest, after which
more of them would change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Blocks

#: Levels of splits (Spark's bound), share of a centre's size below which its move is rounding.
LEVELS, REST = 100, 1e-13


class _JavaRandom:
    """nextDouble of java.util.Random."""
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - bits)

    def double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * 2.0 ** -53


@dataclass
class Bisected:
    """``centers`` by node number (root 1, children 2n and 2n + 1)."""
    centers: dict[int, np.ndarray]
    passes: int

    def children(self, n: int) -> list[int]:
        return [c for c in (2 * n, 2 * n + 1) if c in self.centers]

    def leaves(self, n: int = 1) -> list[int]:
        below = self.children(n)
        return [leaf for c in below for leaf in self.leaves(c)] if below else [n]

    def clusterCenters(self) -> list[np.ndarray]:
        return [self.centers[n] for n in self.leaves()]

    def places(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node, inner = np.ones(len(x), np.int64), [1]
        while inner:
            following = []
            for n in inner:
                below = self.children(n)
                rows = np.flatnonzero(node == n) if below else ()
                if len(rows):
                    far = np.column_stack([((x[rows] - self.centers[c]) ** 2).sum(axis=1) for c in below])
                    node[rows] = np.array(below)[far.argmin(axis=1)]
                following += below
            inner = following
        return node

    def column(self, vec: str = "features") -> Column:
        """The number of a row's leaf, from left to right."""
        x, number = vector_to_array(vec), {n: i for i, n in enumerate(self.leaves())}

        def far(c: int) -> Column:
            center = F.array(*[F.lit(float(v)) for v in self.centers[c]])
            return F.aggregate(F.zip_with(x, center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v)

        def at(n: int) -> Column:
            below = self.children(n)
            if not below:
                return F.lit(number[n])
            return at(below[0]) if len(below) == 1 else F.when(far(below[0]) <= far(below[1]), at(below[0])).otherwise(at(below[1]))
        return at(1)

    def transform(self, df: DataFrame, vec: str = "features", out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column(vec))


def bisect(blocks: Blocks, k: int, seed: int = 42, max_iter: int = 100) -> Bisected:
    """At most ``k`` clusters of the rows of ``blocks`` (features alone)."""
    d, random = blocks.width, _JavaRandom(seed)

    def summed(tree: Bisected, wanted: list[int]) -> np.ndarray:
        """Number, sum and sum of squares of the rows of the ``wanted`` leaves."""
        def one(x):
            place, out = tree.places(x), np.zeros((len(wanted), d + 2))
            for i, n in enumerate(wanted):
                part = x[place == n]
                out[i] = [len(part), *part.sum(axis=0), (part * part).sum()]
            return out.ravel()
        return blocks.sums(one, len(wanted) * (d + 2)).reshape(-1, d + 2)

    def centre(row: np.ndarray) -> np.ndarray:
        return row[1:-1] / max(row[0], 1)

    if not blocks.rows:
        return Bisected({1: np.zeros(d)}, 0)
    tree = Bisected({1: np.zeros(d)}, 1)
    active = {1: summed(tree, [1])[0]}
    tree.centers[1] = centre(active[1])
    needed, level = k - 1, 1
    while active and needed > 0 and level < LEVELS:
        cost = {n: max(row[-1] - row[0] * (centre(row) ** 2).sum(), 0.0) for n, row in active.items()}
        split = [n for n, row in active.items() if row[0] >= 1 and cost[n] > np.finfo(float).eps * row[0]]
        split = sorted(split, key=lambda n: -active[n][0])[:needed] if len(split) > needed else split
        if not split:
            break
        for n in sorted(split):
            mean = tree.centers[n]
            noise = 1e-4 * np.sqrt((mean * mean).sum()) * np.array([random.double() for _ in range(d)])
            tree.centers |= {2 * n: mean - noise, 2 * n + 1: mean + noise}
        rows: dict[int, np.ndarray] = {}
        for _ in range(max_iter):
            wanted = [c for n in sorted(split) for c in tree.children(n)]
            got = dict(zip(wanted, summed(tree, wanted), strict=True))
            tree.passes += 1
            rested = all(row[0] > 0 and np.abs(centre(row) - tree.centers[c]).max() <= REST * max(np.abs(tree.centers[c]).max(), 1.0) for c, row in got.items())
            for c in wanted:
                if got[c][0] > 0:
                    tree.centers[c] = centre(got[c])
                else:
                    del tree.centers[c]         # no rows: its parent keeps one child
            rows = {c: row for c, row in got.items() if row[0] > 0}
            if rested:
                break
        active, needed, level = rows, needed - len(split), level + 1
    return tree
