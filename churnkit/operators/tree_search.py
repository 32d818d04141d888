"""All candidates of a tree grid by held-out AUC, from trees grown and scored in the same tasks (H1).

One deep tree per fold, criterion and least leaf holds its candidates, as limits of depth and rows to split cut it to a prefix. The trees
are those of Spark ML: the same cuts (32 bins; over all rows, where Spark takes 10,000), impurities, order of ties and, for
'entropy', sibling leaves of one class joined. All trees grow together: nodes of more than ``GROUP`` rows are split from histograms, one pass
over the packed rows for a level of every tree; a smaller node is a group, whose rows, those of the held-out fold marked, are shuffled to
one task that grows the subtree and counts the held-out rows by the value of the node where each candidate ends. So no tree
and no score of a row reaches the driver or a table: only counts by candidate, fold and value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .forest import BINS, CELLS, _dealt, _spread, _squeezed, binned
from .vector_blocks import Blocks

#: Rows of a node whose subtree one task grows; distinct values of a feature beyond which its cuts are quantiles.
GROUP, VALUES = 50_000, 10_000
COUNTS = "tree int, node int, candidate int, score double, pos long, neg long"


@dataclass(frozen=True)
class Tree:
    """A tree to grow, and its candidates as (number, depth, least rows to split)."""
    fold: int
    criterion: str
    min_leaf: int
    candidates: tuple[tuple[int, int, int], ...]


def stride_cuts(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Spark's cuts of a feature from its ascending values and their rows: all midpoints, or those nearest to equal shares."""
    n = int(count.sum())
    bins = min(BINS, n)
    if len(value) <= bins:
        return (value[:-1] + value[1:]) / 2
    stride, target, cuts = n / bins, n / bins, []
    current = int(count[0])
    for i in range(1, len(value)):
        before, current = current, current + int(count[i])
        if abs(before - target) < abs(current - target):
            cuts.append((value[i - 1] + value[i]) / 2)
            target += stride
    return np.array(cuts)


def fold_cuts(blocks: Blocks, d: int, folds: int) -> list[list[np.ndarray]]:
    """For every fold the cuts of each feature over the rows of the other folds. ``blocks`` hold (features..., label, fold)."""
    names = [f"n{k}" for k in range(folds)]

    def values(x):
        fold, parts = x[:, d + 1].astype(int), []
        for j in range(d):
            v, at = np.unique(x[:, j], return_inverse=True)
            parts.append((np.full(len(v), j), v, np.bincount(at * folds + fold, minlength=len(v) * folds).reshape(-1, folds)))
        feature, value, count = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(value), *[pa.array(count[:, k]) for k in range(folds)]],
                                          ["feature", "value", *names])

    if not d or not blocks.rows:
        return [[np.zeros(0)] * d] * folds
    seen = written(blocks.rows_of(values, "feature int, value double, " + ", ".join(f"{n} long" for n in names)).where(~F.isnan("value"))
                   .groupBy("feature", "value").agg(*[F.sum(n).alias(n) for n in names]))
    many = sorted(r["feature"] for r in seen.groupBy("feature").count().where(F.col("count") > VALUES).collect())
    few = seen.where(~F.col("feature").isin(many)).orderBy("feature", "value").toPandas()
    quantiles = None
    if many:
        def columns(x):
            return pa.RecordBatch.from_arrays([pa.array(x[:, d + 1]), *[pa.array(x[:, j]) for j in many]], ["fold", *[f"x{j}" for j in many]])
        of = lambda j, k: F.when((F.col("fold") != k) & ~F.isnan(f"x{j}"), F.col(f"x{j}"))         # noqa: E731
        quantiles = blocks.rows_of(columns, "fold double, " + ", ".join(f"x{j} double" for j in many)).agg(
            *[F.percentile_approx(of(j, k), [i / BINS for i in range(1, BINS + 1)], 10_000).alias(f"{j}_{k}") for j in many for k in range(folds)]).first()
    by = {j: (g["value"].to_numpy(), g[names].to_numpy()) for j, g in few.groupby("feature")}
    out = []
    for k in range(folds):
        cuts = []
        for j in range(d):
            if j in many:
                cuts.append(np.unique(quantiles[f"{j}_{k}"] or [0.0])[:-1])       # nothing lies above the greatest value
            else:
                value, count = by.get(j, (np.zeros(0), np.zeros((0, folds), int)))
                own = count.sum(axis=1) - count[:, k]
                cuts.append(stride_cuts(value[own > 0], own[own > 0]) if (own > 0).any() else np.zeros(0))
        out.append(cuts)
    return out


class Cells:
    """Bins of all features side by side, and the cuts between two of one feature."""
    def __init__(self, cuts: Sequence[np.ndarray]):
        size = np.array([len(c) + 1 for c in cuts], int)
        self.first = np.r_[0, np.cumsum(size)[:-1]].astype(int)
        self.width = int(size.sum())
        last = np.zeros(self.width, bool)
        last[self.first + size - 1] = True
        self.at = np.flatnonzero(~last)
        self.feature = np.repeat(np.arange(len(cuts)), size)[self.at]
        self.cut = self.at - self.first[self.feature]

    def counts(self, node: np.ndarray, b: np.ndarray, y: np.ndarray, nodes: int) -> np.ndarray:
        """Rows by (node, bin, label)."""
        cell = ((node * self.width)[:, None] + self.first + b) * 2 + y[:, None]
        return np.bincount(cell.ravel(), minlength=2 * nodes * self.width).reshape(nodes, self.width, 2)

    def best(self, counts: np.ndarray, criterion: str, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node the first split of greatest gain, as (feature, cut, gain), the arithmetic in Spark's order."""
        m = len(counts)
        if not len(self.at):
            return np.zeros(m, int), np.zeros(m, int), np.full(m, -1.0)
        sums = np.concatenate([np.zeros((m, 1, 2), counts.dtype), counts.cumsum(axis=1)], axis=1)
        left = (sums[:, self.at + 1] - sums[:, self.first[self.feature]]).astype(float)
        whole = counts[:, :self.first[1] if len(self.first) > 1 else self.width].sum(axis=1)[:, None].astype(float)
        ln, ls = left.sum(axis=2), left[:, :, 1]
        n, s = whole.sum(axis=2), whole[:, :, 1]
        rn, rs = n - ln, s - ls
        gain = impurity(criterion, n, s) - ln / n * impurity(criterion, ln, ls) - rn / n * impurity(criterion, rn, rs)
        gain[(ln < min_leaf) | (rn < min_leaf)] = -1.0
        k = gain.argmax(axis=1)
        return self.feature[k], self.cut[k], gain[np.arange(m), k]


def impurity(criterion: str, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Spark's variance of 0/1 labels ('gini') or entropy of ``n`` rows with ``s`` of class 1."""
    n = np.maximum(n, 1)
    if criterion == "gini":
        return (s - s * s / n) / n
    out = np.zeros(s.shape)
    for part in ((n - s) / n, s / n):
        out -= part * (np.log(np.where(part > 0, part, 1.0)) / np.log(2))
    return out


@dataclass
class Nodes:
    """Nodes, parents before children; the right child follows the left one. left is -1 at a leaf, -2 at a group's root, -3 where a
    split is still sought. n and s count train rows, pos and neg held-out ones; above is the parent's n."""
    tree: np.ndarray
    depth: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    n: np.ndarray
    s: np.ndarray
    above: np.ndarray

    def more(self, other: Nodes) -> Nodes:
        return Nodes(*[np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)])

    def down(self, b: np.ndarray, root: int):
        """The nodes that rows of bins ``b`` have reached, step by step from ``root``."""
        node, at = np.full(len(b), root), np.arange(len(b))
        yield at, node
        while len(at := at[self.left[node[at]] >= 0]):
            here = node[at]
            node[at] = self.left[here] + (b[at, self.feature[here]] > self.cut[here])
            yield at, node

    def joined(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of the leaf that a node is once sibling leaves of one class are joined, else -1, and whether it is still there;
        ``own`` has the classes of leaves and groups."""
        cls, alive = own.copy(), np.ones(len(own), bool)
        inner = np.flatnonzero(self.left >= 0)
        levels = [inner[self.depth[inner] == k] for k in np.unique(self.depth[inner])]
        for at in reversed(levels):
            a, b = cls[self.left[at]], cls[self.left[at] + 1]
            cls[at] = np.where(a == b, a, -1)
        for at in levels:
            for child in (self.left[at], self.left[at] + 1):
                alive[child] = alive[at] & (cls[at] < 0)
        return cls, alive

    def ends(self, depth: int, min_split: int, leaf: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Nodes where paths end under these limits. Rows grow fewer downwards, so the parent's tell whether a node is reached."""
        reached = alive & (self.above >= min_split) & (self.depth <= depth)
        return reached & (leaf | (self.depth == depth) | (self.n < min_split))


def _fresh(tree, depth, n, s, above, min_leaf, max_depth, group):
    leaf = (s <= 0) | (s >= n) | (n < 2 * min_leaf) | (depth >= max_depth)
    zero = np.zeros(len(n), int)
    return Nodes(tree, depth, zero - 1, zero, np.where(leaf, -1, np.where(n <= group, -2, -3)), n, s, above)


def subtree(b: np.ndarray, y: np.ndarray, held: np.ndarray, cells: Cells, tree: Tree, depth: int, above: int, max_depth: int) -> tuple[Nodes, np.ndarray]:
    """The tree over the rows that are not ``held``, and the held rows (node, label) that pass through its nodes."""
    node, rows = np.zeros(len(b), int), np.arange(len(b))
    y, held = y.astype(int), held.astype(int)
    step = max(1, CELLS // max(cells.width, 1))
    whole, through, base, above = None, [], 0, np.array([above])
    m = 1
    while m:
        c = np.bincount((node * 2 + held[rows]) * 2 + y[rows], minlength=4 * m).reshape(m, 2, 2)
        through.append(c[:, 1])
        n = c[:, 0].sum(axis=1)
        level = _fresh(np.zeros(m, int), np.full(m, depth), n, c[:, 0, 1], above, tree.min_leaf, max_depth, -1)
        live = np.flatnonzero(level.left == -3)
        number = np.full(m, -1)
        number[live] = np.arange(len(live))
        keep = number[node] >= 0
        rows, node = rows[keep], number[node[keep]]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        train = held[rows] == 0
        level.left[live] = -1
        for i in range(0, len(live), step):
            lo, hi = np.searchsorted(node, [i, i + step])
            k = train[lo:hi]
            r, at = rows[lo:hi][k], live[i:i + step]
            f, cut, gain = cells.best(cells.counts(node[lo:hi][k] - i, b[r], y[r], len(at)), tree.criterion, tree.min_leaf)
            split = gain > 0
            level.feature[at[split]], level.cut[at[split]] = f[split], cut[split]
        inner = np.flatnonzero(level.feature >= 0)
        level.left[inner] = base + m + 2 * np.arange(len(inner))
        whole = level if whole is None else whole.more(level)
        keep = level.feature[live][node] >= 0
        rows, at = rows[keep], live[node[keep]]
        node = level.left[at] - base - m + (b[rows, level.feature[at]] > level.cut[at])
        above = np.repeat(level.n[inner], 2)
        base, m, depth = base + m, 2 * len(inner), depth + 1
    return whole, np.concatenate(through)


def ended(nodes: Nodes, through: np.ndarray, tree: Tree, leaf: np.ndarray, alive: np.ndarray) -> list[tuple]:
    """(candidate, scores, positives, negatives) of the held-out rows by the value of the nodes where they end."""
    out = []
    for number, depth, min_split in tree.candidates:
        at = np.flatnonzero(nodes.ends(depth, min_split, leaf, alive) & (through.sum(axis=1) > 0))
        score, group = np.unique(nodes.s[at] / np.maximum(nodes.n[at], 1), return_inverse=True)
        neg, pos = (np.bincount(group, through[at, k], len(score)).astype(np.int64) for k in (0, 1))
        out.append((number, score, pos, neg))
    return out


def _majority(nodes: Nodes) -> np.ndarray:
    return (nodes.s > nodes.n - nodes.s).astype(int)


def _top(blocks: Blocks, cuts: list, trees: Sequence[Tree], d: int, max_depth: int, group: int) -> Nodes:
    """Nodes of more than ``group`` rows and those below them; the first are the roots."""
    spark, folds = blocks.df.sparkSession, len(cuts)
    cells = [Cells(c) for c in cuts]
    count = blocks.sums(lambda x: np.bincount(x[:, d + 1].astype(int) * 2 + (x[:, d] == 1), minlength=2 * folds).astype(float), 2 * folds).reshape(folds, 2)
    other = (count.sum(axis=0) - count).round().astype(int)
    fold, leaf = np.array([t.fold for t in trees]), np.array([t.min_leaf for t in trees])
    n = other[fold].sum(axis=1)
    always = np.full(len(trees), np.iinfo(np.int64).max)        # a root is reached under every limit
    top = _fresh(np.arange(len(trees)), np.zeros(len(trees), int), n, other[fold, 1], always, leaf, max_depth, group)
    while len(open_ := np.flatnonzero(top.left == -3)):
        width = max(c.width for c in cells)
        found, step = [], max(1, CELLS // width)
        for i in range(0, len(open_), step):
            some = open_[i:i + step]
            shared = spark.sparkContext.broadcast((top, some))

            def histograms(x, shared=shared, width=width):
                tree, some = shared.value
                number = np.full(len(tree.left), -1)
                number[some] = np.arange(len(some))
                out, y = np.zeros((len(some), width, 2)), (x[:, d] == 1).astype(int)
                for k in range(folds):
                    rows = np.flatnonzero(x[:, d + 1] != k)
                    b = binned(x[rows, :d], cuts[k])
                    for t in np.unique(tree.tree[some]):
                        if trees[t].fold == k:
                            for _, node in tree.down(b, t):
                                pass
                            at = np.flatnonzero(number[node] >= 0)
                            mine = some[tree.tree[some] == t]
                            place = np.searchsorted(mine, node[at])
                            out[number[mine], :cells[k].width] += cells[k].counts(place, b[at], y[rows[at]], len(mine))
                return out.ravel()

            sums = blocks.sums(histograms, 2 * len(some) * width).reshape(len(some), width, 2)
            shared.unpersist()
            found += [(g, trees[top.tree[g]], sums[j]) for j, g in enumerate(some)]
        top.left[open_] = -1
        fresh = []
        for g, t, sums in found:
            c = cells[t.fold]
            f, cut, gain = (a[0] for a in c.best(sums[None, :c.width], t.criterion, t.min_leaf))
            if gain > 0:
                top.feature[g], top.cut[g] = f, cut
                low = sums[c.first[f]:c.first[f] + cut + 1].sum(axis=0).round().astype(int)
                top.left[g] = len(top.left) + 2 * len(fresh)
                fresh.append((g, low))
        if fresh:
            twice = np.repeat([g for g, _ in fresh], 2)
            n = np.ravel([(low.sum(), top.n[g] - low.sum()) for g, low in fresh])
            s = np.ravel([(low[1], top.s[g] - low[1]) for g, low in fresh])
            top = top.more(_fresh(top.tree[twice], top.depth[twice] + 1, n, s, top.n[twice], leaf[top.tree[twice]], max_depth, group))
    return top


def candidate_aucs(blocks: Blocks, trees: Sequence[Tree], folds: int, group: int | None = None) -> list[tuple[int, int, float | None]]:
    """(candidate, fold, AUC) of all candidates on the fold their tree has not seen; None where it has one class.
    ``blocks`` hold (features..., label, fold)."""
    spark, d = blocks.df.sparkSession, max(blocks.width - 2, 0)
    if not blocks.rows:
        return []
    max_depth = max(depth for t in trees for _, depth, _ in t.candidates)
    cuts = fold_cuts(blocks, d, folds)
    top = _top(blocks, cuts, trees, d, max_depth, GROUP if group is None else group)
    two = [np.array([len(c) <= 1 for c in some], bool) for some in cuts]
    shared = spark.sparkContext.broadcast((top, cuts, two))

    def held_rows(x):
        top, cuts, _ = shared.value
        out, y = np.zeros((len(top.left), 2)), (x[:, d] == 1).astype(int)
        for k in range(folds):
            rows = np.flatnonzero(x[:, d + 1] == k)
            b = binned(x[rows, :d], cuts[k])
            for t in range(len(trees)):
                if trees[t].fold == k:
                    for at, node in top.down(b, t):
                        np.add.at(out, (node[at], y[rows[at]]), 1)
        return out.ravel()

    through = blocks.sums(held_rows, 2 * len(top.left)).reshape(-1, 2)

    def route(x):
        top, cuts, two = shared.value
        out = []
        for k in range(folds):
            b = binned(x[:, :d], cuts[k])
            flat = np.column_stack([_squeezed(b, two[k]), ((x[:, d] == 1) + 2 * (x[:, d + 1] == k)).astype(np.uint8)])
            for t in range(len(trees)):
                if trees[t].fold == k:
                    for _, node in top.down(b, t):
                        pass
                    for g in np.unique(node):
                        if top.left[g] == -2:
                            out.append((t, int(g), flat[node == g].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                                           pa.array([o[2] for o in out], pa.binary())], ["tree", "node", "rows"])

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        top, cuts, two = shared.value
        t, g = (k.as_py() for k in key)
        tree, small = trees[t], two[trees[t].fold]
        width = int((~small).sum()) + -(-int(small.sum()) // 8) + 1
        flat = np.concatenate([np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, width) for raw in table.column("rows")])
        nodes, passed = subtree(_spread(flat[:, :-1].tobytes(), small), flat[:, -1] & 1, flat[:, -1] >> 1, Cells(cuts[tree.fold]), tree,
                                int(top.depth[g]), int(top.above[g]), max_depth)
        cls, alive, leaf = np.full(len(nodes.left), -1), np.ones(len(nodes.left), bool), nodes.left == -1
        if tree.criterion == "entropy":
            cls, alive = nodes.joined(np.where(leaf, _majority(nodes), -1))
            leaf = cls >= 0
        rows = [(-1, [float(cls[0])], [0], [0]), *ended(nodes, passed, tree, leaf, alive)]
        number, score, pos, neg = ([*np.concatenate(p)] for p in zip(*[(np.full(len(v), c), v, a, b) for c, v, a, b in rows], strict=True))
        return pa.table({"tree": pa.array([t] * len(score), pa.int32()), "node": pa.array([g] * len(score), pa.int32()), "candidate": pa.array(number, pa.int32()),
                         "score": pa.array(score, pa.float64()), "pos": pa.array(pos, pa.int64()), "neg": pa.array(neg, pa.int64())})

    parts = written(_dealt(blocks.rows_of(route, "tree int, node int, rows binary")).groupBy("tree", "node").applyInArrow(finish, COUNTS))
    own = np.where(top.left == -1, _majority(top), -1)
    for r in parts.where("candidate < 0").select("node", "score").collect():        # one row per group
        own[r["node"]] = int(r["score"])
    entropy = np.array([t.criterion == "entropy" for t in trees])[top.tree]
    cls, alive = top.joined(np.where(entropy, own, -1))
    leaf = (top.left == -1) | (cls >= 0)
    group_root = top.left == -2
    above = []
    for t, tree in enumerate(trees):
        mine = (top.tree == t) & ~group_root
        for number, score, pos, neg in ended(top, through * mine[:, None], tree, leaf, alive):
            above += [(t, -1, number, float(v), int(p), int(q)) for v, p, q in zip(score, pos, neg, strict=True)]
    gone = [int(g) for g in np.flatnonzero(group_root & ~alive)]
    counts = parts.where((F.col("candidate") >= 0) & ~F.col("node").isin(gone)).unionByName(spark.createDataFrame(above, COUNTS))
    return _aucs(counts, trees)


def _aucs(counts: DataFrame, trees: Sequence[Tree]) -> list[tuple[int, int, float | None]]:
    """Mann-Whitney, ties half, from the rows of both classes by value."""
    by = counts.groupBy("tree", "candidate", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("tree", "candidate").orderBy("score")) - F.col("neg")
    whole = by.withColumn("u", F.col("pos") * (below + 0.5 * F.col("neg"))).groupBy("tree", "candidate").agg(
        F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = whole.select("tree", "candidate", (F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc")).collect()      # one per candidate and fold
    return [(r["candidate"], trees[r["tree"]].fold, r["auc"]) for r in rows]
