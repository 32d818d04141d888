"""Many linear classifiers fitted together.

Each problem minimises sum(loss) + (1 / C) * ((1 - l1_ratio) / 2 * |w|^2 + l1_ratio * |w|_1)
over the rows it may see: those of other folds than ``leave_fold`` whose rank is at
most ``max_rank``. The loss is ``logistic``, ``squared_hinge`` or ``squared``
(distance to -1 and 1; ridge with alpha is C = 1 / (2 alpha)). All problems advance
by proximal Newton steps at once: one pass over the packed rows gives every
problem's loss, gradient and second derivatives (matrix products per block, one
sum), the driver solves the small quadratic problems, and problems that have
settled leave the later passes. A step that does not lower the objective enough is halved.

Cases: one class gives an intercept that tends to infinity and ends at the bound of
passes with a warning; an empty table gives zero weights; constant columns keep weight 0.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Blocks, _matrix

#: Passes before a fit is given up with a warning, and second derivatives (doubles) of one pass.
MAX_PASSES, CELLS = 200, 500_000
#: Share of the objective below which a step's worth counts as nothing (with an L1 term, steps are inexact).
FLAT, FLAT_L1 = 1e-12, 1e-8


@dataclass(frozen=True)
class Problem:
    name: str
    C: float = 1.0
    l1_ratio: float = 0.0
    leave_fold: int = -1
    max_rank: float = math.inf
    penalise_intercept: bool = False    # as liblinear does


@dataclass
class LinearFit:
    problem: Problem
    weights: np.ndarray
    intercept: float
    passes: int
    converged: bool
    objective: float
    expand: Callable[[np.ndarray], np.ndarray] | None = field(default=None, repr=False)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (self.expand(x) if self.expand else x) @ self.weights + self.intercept


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _derivatives(loss: str, z: np.ndarray, y: np.ndarray):
    """Loss, first and second derivative by z, labels 0/1."""
    s = 2 * y[:, None] - 1
    if loss == "logistic":
        p = sigmoid(z)
        return np.logaddexp(0, -s * z), p - y[:, None], p * (1 - p)
    if loss == "squared":       # distance to the labels -1 and 1
        return (z - s) ** 2, 2 * (z - s), np.full_like(z, 2.0)
    gap = np.maximum(0, 1 - s * z)
    return gap * gap, -2 * s * gap, 2.0 * (gap > 0)


def _curvature(a: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper triangle (``i``, ``j``) of a' diag(w) a for every column w of ``weight`` (none negative): many problems as one product
    with the rows' products of two columns, few or wide ones each on the rows they weigh."""
    m = weight.shape[1]
    out = np.zeros((m, len(i)))
    if m >= 4 and a.shape[1] <= 64:
        for k in range(0, len(a), 512):
            part = a[k:k + 512]
            out += weight[k:k + 512].T @ (part[:, i] * part[:, j])
        return out
    for k in range(m):
        rows = np.flatnonzero(weight[:, k])
        root = a[rows] * np.sqrt(weight[rows, k])[:, None]
        out[k] = (root.T @ root)[i, j]
    return out


def _direction(grad, hess, w, l1):
    """argmin of g.d + d'Hd/2 + sum(l1 * |w + d|) for each problem (rows); coordinate descent where l1 > 0."""
    n, p = grad.shape
    out = np.zeros((n, p))
    ridge = 1e-10 * np.maximum(np.trace(hess, axis1=1, axis2=2) / p, 1e-12)
    hess = hess + ridge[:, None, None] * np.eye(p)
    smooth = (l1 == 0).all(axis=1)
    if smooth.any():
        out[smooth] = np.linalg.solve(hess[smooth], -grad[smooth][:, :, None])[:, :, 0]
    at = np.flatnonzero(~smooth)
    if len(at):
        g, h, v, l1_ = grad[at], hess[at], w[at], l1[at]
        d, hd = np.zeros_like(g), np.zeros_like(g)
        diag = np.einsum("kii->ki", h)
        for _ in range(50):
            moved = np.zeros(len(at))
            for j in range(p):
                b, a = g[:, j] + hd[:, j], diag[:, j]
                c = v[:, j] + d[:, j]
                u = c - b / a
                new = np.sign(u) * np.maximum(np.abs(u) - l1_[:, j] / a, 0)
                step = new - c
                d[:, j] += step
                hd += step[:, None] * h[:, :, j]
                moved = np.maximum(moved, np.abs(step) * np.sqrt(a))
            # the quadratic problem is solved to a share of what its step is worth
            if (moved < 1e-12 + 1e-4 * np.sqrt(np.abs(np.einsum("ki,ki->k", g, d)))).all():
                break
        out[at] = [_polished(*one) for one in zip(g, h, v, l1_, d, strict=True)]
    return out


def _polished(g, h, w, l1, d):
    """The step with its nonzero weights solved exactly, as far as none changes its sign (that one becomes 0, and again)."""
    d = d.copy()
    on = (w + d != 0) | (l1 == 0)
    for _ in range(len(d)):
        c = w + d
        sign = np.sign(c)
        if not on.any():
            break
        rest = h[np.ix_(on, ~on)] @ d[~on]
        to = np.linalg.solve(h[np.ix_(on, on)], -(g[on] + l1[on] * sign[on] + rest))
        crossing = (l1[on] > 0) & ((w[on] + to) * sign[on] < 0)
        if not crossing.any():
            d[on] = to
            break
        share = np.where(crossing, c[on] / np.where(crossing, c[on] - (w[on] + to), 1), 1.0)
        first = int(share.argmin())
        place = np.flatnonzero(on)
        d[place] += share[first] * (to - d[place])
        d[place[first]] = -w[place[first]]
        on[place[first]] = False
    return d


def fit_many(blocks: Blocks, problems: Sequence[Problem], loss: str = "logistic", *, n_features: int | None = None,
             expand: Callable[[np.ndarray], np.ndarray] | None = None, tol: float = 1e-7, max_passes: int = MAX_PASSES) -> list[LinearFit]:
    """Fits of all ``problems`` over blocks of (features..., label, fold, rank); ``expand`` maps a block's features to
    ``n_features`` others."""
    d = blocks.width - 3
    p = (n_features or max(d, 0)) + 1
    per_pass = max(1, CELLS // (p * p))
    out: list[LinearFit] = []
    for i in range(0, len(problems), per_pass):
        out += _fit(blocks, list(problems[i:i + per_pass]), loss, d, p, expand, tol, max_passes)
    return out


def _fit(blocks, problems, loss, d, p, expand, tol, max_passes) -> list[LinearFit]:
    k = len(problems)
    scale = np.array([1 / q.C for q in problems])
    l1 = np.outer(scale * [q.l1_ratio for q in problems], np.ones(p))
    l2 = np.outer(scale * [1 - q.l1_ratio for q in problems], np.ones(p))
    free = np.array([not q.penalise_intercept for q in problems])
    l1[free, -1] = l2[free, -1] = 0
    fold = np.array([q.leave_fold for q in problems], float)
    rank = np.array([q.max_rank for q in problems])

    upper = np.triu_indices(p)
    w, trial = np.zeros((k, p)), np.zeros((k, p))
    best, slope, step, move = np.full(k, np.inf), np.zeros(k), np.ones(k), np.zeros((k, p))
    settled, passes = np.zeros(k, bool), np.zeros(k, int)
    for _ in range(max_passes if blocks.rows else 0):
        at = np.flatnonzero(~settled)
        if len(at) == 0:
            break
        spark = blocks.df.sparkSession
        shared = spark.sparkContext.broadcast((trial[at], fold[at], rank[at]))      # of the problems' size
        m = len(at)

        def one(x, shared=shared, m=m):
            v, f, r = shared.value
            a = np.column_stack([expand(x[:, :d]) if expand else x[:, :d], np.ones(len(x))])
            y = x[:, d]
            seen = (x[:, d + 1][:, None] != f) & (x[:, d + 2][:, None] <= r)
            value, first, second = _derivatives(loss, a @ v.T, y)
            return np.concatenate([(value * seen).sum(axis=0), ((first * seen).T @ a).ravel(), _curvature(a, second * seen, *upper).ravel()])

        total = blocks.sums(one, m * (1 + p + len(upper[0])))
        shared.unpersist()
        passes[at] += 1
        t = trial[at]
        value = total[:m] + (l2[at] * t * t).sum(axis=1) / 2 + (l1[at] * np.abs(t)).sum(axis=1)
        grad = total[m:m + m * p].reshape(m, p) + l2[at] * t
        hess = np.empty((m, p, p))
        hess[:, upper[0], upper[1]] = hess[:, upper[1], upper[0]] = total[m + m * p:].reshape(m, -1)
        hess += l2[at][:, :, None] * np.eye(p)
        good = (value <= best[at] + 1e-4 * step[at] * slope[at] + 1e-12 * np.abs(value)) | ~np.isfinite(best[at])
        back = at[~good]
        step[back] /= 2
        trial[back] = w[back] + step[back][:, None] * move[back]
        settled[back[step[back] < 1e-10]] = True
        ok = at[good]
        if len(ok) == 0:
            continue
        w[ok], best[ok] = trial[ok], value[good]
        move[ok] = _direction(grad[good], hess[good], w[ok], l1[ok])
        slope[ok] = (grad[good] * move[ok]).sum(axis=1) + (l1[ok] * (np.abs(w[ok] + move[ok]) - np.abs(w[ok]))).sum(axis=1)
        step[ok] = 1.0
        trial[ok] = w[ok] + move[ok]
        # settled where the next step is small, or worth nothing (collinear columns leave flat directions)
        settled[ok] = ((np.abs(move[ok]).max(axis=1) <= tol * (1 + np.abs(w[ok]).max(axis=1)))
                       | (slope[ok] >= -FLAT * np.maximum(np.abs(best[ok]), 1)))
    for q, done in zip(problems, settled, strict=True):
        if blocks.rows and not done:
            warnings.warn(f"{q.name}: stopped after {max_passes} passes before it settled", stacklevel=3)
    return [LinearFit(q, w[j, :-1].copy(), float(w[j, -1]), int(passes[j]), bool(settled[j]), float(best[j]), expand)
            for j, q in enumerate(problems)]


def score_many(df: DataFrame, fits: Sequence[LinearFit], *, probability: bool = True, keep: Sequence[str] = ("row_id", "label", "split"),
               vec: str | Column = "features", held_out: bool = False) -> DataFrame:
    """The long predictions table (``keep``..., model, score, prediction) of all fits.

    score is the probability, or the margin. With ``held_out`` a row is scored only by the fits that left its
    ``fold`` out, so that each row has one score per model.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    order = {name: k for k, name in enumerate(keep)}
    fields.sort(key=lambda f: order[f.name])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", model string, score double, prediction int"
    names = pa.array([q.problem.name for q in fits])
    folds = np.array([q.problem.leave_fold for q in fits])
    shared = df.sparkSession.sparkContext.broadcast(list(fits))
    cols = [(vec if isinstance(vec, Column) else vector_to_array(vec)).alias("x"), *keep, *([F.col("fold").alias("_fold")] if held_out else [])]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            margins = np.column_stack([q.margin(x) for q in shared.value])
            if held_out:
                row, fit = np.nonzero(batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)[:, None] == folds)
            else:
                row, fit = (a.ravel() for a in np.indices(margins.shape))
            z = margins[row, fit]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(1 + k).take(take) for k in range(len(keep))], names.take(pa.array(fit)),
                 pa.array(sigmoid(z) if probability else z), pa.array((z > 0 if not probability else sigmoid(z) >= 0.5).astype(np.int32))],
                [*keep, "model", "score", "prediction"])

    return df.select(*cols).mapInArrow(score, schema)


def seen_and_held(df: DataFrame, fits: Sequence[LinearFit], vec: str = "features") -> DataFrame:
    """(model, fold, part, label, score): each fit's margins of its own training rows (``train``: other folds, rank within
    its limit) and of the fold it left out (``held``). ``df`` has label, fold, rank."""
    shared = df.sparkSession.sparkContext.broadcast(list(fits))
    names = pa.array([q.problem.name for q in fits])
    folds, limits = (np.array([getattr(q.problem, a) for q in fits]) for a in ("leave_fold", "max_rank"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            margins = np.column_stack([q.margin(_matrix(batch)) for q in shared.value])
            fold, rank = (batch.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (2, 3))
            held = fold == folds
            row, fit = np.nonzero(held | (rank <= limits))
            part = pa.array(np.where(held[row, fit], "held", "train"))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(fit)), pa.array(folds[fit], pa.int32()), part,
                                              batch.column(1).take(pa.array(row)), pa.array(margins[row, fit])],
                                             ["model", "fold", "part", "label", "score"])

    cols = [vector_to_array(vec).alias("x"), F.col("label").cast("int").alias("label"), "fold", F.col("rank").cast("double").alias("rank")]
    return df.select(*cols).mapInArrow(score, "model string, fold int, part string, label int, score double")


@dataclass
class Polynomial:
    """All features and products of two, less ``mean``, over ``std``."""
    pairs: tuple[np.ndarray, np.ndarray]
    mean: np.ndarray
    std: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, x[:, self.pairs[0]] * x[:, self.pairs[1]]])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.raw(x) - self.mean) / self.std


def polynomial(blocks: Blocks, d: int) -> tuple[Polynomial, int]:
    """all products of at most two features, standardised by the mean and population std over ``blocks``."""
    pairs = np.triu_indices(d)
    size = d + len(pairs[0])
    whole = Polynomial(pairs, np.zeros(size), np.ones(size))
    n = max(blocks.rows, 1)
    mean = blocks.sums(lambda x: whole.raw(x[:, :d]).sum(axis=0), size) / n
    # a second pass about the mean: sums of squares of large numbers lose digits
    std = np.sqrt(blocks.sums(lambda x: ((whole.raw(x[:, :d]) - mean) ** 2).sum(axis=0), size) / n)
    std[std < 1e-12] = 1.0
    return Polynomial(pairs, mean, std), size
