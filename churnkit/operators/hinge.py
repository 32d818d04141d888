"""Linear SVM with the plain hinge in few passes.

Minimises sum(max(0, 1 - s z)) + |w|^2 / (2 C) over weights and a free intercept, z the margin and s the label as -1 or 1. The
hinge is not smooth, and steps by its gradient need hundreds of passes. So the slack of a row and the room above it carry
logarithmic barriers of weight mu, which gives a smooth loss with exact second derivatives; Newton steps (one pass over the
packed rows each) minimise it, and mu falls until the barriers hold the sum within ``tol`` of the least one. A row adds at
most 2 mu to that distance, whatever the data, so the number of passes does not grow with the rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np

from .linear_many import MAX_PASSES, LinearFit, Problem, _curvature, _direction
from .vector_blocks import Blocks

#: First weight of the barriers, its next share, how far (as a share of the barriers' own) a weight is minimised, and shorter steps.
FIRST, FALL, NEAR, STEPS = 1.0, 0.3, 0.2, [2.0 ** -k for k in range(1, 8)]


def barrier_hinge(gap: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """min over the slack v > max(0, gap) of v - mu log(v) - mu log(v - gap), up to a constant, and its derivatives by the gap."""
    s = np.sqrt(gap * gap + 4 * mu * mu)
    far = 4 * mu * mu / (s + np.abs(gap))           # the smaller of s - gap and s + gap, without their rounding
    less, more = np.where(gap > 0, far, s - gap), np.where(gap > 0, s + gap, far)
    slack, room = mu + more / 2, mu + less / 2
    first = mu / room
    return slack - mu * np.log(slack / mu) - mu * np.log(room / mu), first, first * first / (2 * mu) * (less / s)


def fit_hinge(blocks: Blocks, problem: Problem, *, n_features: int | None = None, expand: Callable[[np.ndarray], np.ndarray] | None = None,
              tol: float = 2e-4, max_passes: int = MAX_PASSES) -> LinearFit:
    """The fit over blocks of (features..., label), to a share ``tol`` of the least objective; ``expand`` maps a block's features to
    ``n_features`` others. Rows of one class get zero weights and the margin of their side."""
    d = max(blocks.width - 1, 0)
    p = (n_features or d) + 1
    upper = np.triu_indices(p)
    w, n = np.zeros(p), blocks.rows
    positive = float(blocks.sums(lambda x: np.array([(x[:, d] == 1).sum()], float), 1)[0]) if n else 0.0
    if not 0 < positive < n:
        return LinearFit(problem, w[:-1], float(np.sign(positive - 0.5)) if n else 0.0, 0, True, 0.0, expand)
    l2 = np.full(p, 1 / problem.C)
    l2[-1] = 0.0

    def at(trial: np.ndarray, start: np.ndarray, move: np.ndarray, mu: float):
        """At ``trial`` the barrier objective, objective, gradient and second derivatives; the barrier objective at the shorter steps."""
        def one(x):
            a = np.column_stack([expand(x[:, :d]) if expand else x[:, :d], np.ones(len(x))])
            s = 2 * x[:, d] - 1
            z, from_, by = (a @ np.column_stack([trial, start, move])).T
            gap = 1 - s * z
            value, first, second = barrier_hinge(gap, mu)
            shorter = [barrier_hinge(1 - s * (from_ + t * by), mu)[0].sum() for t in STEPS]
            return np.concatenate([[value.sum(), np.maximum(gap, 0).sum(), *shorter], a.T @ (-s * first), _curvature(a, second[:, None], *upper).ravel()])

        k = 2 + len(STEPS)
        total = blocks.sums(one, k + p + len(upper[0]))
        hess = np.empty((p, p))
        hess[upper] = hess[upper[1], upper[0]] = total[k + p:]
        penalty = lambda v: (l2 * v * v).sum() / 2          # noqa: E731
        return (total[0] + penalty(trial), total[1] + penalty(trial), [total[2 + j] + penalty(start + t * move) for j, t in enumerate(STEPS)],
                total[k:k + p] + l2 * trial, hess + np.diag(l2))

    mu, passes, done, objective = FIRST, 0, False, np.inf
    while not done and passes < max_passes:
        best, slope, move, step, trial = np.inf, 0.0, np.zeros(p), 1.0, w
        while passes < max_passes:
            value, plain, shorter, grad, hess = at(trial, w, move, mu)
            passes += 1
            if np.isfinite(best) and step == 1 and not value <= best + 1e-4 * slope:
                k = int(np.argmin(shorter))
                if shorter[k] >= best:          # rounding is all that is left
                    break
                step = STEPS[k]
                trial = w + step * move
                continue
            w, best, objective = trial, value, plain
            move = _direction(grad[None], hess[None], w[None], np.zeros((1, p)))[0]
            slope, step, trial = float(grad @ move), 1.0, w + move
            if -slope <= NEAR * mu * n:
                break
        done = 2 * mu * n <= tol * objective
        mu *= FALL
    if not done:
        warnings.warn(f"{problem.name}: stopped after {max_passes} passes before it settled", stacklevel=2)
    return LinearFit(problem, w[:-1].copy(), float(w[-1]), passes, done, float(objective), expand)
