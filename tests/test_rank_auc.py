"""Exact AUC of fits over packed rows, and second derivatives of many problems at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector

from churnkit.operators import linear_many as L
from churnkit.operators import rank_auc as R
from churnkit.operators.metrics import roc_auc
from churnkit.operators.vector_blocks import pack


def test_aucs_equal_those_of_the_long_table(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(500, 2)).astype(float)
    rows = [(i, int(rng.random() < 0.4), i % 3, float(rng.random()), [float(v) for v in x[i]]) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, label int, fold int, rank double, a array<double>")
    df = df.select("row_id", "label", "fold", "rank", array_to_vector("a").alias("features")).repartition(3)
    blocks = pack(df, ["label", "fold", "rank"])
    products = L.Polynomial(np.triu_indices(2), np.zeros(5), np.ones(5))
    fits = [L.LinearFit(L.Problem(f"m{j}", leave_fold=k, max_rank=math.inf if j else 0.5), np.array([1.0, -0.5 * j] + [0.3] * (3 * (j == 2))), 0.1, 1, True, 0.0,
                        products if j == 2 else None) for j in range(3) for k in range(3)]
    want = roc_auc(L.seen_and_held(df, fits), ["model", "fold", "part"]).collect()
    monkeypatch.setattr(R, "BUFFER", 300)       # pieces of several sends meet again
    got = R.fit_aucs(blocks, fits, seen=True).collect()
    key = lambda r: (r.model, r.fold, r.part)       # noqa: E731
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 18
    assert np.allclose([r.auc for r in sorted(got, key=key)], [r.auc for r in sorted(want, key=key)], atol=1e-12)
    held = R.fit_aucs(blocks, fits).collect()
    assert {key(r): r.auc for r in held} == {key(r): r.auc for r in got if r.part == "held"}
    one = df.where("label = 1")
    assert all(r.auc is None for r in R.fit_aucs(pack(one, ["label", "fold", "rank"]), fits[:3]).collect())


def test_order_of_keys_and_curvature():
    v = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 1e-300, 2.0, np.inf, np.nan])
    k = R.ordered_key(v)
    assert k[3] == k[4] and (np.diff(k[[0, 1, 2, 3, 5, 6, 7, 8]]) > 0).all()
    rng = np.random.default_rng(2)
    a, w = rng.normal(size=(700, 5)), np.maximum(rng.normal(size=(700, 6)), 0)
    i, j = np.triu_indices(5)
    want = np.array([((a * w[:, [c]]).T @ a)[i, j] for c in range(6)])
    assert np.allclose(L._curvature(a, w, i, j), want) and np.allclose(L._curvature(a, w[:, :2], i, j), want[:2])
