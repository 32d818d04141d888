"""DBSCAN against a plain search of all pairs."""

from __future__ import annotations

import random

import pytest

from churnkit.operators.components import connected_components
from churnkit.operators.dbscan import dbscan


def brute(rows, eps, m):
    ids = [r[0] for r in rows]
    pt = {r[0]: r[1:] for r in rows}
    near = {i: [j for j in ids if sum((a - b) ** 2 for a, b in zip(pt[i], pt[j])) <= eps * eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= m}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack, label[i] = [i], i
            while stack:
                for j in near[stack.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        stack.append(j)
    number = {x: k for k, x in enumerate(sorted(set(label.values())))}
    out = []
    for i in ids:
        own = [number[label[j]] for j in near[i] if j in core]
        out.append((i, number[label[i]] if i in core else min(own, default=-1), int(i in core)))
    return sorted(out)


def _points(rng, d, n):
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            p = [0.3] * d                                       # a third at one place
        elif kind < 0.6:
            p = [rng.gauss(2, 0.05) for _ in range(d)]          # a dense blob over several cells
        elif kind < 0.7:
            p = [2.0 + rng.choice([0, 0.5, 0.51]) + rng.gauss(0, 0.02), *[2.0] * (d - 1)]
        else:
            p = [round(rng.uniform(0, 5), 1) for _ in range(d)]
        out.append((i * 3, *[float(x) for x in p]))
    return out


@pytest.mark.parametrize("d,eps,m", [(2, 0.3, 5), (1, 0.05, 4), (4, 0.9, 4)])
def test_equals_all_pairs(spark, d, eps, m):
    rows = _points(random.Random(d), d, 160)
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"c{i} double" for i in range(d))).repartition(3)
    got = sorted(tuple(r) for r in dbscan(df, [f"c{i}" for i in range(d)], eps, m).collect())
    assert got == brute(rows, eps, m)


def test_dense_cells_are_joined_only_by_near_points(spark):
    """Two dense columns of points whose cells are neighbours: 0.31 apart is not joined, 0.3 is."""
    rows = []
    for k, x in enumerate((0.01, 0.32, 1.0, 1.299999)):
        rows += [(100 * k + i, x, 0.002 * i) for i in range(30)]
    df = spark.createDataFrame([(*r, None if r[0] else "x") for r in rows] + [(990, None, 1.0, ""), (991, float("nan"), 1.0, "")],
                               "row_id long, c0 double, c1 double, cluster string")
    got = {r.row_id: r.cluster for r in dbscan(df, ["c0", "c1"], 0.3, 5).collect()}
    assert got[990] == got[991] == -1
    assert [got[0], got[100], got[200], got[300]] == [0, 1, 2, 2]
    assert dbscan(df.limit(0), ["c0", "c1"], 0.3, 5).count() == 0


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 20], "a long, b long")
    got = {r.node: r.label for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(n)}
