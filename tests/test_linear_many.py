"""Batched linear fits against Spark's own optimum, optimality conditions and each problem alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnkit.operators import models as MD
from churnkit.operators.linear_many import Problem, fit_many, polynomial, score_many
from churnkit.operators.vector_blocks import pack


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) * [1, 2, 0.5, 1, 1, 0]
    y = (x @ [0.8, -0.4, 1.0, 0, 0, 0] - 0.5 + rng.logistic(size=900) > 0).astype(int)
    rows = [(i, int(y[i]), "train" if i % 5 else "val", i % 3, i, [float(v) for v in x[i]]) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, label int, split string, fold int, rank int, a array<double>")
    return df.select("row_id", "label", "split", "fold", "rank", array_to_vector("a").alias("features")).repartition(3).persist()


def _blocks(df):
    return pack(MD.train_rows(df), ["label", "fold", "rank"])


def test_same_optimum_as_spark(table):
    b = _blocks(table)
    n = b.rows
    fits = {f.problem.name: f for f in fit_many(b, [Problem("l2"), Problem("l1", C=0.1, l1_ratio=1.0), Problem("net", C=1 / (0.05 * n), l1_ratio=0.5)])}
    for name, model in (("l2", MD.logistic(table)[0]), ("l1", MD.logistic(table, 0.1, "l1")[0]), ("net", MD.elastic_net(table, 0.05)[0])):
        assert fits[name].converged
        assert np.abs(fits[name].weights - model.coefficients.toArray()).max() < 1e-4
        assert abs(fits[name].intercept - model.intercept) < 1e-4
    assert (fits["net"].weights[[3, 4, 5]] == 0).all()
    b.close()


def test_folds_and_ranks_are_left_out_and_problems_do_not_mix(table):
    b = _blocks(table)
    problems = [Problem(f"{c}-{f}-{r}", c, l1, f, r) for c in (0.01, 1e4) for l1 in (0.0, 0.5) for f in (-1, 0, 2) for r in (300, np.inf)]
    together = fit_many(b, problems)
    train = MD.train_rows(table).toPandas()
    x, y = np.stack(train.features.map(lambda v: v.toArray())), train.label.to_numpy()
    for fit in together:
        q = fit.problem
        seen = ((train.fold != q.leave_fold) & (train["rank"] <= q.max_rank)).to_numpy()
        z = x[seen] @ fit.weights + fit.intercept
        g = x[seen].T @ (1 / (1 + np.exp(-z)) - y[seen]) + (1 - q.l1_ratio) / q.C * fit.weights
        limit = q.l1_ratio / q.C
        on = fit.weights != 0
        assert np.abs(g[on] + limit * np.sign(fit.weights[on])).max(initial=0) < 1e-3 * (1 + limit)     # subgradient holds 0
        assert (np.abs(g[~on]) <= limit + 1e-3).all()
        assert abs((1 / (1 + np.exp(-z)) - y[seen]).sum()) < 1e-3
    alone = fit_many(b, [problems[5]])[0]
    assert np.abs(alone.weights - together[5].weights).max() < 1e-6
    b.close()


def test_squared_hinge_and_penalised_intercept(table):
    b = _blocks(table)
    fit = fit_many(b, [Problem("svm", penalise_intercept=True)], loss="squared_hinge")[0]
    train = MD.train_rows(table).toPandas()
    x, s = np.stack(train.features.map(lambda v: v.toArray())), 2 * train.label.to_numpy() - 1
    gap = np.maximum(0, 1 - s * (x @ fit.weights + fit.intercept))
    assert np.abs(x.T @ (-2 * s * gap) + fit.weights).max() < 1e-4
    assert abs((-2 * s * gap).sum() + fit.intercept) < 1e-4
    p = score_many(table, [fit], probability=False)
    got = {r.row_id: (r.score, r.prediction) for r in p.collect()}
    row = train.iloc[0]
    margin = float(np.dot(row.features.toArray(), fit.weights) + fit.intercept)
    assert got[row.row_id][0] == pytest.approx(margin) and got[row.row_id][1] == int(margin > 0)
    b.close()


def test_polynomial_terms_are_standardised_and_fit(table):
    b = _blocks(table)
    expand, size = polynomial(b, 6)
    assert size == 6 + 21
    fit = fit_many(b, [Problem("poly")], n_features=size, expand=expand)[0]
    model = MD.polynomial_logistic(table)[0]
    _, want = MD.polynomial_logistic(table)
    got = score_many(table, [fit]).select("row_id", F.col("score").alias("s"))
    far = want.join(got, "row_id").agg(F.max(F.abs(F.col("score") - F.col("s")))).first()[0]
    assert model is not None and far < 2e-3
    b.close()


def test_held_out_scores_come_from_the_fit_that_left_the_fold_out(table):
    b = _blocks(table)
    fits = fit_many(b, [Problem("m", leave_fold=f) for f in range(3)])
    p = score_many(MD.train_rows(table), fits, keep=("row_id", "label", "fold"), held_out=True)
    assert p.count() == b.rows == p.select("row_id").distinct().count()
    one = p.where("fold = 1").orderBy("row_id").first()
    x = table.where(F.col("row_id") == one.row_id).first().features.toArray()
    assert one.score == pytest.approx(float(1 / (1 + np.exp(-(x @ fits[1].weights + fits[1].intercept)))))
    b.close()


def test_empty_table_and_one_class(table):
    b = pack(table.limit(0), ["label", "fold", "rank"])
    assert b.rows == 0 and fit_many(b, [Problem("none")])[0].passes == 0
    b.close()
    b = pack(table.where("label = 1"), ["label", "fold", "rank"])
    with pytest.warns(UserWarning):
        fit_many(b, [Problem("one", C=1.0)], max_passes=5)
    b.close()
