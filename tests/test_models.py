import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from churnkit.operators import clustering as CL
from churnkit.operators import kernels as K
from churnkit.operators import models as MD
from churnkit.operators import tuning as TU


@pytest.fixture(scope="module")
def table(spark):
    """Two informative columns and one of noise; split by row number."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3)) * [1.0, 3.0, 0.5] + [0.0, 5.0, 0.0]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 5) + rng.normal(size=600) * 0.7 > 0).astype(int)
    rows = [(i, int(y[i]), ("test", "val", "train", "train", "train")[i % 5], *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, label int, split string, a double, b double, c double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist(), x, y


def test_linear_fits_converge_before_their_bound(table):
    df, _, _ = table
    tr, n = MD.fit_input(df)
    lr = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=MD.MAX_ITER, tol=1e-7).fit(tr)
    svm = LinearSVC(regParam=1.0 / n, standardization=False, maxIter=MD.MAX_ITER, tol=MD.HINGE_TOL).fit(tr)
    assert lr.summary.totalIterations < MD.MAX_ITER and svm.summary().totalIterations < MD.MAX_ITER
    again, _ = MD.logistic(df)
    assert np.allclose(again.coefficients, lr.coefficients, atol=1e-4)


def test_polynomial_terms_use_the_population_std(table):
    df, x, _ = table
    model, _ = MD.polynomial_logistic(df)
    got = model.transform(df.where("row_id in (2, 3)").orderBy("row_id")).select("_polys").collect()
    train = x[[i for i in range(600) if i % 5 > 1]]
    # Spark's order of terms of degree two: a, a*a, b, a*b, b*b, c, a*c, b*c, c*c
    terms = lambda m: np.stack([m[:, 0], m[:, 0] ** 2, m[:, 1], m[:, 0] * m[:, 1], m[:, 1] ** 2, m[:, 2], m[:, 0] * m[:, 2], m[:, 1] * m[:, 2], m[:, 2] ** 2], 1)
    t = terms(train)
    want = (terms(x[[2, 3]]) - t.mean(0)) / t.std(0)
    assert np.allclose(np.array([r[0].toArray() for r in got]), want)


def test_mixture_likelihood_is_that_of_the_returned_parameters(table):
    df, x, _ = table
    m, info, _ = CL.gaussian_mixture(df, 2, max_iter=30)
    total = 0.0
    for row in x:
        parts = [math.log(w) - 0.5 * (np.linalg.slogdet(2 * math.pi * g.cov.toArray())[1]
                                      + (row - g.mean.toArray()) @ np.linalg.inv(g.cov.toArray()) @ (row - g.mean.toArray()))
                 for w, g in zip(m.weights, m.gaussians)]
        top = max(parts)
        total += top + math.log(sum(math.exp(p - top) for p in parts))
    assert abs(info["log_likelihood"] - total) < 1e-6 * abs(total)
    assert abs(info["aic"] - (2 * info["n_params"] - 2 * total)) < 1e-3


def test_nystrom_features_reproduce_the_kernel_on_the_landmarks(table):
    df, _, _ = table
    z = K.landmarks(df, 40)
    root = K.inverse_root(K.kernel_values(z, z, "rbf", 0.1))
    features = K.kernel_values(z, z, "rbf", 0.1) @ root
    assert np.allclose(features @ features.T, K.kernel_values(z, z, "rbf", 0.1), atol=1e-6)
    mapped = K.kernel_map(df, "rbf", m=40, gamma=0.1)
    got = np.array([r[0].toArray() for r in mapped.where("row_id < 5").orderBy("row_id").select("kfeatures").collect()])
    x = np.array([r[0].toArray() for r in df.where("row_id < 5").orderBy("row_id").select("features").collect()])
    assert np.allclose(got, K.kernel_values(x, z, "rbf", 0.1) @ root)


def test_gamma_scale_and_kernel_svm(table):
    df, x, _ = table
    train = x[[i for i in range(600) if i % 5 > 1]]
    assert abs(K.gamma_scale(df) - 1 / (3 * train.var())) < 1e-9
    _, p = K.kernel_svm(df, "rbf", m=60)
    right = p.where("split = 'test'").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.75        # the labels' own noise leaves about 0.83


def test_adaboost_first_round_by_hand(table):
    df, _, _ = table
    stumps, p = MD.adaboost(df, rounds=1)
    assert len(stumps) == 1
    st, alpha = stumps[0]
    err = st.transform(MD.train_rows(df)).agg(F.avg(((F.col(st.getPredictionCol()) >= 0.5).cast("int") != F.col("label")).cast("double"))).first()[0]
    assert abs(alpha - math.log((1 - err) / err)) < 1e-9
    assert {r[0] for r in p.select("score").distinct().collect()} == {0.0, 1.0}


def test_early_stopped_prefix_is_the_first_best(table):
    df, _, _ = table
    (m, k), p = MD.early_stopped_boosting(df, n_trees=8, leaves=4, patience=3)
    assert 1 <= k <= 8 and p.where("score < 0 or score > 1").count() == 0
    row = df.where("row_id = 7")
    margin = sum(w * t.transform(row).first()[t.getPredictionCol()] for t, w in list(zip(m.trees, m.treeWeights))[:k])
    assert abs(p.where("row_id = 7").first()["score"] - 1 / (1 + math.exp(-2 * margin))) < 1e-9


def test_learning_curve_and_stacking(table):
    df, _, _ = table
    rows = TU.learning_curve(df, fractions=(0.2, 1.0), folds=3, models=TU.CURVE_MODELS[:1]).orderBy("fraction").collect()
    assert [r.fraction for r in rows] == [0.2, 1.0] and all(r.val_auc > 0.8 and r.folds == 3 and r.val_std >= 0 for r in rows)
    fams = {"LogisticRegression": TU.DEFAULT_FAMILIES["LogisticRegression"], "DecisionTree": TU.DEFAULT_FAMILIES["DecisionTree"]}
    s = TU.stacking(df, folds=3, families=fams)
    assert s.where("split = 'test'").count() == 120


def test_grids_equal_separate_fits(table):
    """Batched linear candidates and tree prefixes have the AUC of a fit of their own on every fold."""
    df, _, _ = table
    grid = {(r.penalty, r.C): r for r in TU.linear_grid(df, [("l2", (0.01, 1.0), (0.0,)), ("l1", (0.1,), (1.0,))], folds=3).collect()}
    assert sum(r.is_best for r in grid.values()) == 1 and max(grid.values(), key=lambda r: r.mean_auc).is_best == 1
    tr = TU.fold_table(df.select("row_id", "label", "split", "features"), 3)
    for c, penalty in ((0.01, "l2"), (0.1, "l1")):
        own = {r.fold: r.auc for r in TU.roc_auc(TU._fold_fits(tr, 3, lambda d, c=c, p=penalty: MD.logistic(d, c, p)), ["fold"]).collect()}
        assert np.allclose(grid[penalty, c].fold_auc, [own[k] for k in range(3)], atol=1e-4)
    trees = {(r.criterion, r.max_depth): r for r in TU.tree_grid(df, {"depth": (2, 4), "min_split": (2,), "min_leaf": (2,), "criterion": ("gini", "entropy")}, folds=3).collect()}
    own = {r.fold: r.auc for r in TU.roc_auc(TU._fold_fits(tr, 3, lambda d: MD.decision_tree(d, 2, 2)), ["fold"]).collect()}
    assert len(trees) == 4 and np.allclose(trees["gini", 2].fold_auc, [own[k] for k in range(3)], atol=1e-9)
    forests = TU.forest_search(df, {"n_trees": (3, 6), "depth": (2, 4), "min_leaf": (1,), "subsample": (0.8,)}, n_iter=4, folds=2)
    assert forests.count() == 4 and forests.agg(F.min("mean_auc")).first()[0] > 0.7
    cv = TU.logistic_cv(df, (0.01, 1.0), folds=3)
    fit, p = TU.best_linear(df, cv, "Tuned")
    model, _ = MD.logistic(df, fit.problem.C)
    assert np.abs(fit.weights - model.coefficients.toArray()).max() < 1e-4 and p.count() == 600
    kernels = TU.kernel_comparison(df, ("linear", "rbf"), folds=2, m=30).collect()
    assert [len(r.fold_auc) for r in kernels] == [2, 2] and all(r.mean_auc > 0.8 for r in kernels)


def test_hierarchical_covers_all_rows(table):
    df, _, _ = table
    _, lab = CL.hierarchical(df, 3)
    assert lab.select("cluster").distinct().count() == 3 and lab.count() == 600


def test_forest_search_grows_by_groups(table, monkeypatch):
    """One forest per (least leaf, subsample) and fold, grown outside the driver; a candidate's AUC is that of the forest itself."""
    df, _, _ = table
    made = []
    grow = TU.grow_forest
    monkeypatch.setattr(TU, "grow_forest", lambda *a, **k: made.append(grow(*a, **k)) or made[-1])
    got = TU.forest_search(df, {"n_trees": (3, 6), "depth": (2, 4), "min_leaf": (2,), "subsample": (0.8,)}, n_iter=4, folds=2, threads=1).collect()
    assert len(made) == 2 and all(f.nodes.count() == 6 for f in made)
    tr = TU.with_folds(df.select("row_id", "label", "split", "features"), 2)
    full = next(r for r in got if (r.n_trees, r.max_depth) == (6, 4))
    for k, forest in enumerate(made):
        own = TU.roc_auc(forest.score(tr.where(F.col("fold") == k), ["label", "fold"]), ["fold"]).first().auc
        assert full.fold_auc[k] == pytest.approx(own, abs=1e-12)


def test_calibration_equals_separate_fits(table, monkeypatch):
    """The shared passes give the AUCs of one Spark fit per fold, and no Spark fit is left."""
    df, _, _ = table
    want = TU.isotonic_calibration(df, fit=lambda d: MD.logistic(d)).first()
    monkeypatch.setattr(MD, "logistic", None)
    got = TU.isotonic_calibration(df).first()
    assert got.model == "LogisticRegression" and got.auc_before == pytest.approx(want.auc_before, abs=1e-6)
    assert got.auc_after == pytest.approx(want.auc_after, abs=1e-3) and got.improvement == pytest.approx(got.auc_after - got.auc_before)


def test_kernel_svm_reaches_the_least_hinge_sum_in_few_passes(table):
    """No other weights, those of Spark's long run included, have a sum lower by more than the tolerance."""
    df, x, y = table
    fit, p = K.kernel_svm(df, "rbf", m=30)
    assert fit.converged and fit.passes < 80
    at = [i for i in range(600) if i % 5 > 1]
    a, s = fit.expand(x[at]), 2 * y[at] - 1
    total = lambda w, b: np.maximum(0, 1 - s * (a @ w + b)).sum() + (w @ w) / 2     # noqa: E731
    least = total(fit.weights, fit.intercept)
    assert abs(least - fit.objective) < 1e-6 * least
    spark_fit = LinearSVC(featuresCol="kfeatures", regParam=1.0 / len(at), maxIter=300, standardization=False, tol=1e-7).fit(
        MD.train_rows(K.kernel_map(df, "rbf", m=30)).coalesce(1))
    assert least <= total(spark_fit.coefficients.toArray(), spark_fit.intercept) * (1 + 2e-4)
    rng = np.random.default_rng(1)
    for size in (1e-3, 1e-2, 0.1):
        for _ in range(50):
            assert least <= total(fit.weights + size * rng.normal(size=30), fit.intercept + size * rng.normal()) * (1 + 2e-4)
    got = {r.row_id: r.score for r in p.collect()}
    assert len(got) == 600 and max(abs(got[i] - (a[k] @ fit.weights + fit.intercept)) for k, i in enumerate(at)) < 1e-9


def test_kernel_svm_of_one_class(table):
    df, _, _ = table
    fit, p = K.kernel_svm(df.withColumn("label", F.lit(0)), "rbf", m=10)
    assert fit.intercept == -1 and not fit.weights.any() and p.where("prediction = 1").count() == 0
