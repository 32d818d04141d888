"""Classifier families on Spark ML (L1-L16) with one output shape.

Every family fits on the ``split = 'train'`` rows of a feature table with a
``features`` vector and returns the long predictions table
``(row_id, label, split, model, score, prediction)`` for all rows, so that
metrics, curves and ensembles (operators.metrics / ensemble) apply unchanged.
Scores are class-1 probabilities where the model has them, else the
decision value (AUC needs order only).
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boost, fit_boosts, prefix_margins, score_boosts
from .forest import Forest, fit_forest
from .stumps import fit_stumps

KEY = ["row_id", "label", "split"]


def _out(scored: DataFrame, name: str, score, prediction=None) -> DataFrame:
    pred = prediction if prediction is not None else (score >= 0.5).cast("int")
    return scored.select(*KEY, F.lit(name).alias("model"), score.cast("double").alias("score"),
                         pred.cast("int").alias("prediction"))


def _prob1():
    return vector_to_array(F.col("probability"))[1]


#: Upper bound of optimiser steps; fits end earlier, when the tolerance is reached.
MAX_ITER = 500
#: Relative change at which the hinge loss, which is not smooth, counts as settled.
HINGE_TOL = 1e-4


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def fit_input(df: DataFrame, n: int | None = None) -> tuple[DataFrame, int]:
    """Train rows as they are partitioned, and their number."""
    tr = train_rows(df)
    return tr, (n if n is not None else tr.count())


def logistic(df: DataFrame, C: float = 1.0, penalty: str = "l2", name: str = "LogisticRegression",
             max_iter: int = MAX_ITER, n_train: int | None = None):
    """L1/L2: scikit-learn's C maps to regParam = 1 / (C * n_train); no feature standardisation."""
    tr, n = fit_input(df, n_train)
    lr = LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            standardization=False, maxIter=max_iter, tol=1e-7)
    m = lr.fit(tr)
    return m, _out(m.transform(df), name, _prob1())


def elastic_net(df: DataFrame, alpha: float = 0.1, l1_ratio: float = 0.5, name: str = "ElasticNet",
                max_iter: int = MAX_ITER):
    """Exact optimum of the elastic-net logistic objective (instead of SGD)."""
    lr = LogisticRegression(regParam=alpha, elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter)
    m = lr.fit(fit_input(df)[0])
    return m, _out(m.transform(df), name, _prob1())


def polynomial_logistic(df: DataFrame, degree: int = 2, C: float = 1.0, name: str = "PolynomialLogistic",
                        max_iter: int = MAX_ITER):
    """Degree-2 expansion, standardised on the train rows (population std, as F1), then L2 logistic."""
    tr, n = fit_input(df)
    expand = PolynomialExpansion(degree=degree, inputCol="features", outputCol="_poly")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_poly", outputCol="_sample").fit(expand.transform(tr))
    # Spark divides by the sample std; a common factor turns that into the population std
    factor = math.sqrt(n / max(n - 1, 1))
    to_population = ElementwiseProduct(scalingVec=Vectors.dense([factor] * scaler.mean.size), inputCol="_sample", outputCol="_polys")
    lr = LogisticRegression(featuresCol="_polys", regParam=1.0 / (C * n), standardization=False, maxIter=max_iter)
    prepared = PipelineModel(stages=[expand, scaler, to_population])
    m = PipelineModel(stages=[expand, scaler, to_population, lr.fit(prepared.transform(tr))])
    return m, _out(m.transform(df), name, _prob1())


def ridge_classifier(df: DataFrame, alpha: float = 1.0, name: str = "RidgeClassifier"):
    """L4: least squares on +-1 labels with an L2 penalty; class = sign of the fit.

    Spark scales the penalty by the label's std, hence regParam = alpha * std_pop(y) / n.
    """
    tr = train_rows(df).withColumn("_pm1", F.col("label") * 2.0 - 1.0)
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_pm1").alias("sd")).first()
    reg = alpha * (st["sd"] or 1.0) / st["n"]
    m = LinearRegression(labelCol="_pm1", solver="normal", regParam=reg, elasticNetParam=0.0,
                         standardization=False).fit(tr)
    s = m.transform(df)
    return m, _out(s, name, F.col("prediction"), (F.col("prediction") > 0).cast("int"))


def decision_tree(df: DataFrame, max_depth: int = 5, min_leaf: int = 1, name: str = "DecisionTree",
                  max_bins: int = 32, seed: int = 42):
    """Regression tree on the 0/1 label (variance = gini / 2, same splits); leaf mean = probability."""
    m = DecisionTreeRegressor(maxDepth=min(max_depth or 30, 30), minInstancesPerNode=min_leaf,
                              maxBins=max_bins, seed=seed).fit(train_rows(df))
    return m, _out(m.transform(df), name, F.col("prediction"))


def forest_model(df: DataFrame, n_trees: int = 100, max_depth: int = 30, seed: int = 42) -> Forest:
    """L8's model alone: regression trees on 0/1, sqrt feature subsets."""
    return fit_forest(train_rows(df), trees=n_trees, max_depth=max_depth, seed=seed)


def random_forest(df: DataFrame, n_trees: int = 100, max_depth: int = 30, name: str = "RandomForest",
                  seed: int = 42):
    """Forest of regression trees on 0/1 (mean of leaf probabilities), sqrt feature subsets; depth 30 stands for no limit."""
    m = forest_model(df, n_trees, max_depth, seed)
    return m, _out(m.score(df, KEY), name, F.col("score"))


def random_forest_folds(df: DataFrame, folds: int, n_trees: int = 100, max_depth: int = 30, name: str = "RandomForest", seed: int = 42) -> list[DataFrame]:
    """L8 out of fold: for every fold its rows of ``df``, and no others, scored by the forest of the other folds."""
    parts = []
    for k in range(folds):
        m = fit_forest(df.where(F.col("fold") != k), trees=n_trees, max_depth=max_depth, seed=seed)
        parts.append(_out(m.score(df.where(F.col("fold") == k), KEY), name, F.col("score")))
    return parts


def boost(name: str = "GradientBoosting", n_trees: int = 100, max_depth: int = 3, rate: float = 0.1, subsample: float = 1.0, seed: int = 42, *,
          column_share: float = 1.0, min_gain: float = 0.0, min_leaf: int = 1, leave_fold: int = -1) -> Boost:
    """The problem of ``gradient_boosting``; many of them share their passes."""
    return Boost(name, n_trees, max_depth, rate, subsample, column_share, min_gain, min_leaf, leave_fold, seed)


def gradient_boosting(df: DataFrame, n_trees: int = 100, max_depth: int = 3, rate: float = 0.1,
                      subsample: float = 1.0, name: str = "GradientBoosting", seed: int = 42, *,
                      column_share: float = 1.0, min_gain: float = 0.0, min_leaf: int = 1):
    """Logistic-loss boosted trees.

    ``column_share`` (columns tried at a split), ``min_gain`` (of a split) and ``min_leaf`` (rows in a leaf)
    stand for XGBoost's colsample, gamma and child weight.
    """
    p = Boost(name, n_trees, max_depth, rate, subsample, column_share, min_gain, min_leaf, seed=seed)
    m = fit_boosts(train_rows(df), [p])[0]
    return m, score_boosts(df, [m], keep=KEY)


def gradient_boosting_folds(df: DataFrame, folds: int, n_trees: int = 100, max_depth: int = 3, rate: float = 0.1,
                            subsample: float = 1.0, name: str = "GradientBoosting", seed: int = 42, *,
                            column_share: float = 1.0, min_gain: float = 0.0, min_leaf: int = 1) -> DataFrame:
    """L9/L10 out of fold: every row of ``df`` (with ``fold``) scored by the model fitted without its fold; all folds share their passes."""
    p = Boost(name, n_trees, max_depth, rate, subsample, column_share, min_gain, min_leaf, seed=seed)
    return score_boosts(df, fit_boosts(df, [replace(p, leave_fold=k) for k in range(folds)], "fold"), keep=KEY, held_out=True)


def early_stopped_boosting(df: DataFrame, n_trees: int = 100, leaves: int = 31, rate: float = 0.1,
                           patience: int = 20, name: str = "LightGBM", seed: int = 42):
    """Fit all rounds, then keep the tree prefix chosen by validation AUC
    (stop when the AUC has not improved for ``patience`` rounds).

    The margin of a prefix is the weighted sum of the first trees' outputs;
    probability = sigmoid(2 * margin) as in Spark's logistic GBT. Each prefix
    AUC is computed in Spark on the validation rows (operators.metrics), all in one job.
    """
    from .metrics import roc_auc
    depth = max(1, math.ceil(math.log2(leaves)))
    m = fit_boosts(train_rows(df), [Boost(name, n_trees, depth, rate, seed=seed)])[0]
    aucs = {r["model"]: r["auc"] for r in roc_auc(prefix_margins(df.filter(F.col("split") == "val"), m)).collect()}
    best_k, best, since = 0, -1.0, 0
    for k in range(len(m.trees)):
        a = aucs.get(k) or 0.0
        if a > best:
            best, best_k, since = a, k, 0
        else:
            since += 1
            if since >= patience:
                break
    return (m, best_k + 1), score_boosts(df, [m], keep=KEY, trees=best_k + 1)


def adaboost(df: DataFrame, rounds: int = 100, rate: float = 1.0, name: str = "AdaBoost"):
    """SAMME with weighted depth-1 trees.

    Each round: weighted stump (regression on 0/1, thresholded at 1/2), alpha = rate * ln((1 - e) / e), reweight.
    Stops when e <= 0 or e >= 1/2. A round is one pass over packed rows (operators.stumps).
    """
    m = fit_stumps(train_rows(df), rounds, rate)
    return m.stumps, _out(m.score(df, KEY), name, F.col("score"))


def linear_svm(df: DataFrame, C: float = 1.0, name: str = "LinearSVM", max_iter: int = MAX_ITER):
    """Hinge-loss linear SVM, regParam = 1 / (C * n); score = decision value."""
    tr, n = fit_input(df)
    m = LinearSVC(regParam=1.0 / (C * n), standardization=False, maxIter=max_iter, tol=HINGE_TOL).fit(tr)
    s = m.transform(df)
    margin = vector_to_array(F.col("rawPrediction"))[1]
    return m, _out(s, name, margin, (margin > 0).cast("int"))


def coefficients(model, names) -> list[tuple[str, float]]:
    return list(zip(names, [float(x) for x in model.coefficients]))


def decision_grid(df: DataFrame, model, f1: str, f2: str, names, step: float = 0.02, margin: float = 1.0) -> DataFrame:
    """Score a dense grid over two features, every other feature 0.

    Axes are ``arange(min - margin, max + margin, step)`` per feature; the grid
    size depends on the value ranges and the step, not on the number of rows.
    Points are generated by two explodes from one row of min/max, in parallel.
    """
    from pyspark.ml.feature import VectorAssembler
    mm = df.agg(F.min(f1).alias("a0"), F.max(f1).alias("a1"), F.min(f2).alias("b0"), F.max(f2).alias("b1"))
    r = mm.first()
    na = int(math.ceil((r["a1"] - r["a0"] + 2 * margin) / step))
    nb = int(math.ceil((r["b1"] - r["b0"] + 2 * margin) / step))
    g = (mm.select(F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("i"), "a0", "b0").repartition("i")
         .select("i", "a0", "b0", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("j")))
    g = g.select("i", "j", (F.col("a0") - margin + F.col("i") * step).alias(f1),
                 (F.col("b0") - margin + F.col("j") * step).alias(f2))
    zeros = [F.lit(0.0).alias(n) for n in names if n not in (f1, f2)]
    pts = g.select("i", "j", f1, f2, *zeros)
    x = VectorAssembler(inputCols=list(names), outputCol="features").transform(pts)
    s = model.transform(x)
    p1 = vector_to_array(F.col("probability"))[1] if "probability" in s.columns else F.col("prediction")
    return s.select("i", "j", f1, f2, p1.cast("double").alias("score"))
