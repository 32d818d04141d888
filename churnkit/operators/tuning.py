"""Tuning, resampling, stacking and calibration.

Folds come from the exact stratified ``ntile`` folds (W2) so that every
candidate sees the same rows. Linear candidates of all folds are fitted in shared
passes (linear_many); tree candidates are read as prefixes of a few forests
(tree_tables) or of deep trees that grow together (tree_search).
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from dataclasses import replace
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import models as MD
from .ensemble import pivot_predictions
from .forest import cut_points, forest_blocks, grow_forest
from .kernels import nystrom
from .linear_many import LinearFit, Problem, fit_many, score_many
from .metrics import roc_auc
from .ordered import attach
from .panel import fit_all
from .rank_auc import fit_aucs
from .split import class_rank, hash_sample, stratified_folds
from .tree_search import Tree, candidate_aucs
from .tree_tables import Prefix, prefix_aucs, read_trees
from .vector_blocks import held, pack


def with_folds(df: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Train rows with a ``fold`` column 0..folds-1 (exact stratified ntile)."""
    return stratified_folds(MD.train_rows(df), "label", folds, seed)


#: The reference's three grids of the logistic model: penalty, values of C, shares of L1. Its solvers reach one optimum.
LOGISTIC_GRIDS = [("l1", (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (1.0,)),
                  ("l2", (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (0.0,)),
                  ("elasticnet", (0.001, 0.01, 0.1, 1.0, 10.0), (0.2, 0.5, 0.8))]
#: The valid half of its linear SVM grid (the plain hinge has no primal solver there).
SVM_GRIDS = [("l1", (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (1.0,)), ("l2", (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), (0.0,))]
CV_CS = tuple(10.0 ** (-4 + 8 * i / 9) for i in range(10))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", "label", "split", "features")


def _summary(spark, candidates: Sequence[tuple], fields: str, aucs: DataFrame) -> DataFrame:
    """One row per candidate: ``fields``, mean and population std of its folds' AUCs, and the first strict maximum flagged.

    ``aucs`` has one row per candidate and fold; ``candidates`` are tuples, the first member is the model's name.
    """
    by: dict[str, dict] = {}
    for r in aucs.collect():
        by.setdefault(r["model"], {})[r["fold"]] = r["auc"]
    rows, best = [], None
    for c in candidates:
        folds = [by.get(c[0], {})[k] for k in sorted(by.get(c[0], {})) if by[c[0]][k] is not None]
        mean = sum(folds) / len(folds) if folds else None
        std = (sum((a - mean) ** 2 for a in folds) / len(folds)) ** 0.5 if folds else None
        rows.append([*c[1:], mean, std, folds, 0])
        if mean is not None and (best is None or mean > rows[best][-4]):
            best = len(rows) - 1
    if best is not None:
        rows[best][-1] = 1
    return spark.createDataFrame([tuple(r) for r in rows], f"{fields}, mean_auc double, std_auc double, fold_auc array<double>, is_best int")


def cv_linear(df: DataFrame, problems: Sequence[Problem], folds: int = 5, loss: str = "logistic") -> DataFrame:
    """(model, fold, auc) of every problem on every fold it did not see; all (problem, fold) fits share their passes."""
    return _cv_linear(df, [(loss, p) for p in problems], folds)


def _cv_linear(df: DataFrame, problems: Sequence[tuple[str, Problem]], folds: int) -> DataFrame:
    """``cv_linear`` of problems of several losses over the same packed rows."""
    blocks = pack(with_folds(_rows(df), folds), ["label", "fold", F.lit(0)])
    fits = []
    for loss in sorted({one for one, _ in problems}):
        fits += fit_many(blocks, [replace(p, leave_fold=k) for one, p in problems if one == loss for k in range(folds)], loss)
    out = fit_aucs(blocks, fits).drop("part")
    blocks.close()
    return out


def linear_grid(df: DataFrame, grids=LOGISTIC_GRIDS, folds: int = 5, loss: str = "logistic") -> DataFrame:
    """H1: every (penalty, C, L1 share) of the grids by mean held-out AUC; the best, the first strict maximum over all grids, is flagged."""
    candidates = [(f"{penalty}/{c!r}/{share!r}", penalty, float(c), float(share)) for penalty, cs, shares in grids for c in cs for share in shares]
    aucs = cv_linear(df, [Problem(name, c, share) for name, _, c, share in candidates], folds, loss)
    return _summary(df.sparkSession, candidates, "penalty string, C double, l1_ratio double", aucs)


def best_linear(df: DataFrame, table: DataFrame, name: str, loss: str = "logistic") -> tuple[LinearFit, DataFrame]:
    """The flagged candidate of ``linear_grid`` refitted on all train rows, and its predictions."""
    row = table.where("is_best = 1").first()
    blocks = pack(MD.train_rows(_rows(df)), ["label", F.lit(-2), F.lit(0)])
    fit = fit_many(blocks, [Problem(name, row["C"], row["l1_ratio"])], loss)
    blocks.close()
    return fit[0], score_many(df, fit, probability=loss == "logistic")


def logistic_cv(df: DataFrame, Cs: Sequence[float] = CV_CS, folds: int = 5) -> DataFrame:
    """L3: ten values of C from 1e-4 to 1e4 by held-out AUC; ``best_linear`` refits the flagged one."""
    return linear_grid(df, [("l2", tuple(Cs), (0.0,))], folds)


def _kernel_aucs(df: DataFrame, jobs: Sequence[tuple[str, str, float | None, Sequence[float]]], folds: int, m: int) -> DataFrame:
    """(model, fold, auc) of kernel machines: for each job (name, kernel, gamma, values of C) and fold the landmarks, gamma
    and map come from the rows of the other folds alone; models are called name/C."""
    tr = with_folds(_rows(df), folds).persist()
    blocks = pack(tr, ["label", "fold", F.lit(0)])
    fitted: dict = {}

    def run(name, kernel, gamma, cs, k):
        made = nystrom(tr.where(F.col("fold") != k), kernel, m, gamma)
        fitted[name, k] = fit_many(blocks, [Problem(f"{name}/{c!r}", c, leave_fold=k) for c in cs], "squared_hinge", n_features=len(made.z), expand=made)

    fit_all({f"{j[0]} {k}": partial(run, *j, k) for j in jobs for k in range(folds)}, df.sparkSession)
    out = fit_aucs(blocks, [fit for key in sorted(fitted) for fit in fitted[key]]).drop("part")
    blocks.close()
    tr.unpersist()
    return out


def kernel_comparison(df: DataFrame, kernels: Sequence[str] = ("linear", "rbf", "poly", "sigmoid"), folds: int = 3, m: int = 200) -> DataFrame:
    """H4: held-out AUC of kernel machines, C = 1, gamma = 'scale'; nothing of the held-out fold enters the map."""
    aucs = _kernel_aucs(df, [(k, k, None, (1.0,)) for k in kernels], folds, m)
    return _summary(df.sparkSession, [(f"{k}/1.0", k) for k in kernels], "kernel string", aucs)


def rbf_grid(df: DataFrame, sample: int = 2000, Cs: Sequence[float] = (0.1, 1.0, 10.0, 100.0),
             gammas: Sequence[str | float] = ("scale", "auto", 0.001, 0.01, 0.1), folds: int = 3, m: int = 200) -> DataFrame:
    """H1 for the RBF machine: 20 candidates, 3 folds, on ``sample`` train rows by hash order (the reference's own sample)."""
    rows = hash_sample(MD.train_rows(_rows(df)), sample)
    d = len(df.select("features").first()[0])
    value = lambda g: None if g == "scale" else 1.0 / d if g == "auto" else float(g)       # noqa: E731
    aucs = _kernel_aucs(rows, [(str(g), "rbf", value(g), Cs) for g in gammas], folds, m)
    return _summary(df.sparkSession, [(f"{g}/{c!r}", str(g), float(c)) for c in Cs for g in gammas], "gamma string, C double", aucs)


#: The reference's 192 candidates of the decision tree; depth 30 stands for no limit (Spark's deepest tree).
TREE_GRID = {"depth": (3, 5, 7, 10, 15, 30), "min_split": (2, 5, 10, 20), "min_leaf": (1, 2, 4, 8), "criterion": ("gini", "entropy")}


def tree_grid(df: DataFrame, grid: dict = TREE_GRID, folds: int = 5) -> DataFrame:
    """H1 for the decision tree: all candidates from one deep tree per criterion, least leaf and fold, since depth and
    rows-to-split limits cut a tree to a prefix (operators.tree_search). 'gini' grows on the 0/1 label (variance = gini / 2);
    'entropy' joins sibling leaves of one class, as Spark's classifier does."""
    every = [(f"{c}/{leaf}/{d}/{s}", c, d, s, leaf) for c in grid["criterion"] for d in grid["depth"] for leaf in grid["min_leaf"] for s in grid["min_split"]]
    trees = [Tree(k, c, leaf, tuple((i, d, s) for i, (_, of, d, s, least) in enumerate(every) if (of, least) == (c, leaf)))
             for k in range(folds) for c in grid["criterion"] for leaf in grid["min_leaf"]]
    blocks = pack(with_folds(_rows(df), folds), ["label", "fold"])
    rows = [(every[i][0], k, auc) for i, k, auc in candidate_aucs(blocks, trees, folds)]
    blocks.close()
    aucs = df.sparkSession.createDataFrame(rows, "model string, fold int, auc double")
    return _summary(df.sparkSession, every, "criterion string, max_depth int, min_samples_split int, min_samples_leaf int", aucs)


#: Space of the random search over forests.
FOREST_SPACE = {"n_trees": (100, 200, 300), "depth": (3, 5, 7, 9), "min_leaf": (1, 3, 5), "subsample": (0.6, 0.8, 1.0)}


def forest_search(df: DataFrame, space: dict = FOREST_SPACE, n_iter: int = 50, folds: int = 5, seed: int = 42, threads: int = 8) -> DataFrame:
    """H2: ``n_iter`` draws without replacement from the product of ``space``, by held-out AUC.

    Draws that differ only in depth or number of trees are prefixes of one forest per (least leaf, subsample) and
    fold, grown to the largest of both that was drawn for the subsample. Separate fits of the same seed would draw other rows
    and columns; the candidates of one forest here share theirs, and forests that differ in the least leaf alone grow together as far as
    their splits are the same. Forests grow outside the driver (operators.forest); only the
    nodes of one fold's forests are on the driver at a time, at most 2^(depth + 1) a tree whatever the number of rows.
    """
    combos = list(itertools.product(*space.values()))
    drawn = [dict(zip(space, c, strict=True)) for c in random.Random(seed).sample(combos, min(n_iter, len(combos)))]
    shares = sorted({c["subsample"] for c in drawn})

    name = lambda c: "/".join(str(c[k]) for k in space)     # noqa: E731
    every = [(name(c), c["n_trees"], c["depth"], c["min_leaf"], c["subsample"]) for c in drawn]
    candidates = [Prefix(name(c), f"{c['min_leaf']}/{c['subsample']}", c["n_trees"], c["depth"]) for c in drawn]
    kept, tr = held(with_folds(_rows(df), folds))
    rows = []
    for k in range(folds):
        blocks = forest_blocks(tr.where(F.col("fold") != k))
        cuts = cut_points(blocks, max(blocks.width - 2, 0))
        grown: dict = {}

        def grow(share, blocks=blocks, cuts=cuts, grown=grown):
            mine = [c for c in drawn if c["subsample"] == share]
            leaf, *also = sorted({c["min_leaf"] for c in mine})
            forest = grow_forest(blocks, cuts, trees=max(c["n_trees"] for c in mine), max_depth=max(c["depth"] for c in mine),
                                 min_leaf=leaf, rate=share, seed=seed, also=also)
            grown.update({f"{one}/{share}": read_trees(f) for one, f in {leaf: forest, **forest.also}.items()})

        fit_all({str(share): partial(grow, share) for share in shares}, df.sparkSession, threads)
        blocks.close()
        aucs = prefix_aucs(tr.where(F.col("fold") == k), grown, candidates)
        rows += [(c.name, k, aucs[c.name]) for c in candidates if c.name in aucs]
    kept.unpersist()
    aucs = df.sparkSession.createDataFrame(rows, "model string, fold int, auc double")
    return _summary(df.sparkSession, every, "n_trees int, max_depth int, min_leaf int, subsample double", aucs)


def _fold_fits(tr: DataFrame, folds: int, fit):
    """Out-of-fold predictions: for each fold, fit on the others, score the fold."""
    out = None
    for f in range(folds):
        inner = tr.withColumn("split", F.when(F.col("fold") == f, "oof").otherwise("train"))
        _, p = fit(inner)
        p = p.filter(F.col("split") == "oof").withColumn("fold", F.lit(f))
        out = p if out is None else out.unionByName(p)
    return out


DEFAULT_FAMILIES = {
    "LogisticRegression": lambda d: MD.logistic(d),
    "LinearSVM": lambda d: MD.linear_svm(d),
    "DecisionTree": lambda d: MD.decision_tree(d, 5),
}

#: The five base models of the stacked ensemble.
STACKED_FAMILIES = {
    "LogisticRegression": lambda d: MD.logistic(d),
    "RandomForest": lambda d: MD.random_forest(d),
    "GradientBoosting": lambda d: MD.gradient_boosting(d),
    "LinearSVM": lambda d: MD.linear_svm(d),
    "DecisionTree": lambda d: MD.decision_tree(d, 5),
}


def fold_table(df: DataFrame, folds: int) -> DataFrame:
    """``with_folds`` written once to the shared checkpoint folder: read by every fit, held by no cache."""
    return cut_lineage(with_folds(df, folds))


#: Linear families of the cross-validated comparison: loss and problem.
CV_LINEAR = [("logistic", Problem("LogisticRegression")), ("logistic", Problem("LogisticRegression_L1", 0.1, 1.0)),
             ("squared", Problem("RidgeClassifier", 0.5)), ("squared_hinge", Problem("LinearSVM", penalise_intercept=True))]


def cv_auc(df: DataFrame, folds: int = 5, families=None, linear: Sequence[tuple[str, Problem]] = CV_LINEAR) -> DataFrame:
    """H3: AUC of every fold, mean and population std per model; linear families share their passes, others fit per fold."""
    families = {"DecisionTree": DEFAULT_FAMILIES["DecisionTree"]} if families is None else families
    n = MD.train_rows(df).count() * (folds - 1) // folds
    problems = [*linear, ("logistic", Problem("ElasticNet", 1.0 / (0.1 * max(n, 1)), 0.5))] if linear is CV_LINEAR else list(linear)
    per_fold = None
    if problems:
        per_fold = _cv_linear(df, problems, folds)
    if families:
        tr = fold_table(_rows(df), folds)
        for name, fit in families.items():
            a = roc_auc(_fold_fits(tr, folds, fit).withColumn("model", F.lit(name)), ["model", "fold"])
            per_fold = a if per_fold is None else per_fold.unionByName(a)
    return per_fold.groupBy("model").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "auc"))), lambda s: s["auc"]).alias("fold_auc"))


#: The four models of the learning curves.
CURVE_MODELS = [("logistic", Problem("LogisticRegression")), ("logistic", Problem("LogisticRegression_L1", 0.1, 1.0)),
                ("squared", Problem("RidgeClassifier", 0.5)), ("squared_hinge", Problem("LinearSVM", penalise_intercept=True))]


def learning_curve(df: DataFrame, fractions=tuple(i / 10 for i in range(1, 11)), folds: int = 5,
                   models: Sequence[tuple[str, Problem]] = CURVE_MODELS) -> DataFrame:
    """H5: per model and fraction the mean and population std over the folds of the train AUC and of the held-out AUC.

    Inside each fold the rows have a second hash order; the prefix of fraction f takes the first f of every
    other fold (T5). All (model, fraction, fold) fits of a loss share their passes.
    """
    tr = class_rank(with_folds(_rows(df), folds), "fold", seed=43)
    sizes = with_folds(_rows(df), folds).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    tr = attach(tr, sizes, ["fold"]).withColumn("rank", F.col("_rank") / F.col("n")).drop("_rank", "n")
    blocks = pack(tr, ["label", "fold", "rank"])
    fits = []
    for loss in sorted({one for one, _ in models}):
        fits += fit_many(blocks, [replace(p, name=f"{p.name}@{f!r}", leave_fold=k, max_rank=f) for one, p in models if one == loss for f in fractions for k in range(folds)], loss)
    auc = fit_aucs(blocks, fits, seen=True)
    blocks.close()
    at = F.split("model", "@")
    side = lambda fn, part: fn(F.when(F.col("part") == part, F.col("auc")))      # noqa: E731
    return auc.groupBy(at[0].alias("model"), at[1].cast("double").alias("fraction")).agg(
        side(F.avg, "train").alias("train_auc"), side(F.stddev_pop, "train").alias("train_std"),
        side(F.avg, "held").alias("val_auc"), side(F.stddev_pop, "held").alias("val_std"), F.countDistinct("fold").alias("folds"))


def stacking(df: DataFrame, folds: int = 5, families=None, name: str = "Stacking Ensemble") -> DataFrame:
    """Out-of-fold base scores on the train rows -> logistic meta-model;
    base models refitted on all train rows score val/test."""
    families = families or STACKED_FAMILIES
    names = list(families)
    tr = fold_table(df, folds)
    oof, full = None, None
    for nm, fit in families.items():
        p = _fold_fits(tr, folds, fit).withColumn("model", F.lit(nm)).withColumn("split", F.lit("train"))
        oof = p if oof is None else oof.unionByName(p)
        _, q = fit(df)
        q = q.filter(F.col("split") != "train").withColumn("model", F.lit(nm))
        full = q if full is None else full.unionByName(q)
    cols = ["row_id", "label", "split", "model", "score"]
    allp = oof.select(*cols).unionByName(full.select(*cols))
    allp = cut_lineage(allp)                # all base scores, computed once
    wide = pivot_predictions(allp, names, value="score", key=("row_id", "label", "split"))
    va = VectorAssembler(inputCols=names, outputCol="_meta").transform(wide)
    meta = LogisticRegression(featuresCol="_meta", maxIter=MD.MAX_ITER).fit(va.filter(F.col("split") == "train"))
    s = meta.transform(va)
    return s.select("row_id", "label", "split", F.lit(name).alias("model"),
                    vector_to_array("probability")[1].alias("score"),
                    F.col("prediction").cast("int").alias("prediction"))


def isotonic_curve(rows: DataFrame):
    """Isotonic model of ``label`` on ``score``, predicting ``cal_score``; one weighted point per distinct score, as the
    fit's last step pools on the driver."""
    pooled = rows.groupBy("score").agg(F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="cal_score", weightCol="weight").fit(pooled)


def _logistic_parts(df: DataFrame, val: DataFrame, test: DataFrame, folds: int, name: str):
    """Test rows scored by the logistic model of the train rows, and for each fold of ``val`` its rows and the test rows scored by the
    model of the other folds; the models of all folds share their passes (linear_many)."""
    blocks = pack(MD.train_rows(_rows(df)), ["label", F.lit(-2), F.lit(0)])
    base = score_many(test, fit_many(blocks, [Problem(name)]))
    blocks.close()
    blocks = pack(val, ["label", "fold", F.lit(0)])
    fits = fit_many(blocks, [Problem(name, leave_fold=f) for f in range(folds)])
    blocks.close()
    return base, [(score_many(val.filter(F.col("fold") == f), [fits[f]]), score_many(test, [fits[f]])) for f in range(folds)]


def isotonic_calibration(df: DataFrame, folds: int = 3, fit=None, name: str = "LogisticRegression") -> DataFrame:
    """E5: k-fold isotonic calibration on the validation rows; test AUC before and after.

    Per fold: refit the model on the other validation folds, fit an isotonic
    map on this fold's scores, apply both to the test rows; the calibrated
    test score is the mean over folds.
    """
    test, val = df.filter(F.col("split") == "test"), stratified_folds(df.filter(F.col("split") == "val"), "label", folds)
    if fit is None:
        base, scored = _logistic_parts(df, val, test, folds, name)
    else:
        _, base = fit(df)
        scored = []
        for f in range(folds):
            inner = val.withColumn("split", F.when(F.col("fold") == f, "cal").otherwise("train")).drop("fold")
            _, p = fit(inner.unionByName(test))
            scored.append((p.filter(F.col("split") == "cal"), p.filter(F.col("split") == "test")))
    before = roc_auc(base.filter(F.col("split") == "test")).select(F.col("auc").alias("auc_before"))
    cal = None
    for own, p in scored:
        t = isotonic_curve(own).transform(p).select("row_id", "label", "cal_score")
        cal = t if cal is None else cal.unionByName(t)
    avg = cal.groupBy("row_id", "label").agg(F.avg("cal_score").alias("score")).withColumn("model", F.lit(name))
    after = roc_auc(avg).select(F.col("auc").alias("auc_after"))
    return (before.withColumns({"auc_after": after.scalar()})
            .select(F.lit(name).alias("model"), "auc_before", "auc_after",
                    (F.col("auc_after") - F.col("auc_before")).alias("improvement")))
