"""Registered queries: fitted models (L*, H*, E2, E5, C1-C6, F4, M10-M13, M19, R3).

Where a degenerate case has a closed form, the oracle is that closed form in
SQL (checked by value). Full fits have no SQL twin; they are rows-only checks
in the driver and property tests in tests/.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from ..operators import clustering as CL
from ..operators import kernels as K
from ..operators import models as MD
from ..operators import tuning
from ..operators.metrics import model_table, roc_auc, val_test_table
from ..session import cut_lineage
from .fixtures import PSEUDO_CLUSTER_SQL, cb_sql, churn_base
from .pipeline import churn_features, with_vector
from .registry import register, round_doubles
from .sqltext import features_cte


def vec_table(spark, sf_dir):
    return with_vector(churn_features(spark, sf_dir, scale=True))


def _single(df, col, out="x"):
    return VectorAssembler(inputCols=[col], outputCol="features").transform(df.withColumn(out, F.col(col)))


# --- closed-form (degenerate) oracles -----------------------------------------------------------

@register("l1_logistic_closed_form", cb_sql(
    features_cte(scale=False) +
    ", d AS (SELECT Partner AS x, label FROM sp WHERE split = 'train')"
    ", p AS (SELECT avg(CASE WHEN x = 0 THEN CAST(label AS DOUBLE) END) AS p0,"
    " avg(CASE WHEN x = 1 THEN CAST(label AS DOUBLE) END) AS p1 FROM d)"
    " SELECT round(ln(p0 / (1 - p0)), 4) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) AS coef FROM p"))
def l1_closed(spark, sf_dir):
    """L1 with one 0/1 feature and a vanishing penalty: intercept = logit(p0), w = logit(p1) - logit(p0)."""
    m, _ = MD.logistic(_single(churn_features(spark, sf_dir, scale=False), "Partner"), C=1e9)
    return spark.createDataFrame([(round(float(m.intercept), 4), round(float(m.coefficients[0]), 4))],
                                 "intercept double, coef double")


@register("l4_ridge_closed_form", cb_sql(
    features_cte(scale=False) +
    ", d AS (SELECT CAST(tenure AS DOUBLE) AS x, CAST(label AS DOUBLE) * 2 - 1 AS y FROM sp WHERE split = 'train')"
    ", m AS (SELECT avg(x) AS mx, avg(y) AS my FROM d)"
    ", s AS (SELECT sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, any_value(mx) AS mx,"
    " any_value(my) AS my FROM d, m)"
    " SELECT round(sxy / (sxx + 1.0), 6) AS coef, round(my - sxy / (sxx + 1.0) * mx, 6) AS intercept FROM s"))
def l4_closed(spark, sf_dir):
    """L4 with one feature: w = Sxy / (Sxx + alpha), alpha = 1."""
    f = churn_features(spark, sf_dir, scale=False).withColumn("tenure_d", F.col("tenure").cast("double"))
    m, _ = MD.ridge_classifier(_single(f, "tenure_d"), alpha=1.0)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))],
                                 "coef double, intercept double")


@register("l7_tree_stump", cb_sql(
    features_cte(scale=False) +
    ", d AS (SELECT CAST(ServiceCount AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM sp WHERE split = 'train')"
    ", v AS (SELECT DISTINCT x FROM d)"
    ", t AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2.0 AS t FROM v)"
    ", s AS (SELECT t, count(*) FILTER (WHERE x <= t) AS nl, sum(y) FILTER (WHERE x <= t) AS sl,"
    " count(*) FILTER (WHERE x > t) AS nr, sum(y) FILTER (WHERE x > t) AS sr FROM t, d WHERE t IS NOT NULL GROUP BY t)"
    ", g AS (SELECT t, nl, nr, sl / nl AS ml, sr / nr AS mr, sl * sl / nl + sr * sr / nr AS score FROM s)"
    " SELECT round(t, 6) AS threshold, round(ml, 6) AS left_mean, round(mr, 6) AS right_mean, nl AS n_left,"
    " nr AS n_right FROM g ORDER BY score DESC, t LIMIT 1"))
def l7_stump(spark, sf_dir):
    """L7 depth 1 (regression form on 0/1): best variance split and the two leaf means."""
    f = _single(churn_features(spark, sf_dir, scale=False).withColumn("sc", F.col("ServiceCount").cast("double")), "sc")
    m, _ = MD.decision_tree(f, max_depth=1)
    d = MD.train_rows(f)
    thr = float(m._call_java("rootNode").split().threshold())
    out = d.select(F.when(F.col("sc") <= thr, "l").otherwise("r").alias("side"), F.col("label").cast("double").alias("y"))
    g = out.groupBy("side").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["side"]: r for r in g}
    return spark.createDataFrame(
        [(round(thr, 6), round(by["l"]["m"], 6), round(by["r"]["m"], 6), by["l"]["n"], by["r"]["n"])],
        "threshold double, left_mean double, right_mean double, n_left long, n_right long")


@register("c1_kmeans_two_blocks", cb_sql(
    " SELECT CAST(row_id % 2 AS INTEGER) AS block, round(avg(CAST(tenure AS DOUBLE) / 73 + 100 * (row_id % 2)), 6)"
    " AS center FROM cb GROUP BY row_id % 2"))
def c1_blocks(spark, sf_dir):
    """C1 with k = 2 on two far-apart blocks: the centers are the block means."""
    b = churn_base(spark, sf_dir).select(
        (F.col("tenure").cast("double") / 73 + 100 * (F.col("row_id") % 2)).alias("x"))
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(b)
    m, _, _ = CL.kmeans_best_of(d, 2, n_init=2)
    cs = sorted(float(c[0]) for c in m.clusterCenters())
    return spark.createDataFrame([(i, round(c, 6)) for i, c in enumerate(cs)], "block int, center double")


@register("f4_pca_two_features", cb_sql(
    ", s AS (SELECT var_samp(CAST(tenure AS DOUBLE)) AS a, var_samp(MonthlyCharges) AS c,"
    " covar_samp(CAST(tenure AS DOUBLE), MonthlyCharges) AS b FROM cb)"
    ", e AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,"
    " (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM s)"
    " SELECT 0 AS component, round(l1 / (l1 + l2), 6) AS ratio FROM e UNION ALL"
    " SELECT 1, round(l2 / (l1 + l2), 6) FROM e"))
def f4_pca(spark, sf_dir):
    """F4 on two features: explained-variance ratios = eigenvalues of the 2x2 covariance."""
    b = churn_base(spark, sf_dir).select(F.col("tenure").cast("double").alias("t"), "MonthlyCharges")
    d = VectorAssembler(inputCols=["t", "MonthlyCharges"], outputCol="features").transform(b)
    _, ratios, _ = CL.pca(d, 2)
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(ratios)], "component int, ratio double")


# --- full fits (rows-only in the driver) -------------------------------------------------------

@register("l7_l8_tree_models")
def tree_models(spark, sf_dir):
    """Validation AUC next to test metrics."""
    d = vec_table(spark, sf_dir)
    p = MD.decision_tree(d, 5)[1].unionByName(MD.random_forest(d)[1])
    return round_doubles(val_test_table(p))


@register("l9_l11_boosting_models")
def boosting_models(spark, sf_dir):
    """L9 gradient boosting, L10 subsampled variant, L11 early-stopped prefix."""
    d = vec_table(spark, sf_dir)
    p = (MD.gradient_boosting(d)[1]
         .unionByName(MD.gradient_boosting(d, subsample=0.8, name="XGBoost")[1])
         .unionByName(MD.early_stopped_boosting(d)[1]))
    return round_doubles(model_table(p.filter(F.col("split") == "test")))


@register("l12_adaboost")
def adaboost(spark, sf_dir):
    d = vec_table(spark, sf_dir)
    _, p = MD.adaboost(d)
    return round_doubles(model_table(p.filter(F.col("split") == "test")))


@register("l14_l16_kernel_svms")
def kernel_svms(spark, sf_dir):
    """L14 kernel map + linear SVM for rbf, poly, sigmoid; L15 on PCA; L16 Platt probabilities."""
    d = vec_table(spark, sf_dir)
    parts = [K.kernel_svm(d, k)[1] for k in ("rbf", "poly", "sigmoid")]
    parts.append(K.svm_with_pca(d, k=10)[1])
    parts.append(K.platt(parts[0]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return round_doubles(model_table(out.filter(F.col("split") == "test")))


@register("h1_grid_search")
def grid_search(spark, sf_dir):
    """H1: the logistic model's three grids (27 distinct candidates), 5 stratified folds (W2), AUC; the best is flagged."""
    return round_doubles(tuning.linear_grid(vec_table(spark, sf_dir), folds=5).drop("fold_auc"))


@register("h1_tuned_logistic")
def tuned_logistic(spark, sf_dir):
    """H1: the best candidate refitted on all train rows: validation AUC and test metrics."""
    d = vec_table(spark, sf_dir)
    _, p = tuning.best_linear(d, tuning.linear_grid(d, folds=5), "LogisticRegression_Tuned")
    return round_doubles(val_test_table(p))


@register("l3_logistic_cv")
def logistic_cv(spark, sf_dir):
    """L3: ten values of C, 5 folds, AUC of each, best flagged."""
    return round_doubles(tuning.logistic_cv(vec_table(spark, sf_dir), folds=5).select("C", "mean_auc", "std_auc", "is_best"))


@register("h1_linear_svm_grid")
def linear_svm_grid(spark, sf_dir):
    """H1: linear SVM, penalty x C with the squared hinge, 5 folds."""
    return round_doubles(tuning.linear_grid(vec_table(spark, sf_dir), tuning.SVM_GRIDS, folds=5, loss="squared_hinge").drop("fold_auc", "l1_ratio"))


@register("h1_rbf_grid")
def rbf_grid(spark, sf_dir):
    """H1: RBF machine, C x gamma, 3 folds on 2000 sampled train rows."""
    return round_doubles(tuning.rbf_grid(vec_table(spark, sf_dir), folds=3).drop("fold_auc"))


@register("h1_tree_grid")
def tree_grid(spark, sf_dir):
    """H1: decision tree, all 192 candidates, 5 folds."""
    return round_doubles(tuning.tree_grid(vec_table(spark, sf_dir), folds=5).drop("fold_auc"))


@register("h3_cv_scores")
def cv_scores(spark, sf_dir):
    """H3: per-fold AUC, mean and std (ddof 0) for the linear families and the decision tree."""
    return round_doubles(tuning.cv_auc(vec_table(spark, sf_dir)))


@register("h4_kernel_comparison")
def kernel_comparison(spark, sf_dir):
    """H4: linear, rbf, poly and sigmoid machines, 3 folds, mean and std of the held-out AUC."""
    return round_doubles(tuning.kernel_comparison(vec_table(spark, sf_dir), folds=3).drop("fold_auc"))


@register("h5_learning_curve")
def learning_curve(spark, sf_dir):
    """H5: four models x ten fractions x five folds."""
    return round_doubles(tuning.learning_curve(vec_table(spark, sf_dir)))


@register("e5_isotonic_calibration")
def calibration(spark, sf_dir):
    return round_doubles(tuning.isotonic_calibration(vec_table(spark, sf_dir)))


@register("c4_gmm_bic_aic")
def gmm(spark, sf_dir):
    """C4 + M19 on the 2-D points (full covariance)."""
    b = churn_base(spark, sf_dir).select((F.col("tenure").cast("double") / 10).alias("x1"),
                                         (F.col("MonthlyCharges") / 10).alias("x2"))
    d = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(b)
    rows = []
    for k in (2, 3):
        _, info, _ = CL.gaussian_mixture(d, k)
        rows.append((k, info["log_likelihood"], info["bic"], info["aic"], int(info["n_params"])))
    return round_doubles(spark.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double, n_params int"))


@register("c2_hierarchical_segments")
def hierarchical(spark, sf_dir):
    """C2 (divisive form, k = 2) on the scaled features and C9 segments of its clusters, averages in raw units."""
    from ..operators.cluster_quality import segments
    f = vec_table(spark, sf_dir).filter(F.col("split").isin("train", "val"))
    _, lab = CL.hierarchical(f, 2)
    raw = churn_features(spark, sf_dir, scale=False)
    return round_doubles(segments(raw.join(lab.select("row_id", "cluster"), "row_id")))


@register("c1_c8_h6_k_search")
def k_search(spark, sf_dir):
    """H6: k-means cost and scalable quality per k on the feature table (train + val)."""
    f = vec_table(spark, sf_dir).filter(F.col("split").isin("train", "val"))
    rows = CL.k_search(f)
    return round_doubles(spark.createDataFrame(rows, "k int, inertia double, silhouette_sq double, "
                                               "davies_bouldin double, calinski_harabasz double, is_best int"))


@register("m10_m11_importance")
def importance(spark, sf_dir):
    """M10 feature importances of a forest and M11 logistic coefficients, ranked (T2 top 10)."""
    from ..operators.explain import coefficient_table, importance_table
    from ..operators.prep import feature_columns
    d = vec_table(spark, sf_dir)
    rf = MD.forest_model(d)
    lr, _ = MD.logistic(d)
    names = feature_columns()
    return round_doubles(importance_table(spark, rf, names, "RandomForest", 10)
                         .unionByName(coefficient_table(spark, lr, names, "LogisticRegression", 10)))


@register("m13_tree_rules")
def tree_rules(spark, sf_dir):
    """Nodes of a fitted tree down to depth 3 as a table."""
    from ..operators.explain import tree_nodes
    from ..operators.prep import feature_columns
    d = vec_table(spark, sf_dir)
    m, _ = MD.decision_tree(d, 5)
    return round_doubles(tree_nodes(spark, m, feature_columns(), max_depth=3))


@register("m12_linear_attributions")
def attributions(spark, sf_dir):
    """M12 (linear model form): per-row contributions w_j * (x_j - mean_j) and their mean |value|."""
    from ..operators.explain import linear_attributions
    from ..operators.prep import feature_columns
    d = vec_table(spark, sf_dir)
    lr, _ = MD.logistic(d)
    return round_doubles(linear_attributions(d.filter(F.col("split") == "test"), lr, feature_columns()))


@register("io10_batch_scoring")
def batch_scoring(spark, sf_dir):
    """IO7/IO8/IO10: fit two pipelines (scaling included), save them, load those that exist, choose the one with
    the best validation AUC, and score the raw customer rows (the same projection serves a stream)."""
    from ..operators.scale import Standardizer
    from ..session import ensure_checkpoint_dir
    from ..streaming.scoring import best_model, fit_pipeline, load_models, save_model, score
    from .pipeline import scaled_columns
    f = churn_features(spark, sf_dir, scale=False)
    train = f.filter(F.col("split") == "train")
    scaler = Standardizer(scaled_columns()).fit(train)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    for name, C in (("logistic", 1.0), ("logistic_strong_penalty", 0.001)):
        lr = LogisticRegression(regParam=1.0 / (C * train.count()), standardization=False, maxIter=MD.MAX_ITER)
        save_model(fit_pipeline(train, scaler, lr), f"{folder}/{name}")
    loaded = load_models(spark, folder, ["logistic", "logistic_strong_penalty", "missing_model"])
    held = f.filter(F.col("split") == "val").select("row_id", "label")
    raw = churn_base(spark, sf_dir)
    scored = None
    for name, model in loaded.items():
        one = score(raw, model, name)
        scored = one if scored is None else scored.unionByName(one)
    best = best_model(roc_auc(scored.join(held, "row_id")), list(loaded))
    return round_doubles(scored.where(F.col("model") == best))


@register("p19_decision_grid")
def decision_grid(spark, sf_dir):
    """A logistic model on two scaled features scored on a 0.02-step grid (others 0)."""
    from ..operators.prep import feature_columns
    d = vec_table(spark, sf_dir)
    names = feature_columns()
    m, _ = MD.logistic(d)
    g = MD.decision_grid(MD.train_rows(d), m, "tenure", "MonthlyCharges", names)
    return round_doubles(g)


@register("c10_pca_projection", cb_sql(
    features_cte(scale=False) + f", cl AS (SELECT row_id, {PSEUDO_CLUSTER_SQL} AS cluster FROM sp WHERE split IN ('train', 'val'))"
    " SELECT cluster, count(*) AS n, sum(row_id) AS key_sum, 0.0 AS pc1_mean_all, 0.0 AS pc2_mean_all, 1 AS variances_match FROM cl GROUP BY cluster"))
def pca_projection(spark, sf_dir):
    """2-D principal-component projection of the scaled features (train + val) with cluster labels from the
    raw table. Per cluster: rows; and over all rows the properties that define the projection: both components are
    centred, uncorrelated, and their variances have the ratio of the explained variances."""
    p = pca_points(spark, sf_dir).persist()
    whole = p.agg(F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"), F.covar_samp("pc1", "pc2").alias("c"),
                  F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), F.first("ratio1").alias("r1"), F.first("ratio2").alias("r2")).first()
    fits = abs(whole["c"]) < 1e-6 and abs(whole["v2"] / whole["v1"] - whole["r2"] / whole["r1"]) < 1e-6 and whole["v1"] >= whole["v2"]
    out = cut_lineage(p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum")))
    p.unpersist()
    return out.withColumns({"pc1_mean_all": F.abs(F.round(F.lit(float(whole["m1"])), 6)), "pc2_mean_all": F.abs(F.round(F.lit(float(whole["m2"])), 6)),
                            "variances_match": F.lit(int(fits))})


def pca_points(spark, sf_dir):
    """(row_id, cluster, pc1, pc2, ratio1, ratio2)"""
    from pyspark.ml.functions import vector_to_array
    from .fixtures import pseudo_clusters
    labels = pseudo_clusters(churn_features(spark, sf_dir, scale=False)).select("row_id", "cluster")
    f = vec_table(spark, sf_dir).filter(F.col("split").isin("train", "val"))
    _, ratios, proj = CL.pca(f, 2)
    a = vector_to_array("pca")
    return proj.join(labels, "row_id").select("row_id", "cluster", a[0].alias("pc1"), a[1].alias("pc2"),
                                              F.lit(float(ratios[0])).alias("ratio1"), F.lit(float(ratios[1])).alias("ratio2"))


@register("c10_pca_points")
def pca_points_query(spark, sf_dir):
    """The projected rows themselves."""
    return round_doubles(pca_points(spark, sf_dir))


@register("h2_random_search")
def random_search(spark, sf_dir):
    """H2: seeded random search over forests, 50 draws, 5 folds, AUC on the leaf-mean score."""
    return round_doubles(tuning.forest_search(vec_table(spark, sf_dir), n_iter=50, folds=5).drop("fold_auc"))


@register("r4_evaluate_stored")
def evaluate_stored(spark, sf_dir):
    """Two pipelines are fitted, registered with their test metrics, loaded again and scored against the test rows."""
    from ..operators.scale import Standardizer
    from ..session import ensure_checkpoint_dir
    from ..sources.register import ModelRegister
    from ..streaming.scoring import fit_pipeline
    from .pipeline import scaled_columns
    f = churn_features(spark, sf_dir, scale=False)
    train, test = f.filter(F.col("split") == "train"), f.filter(F.col("split") == "test")
    scaler = Standardizer(scaled_columns()).fit(train)

    def score(table, model, name):
        s = model.transform(table)
        p1 = vector_to_array("probability")[1] if "probability" in s.columns else F.col("prediction")
        return s.select("row_id", "label", F.lit(name).alias("model"), p1.cast("double").alias("score"), (p1 >= 0.5).cast("int").alias("prediction"))

    stored = ModelRegister(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/register-{uuid.uuid4().hex}")
    for name, estimator in (("logistic", LogisticRegression(regParam=1.0 / train.count(), standardization=False, maxIter=MD.MAX_ITER)),
                            ("tree", DecisionTreeRegressor(maxDepth=5, seed=42))):
        model = fit_pipeline(train, scaler, estimator)
        at_fit = model_table(score(test, model, name)).first().asDict()
        stored.add(name, model, train.columns, train, {k: v for k, v in at_fit.items() if k != "model"})
    out = stored.evaluate(test, score, model_table)
    return round_doubles(out).withColumn("equal", F.col("at_fit").eqNullSafe(F.col("now")).cast("int"))


@register("m12_tree_attributions")
def tree_attributions(spark, sf_dir):
    """M12 on a forest: sampled Shapley values of 100 sampled test rows against 50 background rows; mean |value| per feature."""
    from ..operators.explain import attribution_table, forest_shapley_values
    from ..operators.prep import feature_columns
    from ..operators.split import hash_sample
    d = vec_table(spark, sf_dir).select("row_id", "label", "split", "features")
    forest = MD.forest_model(d)
    rows = hash_sample(d.filter(F.col("split") == "test"), 100).repartition(spark.sparkContext.defaultParallelism, "row_id")
    return round_doubles(attribution_table(forest_shapley_values(rows, MD.train_rows(d), forest, feature_columns()), "RandomForest"))


@register("c6_spectral")
def spectral_clusters(spark, sf_dir):
    """C6 (k = 2, RBF, gamma 'scale') on the feature table (train + val): every row's cluster."""
    from ..operators.spectral import spectral
    f = vec_table(spark, sf_dir).filter(F.col("split").isin("train", "val"))
    return spectral(f, 2, gamma=K.gamma_scale(f))
