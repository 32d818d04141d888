"""Model explanation tables (M10, M11, M12 linear form, M13)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .forest import Forest
from .split import hash_sample
from .vector_blocks import _matrix


def _ranked(df: DataFrame, value: str, top: int | None) -> DataFrame:
    # One row per feature (tens of rows): a window over the model's rows.
    w = Window.partitionBy("model").orderBy(F.col(value).desc(), F.col("feature"))
    r = df.withColumn("rank", F.row_number().over(w))
    return r.filter(F.col("rank") <= top) if top else r


def importance_table(spark: SparkSession, model, names: Sequence[str], name: str, top: int | None = None) -> DataFrame:
    """Impurity importances of a tree model, ranked."""
    imp = model.featureImportances.toArray()
    rows = [(name, f, float(v)) for f, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    return _ranked(df.withColumn("value", F.col("importance")), "value", top).select(
        "model", "feature", "value", F.lit("importance").alias("kind"), "rank")


def coefficient_table(spark: SparkSession, model, names: Sequence[str], name: str, top: int | None = None) -> DataFrame:
    """Coefficients ranked by absolute value, with their sign."""
    rows = [(name, f, float(v)) for f, v in zip(names, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "model string, feature string, coef double").withColumn("abs_coef", F.abs("coef"))
    r = _ranked(df, "abs_coef", top)
    return r.select("model", "feature", F.col("coef").alias("value"),
                    F.when(F.col("coef") < 0, "negative").otherwise("positive").alias("kind"), "rank")


def tree_nodes(spark: SparkSession, model, names: Sequence[str], max_depth: int = 3) -> DataFrame:
    """Nodes down to ``max_depth``: (node, depth, feature, threshold, prediction, impurity, n)."""
    rows = []
    stack = [(model._call_java("rootNode"), 0, "0")]
    while stack:
        node, depth, path = stack.pop()
        internal = node.getClass().getSimpleName() == "InternalNode"
        feat = thr = None
        if internal:
            sp = node.split()
            feat = names[sp.featureIndex()] if sp.featureIndex() < len(names) else str(sp.featureIndex())
            thr = float(sp.threshold()) if hasattr(sp, "threshold") else None
        rows.append((path, depth, feat, thr, float(node.prediction()), float(node.impurity()),
                     int(node.impurityStats().count())))
        if internal and depth < max_depth:
            stack.append((node.rightChild(), depth + 1, path + "R"))
            stack.append((node.leftChild(), depth + 1, path + "L"))
    return spark.createDataFrame(rows, "node string, depth int, feature string, threshold double, "
                                       "prediction double, impurity double, n long")


def linear_attributions(df: DataFrame, model, names: Sequence[str], background: DataFrame | None = None) -> DataFrame:
    """M12 for linear models: attribution_j = w_j * (x_j - mean_j) (exact Shapley values of a
    linear margin); returns the mean absolute attribution per feature, ranked."""
    bg = background if background is not None else df
    x = vector_to_array("features")
    w = [float(v) for v in model.coefficients.toArray()]
    means = bg.select(x.alias("x")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(w))]).alias("m")).scalar()
    d = df.select(x.alias("x")).withColumn("m", means)
    contrib = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(w[i]) * (F.col("x")[i] - F.col("m")[i])).alias("phi"))
                        for i, n in enumerate(names)])
    e = d.select(F.explode(contrib).alias("c")).select("c.*")
    g = e.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"))
    r = g.withColumn("model", F.lit("LogisticRegression"))
    return _ranked(r, "mean_abs", None).select("feature", "mean_abs", "mean", "rank")


def _walks(walks: np.ndarray, x: np.ndarray, key: int | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points (walks, steps, features) on the ways from ``walks`` to ``x``, in orders drawn by the key, and the step at which
    each feature is switched (walks, features)."""
    d = len(x)
    rng = np.random.default_rng([seed, abs(key or 0)])
    order = np.argsort(rng.random((len(walks), d)), axis=1)
    place = np.argsort(order, axis=1)
    on = place[:, None, :] < np.arange(d + 1)[None, :, None]
    return np.where(on, x, walks[:, None, :]), place


def _background(rows: DataFrame, n: int, seed: int, vec: str) -> np.ndarray:
    return np.array([r.x for r in hash_sample(rows.select("row_id", vec), n, seed).select("row_id", vector_to_array(vec).alias("x"))
                     .orderBy("row_id").collect()])


def forest_shapley_values(rows: DataFrame, background: DataFrame, forest: Forest, names: Sequence[str], *,
                          n_background: int = 50, orders: int = 2, seed: int = 42, vec: str = "features") -> DataFrame:
    """``shapley_values`` of a forest whose nodes are a table: the points of all walks are rows, scored by the forest as others are.

    A point counts for the feature switched to reach it, and against the one switched next.
    """
    start = np.repeat(_background(background, n_background, seed, vec), orders, axis=0)
    d = len(names)
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = shared.value
        for batch in batches:
            for i, x in enumerate(_matrix(batch)):
                key = batch.column(1)[i].as_py()
                at, place = _walks(walks, x, key, seed)
                order = np.argsort(place, axis=1)
                none = np.full((len(walks), 1), -1)
                flat = at.reshape(-1, d)
                yield pa.RecordBatch.from_pydict({
                    "row_id": pa.array([key] * len(flat), pa.int64()), "part": pa.array([uuid.uuid4().hex] * len(flat)),
                    "reached": pa.array(np.hstack([none, order]).ravel(), pa.int32()), "next": pa.array(np.hstack([order, none]).ravel(), pa.int32()),
                    "x": pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * d, pa.int32()), pa.array(flat.ravel()))})

    table = rows.select(vector_to_array(vec).alias("x"), F.col("row_id").cast("long").alias("row_id")).mapInArrow(
        points, "row_id long, part string, reached int, next int, x array<double>").withColumn("features", array_to_vector("x"))
    scored = forest.score(table, ["row_id", "part", "reached", "next"])
    steps = scored.select("row_id", "part", F.explode(F.array(F.struct(F.col("reached").alias("f"), F.col("score").alias("v")),
                                                              F.struct(F.col("next").alias("f"), (-F.col("score")).alias("v")))).alias("s"))
    sums = steps.where("s.f >= 0").groupBy("row_id", "part", F.col("s.f").alias("f")).agg((F.sum("s.v") / len(start)).alias("phi"))
    return sums.select("row_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1).alias("feature"), "phi")


def shapley_values(rows: DataFrame, background: DataFrame, predict: Callable[[np.ndarray], np.ndarray], names: Sequence[str], *,
                   n_background: int = 50, orders: int = 2, seed: int = 42, vec: str = "features") -> DataFrame:
    """M12 for any model: sampled Shapley values (Strumbelj & Kononenko 2014), as (row_id, feature, phi).

    Every explained row walks from each of ``n_background`` background rows (by hash order; a bounded array) to itself
    in ``orders`` random orders of the features, drawn by the row's id; a feature's value is the mean change of the prediction when it
    is switched. A row's values add up to its prediction less the background's mean, exactly; for a linear model they
    are w * (x - mean) in any order. ``predict`` maps a matrix of rows to predictions and runs on all walks of a row at once.
    """
    base = _background(background, n_background, seed, vec)
    d, shared = len(names), rows.sparkSession.sparkContext.broadcast((base, predict))

    def explain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, model = shared.value
        walks = np.repeat(start, orders, axis=0)
        for batch in batches:
            for i, x in enumerate(_matrix(batch)):
                key = batch.column(1)[i].as_py()
                points, place = _walks(walks, x, key, seed)
                step = np.diff(model(points.reshape(-1, d)).reshape(len(walks), d + 1), axis=1)
                phi = np.take_along_axis(step, place, axis=1).mean(axis=0)
                yield pa.RecordBatch.from_pydict({"row_id": pa.array([key] * d, pa.int64()), "feature": pa.array(list(names)), "phi": pa.array(phi)})

    return rows.select(vector_to_array(vec).alias("x"), F.col("row_id").cast("long").alias("row_id")).mapInArrow(explain, "row_id long, feature string, phi double")


def attribution_table(values: DataFrame, name: str) -> DataFrame:
    """Mean absolute and mean attribution of each feature, ranked."""
    g = values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean")).withColumn("model", F.lit(name))
    return _ranked(g, "mean_abs", None).select("model", "feature", "mean_abs", "mean", "rank")
