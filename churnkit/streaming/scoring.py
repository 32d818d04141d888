"""Batch and streaming scoring with a saved pipeline (IO7, IO8, IO10).

Scoring is a stateless projection (feature chain + model transform), so the
same function serves a batch DataFrame and a Structured Streaming one.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import encoded, feature_columns
from ..operators.scale import Standardizer


def save_model(model, path: str) -> None:
    """IO7: Spark ML persistence (overwrites)."""
    model.write().overwrite().save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_models(spark: SparkSession, folder: str, names, loader=PipelineModel.load) -> dict:
    """IO8: load the named models that exist under ``folder``; missing ones are skipped."""
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in names}
    return {n: loader(p) for n, p in paths.items() if path_exists(spark, p)}


def scaling_stage(scaler: Standardizer) -> SQLTransformer:
    """F1 with its fitted numbers as a pipeline stage, so that it is saved and loaded with the model."""
    scaled = ", ".join(f"(CAST(`{c}` AS DOUBLE) - {scaler.mean[c]!r}D) / {scaler.std[c]!r}D AS `z_{c}`" for c in scaler.cols)
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def fit_pipeline(train: DataFrame, scaler: Standardizer, estimator, cols=None) -> PipelineModel:
    """Scaling, vector and ``estimator`` fitted on encoded rows, as one model that can be saved."""
    cols = list(cols or feature_columns())
    inputs = [f"z_{c}" if c in scaler.cols else c for c in cols]
    vector = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[scaling_stage(scaler), vector, estimator]).fit(train)


def best_model(comparison: DataFrame, names) -> str | None:
    """The name with the highest AUC among those that are loaded (ties to the first name)."""
    row = (comparison.where(F.col("model").isin(list(names)) & F.col("auc").isNotNull())
           .orderBy(F.col("auc").desc(), "model").select("model").limit(1).collect())
    return row[0][0] if row else None


def score(raw: DataFrame, model, name: str = "model") -> DataFrame:
    """IO10: raw customer rows -> (row_id, model, score, prediction), by a saved pipeline.

    Works on batch and streaming inputs: every step is a per-row projection.
    """
    s = model.transform(encoded(raw).select("row_id", *feature_columns()))
    p1 = vector_to_array("probability")[1] if "probability" in s.columns else F.col("prediction")
    return s.select("row_id", F.lit(name).alias("model"), p1.cast("double").alias("score"),
                    (p1 >= 0.5).cast("int").alias("prediction"))


def stream_score(spark: SparkSession, source_dir: str, schema: T.StructType, model,
                 checkpoint: str, fmt: str = "parquet", sink: str = "memory", query_name: str = "scored"):
    """Start a streaming scoring query reading new files of ``source_dir``.

    The checkpoint folder must be on shared storage so a restarted driver or
    lost executors resume exactly once.
    """
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    out = score(src, model)
    w = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(query_name)
    else:
        w = w.format(sink)
    return w.start()
