"""The full preprocessing chain (F2) and the model input table.

raw -> clean -> encode -> derive -> stratified split -> standardise on the
train rows -> (optional) vector column. Two small actions happen (class
counts for the split, train mean/std for scaling); everything else is one
lazy plan.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import encoded, feature_columns, indicator_columns
from ..operators.scale import Standardizer
from ..operators.split import stratified_split
from .fixtures import churn_base


def scaled_columns(levels=None) -> list[str]:
    """Numeric non-dummy columns: the reference scales recoded ints but not dummies."""
    ind = set(indicator_columns(levels))
    return [c for c in feature_columns(levels) if c not in ind]


def feature_table(raw: DataFrame, scale: bool = True, levels=None, seed: int = 42,
                  test_size=0.2, val_size=0.1) -> DataFrame:
    """(row_id, label, split, <34 features>)."""
    enc = encoded(raw, levels)
    feats = feature_columns(levels)
    enc = enc.select("row_id", "label", *feats)
    out = stratified_split(enc, "label", test_size, val_size, seed)
    out = out.select("row_id", "label", "split", *feats)
    if scale:
        sc = Standardizer(scaled_columns(levels)).fit(out.filter(F.col("split") == "train"))
        out = sc.transform(out)
    return out


_CACHE: dict = {}


def churn_features(spark: SparkSession, sf_dir: str, scale: bool = True) -> DataFrame:
    """Feature table of the churn fixture, built once per session and kept
    (memory, spilling to disk) for the queries that follow (IO5 within a run)."""
    key = (spark.sparkContext.applicationId, sf_dir, scale)
    df = _CACHE.get(key)
    if df is None:
        df = feature_table(churn_base(spark, sf_dir), scale=scale).persist(StorageLevel.MEMORY_AND_DISK)
        _CACHE[key] = df
    return df


def with_vector(df: DataFrame, cols=None, out: str = "features") -> DataFrame:
    cols = list(cols or feature_columns())
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)
