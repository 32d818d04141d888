"""Readers and writers (IO1, IO2, IO4, IO6)."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Raw customer file schema (declared, never inferred). TotalCharges stays text:
# blanks must survive the read so that the cleaning step decides about them.
RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_SCHEMA) -> DataFrame:
    """IO1: one headed CSV file (or a folder of parts) with a declared schema."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def list_files(spark: SparkSession, folder: str, ext: str) -> list[str]:
    """Files of a folder in any store that Spark reads, by the Hadoop file system of its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(ext))


def _plain(path: str) -> str:
    """A path without scheme and escapes, as listings and scans write it differently."""
    return unquote(urlparse(path).path)


def read_folder(spark: SparkSession, folder: str, fmt: str = "csv",
                schema: T.StructType | None = None) -> DataFrame:
    """IO2: every file of a folder, stacked by column name.

    Files with different columns are aligned by name; a column missing in
    one file is null there. An empty folder gives an empty DataFrame.
    Files with the same columns are one scan (without a schema, CSV types are
    found by one more read of them). The union is lazy and all scans run in
    parallel.
    """
    files = list_files(spark, folder, "." + fmt)
    if not files:
        return spark.createDataFrame([], schema or T.StructType([]))
    if schema is not None:
        groups = {None: files}
    elif fmt == "csv":
        # the headers of all files in one scan: each task reads its files' first lines; files of one header become one scan
        lines = spark.read.text(files).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"), "value")
        heads = {_plain(r.f): r.head for r in lines.groupBy("f").agg(F.min_by("value", "n").alias("head")).collect()}
        groups = {}
        for f in files:
            groups.setdefault(heads.get(_plain(f), ""), []).append(f)
    else:
        groups = {}
        for f in files:
            groups.setdefault(spark.read.format(fmt).load(f).schema.json(), []).append(f)
    out = None
    for paths in groups.values():
        if fmt == "csv":
            part = spark.read.option("header", True).option("inferSchema", schema is None)
            part = part.schema(schema).csv(paths) if schema is not None else part.csv(paths)
        else:
            part = (spark.read.schema(schema) if schema is not None else spark.read).format(fmt).load(paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_split(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """IO4: the split data set, one directory per split value."""
    w = df.write.mode(mode).partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """IO6: a result table. Results are small aggregates; no coalesce is forced."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
