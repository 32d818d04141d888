"""Query registry: name -> (Spark builder, DuckDB oracle text or None).

Keys are the SURVEY §2 inventory id in lower case plus a short name.
Every builder takes (spark, sf_dir) and reads the driver tables; results
round doubles to 6 digits so two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    repl = {f.name: F.round(F.col(f"`{f.name}`"), digits)
            for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(repl) if repl else df
