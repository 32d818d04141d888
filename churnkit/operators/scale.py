"""Standardisation (F1) and min-max rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import attach


class Standardizer:
    """Mean and population std from the fitting rows, applied everywhere.

    Fitting is one aggregate (partial/final); only 2 numbers per column reach
    the driver. A column with zero std is only centred (std taken as 1), as
    scikit-learn does.
    """

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.mean: dict[str, float] = {}
        self.std: dict[str, float] = {}

    def fit(self, df: DataFrame) -> "Standardizer":
        aggs = []
        for c in self.cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        for c in self.cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            self.mean[c] = 0.0 if m is None else float(m)
            self.std[c] = 1.0 if (s is None or s == 0.0) else float(s)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        repl = {c: ((F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.std[c]))
                for c in self.cols}
        return df.withColumns(repl)


def standardize(df: DataFrame, cols: Sequence[str], fit_on=None) -> DataFrame:
    """fit on the rows selected by ``fit_on`` (a Column), apply to all rows."""
    fit_df = df if fit_on is None else df.filter(fit_on)
    return Standardizer(cols).fit(fit_df).transform(df)


def minmax(df: DataFrame, col: str, name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) per group; a constant column gives null.

    The min/max are a grouped aggregate, read by every row as a map (one entry
    per group), so no row moves.
    """
    name = name or col
    by = list(by)
    mm = df.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    scaled = (F.col(col) - F.col("_mn")) / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0.0))
    return attach(df, mm, by).withColumn(name, scaled).drop("_mn", "_mx")
