"""A register of stored models (R4, IO7, IO8).

An entry names a model's folder, the columns it reads, the fingerprint of its training rows and the
metrics found when it was fitted. The model is saved first; the entry, which a reader looks for, is
published after it. ``evaluate`` loads every entry and scores it against a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import _fs, read_text, write_text


def fingerprint(df: DataFrame) -> str:
    """Rows and their hash sum: alike for the same rows in any order and partitioning."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


@dataclass
class ModelRegister:
    spark: SparkSession
    root: str

    def _entry(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.json"

    def add(self, name: str, model, columns: list[str], train: DataFrame, metrics: dict[str, float | None]) -> None:
        path = f"{self.root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        model.write().save(path)
        write_text(self.spark, self._entry(name), json.dumps({"path": path, "columns": columns, "train": fingerprint(train), "metrics": metrics}))

    def names(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(".json"))

    def entry(self, name: str) -> dict | None:
        text = read_text(self.spark, self._entry(name))
        return json.loads(text) if text else None

    def load(self, name: str):
        return DefaultParamsReader.loadParamsInstance(self.entry(name)["path"], self.spark.sparkContext)

    def evaluate(self, table: DataFrame, score: Callable[[DataFrame, object, str], DataFrame], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(model, metric, at_fit, now) of every entry: ``score(table, model, name)`` gives predictions, ``measure`` one row of
        metrics per model. Entries whose columns the table lacks are left out."""
        usable = [n for n in self.names() if set(self.entry(n)["columns"]) <= set(table.columns)]
        every = None
        for n in usable:
            p = score(table, self.load(n), n)
            every = p if every is None else every.unionByName(p)
        schema = "model string, metric string, at_fit double"
        known = self.spark.createDataFrame([(n, k, v) for n in usable for k, v in self.entry(n)["metrics"].items()], schema)
        if every is None:
            return known.withColumn("now", F.lit(None).cast("double"))
        m = measure(every)
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("now")) for c in m.columns if c != "model"])
        now = m.select("model", F.explode(cells).alias("c")).select("model", "c.*")
        return known.join(now, ["model", "metric"], "left").select("model", "metric", "at_fit", "now")
