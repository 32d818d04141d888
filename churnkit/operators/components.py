"""Connected components of an edge table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component.

    ``nodes`` has the column node, ``edges`` a and b (either direction suffices). Every round each node takes the
    least label of itself and its neighbours, then the label's own label; rounds end when no label falls.
    Each round is written to the shared folder. An edge's ends must be nodes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    now = written(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        seen = both.join(now, both["a"] == now["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        moved = written(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label")))
        if moved.where("label < old").limit(1).count() == 0:
            return moved.select("node", "label")
        now = moved.select("node", "label")
