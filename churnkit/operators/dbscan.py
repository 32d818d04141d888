"""Density clustering (DBSCAN) of all rows, exact.

Points of up to three dimensions fall into cells of side eps / sqrt(d), so all points of a
cell are neighbours. A cell of at least ``min_samples`` rows is dense: its points are core
and of one cluster, with no pair compared. The other cells hold fewer rows than that, so
the join of their points with the cells around costs each point a bounded number of
comparisons, however many rows a dense cell has; the dense side is salted. Two dense
cells are joined if some pair of their points is near: boxes of a finer grid with one real point
each settle most pairs, and only pairs of boxes that stay open are split further, until a
box is one point. Clusters are the components of cells and remaining core points.

With more dimensions the cells have side eps over the three columns of the widest spread, and
all pairs of neighbouring cells are compared in full: exact, but a cell of n different points costs
n * n comparisons (rows at equal places are one weighted point at any dimension).

A border point joins the cluster of the least label among its core neighbours; clusters are
numbered by the least row id of their core points; noise is -1.

Cases: rows with a null or NaN coordinate are noise; equal points count with their number;
an empty table gives no rows. ``row_id`` is unique.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import connected_components
from .ordered import dense_index

#: Salts of a cell's points, and parts of a box's side when it is split.
SALTS, PARTS = 16, 8


def _square(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return total


def _gap(a: str, b: str, d: int) -> Column:
    """Square of the least distance of two boxes (columns lo0.. and hi0.. with the prefixes)."""
    total = F.lit(0.0)
    for i in range(d):
        part = F.greatest(F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.lit(0.0))
        total = total + part * part
    return total


def _boxes(points: DataFrame, d: int, side: float, level: int) -> DataFrame:
    """(cell, box, parent, lo*, hi*, p*) of the dense cells at a level of the finer grid; p is one real point."""
    key = lambda n: F.concat_ws(",", *[F.floor(F.col(f"x{i}") / F.lit(side / PARTS**n)).cast("string") for i in range(d)])
    first = F.min(F.struct(*[f"x{i}" for i in range(d)]))
    rows = points.groupBy("cell", key(level).alias("box"), key(level - 1).alias("parent")).agg(
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)], first.alias("p"))
    return rows.select("cell", "box", "parent", *[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)],
                       *[F.col("p")[f"x{i}"].alias(f"p{i}") for i in range(d)])


def _dense_edges(points: DataFrame, pairs: DataFrame, d: int, side: float, eps2: float) -> DataFrame:
    """The pairs (a, b) of dense cells with points no further apart than eps."""
    found, level = None, 1
    open_ = pairs.withColumn("pa", F.lit(None).cast("string")).withColumn("pb", F.lit(None).cast("string"))
    while True:
        boxes = _boxes(points, d, side, level)
        left = boxes.select(*[F.col(c).alias(f"l_{c}") for c in boxes.columns])
        right = boxes.select(*[F.col(c).alias(f"r_{c}") for c in boxes.columns])
        on_left = (F.col("a") == F.col("l_cell")) & (F.col("pa").isNull() | (F.col("pa") == F.col("l_parent")) if level == 1 else F.col("pa") == F.col("l_parent"))
        on_right = (F.col("b") == F.col("r_cell")) & (F.lit(True) if level == 1 else F.col("pb") == F.col("r_parent"))
        both = open_.join(left, on_left).join(right, on_right)
        near = _square([F.col(f"l_p{i}") for i in range(d)], [F.col(f"r_p{i}") for i in range(d)]) <= eps2
        may = _gap("l_", "r_", d) <= eps2
        both = written(both.where(may).select("a", "b", F.col("l_box").alias("pa"), F.col("r_box").alias("pb"), near.alias("near")))
        yes = both.where("near").select("a", "b").distinct()
        found = yes if found is None else found.union(yes)
        open_ = both.join(yes, ["a", "b"], "left_anti").select("a", "b", "pa", "pb").distinct()
        if open_.limit(1).count() == 0:
            return found.distinct()
        level += 1


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5, row_id: str = "row_id") -> DataFrame:
    """(row_id, cluster, is_core) of every row; ``min_samples`` counts the row itself."""
    d, eps2 = len(cols), eps * eps
    rows = df.select(F.col(row_id).alias("row_id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    xs = [f"x{i}" for i in range(d)]
    whole = F.lit(True)
    for x in xs:
        whole = whole & F.col(x).isNotNull() & ~F.isnan(x)
    points = rows.where(whole).groupBy(*xs).agg(F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("n"))
    if d <= 3:
        side, axes, reach = eps / d**0.5 * (1 - 1e-9), xs, 2
    else:
        spread = rows.where(whole).agg(*[(F.max(x) - F.min(x)).alias(x) for x in xs]).first()
        side, axes, reach = eps * (1 + 1e-9), sorted(xs, key=lambda x: (-(spread[x] or 0.0), x))[:3], 1
    at = [F.floor(F.col(x) / F.lit(side)).cast("long") for x in axes]
    points = points.withColumn("at", F.array(*at)).withColumn("cell", F.concat_ws(",", *[a.cast("string") for a in at]))
    cells = points.groupBy("cell").agg(F.sum("n").alias("cell_n"), F.min("pid").alias("cell_id"), F.first("at").alias("at"))
    cells = cells.withColumn("dense", (F.col("cell_n") >= min_samples) & F.lit(d <= 3))
    salt = F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int")
    marks = cells.select("cell", "dense", "cell_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    points = written(points.withColumn("salt", salt).join(marks, ["cell", "salt"]))

    # points of sparse cells meet the points of all cells around
    offsets = [o for o in itertools.product(range(-reach, reach + 1), repeat=len(axes))]
    around = F.explode(F.array(*[F.concat_ws(",", *[(F.col("at")[k] + o[k]).cast("string") for k in range(len(axes))]) for o in offsets]))
    probes = (points.where("NOT dense").select(F.col("pid").alias("a"), F.col("n").alias("a_n"), *[F.col(x).alias(f"a_{x}") for x in xs], around.alias("cell"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    pairs = (probes.join(points.select("cell", "salt", "pid", "n", "dense", "cell_id", *xs), ["cell", "salt"])
             .where(_square([F.col(f"a_{x}") for x in xs], [F.col(x) for x in xs]) <= eps2)
             .select("a", F.col("pid").alias("b"), "n", "dense", "cell_id"))
    pairs = written(pairs)
    sparse_core = written(pairs.groupBy("a").agg(F.sum("n").alias("near")).where(F.col("near") >= min_samples).select(F.col("a").alias("pid")))

    # core neighbours of sparse points, by their node: the cell of a dense one, itself of a sparse one
    linked = pairs.join(sparse_core.select(F.col("pid").alias("b"), F.lit(True).alias("core_b")), "b", "left")
    linked = written(linked.where("dense OR core_b").select("a", F.when(F.col("dense"), F.col("cell_id")).otherwise(F.col("b")).alias("node")).distinct())
    edges = linked.join(sparse_core.select(F.col("pid").alias("a")), "a").select("a", F.col("node").alias("b"))
    dense = cells.where("dense")
    if d <= 3:
        forward = [o for o in offsets if o > (0,) * d]
        around = F.explode(F.array(*[F.concat_ws(",", *[(F.col("at")[k] + o[k]).cast("string") for k in range(d)]) for o in forward]))
        near = dense.select(F.col("cell").alias("a"), around.alias("b")).join(dense.select(F.col("cell").alias("b")), "b")
        met = _dense_edges(points.where("dense").select("cell", *xs), written(near.select("a", "b")), d, side, eps2)
        ids = dense.select("cell", "cell_id")
        met = (met.join(ids.select(F.col("cell").alias("a"), F.col("cell_id").alias("ia")), "a")
               .join(ids.select(F.col("cell").alias("b"), F.col("cell_id").alias("ib")), "b"))
        edges = edges.union(met.select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    nodes = dense.select(F.col("cell_id").alias("node")).union(sparse_core.select(F.col("pid").alias("node")))
    labels = connected_components(nodes, edges)
    numbers = dense_index(labels.select(F.col("label")).distinct(), "label", "cluster")
    of_node = written(labels.join(numbers.select("label", F.col("cluster").cast("int").alias("cluster")), "label"))

    border = linked.join(of_node, "node").groupBy(F.col("a").alias("pid")).agg(F.min("cluster").alias("border"))
    sparse = (points.where("NOT dense").select("pid").join(of_node.select(F.col("node").alias("pid"), F.col("cluster")), "pid", "left")
              .join(border, "pid", "left").select("pid", F.coalesce("cluster", "border").alias("cluster"), F.col("cluster").isNotNull().alias("is_core")))
    core = points.where("dense").select("pid", F.col("cell_id").alias("node"), salt.alias("salt"))
    spread_out = of_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    core = core.join(spread_out, ["node", "salt"]).select("pid", "cluster", F.lit(True).alias("is_core"))
    decided = points.select("pid", *xs).join(sparse.union(core), "pid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row_salt = F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")
    out = rows.withColumn("salt", row_salt).join(decided.drop("pid"), [*xs, "salt"], "left")
    return out.select("row_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).cast("int").alias("is_core"))
