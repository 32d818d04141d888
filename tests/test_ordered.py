import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnkit.operators.ordered import monotone_bucket, running_totals
from churnkit.operators.profile import exact_quantiles


def test_monotone_bucket_is_monotone(spark):
    vals = sorted([0.0, 1e-300, -1e-300, 0.5, 0.25, 0.2500001, 1.0, 2.0, 7.999999, 8.0, 8.000001, -3.0, -0.1, 1e12])
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = [r[0] for r in df.select(monotone_bucket("x")).collect()]
    got = dict(zip([r[0] for r in df.collect()], b))
    ks = [got[v] for v in vals]
    assert ks == sorted(ks)


def test_running_totals_match_plain_window(spark):
    random.seed(1)
    rows = [(g, float(random.randint(-50, 50)) / 7, random.randint(0, 3)) for g in range(3) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, x double, v int").groupBy("g", "x").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("g").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(tuple(r) for r in df.select("g", "x", F.sum("v").over(w)).collect())
    for parts in (1, 4, 13):
        r = running_totals(df.repartition(parts), ["g"], ["x"], ["v"], monotone_bucket("x"), descending=True)
        got = sorted(tuple(x) for x in r.select("g", "x", "cum_v").collect())
        assert got == want


def test_exact_quantiles_match_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    q = exact_quantiles(df, ["a"], [0.25, 0.5, 0.75]).first()
    assert np.allclose([q["q_0"], q["q_1"], q["q_2"]], np.percentile(vals, [25, 50, 75]))
