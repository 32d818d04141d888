from pyspark.sql import functions as F

from churnkit.functions.columns import tenure_band, to_number
from churnkit.operators.prep import encode


def test_tenure_bands_right_closed(spark):
    df = spark.createDataFrame([(t,) for t in (0, 12, 13, 24, 48, 72, 73)], "tenure int")
    got = [r[0] for r in df.select(tenure_band("tenure")).collect()]
    assert got == [None, "0-1yr", "1-2yr", "1-2yr", "2-4yr", "4-6yr", None]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(" ",), ("NaN",), ("12.5",), ("abc",)], "t string")
    got = [r[0] for r in df.select(F.coalesce(to_number("t"), F.lit(0.0))).collect()]
    assert got == [0.0, 0.0, 12.5, 0.0]


def test_unseen_category(spark):
    df = spark.createDataFrame([("Maybe", "Satellite", "Yes")], "Partner string, InternetService string, Churn string")
    r = encode(df).first().asDict()
    assert r["Partner"] is None
    assert r["InternetService_DSL"] == 0 and r["InternetService_No"] == 0 and r["InternetService_Fiber optic"] == 0
