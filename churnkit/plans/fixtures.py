"""Derived fixtures over the driver tables (FIXTURES.md §4-5).

``churn_base`` turns ``customer`` and ``orders`` into a raw customer-churn
table with the reference's columns. The DataFrame version below is what the
engine runs; ``CHURN_BASE_SQL`` is the same definition as DuckDB text, used
only by the oracle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


_BASE: dict = {}


def churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw churn table, built once per session and kept for later queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BASE:
        _BASE[key] = build_churn_base(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _BASE[key]


def build_churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")

    def n_if(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    # One partial+final aggregate per customer: a hot customer is combined
    # map-side before the shuffle.
    a = (orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("o_orderdate").alias("last_d"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
        n_if(prio == "1-URGENT").alias("p1"),
        n_if(prio == "2-HIGH").alias("p2"),
        n_if(prio == "3-MEDIUM").alias("p3"),
        n_if(prio == "4-NOT SPECIFIED").alias("p4"),
        n_if(prio == "5-LOW").alias("p5"),
        n_if(status == "F").alias("sf"),
        n_if(status == "O").alias("so"),
        n_if(status == "P").alias("sp")))
    # Latest order date as a scalar subquery (one value, computed once).
    d = orders.select(F.max("o_orderdate")).scalar()
    b = (customer.join(a, customer.c_custkey == a.o_custkey, "left").fillna(0, ["n", "total", "p1", "p2", "p3", "p4", "p5", "sf", "so", "sp"])
         .withColumn("ph", F.col("c_nationkey") % 10 != 0)
         .withColumn("inet", F.col("c_nationkey") % 3)
         .withColumn("tenure", ((F.col("c_custkey") * 37) % 73).cast("int")))

    inet = F.col("inet")

    def svc(counter, k):
        return (F.when(inet == 0, "No internet service")
                .when(F.col(counter) >= k, "Yes").otherwise("No"))

    yes_no = lambda cond: F.when(cond, "Yes").otherwise("No")
    return b.select(
        F.col("c_name").alias("customerID"),
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("SeniorCitizen"),
        yes_no(F.col("p1") >= 2).alias("Partner"),
        yes_no(F.col("sf") >= 3).alias("Dependents"),
        "tenure",
        yes_no(F.col("ph")).alias("PhoneService"),
        F.when(~F.col("ph"), "No phone service").when(F.col("sp") >= 3, "Yes").otherwise("No")
        .alias("MultipleLines"),
        F.when(inet == 0, "No").when(inet == 1, "DSL").otherwise("Fiber optic").alias("InternetService"),
        svc("p1", 3).alias("OnlineSecurity"),
        svc("p2", 2).alias("OnlineBackup"),
        svc("p3", 2).alias("DeviceProtection"),
        svc("p4", 2).alias("TechSupport"),
        svc("p5", 2).alias("StreamingTV"),
        svc("so", 3).alias("StreamingMovies"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "One year")
        .when(F.col("c_mktsegment") == "MACHINERY", "Two year")
        .otherwise("Month-to-month").alias("Contract"),
        yes_no(F.col("n") % 2 == 0).alias("PaperlessBilling"),
        F.when(F.col("c_custkey") % 4 == 0, "Electronic check")
        .when(F.col("c_custkey") % 4 == 1, "Mailed check")
        .when(F.col("c_custkey") % 4 == 2, "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)").alias("PaymentMethod"),
        F.when(F.col("n") > 0, F.floor(F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0)) / 4000 * 100) / 100).otherwise(0.0).alias("MonthlyCharges"),
        F.when(F.col("tenure") == 0, F.lit(" ")).otherwise(F.col("total").cast("string"))
        .alias("TotalCharges"),
        yes_no(F.col("last_d").isNull() | (F.col("last_d") < d - F.expr("INTERVAL 270 DAYS"))).alias("Churn"),
    )


CHURN_BASE_SQL = """
WITH m AS (SELECT max(o_orderdate) AS d FROM orders),
a AS (
  SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_d,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS p1,
         sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS p2,
         sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS p3,
         sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS p4,
         sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS p5,
         sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS sf,
         sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS so,
         sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS sp
  FROM orders GROUP BY o_custkey),
b AS (SELECT c.*, coalesce(n, 0) AS n, last_d, coalesce(total, 0) AS total, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3,
             coalesce(p4, 0) AS p4, coalesce(p5, 0) AS p5, coalesce(sf, 0) AS sf, coalesce(so, 0) AS so, coalesce(sp, 0) AS sp, m.d, c_nationkey % 10 <> 0 AS ph, c_nationkey % 3 AS inet,
             CAST((c_custkey * 37) % 73 AS INT) AS tenure
      FROM customer c LEFT JOIN a ON o_custkey = c_custkey CROSS JOIN m)
SELECT c_name AS customerID, c_custkey AS row_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS SeniorCitizen,
  CASE WHEN p1 >= 2 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN sf >= 3 THEN 'Yes' ELSE 'No' END AS Dependents,
  tenure,
  CASE WHEN ph THEN 'Yes' ELSE 'No' END AS PhoneService,
  CASE WHEN NOT ph THEN 'No phone service' WHEN sp >= 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  CASE inet WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' ELSE 'Fiber optic' END AS InternetService,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN p1 >= 3 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN p2 >= 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN p3 >= 2 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN p4 >= 2 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN p5 >= 2 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN inet = 0 THEN 'No internet service' WHEN so >= 3 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'One year' WHEN 'MACHINERY' THEN 'Two year' ELSE 'Month-to-month' END AS Contract,
  CASE WHEN n % 2 = 0 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
  CASE WHEN n > 0 THEN floor(CAST(total AS DOUBLE) / n / 4000 * 100) / 100 ELSE 0.0 END AS MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' ' ELSE CAST(total AS VARCHAR(30)) END AS TotalCharges,
  CASE WHEN last_d IS NULL OR last_d < d - INTERVAL '270' DAY THEN 'Yes' ELSE 'No' END AS Churn
FROM b
"""


def pseudo_scores(base: DataFrame) -> DataFrame:
    """Three deterministic 'model' scores in long form (row_id, label, model, score, prediction)."""
    label = F.when(F.col("Churn") == "Yes", 1).otherwise(0)
    s1 = F.col("tenure").cast("double") / 73
    s2 = F.col("MonthlyCharges") / 120
    s3 = ((F.col("row_id") * 17) % 101).cast("double") / 101
    wide = base.select("row_id", label.alias("label"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"))
    long = wide.select("row_id", "label", F.explode(F.array(
        F.struct(F.lit("s1").alias("model"), F.col("s1").alias("score")),
        F.struct(F.lit("s2").alias("model"), F.col("s2").alias("score")),
        F.struct(F.lit("s3").alias("model"), F.col("s3").alias("score")))).alias("m"))
    return long.select("row_id", "label", "m.model", "m.score",
                       (F.col("m.score") >= 0.5).cast("int").alias("prediction"))


PSEUDO_SCORES_SQL = """
SELECT row_id, label, model, score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (
  SELECT row_id, label, 's1' AS model, CAST(tenure AS DOUBLE) / 73 AS score FROM cb
  UNION ALL SELECT row_id, label, 's2', MonthlyCharges / 120 FROM cb
  UNION ALL SELECT row_id, label, 's3', CAST((row_id * 17) % 101 AS DOUBLE) / 101 FROM cb)
"""


def pseudo_clusters(base: DataFrame) -> DataFrame:
    """Deterministic cluster labels: tenure bands, every 20th row noise (-1)."""
    return base.withColumn(
        "cluster",
        F.when(F.col("row_id") % 20 == 0, F.lit(-1))
        .otherwise(F.floor(F.col("tenure").cast("double") / 25).cast("int")))


PSEUDO_CLUSTER_SQL = ("CASE WHEN row_id % 20 = 0 THEN -1 "
                      "ELSE CAST(floor(CAST(tenure AS DOUBLE) / 25) AS INTEGER) END")


def cb_sql(body: str) -> str:
    """Oracle text with the churn fixture and a ``label`` column as CTE ``cb``."""
    return ("WITH cb0 AS (" + CHURN_BASE_SQL + "), "
            "cb AS (SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label FROM cb0) "
            + body)
