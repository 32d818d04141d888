from pyspark.sql import functions as F

from churnkit.operators.split import allocate, split_sizes, stratified_folds, stratified_split


def test_reference_split_sizes():
    # 7043 rows, 1869 positives -> the shipped label files: test 374/1035, val 187/518, train 1308/3621
    test, val = split_sizes({1: 1869, 0: 5174})
    assert (test[1], test[0]) == (374, 1035)
    assert (val[1], val[0]) == (187, 518)
    assert 1869 - test[1] - val[1] == 1308 and 5174 - test[0] - val[0] == 3621


def test_allocate_tie_to_lower_label():
    assert allocate({0: 5, 1: 5}, 3) == {0: 2, 1: 1}


def test_split_exact_and_deterministic(spark):
    df = spark.range(0, 997).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = stratified_split(df).groupBy("split", "label").count().collect()
    counts = {(r["split"], r["label"]): r["count"] for r in a}
    test, val = split_sizes({1: 333, 0: 664})
    assert counts[("test", 1)] == test[1] and counts[("val", 0)] == val[0]
    one = sorted(tuple(r) for r in stratified_split(df.repartition(1)).select("row_id", "split").collect())
    many = sorted(tuple(r) for r in stratified_split(df.repartition(13)).select("row_id", "split").collect())
    assert one == many


def test_folds_are_ntile(spark):
    df = spark.range(0, 101).select(F.col("id").alias("row_id"), F.lit(0).alias("label"))
    sizes = sorted(r["count"] for r in stratified_folds(df, k=5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 20, 20, 21]
