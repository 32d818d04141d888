import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnkit.sources.tables import read_folder, write_split


def test_read_folder_stacks_by_name(spark):
    d = tempfile.mkdtemp(prefix="churnkit-io-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("id,x\n1,a\n2,b\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("id,y\n3,c\n")
    df = read_folder(spark, d)
    rows = sorted((r["id"], r["x"], r["y"]) for r in df.collect())
    assert rows == [(1, "a", None), (2, "b", None), (3, None, "c")]


def test_empty_folder(spark):
    assert read_folder(spark, tempfile.mkdtemp(prefix="churnkit-io-")).count() == 0


def test_write_split_partitions(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="churnkit-io-"), "sets")
    df = spark.range(6).select(F.col("id").alias("row_id"),
                               F.when(F.col("id") < 4, "train").otherwise("test").alias("split"))
    write_split(df, out)
    assert {"split=test", "split=train"} <= set(os.listdir(out))
    assert spark.read.parquet(out).filter("split = 'train'").count() == 4


def test_read_csv_and_write_result(spark):
    from churnkit.sources.tables import RAW_SCHEMA, read_csv, write_result
    folder = os.path.join(tempfile.mkdtemp(prefix="churnkit-io-"), "raw")
    cols = [f.name for f in RAW_SCHEMA.fields]
    row = {f.name: ("x" if f.dataType.simpleString() == "string" else "3") for f in RAW_SCHEMA.fields}
    df = spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"`{c}` string" for c in cols))
    write_result(df, folder, "csv")
    back = read_csv(spark, folder)
    assert back.schema.simpleString() == RAW_SCHEMA.simpleString() and back.count() == 1
    write_result(back, folder + "-p", "parquet")
    assert spark.read.parquet(folder + "-p").collect() == back.collect()


def test_read_folder_with_one_schema_and_equal_headers(spark):
    d = tempfile.mkdtemp(prefix="churnkit-io-")
    for k, name in enumerate(("a.csv", "b.csv", "note.txt")):
        with open(os.path.join(d, name), "w") as f:
            f.write(f"id,x\n{k},v{k}\n")
    assert sorted(r.id for r in read_folder(spark, d).collect()) == [0, 1]
    typed = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.StringType())])
    assert sorted(r.id for r in read_folder(spark, d, schema=typed).collect()) == ["0", "1"]


def test_saved_pipeline_scores_alone_and_as_a_stream(spark):
    from pyspark.ml.classification import LogisticRegression

    from churnkit.operators.prep import encoded, feature_columns
    from churnkit.operators.scale import Standardizer
    from churnkit.plans.fixtures import churn_base
    from churnkit.plans.pipeline import scaled_columns
    from churnkit.streaming.scoring import best_model, fit_pipeline, load_models, save_model, score, stream_score
    raw = churn_base(spark, "/root/testdata/sf0.001")
    train = encoded(raw).select("row_id", "label", *feature_columns())
    scaler = Standardizer(scaled_columns()).fit(train)
    folder = tempfile.mkdtemp(prefix="churnkit-models-")
    fitted = fit_pipeline(train, scaler, LogisticRegression(regParam=0.1))
    save_model(fitted, f"{folder}/one")
    loaded = load_models(spark, folder, ["one", "absent"])
    assert list(loaded) == ["one"]
    want = sorted(score(raw, fitted).collect())
    assert sorted(score(raw, loaded["one"]).collect()) == want and want
    table = spark.createDataFrame([("one", 0.7), ("two", 0.9), ("none", None)], "model string, auc double")
    assert best_model(table, ["one", "none"]) == "one" and best_model(table, []) is None
    raw.write.parquet(f"{folder}/raw")
    q = stream_score(spark, f"{folder}/raw", raw.schema, loaded["one"], f"{folder}/ckpt", query_name="scored_test")
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("scored_test").collect()) == want
