"""IO5 cache, the predictions store and the model register."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from churnkit.operators import ensemble as E
from churnkit.operators import models as MD
from churnkit.operators import panel as P
from churnkit.operators.metrics import model_table
from churnkit.sources.cache import PredictionStore, TableCache, cache_key, listing
from churnkit.sources.register import ModelRegister


def test_cache_is_read_rebuilt_and_ignores_half_written_tables(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("n", F.lit(len(built)))

    key = lambda **more: cache_key(inputs=listing(spark, source), **more)       # noqa: E731
    get = lambda k, **kw: TableCache(spark, str(tmp_path / "kept")).get("t", k, build, **kw)     # noqa: E731  (a new one each time, as another session has)
    first = key(scale=True)
    assert get(first).count() == 5 and get(first).count() == 5 and len(built) == 1
    assert key(scale=False) != first
    assert {r.n for r in get(first, force_reload=True).collect()} == {2}
    spark.range(5, 8).write.mode("append").parquet(source)
    assert key(scale=True) != first and get(key(scale=True)).count() == 8 and len(built) == 3
    half = cache_key(half=1)
    spark.range(2).write.parquet(str(tmp_path / "kept" / "t" / half / "rows-x"))       # no manifest
    assert get(half).count() == 8 and len(built) == 4
    with pytest.raises(FileNotFoundError):
        TableCache(spark, str(tmp_path / "kept")).read("t", "none")
    assert listing(spark, str(tmp_path / "missing")) == []


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    rows = [(i, int(y[i]), ("test", "val", "train", "train", "train")[i % 5], [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, label int, split string, a array<double>")
    return df.select("row_id", "label", "split", array_to_vector("a").alias("features")).repartition(2).persist()


FAMILIES = [P._tree("Tree", MD.decision_tree, max_depth=3), P.Family("Logistic", "linear", {"C": 1.0}),
            P.Family("Poly", "linear", {"C": 1.0, "degree": 2}), P.Family("Hinge", "linear", {"C": 1.0, "loss": "squared_hinge"}),
            P.Family("Machine", "kernel", {"kernel": "rbf", "C": 1.0, "m": 40})]


def test_panel_is_written_once_and_ensembles_equal_sql_over_it(spark, table, tmp_path):
    store = PredictionStore(TableCache(spark, str(tmp_path)), "v1")
    calls = []

    def source():
        calls.append(1)
        return table

    rows = P.predictions(store, source, FAMILIES)
    assert rows.count() == 5 * 400 and P.predictions(store, source, FAMILIES).count() == 2000 and len(calls) == 1
    want = {r.row_id: r.score for r in MD.logistic(table)[1].collect()}
    got = {r.row_id: r.score for r in rows.where("model = 'Logistic'").collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4
    # E6 and R3 over the stored rows by SQL
    test = rows.where("split = 'test'").select("row_id", "label", "model", "score", "prediction")
    voters = ["Tree", "Logistic", "Poly"]
    compared = E.comparison_table(test.unionByName(E.soft_vote(test, voters)))
    con = duckdb.connect()
    files = ", ".join(f"'{p}/*.parquet'" for p in {f.rsplit("/", 1)[0].removeprefix("file:") for f in rows.inputFiles()})
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet([{files}]) WHERE split = 'test'")
    sql = """WITH a AS (SELECT row_id, label, model, score, prediction FROM t UNION ALL SELECT row_id, label, 'Voting Ensemble', avg(score),
      CAST(avg(score) >= 0.5 AS INTEGER) FROM t WHERE model IN ('Tree', 'Logistic', 'Poly') GROUP BY ALL),
      p AS (SELECT model, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc
        FROM a p JOIN a n USING (model) WHERE p.label = 1 AND n.label = 0 GROUP BY model)
      SELECT a.model, avg(CAST(label = prediction AS INT)), any_value(auc) FROM a JOIN p USING (model) GROUP BY a.model"""
    by = {r.model: r for r in compared.collect()}
    want_rows = con.execute(sql).fetchall()
    assert len(want_rows) == len(by) == 6
    for model, accuracy, auc in want_rows:
        assert by[model].accuracy == pytest.approx(accuracy) and by[model].auc == pytest.approx(auc, abs=1e-9)
    best = max(want_rows, key=lambda r: r[2])[0]
    assert E.final_report(compared).where("section = 'top' AND rank = 1").first().model == best
    held = P.out_of_fold(store, source, FAMILIES[:3], folds=3)
    assert held.count() == 3 * 240 and held.select("row_id", "model").distinct().count() == 720
    meta = P.stacked(rows, held, voters)
    assert meta.count() == 160 and model_table(meta.where("split = 'test'")).first().auc > 0.7
    with pytest.raises(FileNotFoundError):
        store.read([("Missing", {})])


def test_reloaded_models_have_the_metrics_of_their_fit(spark, table, tmp_path):
    register = ModelRegister(spark, str(tmp_path / "register"))
    assert register.names() == []
    test = table.where("split = 'test'")

    def score(rows, model, name):
        p = model.transform(rows)
        return p.select("row_id", "label", F.lit(name).alias("model"), F.col("prediction").alias("score"), (F.col("prediction") >= 0.5).cast("int").alias("prediction"))

    for name, depth in (("shallow", 1), ("deep", 4)):
        model = DecisionTreeRegressor(maxDepth=depth).fit(MD.train_rows(table))
        row = model_table(score(test, model, name)).first().asDict()
        register.add(name, model, ["features"], MD.train_rows(table), {k: v for k, v in row.items() if k != "model"})
    assert register.names() == ["deep", "shallow"]
    got = register.evaluate(test, score, model_table).collect()
    assert len(got) == 10 and all(r.at_fit == pytest.approx(r.now, abs=1e-12) for r in got)
    assert register.evaluate(test.drop("features"), score, model_table).count() == 0
    assert register.entry("deep")["train"] == register.entry("shallow")["train"]
