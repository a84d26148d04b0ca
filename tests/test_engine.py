import os

import duckdb
import pytest

import __spark_entry__
from shelfspark.plans import api, config
from shelfspark.plans import queries as retail_queries
from shelfspark.plans.registry import Registry
from shelfspark.sources import readers, retail
from shelfspark.streaming.weekly import weekly_demand

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(retail_queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    assert sorted(d[0] for d in got.description) == columns
    at = [[d[0] for d in got.description].index(c) for c in columns]
    key = lambda r: tuple(map(repr, r))
    assert sorted(key(r) for r in rows.select(*columns).collect()) == sorted(key([r[i] for i in at]) for r in got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


SALES = "timestamp,product_id,qty,unit_price\n"


def written_csv(tmp_path, text):
    (tmp_path / "sales.csv").write_text(text)
    return f"file://{tmp_path}/sales.csv"


def test_csv_rows_and_rejected_rows(spark, tmp_path):
    path = written_csv(tmp_path, SALES + "2025-01-06 10:00:00,1,3,2.5\n2025-01-07 10:00:00,2,4,NaN\n2025-01-08 10:00:00,3,,\n2025-01-08 10:00:00,x,5,1.0\n2025-01-08,4,5\n2025-01-08,5,6,1.0,9\nnever,6,7,1.0\n")
    rows = readers.read_csv(spark, path, "sales").orderBy("product_id").collect()
    assert [(r.product_id, r.qty, r.unit_price) for r in rows] == [(1, 3, 2.5), (2, 4, None), (3, None, None)]
    bad = readers.rejected_rows(spark, path, "sales").collect()
    assert sorted(r.line for r in bad) == ["2025-01-08 10:00:00,x,5,1.0", "2025-01-08,4,5", "2025-01-08,5,6,1.0,9", "never,6,7,1.0"]
    assert {r.cells.product_id for r in bad} == {None, 4, 5, 6}
    # A query of one column doesn't take in rows that are bad in another one.
    assert sorted(r.qty for r in readers.read_csv(spark, path, "sales").select("qty").na.drop().collect()) == [3, 4]
    assert readers.read_csv(spark, path, "sales").count() == 3


def test_csv_headers(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="CSV introuvable"):
        readers.read_csv(spark, f"file://{tmp_path}/none.csv", "sales")
    for header, cells in (("timestamp,product_id,qty", "2025-01-06,1,3"), ("timestamp,product_id,qty,unit_price,note", "2025-01-06,1,3,2.5,a"), ("product_id,timestamp,qty,unit_price", "1,2025-01-06,3,2.5")):
        path = written_csv(tmp_path, f"{header}\n{cells}\n")
        with pytest.raises(Exception, match="header"):
            readers.read_csv(spark, path, "sales").collect()
        row = readers.read_csv(spark, path, "sales", header.split(",")).first().asDict()
        assert (row["product_id"], row["qty"]) == (1, 3)
        assert row.get("note", "a") == "a"


def test_csv_takes_one_scan_without_a_look_at_the_header(spark, tmp_path):
    path = written_csv(tmp_path, SALES + "2025-01-06 10:00:00,1,3,2.5\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("csv-read", "")
    try:
        readers.read_csv(spark, path, "sales")
        assert len(tracker.getJobIdsForGroup("csv-read")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    t = {n: getattr(retail, n)(spark, SF) for n in ("products", "sales", "competitor_prices", "product_suppliers", "promotions")}
    store = Registry(spark, f"file://{tmp_path_factory.mktemp('artifacts')}")
    training = api.Training(spark, store, retail.TIES)
    training.train_all(t)
    training.train_demand(t, trees=20)
    training.train_price(t, trees=20)
    training.train_promo(t, trees=20)
    training.train_anomaly(t, trees=30)
    return t, store, api.Inference(spark, store, retail.TIES)


def test_reports(service):
    _, store, _ = service
    assert store.latest_report("train")["products"] == 200
    report = store.latest_report("price_ml")
    assert report["feature_cols"][0] == "product_id"
    with pytest.raises(FileNotFoundError):
        store.latest("nothing")


def test_answers_for_all_and_for_one(service):
    t, _, inference = service
    assert inference.stock_risk().count() == 200
    whole = {r.product_id: r for r in inference.demand(t).collect()}
    assert len(whole) == 200
    assert {r.source for r in whole.values()} == {"ML_QUANTILE_GBR"}
    one = inference.demand(t, 7).collect()
    assert [(r.product_id, r.p50) for r in one] == [(7, pytest.approx(whole[7].p50))]
    for answer in (inference.price(t, 7), inference.promo(t, 7), inference.restock(t, 7), inference.anomalies(t, 7)):
        assert [r.product_id for r in answer.collect()] == [7]
    assert inference.price(t).filter("recommended_price < interval.low or recommended_price > interval.high").count() == 0


def test_products_without_enough_sales(service):
    t, _, inference = service
    few = t | {"sales": t["sales"].filter("product_id <> 3").withColumn("timestamp", retail.F.when(retail.F.col("product_id") == 4, retail.F.lit("1994-01-03")).otherwise(retail.F.col("timestamp")).cast("timestamp"))}
    for ask, model in ((inference.price, "pricing"), (inference.promo, "promo")):
        got = {r.product_id: r for r in ask(few).collect()}
        assert len(got) == 200
        assert (got[3].error, got[4].error) == ("Pas de ventes pour ce produit.", f"Historique insuffisant (<4 semaines) pour {model} ML.")
        assert got[3].explanation is None
        assert got[7].error is None
        assert ask(few, 3).first().error == got[3].error


def test_unknown_products(service):
    t, _, inference = service
    assert inference.demand(t, 10**9).first().source == "NO_DATA"
    assert inference.stock_risk(10**9).first().probability == 0.0
    assert inference.anomalies(t, 10**9).first().error is not None
    for ask in (inference.price, inference.promo, inference.restock):
        with pytest.raises(api.ProductNotFound):
            ask(t, 10**9)
    assert api.health() == {"status": "ok"}


def test_folders():
    assert config.folders("/b", {}) == config.Folders("/b/data", "/b/artifacts", "/b/artifacts/models", "/b/artifacts/reports")
    assert config.folders("/b", {"ARTIFACTS_DIR": "/a", "REPORTS_DIR": "/r"}) == config.Folders("/b/data", "/a", "/a/models", "/r")


def test_a_release_that_is_cut_off_is_never_read(spark, tmp_path):
    store = Registry(spark, f"file://{tmp_path}")
    with store.release() as out:
        out.save("a", spark.range(1))
        out.save("b", spark.range(1))
        out.report("r", n=1)
        assert not store.has("a")
    other = Registry(spark, f"file://{tmp_path}")
    seen = []
    with pytest.raises(ZeroDivisionError), store.release() as out:
        out.save("a", spark.range(5))
        seen.append((store.latest("a").count(), other.latest("a").count(), store.latest_report("r")["n"]))
        1 / 0  # noqa: B018
    assert seen == [(1, 1, 1)]
    assert (store.latest("a").count(), other.latest("b").count()) == (1, 1)


def test_two_releases_at_once(spark, tmp_path):
    store = Registry(spark, f"file://{tmp_path}")
    assert len({store.save("k", spark.range(n)) for n in (1, 2)}) == 2
    assert store.latest("k").count() == 2
    with pytest.raises(Exception, match="exist"):
        store.save("k", spark.range(1), "20250101_000000") and store.save("k", spark.range(1), "20250101_000000")


def test_models_are_loaded_once_for_each_release(service, spark):
    t, store, inference = service
    inference.price(t)
    first = store.loaded["price_ml"][1]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("second-load", "")
    try:
        assert inference._models("price_ml") is first
        inference.price(t)
        assert len(tracker.getJobIdsForGroup("second-load")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store.save("price_ml", store.latest("price_ml"))
    assert inference._models("price_ml") is not first
    assert inference.price(t, 7).first().error is None


def test_later_artifacts_replace_earlier_ones(spark, tmp_path):
    store = Registry(spark, f"file://{tmp_path}")
    store.save("k", spark.range(1), "20250101_000000")
    assert store.latest("k").count() == 1
    store.save("k", spark.range(2), "20250102_000000")
    assert store.latest("k").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    sales = retail.sales(spark, SF).withColumn("timestamp", retail.F.col("timestamp").cast("timestamp"))
    path = f"file://{tmp_path}/sales"
    sales.write.parquet(path)
    stream = weekly_demand(spark.readStream.schema(sales.schema).parquet(path), "5000 days")
    q = stream.writeStream.format("memory").queryName("weekly_stream").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = __spark_entry__.queries()["weekly_sales"](spark, SF)
    got = spark.table("weekly_stream")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_nothing_else_imports_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "shelfspark")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "shelfspark.llm" not in f.read(), n
