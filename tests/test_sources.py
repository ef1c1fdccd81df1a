import datetime as dt
import json
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import DATA, item
from pyspark.sql import functions as F

from checks.queries import INPUT_TABLES, QUERIES
from vendastat.plans.catalog import VIEWS, cache_views, refresh_views, register_views
from vendastat.plans.fact import order_fact
from vendastat.schemas import TABLES
from vendastat.session import cluster_conf, materialize, scan_bytes, shared_folder
from vendastat.sources.retail import RetailStar
from vendastat.sources.sinks import file_stem, json_payload, read_csv, read_documents, save_fact, write_csv, write_documents
from vendastat.sources.tables import list_tables, range_predicates, read_star, register_tables, run_query, table_inventory


@pytest.fixture(scope="module")
def star(spark):
    return RetailStar(spark, str(DATA), status="delivered")


def test_star_round_trip(spark, star, tmp_path):
    for name, df in zip(TABLES, (star.items, star.customers, star.sellers, star.payments)):
        df.write.parquet(f"{tmp_path}/{name}")
    stored = read_star(spark, str(tmp_path))
    assert stored.items.count() == 19856
    assert order_fact(stored).exceptAll(order_fact(star)).count() == 0


def test_views_by_name_with_bound_parameters(spark, star):
    names = register_views(spark, star)
    assert len(names) == 11
    listed = [r["table_name"] for r in list_tables(spark).collect()]
    assert set(names) <= set(listed) and listed == sorted(listed)
    few = run_query(spark, "SELECT * FROM vw_monthly_kpis WHERE total_orders >= :n", {"n": 60})
    assert few.count() == 47
    risky = run_query(spark, "SELECT :x AS x", {"x": "'; DROP"})
    assert risky.first()["x"] == "'; DROP"
    cache_views(spark, ["vw_state_performance"])
    assert spark.table("vw_state_performance").count() == 25
    assert spark.catalog.isCached("vw_state_performance")
    refresh_views(spark, star)
    assert not spark.catalog.isCached("vw_state_performance")
    for name in names:
        spark.catalog.dropTempView(name)


def test_views_share_a_stored_fact(spark, star, tmp_path):
    save_fact(order_fact(star), f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    january = fact.where("purchase_month_date = DATE'1996-01-01'")
    assert "PartitionFilters: [isnotnull(purchase_month_date" in january._jdf.queryExecution().executedPlan().toString()
    names = register_views(spark, star, fact)
    assert spark.table("vw_cohort_retention").count() == 1690
    assert spark.table("vw_order_fact").columns == order_fact(star).columns
    for name in names:
        spark.catalog.dropTempView(name)


def test_stored_fact_has_few_files_and_splits_large_months(spark, star, tmp_path):
    fact = order_fact(star, ["order_id", "purchase_month_date", "price"]).repartition(16)
    save_fact(fact, f"{tmp_path}/few")
    months = len(list(Path(f"{tmp_path}/few").glob("purchase_month_date=*")))
    assert months == len(list(Path(f"{tmp_path}/few").glob("*/part-*"))) == 79
    hot = fact.withColumn("purchase_month_date", F.lit(dt.date(2020, 1, 1)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        save_fact(hot, f"{tmp_path}/hot")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(f"{tmp_path}/hot").glob("*/part-*"))) > 3
    assert spark.read.parquet(f"{tmp_path}/hot").count() == 19856


def test_inventory_counts_rows(spark):
    got = table_inventory({"a": spark.range(3), "b": spark.range(0)})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 3), ("b", 0)]


def test_csv_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "São", None), (2, 'a,"b"', 1.5)], "k int, t string, v double")
    write_csv(df, f"{tmp_path}/csv", small=True)
    (part,) = Path(f"{tmp_path}/csv").glob("part-*")
    assert part.read_text(encoding="utf-8").splitlines()[:2] == ["k,t,v", "1,São,"]
    texts = spark.createDataFrame([("x", "# a\nb"), ("y", None)], "k string, markdown string")
    write_documents(texts, f"{tmp_path}/all", "k")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/all").select("k", "markdown").collect())) == [
        ("x", "# a\nb"), ("y", None),
    ]
    write_documents(texts, f"{tmp_path}/md", "k", names=["x"])
    assert [p.name for p in Path(f"{tmp_path}/md").glob("k=*")] == ["k=x"]
    (part,) = Path(f"{tmp_path}/md/k=x").glob("part-*")
    assert part.read_text() == "# a\nb\n"
    stem = spark.range(1).select(file_stem(F.lit("Product & Category/New"))).first()[0]
    assert stem == "product_and_category_new"


def test_csv_keeps_the_declared_order(spark, tmp_path):
    rows = [(i, None if i == 7 else (i * 37) % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(8)
    want = [str(k) for k, v in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))]
    for small in (True, False):
        write_csv(df, f"{tmp_path}/{small}", small=small, order=["-v", "k"])
        parts = sorted(Path(f"{tmp_path}/{small}").glob("part-*"))
        assert (len(parts) == 1) or not small
        lines = [line for p in parts for line in p.read_text().splitlines() if line != "k,v"]
        assert [line.split(",")[0] for line in lines] == want


def test_json_payload(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2020, 1, 1), Decimal("1.50"), None, {"a": 1.5}, 2.5)],
        "n int, d date, m decimal(10,2), t string, s map<string,double>, x double",
    )
    assert json.loads(json_payload(df).first()["payload"]) == {
        "n": 1, "d": "2020-01-01", "m": "1.50", "t": None, "s": {"a": 1.5}, "x": 2.5,
    }


def test_materialized_table_is_in_the_shared_folder(spark):
    df = materialize(spark.range(10).toDF("x"), "t")
    assert df.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(
        shared_folder(spark).removeprefix("file:").lstrip("/")
    )
    assert df.count() == 10 and scan_bytes(df) < 100_000


def test_scan_reads_only_the_columns_a_view_needs(spark):
    columns = VIEWS["vw_seller_performance"].columns
    fact = order_fact(RetailStar(spark, str(DATA), "delivered"), columns)
    plan = VIEWS["vw_seller_performance"].build(fact)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "customer.parquet" not in plan and "part.parquet" not in plan
    assert "l_discount" not in plan and "l_linenumber" not in plan and "SinglePartition" not in plan


def test_cluster_settings_follow_the_input():
    small, large = cluster_conf(10**9), cluster_conf(10**14)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert large["spark.sql.shuffle.partitions"] == "20000"
    assert large["spark.sql.files.maxPartitionBytes"] == str(256 * 1024**2)


def test_items_carry_every_declared_column(make_star):
    assert make_star([item(1)]).items.columns == TABLES["fact_order_items"].fieldNames()


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["", None, " ", '"', '""', ",", "\n", "a\nb", "a\r\nb", "\\", '\\"', "é, \"x\"\n,", " padded ", "null", "NULL", "'"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    write_csv(df, f"{tmp_path}/csv", order=["n"])
    assert [r["text"] for r in read_csv(spark, f"{tmp_path}/csv", df.schema).orderBy("n").collect()] == texts
    assert read_csv(spark, f"{tmp_path}/csv", df.schema).dtypes == df.dtypes


def test_documents_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "# One\n\nline"), ("b", 'say "x"')], "key string, markdown string")
    write_documents(df, f"{tmp_path}/lines", "key")
    assert sorted(map(tuple, read_documents(spark, f"{tmp_path}/lines", df.schema).collect())) == sorted(map(tuple, df.collect()))
    write_documents(df, f"{tmp_path}/files", "key", names=["a"])
    schema = spark.createDataFrame([], "key string, value string").schema
    (row,) = read_documents(spark, f"{tmp_path}/files", schema).collect()
    assert (row["key"], row["value"].rstrip("\n")) == ("a", "# One\n\nline")


def test_tables_are_listed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/one")
    for _ in range(2):  # a database of that name is replaced
        register_tables(spark, "listed_here", {"b": f"{tmp_path}/one", "a": f"{tmp_path}/one"})
        assert [r["table_name"] for r in list_tables(spark, "listed_here").collect()] == ["a", "b"]
    assert spark.table("listed_here.a").count() == 3


def test_listed_tables_are_counted(spark, tmp_path):
    for n, name in enumerate(INPUT_TABLES):
        spark.range(n).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = QUERIES["list_tables"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == sorted((name, n) for n, name in enumerate(INPUT_TABLES))


@pytest.mark.parametrize("values, cuts", [([None, 0, 5, 9, 10, 11, 99], [5, 10]), ([None, "", "a", "it's", "z"], ["b", "it's"]), ([1, None], [])])
def test_slices_of_a_table_take_every_row_once(spark, values, cuts):
    kind = "string" if isinstance(values[-2], str) else "bigint"
    df = spark.createDataFrame([(v,) for v in values], f"id {kind}")
    parts = [[r["id"] for r in df.where(p).collect()] for p in range_predicates("id", cuts)]
    assert len(parts) == len(cuts) + 1
    assert sorted(map(repr, sum(parts, []))) == sorted(map(repr, values))
