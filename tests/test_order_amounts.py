"""Amounts of orders come from the lines without storing them; accounts are joined for what is read."""

import pytest
from pyspark.sql import functions as F

from marketlens import catalog
from marketlens.operators import revenue
from marketlens.plans import marts
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.store import TableStore, scratch_folder

URGENT, CONSUMER = "1-URGENT", "3-MEDIUM"


@pytest.fixture(scope="module")
def folder(spark):
    """Orders with repeated and null keys, one with a hot key, lines without an order or a part, a repeated part."""
    days = ["1995-03-01", "1997-08-15", "1999-11-20", "1996-01-31"]
    orders = [(i, i % 9, days[i % 4], URGENT if i % 5 == 0 else "4-NOT SPECIFIED" if i % 7 == 0 else CONSUMER) for i in range(60)]
    orders += [(3, 3, days[1], CONSUMER), (3, 3, days[1], CONSUMER), (None, 2, days[0], CONSUMER), (61, None, days[2], CONSUMER), (62, 4, None, CONSUMER)]
    lines = [(i % 70, i % 11, i % 4, i % 6, float(1 + i % 50), 10.25 * i, "1998-02-03") for i in range(400)]
    lines += [(7, 2, 1, 1, 5.0, 99.5, "1998-02-03")] * 300 + [(None, 1, 1, 1, 2.0, 1.0, None), (8, None, 1, 1, 2.0, 1.0, None), (9, 1, 1, 1, None, 1.0, None)]
    parts = [(i, "PROMO" if i % 2 else "SMALL", 10.07 + i) for i in range(9)] + [(4, "PROMO", 3.33), (None, None, 1.0)]
    customers = [(i, "BUILDING" if i % 2 else "AUTOMOBILE") for i in range(9)] + [(4, "BUILDING")]
    path = scratch_folder(spark, "test-order-amounts")

    def put(name, rows, ddl, *dates):
        df = spark.createDataFrame(rows, ddl)
        df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates}).repartition(3).write.parquet(f"{path}/{name}.parquet")

    put("orders", orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string", "o_orderdate")
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string", "l_shipdate")
    put("part", parts, "p_partkey long, p_type string, p_retailprice double")
    put("customer", customers, "c_custkey long, c_mktsegment string")
    return path


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_revenue_stores_neither_lines_nor_wide_orders(spark, folder):
    wh = Warehouse.refresh(spark, folder)
    lean = rows(revenue.revenue_measure(wh, "gmv", "1990-01-01", "2005-12-31"))
    assert "stg_orders" in wh.store._ready and not {"stg_order_lines", "int_orders"} & set(wh.store._ready)
    plan = wh.source.table("app_db__orders")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan

    other = Warehouse.refresh(spark, folder)
    other.stg("order_lines")
    other.mart("int_orders")
    assert rows(revenue.revenue_measure(other, "gmv", "1990-01-01", "2005-12-31")) == lean != []
    for read in (lambda w: w.stg("orders"), marts.account_orders, marts.eligible_orders, marts.fct_revenue, *[
            lambda w, t=t: marts.revenue_tables(w)[t] for t in ("orders", "invoices", "revenue_recognition", "refunds")]):
        assert rows(read(wh).select(sorted(read(wh).columns))) == rows(read(other).select(sorted(read(wh).columns)))
    assert "int_orders" not in wh.store._ready and "stg_order_lines" not in wh.store._ready


def test_amounts_of_orders_by_hand(spark, folder):
    """Every line counts once per order of its key and per part of its key; unknown parts have no price."""
    wh = Warehouse.refresh(spark, folder)
    got = {}
    for r in wh.stg("orders").filter("subscription_id IS NULL AND promo_code IS NULL").collect():
        got.setdefault(r["order_id"], set()).add(r["gross_amount"])
    price = {}
    for p in spark.read.parquet(f"{folder}/part.parquet").collect():
        price.setdefault(p["p_partkey"], []).append(p["p_retailprice"])
    ids = [r["o_orderkey"] for r in spark.read.parquet(f"{folder}/orders.parquet").filter(f"o_orderpriority <> '{URGENT}'").collect()]
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").collect()
    checked = 0
    for key in {i for i in ids if i is not None and f"ord_{i}" in got}:
        mine = [r for r in lines if r["l_orderkey"] == key and r["l_quantity"] is not None and r["l_partkey"] is not None]
        gross = ids.count(key) * sum(int(r["l_quantity"]) * p for r in mine for p in price.get(r["l_partkey"], []))
        assert [float(g) for g in got[f"ord_{key}"]] == [pytest.approx(gross, abs=0.005)]
        checked += gross > 0
    assert checked > 20 and ids.count(3) == 3


def test_amounts_are_not_sent_once_more_to_be_added_up(spark, folder):
    """Where nothing is small enough for a broadcast, lines lie by order once they are joined, and stay there."""
    wh = Warehouse.refresh(spark, folder)
    wh.stg("subscriptions")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = wh.source.table("app_db__orders")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(order_id" not in plan
    assert plan.count("Exchange hashpartitioning(") == 5  # lines and parts by part, lines and orders by order, orders with their amounts


def test_increments_and_reconciliation_store_neither_lines_nor_wide_orders(spark, folder):
    for name in ("mart_increment", "metric_reconcile"):
        Warehouse.refresh(spark, folder)
        assert catalog.queries()[name](spark, folder).count() > 0
        assert not {"stg_order_lines", "int_orders"} & set(Warehouse.open(spark, folder).store._ready)


def test_stored_tables_are_small(spark):
    """Ids are digits that hardly repeat: packed by entropy, they take far less than their length."""
    df = spark.range(20000).select(F.concat(F.lit("ord_"), (F.xxhash64("id") % 10**12).cast("string")).alias("order_id")).coalesce(1)
    out = TableStore(spark, "test-stored-size").table("ids", lambda: df)
    plain = scratch_folder(spark, "test-plain")
    df.write.option("compression", "snappy").parquet(plain)

    def size(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    assert rows(out) == rows(df)
    assert size(out.inputFiles()[0]) < 0.7 * size(plain)
