"""Skew-safe forms against brute force, and plan checks."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.catalog import catalog
from marketlens.plans import derivations as dv
from marketlens.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"


def _rows(n, hot_share=0.4, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        who = "hot" if rng.random() < hot_share else f"c{rng.randrange(40)}"
        rows.append((who, date(1998, 1, 1) + timedelta(days=rng.randrange(90)), i))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 50, 1_000_000])
def test_term_chain_with_a_hot_customer(spark, width):
    rows = _rows(3000)
    got = {
        r["seq"]: (r["previous_seq"], r["is_last"], r["chain_start"], r["chain_start_seq"])
        for r in dv.term_chain(
            spark.createDataFrame(rows, "who string, start date, seq long"), "who", "start", "seq", width
        ).collect()
    }
    by_customer = {}
    for who, start, seq in rows:
        by_customer.setdefault(who, []).append((start, seq))
    want = {}
    for chain in by_customer.values():
        chain.sort()
        for i, (_, seq) in enumerate(chain):
            want[seq] = (chain[i - 1][1] if i else None, i == len(chain) - 1, chain[0][0], chain[0][1])
    assert got == want


@pytest.mark.parametrize("width", [1, 7, 1_000_000])
def test_chronological_ids_number_globally(spark, width):
    rows = _rows(2000, seed=3)
    df = spark.createDataFrame([(d, i) for _, d, i in rows], "created date, number long")
    got = {r["number"]: r["seq"] for r in dv.chronological_ids(df, "created", "number", width).collect()}
    want = {n: k + 1 for k, (_, n) in enumerate(sorted((d, i) for _, d, i in rows))}
    assert got == want


def test_chain_roots_walk_long_chains(spark):
    lengths = {"x": 37, "y": 1, "z": 5}
    rows = [(f"{c}{i}", f"{c}{i - 1}" if i else None) for c, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "subscription_id string, renewed_from_subscription_id string")
    got = {r["subscription_id"]: r["root_id"] for r in dv.chain_roots(df).collect()}
    assert got == {s: s[0] + "0" for s, _ in rows}


def test_chain_roots_across_customers_and_in_circles(spark):
    schema = "subscription_id string, renewed_from_subscription_id string, customer_id string"
    chain = [("a0", None, "a"), ("b1", "a0", "b"), ("c2", "b1", "c"), ("d3", "c2", "d"), ("e4", "d3", "e"), ("f5", "gone", "f")]
    got = {r["subscription_id"]: r["root_id"] for r in dv.chain_roots(spark.createDataFrame(chain, schema)).collect()}
    assert got == {**dict.fromkeys(("a0", "b1", "c2", "d3", "e4"), "a0"), "f5": "f5"}
    for n in (1, 2, 3, 4):
        circle = [(f"x{i}", f"x{(i + 1) % n}", "x") for i in range(n)]
        with pytest.raises(Exception, match="in a circle"):
            dv.chain_roots(spark.createDataFrame(chain + circle, schema)).collect()


def test_term_chain_with_sparse_keys_holds_only_days(spark):
    """Numbers unrelated to dates: no window partition is larger than the calendar or a cell."""
    rng = random.Random(9)
    rows = [("hot", date(1998, 1, 1) + timedelta(days=rng.randrange(60)), rng.randrange(10**12)) for _ in range(3000)]
    df = dv.term_chain(spark.createDataFrame(rows, "who string, start date, seq long"), "who", "start", "seq")
    got = sorted((r["start"], r["seq"], r["previous_seq"]) for r in df.collect())
    assert [p for _, _, p in got] == [None, *(seq for _, seq, _ in got[:-1])]


# Windows against the monthly series: both sides bounded by the calendar.
NESTED_OK = {"business_monthly_by_period"}


def test_no_cartesian_products_and_no_python(spark):
    wh = Warehouse.open(spark, FOLDER)
    quick = [q for q in catalog() if q not in ("drip_feed_stream", "revenue_stream", "write_raw_tables", "snapshot_overwrite")]
    for name in quick:
        plan = catalog()[name](wh)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
        if name not in NESTED_OK:
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    wh = Warehouse.open(spark, FOLDER)
    plan = catalog()["category_margin"](wh)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date,2000-01-01)" in plan
    assert "order_line_id" not in plan and "unit_price" not in plan


def test_snapshots_do_not_shuffle(spark):
    snap = Warehouse.open(spark, FOLDER).as_of("1999-06-30")
    for name in ("orders", "invoices", "subscriptions", "tickets"):
        assert "Exchange" not in snap.stg(name)._jdf.queryExecution().executedPlan().toString()


def test_results_do_not_depend_on_partitioning(spark):
    wh = Warehouse.open(spark, FOLDER)
    first = {tuple(r) for r in catalog()["table_fingerprint"](wh).collect()}
    shuffled = Warehouse(
        spark, wh.raw, staged=lambda name: wh.stg(name).repartition(13, F.rand(seed=1))
    )
    from marketlens.operators.quality import table_fingerprint

    assert {tuple(r) for r in table_fingerprint(shuffled).collect()} == first


def test_hot_key_of_a_lookup_is_split(spark):
    """One key holds most facts; the lookup join must split it and stay exact."""
    from marketlens.plans.temporal import as_of_lookup

    n = 40_000
    facts = spark.range(0, n, 1, 12).select(
        F.col("id"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("who"),
        F.expr("date_add(date'1998-01-01', cast(id % 400 as int))").alias("on"),
    )
    history = spark.range(500).select(
        F.explode(F.array(F.concat(F.lit("c"), "id"), F.lit("hot"))).alias("who")
    ).distinct().select("who", F.explode(F.expr("array(date'1998-01-01', date'1998-09-01')")).alias("since"))
    history = history.withColumn("name", F.concat_ws("/", "who", F.month("since")))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = as_of_lookup(facts, history, key="who", date="on", since="since", take=["name"])
        execution = out._jdf.queryExecution()
        assert execution.toRdd().count() == n
        assert "skew=true" in execution.executedPlan().toString()
        right = F.concat_ws("/", "who", F.when(F.col("on") < "1998-09-01", 1).otherwise(9))
        assert out.filter(F.col("name") != right).count() == 0 and out.filter("name is null").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
