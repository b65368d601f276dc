"""The event stream gives the batch's daily revenue, whatever repeats or comes late, with a bounded state."""

from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.plans.warehouse import Warehouse
from marketlens.sources.store import scratch_folder
from marketlens.streaming import revenue as stream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.open(spark, FOLDER)


def rows(df):
    return Counter(tuple(map(str, r)) for r in df.select("activity_date", "measure_name", "amount").collect())


def test_stream_equals_the_batch_and_forgets(spark, wh):
    events = stream.revenue_events(wh)
    assert events.count() == events.select("event_id").distinct().count() == wh.mart("fct_revenue").count()
    folder, days = scratch_folder(spark, "test-stream"), ("1998-12-31", "1999-01-31", "1999-03-31", "2000-06-30", "2000-12-31")
    sent, held = 0, []
    for load in stream.loads(events, *days):
        load = load.unionByName(load.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0))  # repeats within a load
        sent += load.count()
        stream.append_events(load, f"{folder}/log")
        query = stream.follow(spark, f"{folder}/log", f"{folder}/slices", f"{folder}/checkpoint")
        held.append(sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"]))
    batch = wh.mart("fct_revenue").filter("activity_date <= '2000-12-31'").groupBy("activity_date", "measure_name")
    want = rows(batch.agg(F.sum("amount").cast("decimal(28,2)").alias("amount")))
    assert rows(stream.newest(spark, f"{folder}/slices")) == want
    assert rows(stream.fold(spark, f"{folder}/slices", f"{folder}/folded")) == want
    distinct = events.filter("activity_date <= '2000-12-31'").count()
    assert sent > 1.3 * distinct and held[-1] < distinct / 5, held
    # a run without new files changes nothing
    stream.follow(spark, f"{folder}/log", f"{folder}/slices", f"{folder}/checkpoint")
    assert rows(stream.newest(spark, f"{folder}/slices")) == want


def test_late_repeated_and_odd_events(spark):
    folder, first = scratch_folder(spark, "test-odd-stream"), date(2000, 1, 1)
    at = lambda k: first + timedelta(days=k)
    loads = [
        [("a", at(0), "gmv", 1), ("a", at(0), "gmv", 1), ("b", at(9), "gmv", 2), (None, at(9), "gmv", 5), (None, at(9), "gmv", 5), ("n", None, "gmv", 9)],
        [("c", at(5), "gmv", 4), ("b", at(9), "gmv", 2), ("d", at(200), "net", -3)],
        [("late", at(1), "gmv", 100), ("a", at(0), "gmv", 1), ("e", at(201), "net", 1)],  # passed by the watermark
    ]
    for load in loads:
        stream.append_events(spark.createDataFrame([(i, d, m, Decimal(v)) for i, d, m, v in load], stream.EVENT), f"{folder}/log")
        stream.follow(spark, f"{folder}/log", f"{folder}/slices", f"{folder}/checkpoint", files_per_batch=1000)
    got = {(r["activity_date"], r["measure_name"]): float(r["amount"]) for r in stream.newest(spark, f"{folder}/slices").collect()}
    assert got == {(at(0), "gmv"): 1, (at(9), "gmv"): 7, (at(5), "gmv"): 4, (at(200), "net"): -3, (at(201), "net"): 1}


def test_a_long_load_is_taken_in_by_periods(spark):
    """A load of two years holds no more state than two delays and one period, and gives the same sums."""
    folder, first = scratch_folder(spark, "test-long-load"), date(1999, 1, 1)
    rows = [(f"e{i}", first + timedelta(days=i * 7 % 730), "gmv", Decimal(i)) for i in range(7300)]
    load = spark.createDataFrame([*rows, *rows[::3], ("n", None, "gmv", Decimal(1))], stream.EVENT).repartition(4)
    parts = stream.periods(load, 1000)
    assert len(parts) > 9 and sum(p.count() for p in parts) == load.count() and len(stream.periods(load)) == 1
    ends = [p.agg(F.min("activity_date"), F.max("activity_date")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    held = []
    follow, settings = stream.follow, {k: spark.conf.get(k, None) for k in (*stream._STATE, "spark.sql.shuffle.partitions")}
    try:
        stream.follow = lambda *a: held.append(max(s["numRowsTotal"] for p in follow(*a).recentProgress for s in p["stateOperators"]))
        stream.take_in(load, f"{folder}/log", f"{folder}/slices", f"{folder}/checkpoint", most=2500)
    finally:
        stream.follow = follow
    assert settings == {k: spark.conf.get(k, None) for k in settings}
    assert len(held) == 4 and max(held) < 3200, held
    want = Counter()
    for _, d, _, v in rows:
        want[d] += v
    got = {r["activity_date"]: r["amount"] for r in stream.newest(spark, f"{folder}/slices").collect()}
    assert got == want
