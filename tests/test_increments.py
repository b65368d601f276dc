"""Signed changes, version tables and running totals against full builds and plain Python."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions import day
from marketlens.operators import increments, revenue
from marketlens.plans.staging import STAGING
from marketlens.plans.versions import FROM, OPEN, TO, WEIGHT, change_columns, signed_changes, versions
from marketlens.plans.visibility import RAW_OF
from marketlens.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"
DAYS = ("1996-12-31", "1997-07-01", "1997-07-02", "1998-03-31", "2000-12-31", "2003-01-01")


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.open(spark, FOLDER)


@pytest.fixture(scope="module")
def late(spark, wh):
    """The same tables with customers, orders and links that arrive after what refers to them."""
    tables = {raw: wh.raw(raw) for raw, _ in STAGING.values()}

    def delayed(raw, column, share, by):
        hit = F.pmod(F.xxhash64(*tables[raw].columns), F.lit(100)) < share
        tables[raw] = tables[raw].withColumn(column, F.when(hit, F.col(column) + F.make_interval(days=F.lit(by))).otherwise(F.col(column)))

    delayed("app_db__customers", "created_at", 40, 300)
    delayed("app_db__orders", "order_date", 30, 200)
    delayed("app_db__customer_id_crosswalk", "linked_at", 50, 150)
    delayed("stripe__customers", "created_at", 50, 400)
    return Warehouse.open_raw(spark, _written(spark, tables))


def _written(spark, tables):
    from marketlens.sources.store import scratch_folder

    folder = scratch_folder(spark, "test-late")
    for raw, df in tables.items():
        df.write.parquet(f"{folder}/{raw}")
    return folder


def rows(df):
    return Counter(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("which", ["wh", "late"])
def test_revenue_from_changes_equals_a_full_build(request, which):
    w = request.getfixturevalue(which)
    got = rows(increments.mart_increment(w, *DAYS))
    assert got == rows(increments.revenue_state(w.as_of(DAYS[-1]))) and len(got) > 1000
    back = increments.apply_revenue(increments.revenue_state(w.as_of("1998-03-31")), increments.revenue_changes(w, "1998-03-31", "1998-03-31"))
    assert rows(back) == rows(increments.revenue_state(w.as_of("1998-03-31")))


def _small(spark):
    """Repeated orders, customers later than their orders, orders later than what refers to them, null keys."""
    put = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    ts = lambda text: None if text is None else datetime.fromisoformat(text)
    people = [("a", "2000-01-01", "customer"), ("b", "2000-03-01", "customer"), ("c", "2000-01-01", "test"), ("d", None, "customer")]
    orders = [("o1", "a", "d2c", "2000-01-05"), ("o2", "b", "d2c", "2000-01-06"), ("o3", "a", "business_subscription", "2000-02-10"), ("o3", "a", "business_subscription", "2000-02-10"),
              ("o4", "c", "d2c", "2000-01-05"), ("o5", "d", "d2c", "2000-01-05"), (None, "a", "d2c", "2000-02-11"), ("o6", None, "d2c", "2000-02-11"), ("o7", "a", "d2c", None)]
    ids = [*dict.fromkeys(o[0] for o in orders)]
    early = ["2000-01-01", "2000-02-20", "2000-04-01"]
    facts = [(f"f{i}", o, ts(early[i % 3]), 10.0 + i) for i, o in enumerate(ids * 3)]
    tables = {
        "app_db__customers": put([(k, ts(d), "consumer", t, "d2c") for k, d, t in people], "app_db_customer_id string, created_at timestamp_ntz, segment string, account_type string, acquisition_channel string"),
        "app_db__orders": put([(*o[:3], ts(o[3]), 50.0, None, 50.0, None, None) for o in orders], "order_id string, customer_id string, channel string, order_date timestamp_ntz, gross_amount double, take_rate double, net_amount double, promo_code string, subscription_id string"),
        "app_db__invoices": put([(f, o, d, d, d + timedelta(days=30) if i % 2 else None, a, False, "s") for i, (f, o, d, a) in enumerate(facts)], "invoice_id string, order_id string, billed_date timestamp_ntz, due_date timestamp_ntz, collected_date timestamp_ntz, amount double, is_bad_debt boolean, salesforce_customer_id string"),
        "app_db__revenue_recognition": put([f[1:] for f in facts], "order_id string, recognition_date timestamp_ntz, amount double"),
        "stripe__refunds": put([(*f, "s") for f in facts], "refund_id string, order_id string, refund_date timestamp_ntz, refund_amount double, stripe_customer_id string"),
    }
    return Warehouse.of(spark, tables)


def test_one_pass_gives_the_changes_of_every_step(spark):
    """Also where an order comes twice, or it or its customer later than an amount: no amount counts twice."""
    w, days = _small(spark), ("1999-12-31", "2000-01-31", "2000-02-15", "2000-03-15", "2000-12-31")
    changes = increments.revenue_changes(w, *days).localCheckpoint()
    for step in range(1, len(days)):
        state = increments.apply_revenue(increments.revenue_state(w.as_of(days[step - 1])), changes.filter(F.col(increments.STEP) == step))
        assert rows(state) == rows(increments.revenue_state(w.as_of(days[step])))
    assert rows(increments.mart_increment(w, *days)) == rows(increments.revenue_state(w.as_of(days[-1]))) != Counter()


def test_facts_are_sent_once_for_all_steps(spark):
    w, days = _small(spark), ("1999-12-31", "2000-01-31", "2000-02-15", "2000-03-15", "2000-12-31")
    sent = [increments.revenue_changes(w, *d)._jdf.queryExecution().executedPlan().toString().count("Exchange ") for d in (days[:2], days)]
    assert sent[0] == sent[1] > 0


def test_a_sum_that_no_row_is_left_of_goes(spark):
    state = spark.createDataFrame([(date(2000, 1, 1), "gmv", Decimal("5.00"), 1), (date(2000, 1, 2), "gmv", Decimal("0.00"), 2)], "activity_date date, measure_name string, amount decimal(28,2), rows bigint")
    changes = spark.createDataFrame([(date(2000, 1, 1), "gmv", Decimal("5.00"), -1), (date(2000, 1, 3), "gmv", Decimal("7.50"), 1)], "activity_date date, measure_name string, amount decimal(18,2), weight int")
    got = sorted(tuple(r) for r in increments.apply_revenue(state, changes).collect())
    assert got == [(date(2000, 1, 2), "gmv", Decimal("0.00"), 2), (date(2000, 1, 3), "gmv", Decimal("7.50"), 1)]


@pytest.mark.parametrize("which", ["wh", "late"])
def test_customers_from_changes_equal_a_full_build(request, which):
    w = request.getfixturevalue(which)
    assert rows(increments.mart_increment_customers(w, *DAYS)) == rows(w.as_of(DAYS[-1]).mart("dim_customers"))


def test_a_withdrawn_link_stops_the_increment(spark, wh):
    from marketlens.operators.increments import _only_new

    with pytest.raises(Exception, match="withdrawn"):
        _only_new(spark.createDataFrame([("a", -1)], "k string, weight int"), "a link").collect()


def test_changes_are_what_two_snapshots_differ_by(wh):
    after, upto = "1998-06-30", "1999-03-31"
    for name in STAGING:
        key, arrival, _ = change_columns(name)
        old, new = rows(wh.as_of(after).stg(name)), rows(wh.as_of(upto).stg(name))
        want = Counter({k: v for k, v in ((k, new[k] - old[k]) for k in old | new) if v})
        columns = sorted(wh.stg(name).columns)
        got = Counter()
        for r in signed_changes(wh, name, after, upto).select(*columns, WEIGHT).collect():
            got[tuple(map(str, r[:-1]))] += r[-1]
        assert Counter({k: v for k, v in got.items() if v}) == want, name


def test_changes_read_by_date_and_do_not_shuffle(spark, wh):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name in ("orders", "revenue_recognition", "invoices", "subscriptions"):
        plan = signed_changes(wh, name, "1998-06-30", "1998-07-31")._jdf.queryExecution().executedPlan().toString()
        _, arrival, update = change_columns(name)
        assert "Exchange" not in plan and f"GreaterThan({arrival}," in plan
        assert update is None or f"GreaterThan({update}," in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_intervals_of_a_row_do_not_overlap(wh):
    for name in ("invoices", "subscriptions", "tickets", "stripe_customers"):
        key, _, _ = change_columns(name)
        held = defaultdict(list)
        for r in versions(wh, name).select(*key, FROM, TO, OPEN).collect():
            held[tuple(r[: len(key)])].append((r[FROM], r[TO], r[OPEN]))
        assert all(len(v) <= 2 for v in held.values())
        for own in held.values():
            own.sort()
            assert own[-1][1] is None and not any(o for _, _, o in own[1:])
            assert len(own) < 2 or own[0][1] + timedelta(days=1) == own[1][0]


def test_series_equals_one_snapshot_per_day(wh):
    days = ["1990-01-01", "1995-01-01", "1997-06-30", "1997-07-01", "1999-02-14", "2001-12-31", "2031-01-01"]
    got = {(str(r["as_of"]), r["table_name"]): r for r in increments.visible_as_of_series(wh, F.array(*map(day, days))).collect()}
    assert len(got) == len(days) * len(STAGING)
    for d in days[1::2]:
        snap = wh.as_of(d)
        for name, (raw, _) in STAGING.items():
            amount = increments.AMOUNT.get(name)
            want = snap.stg(name).agg(F.count(F.lit(1)), F.coalesce(F.sum(amount) if amount else F.lit(0), F.lit(0)).cast("double")).first()
            assert (got[d, raw]["rows"], got[d, raw]["amount"]) == tuple(want), (d, raw)
        for name, column in (("invoices", "collected_date"), ("tickets", "resolved_date"), ("stripe_customers", "deactivated_date")):
            assert got[d, RAW_OF[name]]["open_rows"] == snap.stg(name).filter(f"{column} is null").count()


def test_a_hundred_thousand_windows(spark):
    rng = random.Random(2)
    first = date(1999, 1, 1)
    daily = {(m, first + timedelta(days=rng.randrange(900))): Decimal(rng.randrange(-5000, 9000)) / 100 for m in ("gmv", "net") for _ in range(500)}
    sums = {m: [Decimal(0)] for m in ("gmv", "net")}
    for m, own in sums.items():
        for k in range(1400):
            own.append(own[-1] + daily.get((m, first + timedelta(days=k - 200)), 0))
    ask = [(i, rng.choice(["gmv", "net", "other"]), rng.randrange(1400), rng.randrange(1400)) for i in range(100_000)]
    at = lambda k: first + timedelta(days=k - 200)
    windows = spark.createDataFrame([(i, m, at(a), at(b)) for i, m, a, b in ask] + [(-1, "gmv", None, at(5)), (-2, "gmv", at(3), None), (-3, None, at(3), at(9))],
                                    "case_name int, measure_name string, start_date date, end_date date")
    frame = spark.createDataFrame([(m, d, v) for (m, d), v in daily.items()], "measure_name string, activity_date date, amount decimal(18,2)")
    out = revenue.window_totals(windows, frame)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["case_name"]: r["value"] for r in out.collect()}
    assert len(got) == 100_003 and [got[-1], got[-2], got[-3]] == [0.0] * 3
    for i, m, a, b in ask:
        want = sums[m][b + 1] - sums[m][a] if m in sums and b >= a else 0
        assert got[i] == float(want)
    empty = revenue.window_totals(windows.limit(3), frame.limit(0)).collect()
    assert [r["value"] for r in empty] == [0.0] * 3
