"""Increments and the stream give exactly the snapshot of the day."""

import pytest

from marketlens.plans.warehouse import Warehouse
from marketlens.sources import files
from marketlens.sources.registry import RAW_TABLES, check_registry
from marketlens.sources.store import scratch_folder
from marketlens.streaming import drip

FOLDER = "/root/testdata/sf0.001"
TABLES = ("invoices", "stripe_customers", "subscriptions", "plans", "supplier_shipments", "tickets", "orders")


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.open(spark, FOLDER)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("after,upto", [("1997-06-29", "1997-06-30"), ("1998-03-31", "2000-12-31"), ("1996-01-01", "2003-12-31")])
def test_increment_equals_snapshot(wh, name, after, upto):
    assert rows(drip.drip_feed_increment(wh, name, after, upto)) == rows(wh.as_of(upto).stg(name))


@pytest.mark.parametrize("name", ["tickets", "subscriptions"])
def test_stream_follows_the_log(wh, name):
    folder = scratch_folder(wh.spark, "test-drip")
    log, target, checkpoint = f"{folder}/log", f"{folder}/table", f"{folder}/checkpoint"
    for after, upto in ((None, "1998-12-31"), ("1998-12-31", "1999-01-31"), ("1999-01-31", "2000-12-31")):
        drip.append_change_files(wh, name, log, after, upto)
        got = drip.run_drip(wh, name, log, target, checkpoint, files_per_batch=3)
        assert rows(got) == rows(wh.as_of(upto).stg(name))
    # replaying the whole log from scratch onto the finished table changes nothing
    again = drip.run_drip(wh, name, log, target, f"{folder}/checkpoint-2", files_per_batch=2)
    assert rows(again) == rows(wh.as_of("2000-12-31").stg(name))


def test_snapshot_load_is_idempotent(wh):
    folder = scratch_folder(wh.spark, "test-snapshots")
    for as_of in ("1998-06-30", "1999-06-30", "1998-06-30"):
        files.snapshot_overwrite(wh, folder, as_of)
    for name in ("orders", "invoices", "ad_spend"):
        for as_of in ("1998-06-30", "1999-06-30"):
            assert rows(files.read_snapshot(wh, folder, name, as_of)) == rows(wh.as_of(as_of).stg(name))


def test_registry_order_is_checked():
    check_registry(RAW_TABLES)
    with pytest.raises(ValueError):
        check_registry(list(RAW_TABLES)[:-1])


def test_raw_tables_round_trip(wh):
    folder = scratch_folder(wh.spark, "test-raw")
    files.write_raw_tables(wh, folder)
    tables = files.scan_raw_tables(wh.spark, folder, canonical=False)
    again = Warehouse.of(wh.spark, tables)
    stored = Warehouse.open_raw(wh.spark, folder)
    for name in ("fct_orders", "fct_subscriptions"):
        assert rows(again.mart(name)) == rows(stored.mart(name)) == rows(wh.mart(name))


def test_slices_are_folded_and_survive_a_broken_fold(wh, monkeypatch):
    spark, name = wh.spark, "tickets"
    folder = scratch_folder(spark, "test-fold")
    log, target, checkpoint = f"{folder}/log", f"{folder}/table", f"{folder}/checkpoint"
    days = [None, *(f"{y}-{m}" for y in (1998, 1999) for m in ("03-31", "09-30")), "2000-12-31"]
    key, schema = drip.change_columns(name)[0], drip.change_log(wh, name).schema
    for after, upto in zip(days[:-1], days[1:], strict=True):
        drip.append_change_files(wh, name, log, after, upto)
        got = drip.run_drip(wh, name, log, target, checkpoint, files_per_batch=3, most_slices=2)
        assert rows(got) == rows(wh.as_of(upto).stg(name))
        assert len(drip._folders(spark, target, "batch")) <= 2 or not drip._folders(spark, target, "base")
    assert len(drip._folders(spark, target, "base")) == 1
    # a base that was not finished does not count; slices written again change nothing
    drip.run_drip(wh, name, log, target, f"{folder}/checkpoint-2", files_per_batch=1000)
    wh.as_of("1998-03-31").stg(name).limit(1).write.parquet(f"{target}/base=99")
    fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/base=99/_SUCCESS"), False)
    assert rows(drip.current(spark, target, schema, key).drop(drip.KNOWN)) == rows(wh.as_of("2000-12-31").stg(name))


def test_increments_of_all_tables(wh):
    for r in drip.increment_parity(wh, "1997-06-30", "1999-02-15").collect():
        assert r["same_rows"] and r["increment_rows"] == r["snapshot_rows"], r
    broken = drip.increment_parity(Warehouse(wh.spark, wh.raw, staged=lambda n: wh.stg(n)), "1996-01-01", "1996-01-02")
    assert all(r["same_rows"] for r in broken.collect())


def test_an_order_without_a_customer_stays(wh):
    from marketlens.plans import marts

    extra = wh.raw("app_db__orders").limit(1).selectExpr("* except (customer_id, order_id)", "cast(null as string) as customer_id", "'ord_none' as order_id")
    tables = {raw: wh.raw(raw) for raw in RAW_TABLES} | {"app_db__orders": wh.raw("app_db__orders").unionByName(extra)}
    w = Warehouse.of(wh.spark, tables)
    kept = w.mart("int_orders").filter("order_id = 'ord_none'").collect()
    assert [(r["customer_id"], r["account_type"], r["is_first_order"]) for r in kept] == [(None, None, False)]
    assert marts.account_orders(w).count() == w.stg("orders").count() == wh.stg("orders").count() + 1
    assert w.mart("fct_orders").filter("order_id = 'ord_none'").count() == 0
