"""Known values of the mapped tables (scale 0.01)."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import identity, revenue
from marketlens.plans.warehouse import Warehouse
from fixtures import one


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.open(spark, "/root/testdata/sf0.01")


def test_orders(wh):
    counts = {r["channel"]: r["count"] for r in wh.stg("orders").groupBy("channel").count().collect()}
    assert counts == {"business_subscription": 1010, "d2c": 8796, "direct": 2174, "marketplace": 3020}
    assert wh.mart("fct_orders").count() == 14613


@pytest.mark.parametrize(
    "start,end,want",
    [
        ("2000-01-01", "2000-03-31", (128098012.80, 110432697.41, 107846662.66, 115638062.66, 108081297.41)),
        ("1999-01-01", "1999-12-31", (410568349.50, 351662961.71, 346732608.75, 364910308.75, 338660961.71)),
    ],
)
def test_five_revenues(wh, start, end, want):
    got = one(revenue.five_revenues(wh, start, end))
    assert tuple(got[m] for m in ("gmv", "net_revenue", "recognized_revenue", "billed_revenue", "collected_cash")) == want


def test_terms_and_eligible_rows(wh):
    counts = {r["status"]: r["count"] for r in wh.stg("subscriptions").groupBy("status").count().collect()}
    assert counts == {"renewed": 574, "churned": 214, "active": 222}
    keep = wh.mart("fct_orders").select("order_id")
    eligible = {n: wh.stg(n).join(keep, "order_id", "left_semi") for n in ("refunds", "invoices", "revenue_recognition")}
    assert eligible["refunds"].count() == 816
    assert eligible["revenue_recognition"].count() == 25393
    assert wh.stg("invoices").filter("is_bad_debt").count() == 53


def test_identity(wh):
    snap = wh.as_of("2001-06-30").mart("int_customer_identity").groupBy("resolution_status").count()
    got = {r["resolution_status"]: r["count"] for r in snap.collect()}
    assert got["unresolved_migration_gap"] == 61 and got["unresolved_sync_lag"] == 1
    measures = one(identity.identity_measures(wh, "2001-06-30", "2000-01-01", "2000-12-31"))
    assert measures["correct_multi_source_order_count"] == 4527
    assert measures["unsafe_fanout_order_row_count"] == 15049


def test_new_d2c(wh):
    new = wh.mart("fct_orders").filter(
        F.col("is_first_order") & (F.col("channel") == "d2c") & F.col("order_date").between("2000-01-01", "2000-01-31")
    )
    assert new.count() == 17
