"""The rules that are easy to get wrong, on hand-made rows."""

import pytest
from fixtures import PLAN, customer, one, order, term, warehouse

from marketlens.plans.warehouse import Warehouse
from marketlens.operators import customers, identity, marketing, quality, revenue, subscriptions


def test_refunds_count_on_their_own_date(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a"), customer("t", "test")],
        app_db__orders=[
            order("o1", "a", "d2c", "2000-03-30", 100),
            order("o2", "a", "marketplace", "2000-05-01", 200, 30, take_rate=0.15),
            order("o3", "t", "d2c", "2000-03-30", 999),
        ],
        app_db__revenue_recognition=[
            {"order_id": "o1", "recognition_date": "2000-03-30", "amount": 100},
            {"order_id": "o3", "recognition_date": "2000-03-30", "amount": 999},
        ],
        stripe__refunds=[{"refund_id": "r1", "order_id": "o1", "refund_date": "2000-04-02", "refund_amount": 100}],
    )
    q1, q2 = (one(revenue.five_revenues(wh, *w)) for w in (("2000-01-01", "2000-03-31"), ("2000-04-01", "2000-06-30")))
    assert (q1["gmv"], q1["net_revenue"], q1["recognized_revenue"]) == (100.0, 100.0, 100.0)
    assert (q2["gmv"], q2["net_revenue"], q2["collected_cash"]) == (200.0, -70.0, -70.0)
    keyed = one(revenue.net_revenue_order_keyed(wh, "2000-01-01", "2000-03-31"))
    assert keyed["value"] == 999.0  # unfiltered on purpose


def test_refund_only_quarter_has_null_gmv_and_rate(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a")],
        app_db__orders=[order("o1", "a", "d2c", "2000-03-30", 100)],
        stripe__refunds=[{"refund_id": "r1", "order_id": "o1", "refund_date": "2000-04-02", "refund_amount": 40}],
    )
    rows = {str(r["quarter_start"]): r for r in revenue.refund_rate_by_quarter(wh, "2000-05-31").collect()}
    assert rows["2000-01-01"]["refund_rate"] == 0.0 and not rows["2000-01-01"]["is_partial_quarter"]
    assert rows["2000-01-01"]["refunds_at_order_date"] == 0.4
    late = rows["2000-04-01"]
    assert late["refund_amount"] == 40.0 and late["gmv"] is None and late["refund_rate"] is None
    assert late["is_partial_quarter"]


def test_collected_cash_needs_a_collection_date(spark):
    orders = [order(f"o{i}", "a", "business_subscription", "2000-01-10", 10 ** i) for i in range(1, 4)]
    bill = dict(billed_date="2000-01-10", due_date="2000-02-09", salesforce_customer_id="s")
    wh = warehouse(
        spark,
        app_db__customers=[customer("a", segment="smb")],
        app_db__orders=orders,
        app_db__invoices=[
            {"invoice_id": "i1", "order_id": "o1", "collected_date": "2000-02-20", "amount": 10, **bill},
            {"invoice_id": "i2", "order_id": "o2", "collected_date": "2000-04-02", "amount": 100, **bill},
            {"invoice_id": "i3", "order_id": "o3", "collected_date": None, "amount": 1000, "is_bad_debt": True, **bill},
        ],
    )
    q1 = one(revenue.five_revenues(wh, "2000-01-01", "2000-03-31"))
    assert q1["billed_revenue"] == 1110.0 and q1["collected_cash"] == 10.0
    masked = {r["invoice_id"]: r["collected_date"] for r in wh.as_of("2000-02-20").stg("invoices").collect()}
    assert str(masked["i1"]) == "2000-02-20" and masked["i2"] is None and masked["i3"] is None


def test_first_order_flag_is_day_grained(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a")],
        app_db__orders=[
            order("o1", "a", "direct", "2000-01-05", 10),
            order("o2", "a", "d2c", "2000-01-05", 20),
            order("o3", "a", "d2c", "2000-02-05", 30),
        ],
    )
    assert one(marketing.marketing_kpis(wh, "2000-01-01", "2000-01-31"))["new_customers"] == 2  # rows
    assert one(customers.new_customers(wh, "2000-01-01", "2000-01-31"))["value"] == 1  # customers
    cohort = one(customers.consumer_cohort_repeat_rate(wh, "2000-01-01", "2000-12-31"))
    assert cohort["customers_acquired"] == 2 and cohort["repeated_within_12m"] == 2
    multi = one(customers.multi_channel_customers(wh, "2000-01-01", "2000-12-31"))
    assert multi == {"value": 0, "raw_channel_labels": 1}


def test_term_ending_on_the_cutoff_is_still_active(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a", segment="smb"), customer("b", segment="smb")],
        app_db__plans=[PLAN],
        app_db__subscriptions=[
            term("s1", "a", "1999-07-01", "2000-06-30", 100, status="churned"),
            term("s2", "b", "1999-06-30", "2000-06-29", 100, status="churned"),
        ],
    )
    status = {r["subscription_id"]: r["status"] for r in wh.as_of("2000-06-30").stg("subscriptions").collect()}
    assert status == {"s1": "active", "s2": "churned"}
    assert one(subscriptions.active_subscribers(wh, "2000-06-30"))["value"] == 1


def test_empty_denominators(spark):
    wh = warehouse(spark, app_db__customers=[customer("a")], app_db__plans=[PLAN])
    kpis = one(marketing.marketing_kpis(wh, "2000-01-01", "2000-01-31"))
    assert kpis["aov"] == 0.0 and kpis["cac"] == 0.0
    assert one(subscriptions.subscription_kpis(wh, "2000-01-01", "2000-12-31"))["renewal_rate"] == 0.0
    assert one(subscriptions.renewal_rate(wh, "2000-01-01", "2000-12-31"))["value"] is None
    assert one(customers.customer_kpis(wh, "2000-01-01", "2000-01-31"))["returning_share"] == 0.0


def test_no_observed_alias_is_an_error(spark):
    wh = warehouse(spark)
    with pytest.raises(Exception, match="no observed source ids"):
        identity.identity_measures(wh, "2000-01-01", "2000-01-01", "2000-12-31").collect()


def test_late_link_and_alias_fanout(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a")],
        app_db__orders=[order("o1", "a", "d2c", "2000-01-05", 50)],
        stripe__customers=[
            {"stripe_customer_id": "c1", "created_at": "2000-01-05", "is_active": False, "deactivated_at": "2000-03-01"},
            {"stripe_customer_id": "c2", "created_at": "2000-03-01", "is_active": True},
        ],
        app_db__customer_id_crosswalk=[
            {"source_system": "app_db", "source_customer_id": "a", "app_db_customer_id": "a", "linked_at": "1995-01-01", "link_method": "primary_key"},
            {"source_system": "stripe", "source_customer_id": "c1", "app_db_customer_id": "a", "linked_at": "2000-01-09", "link_method": "direct_sync"},
            {"source_system": "stripe", "source_customer_id": "c2", "app_db_customer_id": "a", "linked_at": "2000-03-20", "link_method": "direct_sync"},
        ],
    )
    measures = lambda at: one(identity.identity_measures(wh, at, "2000-01-01", "2000-12-31"))
    early = measures("2000-01-06")
    assert early["unresolved_source_id_count"] == 1 and early["correct_multi_source_order_count"] == 0
    late = measures("2000-12-31")
    assert late["correct_multi_source_gmv"] == 50.0
    assert late["unsafe_fanout_order_row_count"] == 3 and late["unsafe_fanout_gmv"] == 150.0
    old = {r["stripe_customer_id"]: r["is_active"] for r in wh.as_of("2000-02-01").stg("stripe_customers").collect()}
    assert old == {"c1": True}


def test_current_customers_follow_calendar_months(spark):
    wh = warehouse(
        spark,
        app_db__customers=[customer("a"), customer("b")],
        app_db__orders=[
            order("o1", "a", "d2c", "2000-01-31", 10),
            order("o2", "a", "marketplace", "2000-03-01", 10),
            order("o3", "b", "d2c", "2001-03-01", 10),
        ],
    )
    rows = {str(r["month"])[:7]: r for r in customers.monthly_customer_metrics(wh).collect()}
    assert [rows[m]["current_customers"] for m in ("1999-12", "2000-01", "2000-12", "2001-02", "2001-03")] == [0, 1, 1, 1, 1]
    assert rows["2000-12"]["current_d2c"] == 1 and rows["2001-01"]["current_d2c"] == 0
    assert rows["2001-02"]["current_marketplace"] == 1 and rows["2001-03"]["current_marketplace"] == 0
    assert rows["2000-03"]["returning_customers"] == 1 and rows["2001-03"]["new_customers"] == 1


def test_quality_tests_find_bad_rows(spark):
    link = {"source_system": "stripe", "source_customer_id": "c1", "app_db_customer_id": "a", "linked_at": "1999-01-01", "link_method": "direct_sync"}
    wh = warehouse(
        spark,
        app_db__customers=[customer("a", created="2000-01-01"), customer("a", created="2000-01-01")],
        stripe__customers=[{"stripe_customer_id": "c1", "created_at": "2000-01-05", "is_active": True}],
        app_db__customer_id_crosswalk=[link, link, {**link, "source_customer_id": "gone"}],
        app_db__orders=[order("o1", "nobody", "fax", "2000-01-01", 1)],
    )
    unique = {r["table_name"]: r["violations"] for r in quality.dq_unique(wh).collect()}
    assert unique["app_customers"] == 1 and unique["customer_id_crosswalk"] == 1 and unique["orders"] == 0
    relations = {r["relationship"]: r["violations"] for r in quality.dq_relationships(wh).collect()}
    assert relations["orders.customer_id -> app_customers.app_db_customer_id"] == 1
    assert one(quality.summary(wh, "dq_crosswalk_no_duplicates"))["violations"] == 1
    assert quality.crosswalk_integrity(wh).select("source_customer_id").distinct().count() == 2
    accepted = {(r["table_name"], r["column_name"]): r["violations"] for r in quality.dq_accepted_values(wh).collect()}
    assert accepted[("app_customers", "account_type")] == 0


def test_plan_tables(spark):
    """Tables of fixed values: staging, price history, latest price, retirement mask."""
    wh = Warehouse.open(spark, "/root/testdata/sf0.001")
    plans = {r["plan_id"]: r for r in wh.stg("plans").collect()}
    assert len(plans) == 8 and plans["growth"]["is_current"] and not plans["team_v2"]["is_current"]
    prices = {(r["plan_id"], str(r["effective_date"])): float(r["annual_price_per_seat"]) for r in wh.stg("plan_prices").collect()}
    assert len(prices) == 11 and prices[("growth", "2001-05-01")] == 228.48
    latest = {r["plan_id"]: float(r["current_annual_price_per_seat"]) for r in wh.mart("dim_plans").collect()}
    assert latest["growth"] == 228.48 and latest["pro_v1"] == 156.0 and len(latest) == 8
    then = {r["plan_id"]: r for r in wh.as_of("1998-12-31").stg("plans").collect()}
    assert len(then) == 5 and then["team_v2"]["is_current"] and then["team_v2"]["retired_date"] is None
    assert str(then["pro_v1"]["retired_date"]) == "1997-06-30"
    promos = [r["promo_code"] for r in wh.stg("promotions").orderBy("start_date").collect()]
    assert promos == ["WELCOME10", "SPRING5", "BTB15"]
