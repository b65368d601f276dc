"""Support and supply metrics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import between_days, count_when, day, month_key, month_start, n, sum_when, usd
from marketlens.functions.spines import spine
from marketlens.operators.revenue import _months_back
from marketlens.plans.warehouse import Warehouse


def open_tickets_at(wh: Warehouse, at: str) -> DataFrame:
    created = F.col("created_date") <= day(at)
    unresolved = F.col("resolved_date").isNull() | (F.col("resolved_date") > day(at))
    this_month = F.col("created_date") >= F.trunc(day(at), "MM")
    return wh.stg("tickets").agg(
        count_when(created & unresolved).alias("value"),
        count_when(F.col("status") == "open").alias("status_open_at_snapshot"),
        count_when(created & this_month).alias("created_in_month"),
    )


def shipments_in_transit_at(wh: Warehouse, at: str) -> DataFrame:
    due = F.col("expected_date") <= day(at)
    pending = F.col("received_date").isNull() | (F.col("received_date") > day(at))
    return wh.stg("supplier_shipments").agg(
        count_when(due & pending).alias("value"),
        count_when(F.col("status") == "in_transit").alias("status_in_transit_at_snapshot"),
    )


def tickets_by_category(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        wh.stg("tickets")
        .filter(between_days("created_date", start, end))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("tickets"))
        .orderBy("category")
    )


def tickets_vs_orders_monthly(wh: Warehouse, target_month: str, as_of: str) -> DataFrame:
    """Orders and ticket coverage for the month before, of and after the target."""
    target = date.fromisoformat(f"{target_month}-01")
    first, last = _months_back(target, 1), _months_back(target, -1)
    end = _months_back(target, -2) - timedelta(days=1)
    if str(end) > as_of:
        raise ValueError("all comparison months must end on or before as_of")
    window = (str(first), str(end))
    orders = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", *window))
        .groupBy(month_start("order_date").alias("m"))
        .agg(F.count(F.lit(1)).alias("orders"), count_when(F.col("channel") == "d2c").alias("d2c_orders"))
    )
    per_day = (
        wh.stg("tickets")
        .filter(between_days("created_date", *window))
        .groupBy("created_date")
        .agg(F.count(F.lit(1)).alias("tickets"))
    )
    tickets = per_day.groupBy(month_start("created_date").alias("m")).agg(
        F.sum("tickets").alias("tickets"),
        F.count(F.lit(1)).alias("days_with_tickets"),
        F.min("created_date").alias("first_ticket"),
        F.max("created_date").alias("last_ticket"),
    )
    zero = lambda c: n(F.coalesce(c, F.lit(0)))
    return (
        spine(wh.spark, day(str(first)), day(str(last)), "month", "m")
        .join(orders, "m", "left")
        .join(tickets, "m", "left")
        .select(
            month_key("m").alias("month"),
            zero("orders").alias("orders"),
            zero("d2c_orders").alias("d2c_orders"),
            zero("tickets").alias("tickets"),
            zero("days_with_tickets").alias("days_with_tickets"),
            F.dayofmonth(F.last_day("m")).cast("long").alias("calendar_days"),
            "first_ticket",
            "last_ticket",
        )
        .orderBy("month")
    )


def tickets_vs_orders_flags(wh: Warehouse, target_month: str, as_of: str) -> DataFrame:
    monthly = tickets_vs_orders_monthly(wh, target_month, as_of)
    before = f"{_months_back(date.fromisoformat(f'{target_month}-01'), 1):%Y-%m}"

    def at(month: str, column: str) -> Column:
        return F.max(F.when(F.col("month") == month, F.col(column)))

    return monthly.agg(
        F.lit(target_month).alias("target_month"),
        (at(target_month, "orders") < at(before, "orders")).alias("target_orders_below_previous_month"),
        (at(target_month, "d2c_orders") < at(before, "d2c_orders")).alias("target_d2c_orders_below_previous_month"),
        (at(target_month, "tickets") == 0).alias("target_month_has_no_tickets"),
        (at(target_month, "days_with_tickets") == at(target_month, "calendar_days")).alias(
            "target_has_tickets_every_day"
        ),
    )


def tickets_with_customer(wh: Warehouse) -> DataFrame:
    """Tickets resolved to their customer on the qualified requester key."""
    identity = wh.mart("int_customer_identity").select(
        F.col("source_system").alias("requester_source_system"),
        F.col("source_customer_id").alias("requester_source_id"),
        "app_db_customer_id",
    )
    customers = wh.stg("app_customers").select("app_db_customer_id", "segment", "account_type")
    return (
        wh.stg("tickets")
        .join(identity, ["requester_source_system", "requester_source_id"], "left")
        .join(customers, "app_db_customer_id", "left")
    )


def billing_tickets_vs_enterprise_churn(wh: Warehouse, start: str, end: str) -> DataFrame:
    enterprise = F.col("segment") == "enterprise"
    billing = enterprise & (F.col("category") == "billing")
    tickets = (
        tickets_with_customer(wh)
        .filter(between_days("created_date", start, end))
        .groupBy(month_key("created_date").alias("month"))
        .agg(
            count_when(billing).alias("enterprise_billing_tickets"),
            count_when(billing & F.col("priority").isin("high", "urgent")).alias("of_which_high_urgent"),
            count_when(enterprise).alias("enterprise_tickets_all"),
        )
    )
    gone = F.col("status") == "churned"
    churn = (
        wh.mart("fct_subscriptions")
        .filter(enterprise & F.col("status").isin("renewed", "churned") & between_days("term_end_date", start, end))
        .groupBy(month_key("term_end_date").alias("month"))
        .agg(
            count_when(gone).alias("enterprise_terms_churned"),
            usd(sum_when(gone, "acv")).alias("enterprise_acv_churned"),
        )
    )
    return tickets.join(churn, "month", "left").orderBy("month")
