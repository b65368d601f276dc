"""Point-in-time views and effective-dated lookups as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import canonical_channel, day, literal_table, n
from marketlens.operators.reconcile import reconcile
from marketlens.operators.revenue import five_revenues_by_quarter
from marketlens.plans.staging import STAGING, staged_column
from marketlens.plans.temporal import as_of_lookup
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.registry import RAW_TABLES


def visible_as_of(wh: Warehouse, as_of: str) -> DataFrame:
    """Row count and arrival range of every table of a snapshot."""
    snap, out = wh.as_of(as_of), None
    for name, (raw, _) in STAGING.items():
        arrival = staged_column(name, RAW_TABLES[raw].arrival)
        part = snap.stg(name).agg(
            F.lit(raw).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            F.min(arrival).alias("first_arrival"),
            F.max(arrival).alias("last_arrival"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def price_as_of(wh: Warehouse) -> DataFrame:
    """The list price of each term's plan on its first and on its last day."""
    prices = wh.stg("plan_prices")
    look = dict(key="plan_id", since="effective_date", take=["annual_price_per_seat"])
    terms = wh.stg("subscriptions").select("subscription_id", "plan_id", "term_start_date", "term_end_date")
    out = as_of_lookup(terms, prices, date="term_start_date", **look).withColumnRenamed(
        "annual_price_per_seat", "start_price"
    )
    out = as_of_lookup(out, prices, date="term_end_date", **look).withColumnRenamed("annual_price_per_seat", "end_price")
    return out.select(
        "subscription_id",
        "plan_id",
        F.col("start_price").cast("double").alias("start_price"),
        F.col("end_price").cast("double").alias("end_price"),
    )


def alias_as_of(wh: Warehouse) -> DataFrame:
    """The Stripe id of each refund's customer that was current on the refund date."""
    history = (
        wh.stg("stripe_customers")
        .join(
            wh.stg("customer_id_crosswalk").filter(F.col("source_system") == "stripe"),
            F.col("stripe_customer_id") == F.col("source_customer_id"),
        )
        .select(F.col("app_db_customer_id").alias("customer_id"), F.col("stripe_customer_id").alias("alias"), "created_date")
    )
    refunds = (
        wh.stg("refunds")
        .select("refund_id", "order_id", "refund_date")
        .join(wh.stg("orders").select("order_id", "customer_id"), "order_id")
    )
    return as_of_lookup(
        refunds, history, key="customer_id", date="refund_date", since="created_date", take=["alias"]
    ).select("refund_id", "customer_id", "refund_date", F.col("alias").alias("stripe_customer_id"))


def plan_generation_at(wh: Warehouse) -> DataFrame:
    """The plan generation on sale on each term's first day.

    Sale windows are unfolded to days (bounded by the calendar), which makes this an
    equi-join. A plan not retired is on sale until the last term begins.
    """
    last = wh.stg("subscriptions").agg(F.max("term_start_date")).scalar()
    window = F.sequence(F.min("launched_date"), F.max("until"))
    days = (
        wh.stg("plans")
        .withColumn("until", F.coalesce("retired_date", F.greatest(last, "launched_date")))
        .groupBy(F.col("plan_generation").alias("generation_on_sale"))
        .agg(window.alias("days"))
        .select("generation_on_sale", F.explode("days").alias("term_start_date"))
    )
    return (
        wh.stg("subscriptions")
        .join(days, "term_start_date", "left")
        .select("subscription_id", "term_start_date", n("generation_on_sale").alias("generation_on_sale"))
    )


def promo_match(wh: Warehouse) -> DataFrame:
    """The first promotion whose days and channels cover each order.

    Promotions are unfolded to their days and channels, keeping the first one per cell, so
    each order meets at most one row in an equi-join.
    """
    cells = (
        wh.stg("promotions")
        .withColumn("channel", F.explode(F.split("eligible_channels", ",")))
        .withColumn("order_date", F.explode(F.sequence("start_date", "end_date")))
        .groupBy("order_date", "channel")
        .agg(F.min_by("promo_code", F.struct("start_date", "promo_code")).alias("promo_code"))
    )
    orders = wh.stg("orders").select("order_id", "order_date", canonical_channel("channel").alias("channel"))
    return orders.join(cells, ["order_date", "channel"]).select("order_id", "promo_code")


def skus_available_at(wh: Warehouse, first_month: str, last_month: str) -> DataFrame:
    """SKUs introduced by the end of each month, per category."""
    months = F.sequence(day(f"{first_month}-01"), day(f"{last_month}-01"), F.expr("interval 1 month"))
    cells = literal_table(wh.spark, "category string", [(c,) for c in config.CATEGORIES]).select(
        "category", F.explode(months).alias("m")
    )
    first = day(f"{first_month}-01")
    introduced = (
        wh.stg("products")
        .groupBy("category", F.greatest(F.trunc("introduced_date", "MM"), first).alias("m"))
        .agg(F.count(F.lit(1)).alias("added"))
    )
    so_far = Window.partitionBy("category").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.join(introduced, ["category", "m"], "left")
        .select(
            "category",
            F.last_day("m").alias("as_of"),
            n(F.sum(F.coalesce("added", F.lit(0))).over(so_far)).alias("skus_available"),
        )
    )


# -- does a metric read the future? -----------------------------------------------------------------------
def snapshot_stability(
    wh: Warehouse, metric: Callable[[Warehouse], DataFrame], keys: list[str], as_of: str
) -> DataFrame:
    """A metric on the snapshot against the same metric on all rows, value by value."""
    return reconcile(metric(wh.as_of(as_of)), metric(wh), keys)


def snapshot_parity(wh: Warehouse, start: str, as_of: str) -> DataFrame:
    """The five revenues of elapsed quarters are the same on the snapshot and on all rows."""
    return snapshot_stability(wh, lambda w: five_revenues_by_quarter(w, start, as_of), ["quarter"], as_of)
