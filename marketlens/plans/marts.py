"""Marts and the identity bridge, as functions of a warehouse."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import canonical_channel, day, quarter_key
from marketlens.plans.derivations import chain_roots, chronological_ids, id_number
from marketlens.plans.temporal import fresh_key

if TYPE_CHECKING:
    from marketlens.plans.warehouse import Warehouse


def real_customers(wh: Warehouse) -> DataFrame:
    return wh.stg("app_customers").filter(F.col("account_type") == "customer")


def eligible_order_ids(wh: Warehouse) -> DataFrame:
    """Orders of real customers (test and internal accounts drop out)."""
    real = real_customers(wh).select(F.col("app_db_customer_id").alias("customer_id"))
    return wh.stg("orders").join(real, "customer_id", "left_semi").select("order_id")


def revenue_tables(wh: Warehouse) -> dict[str, DataFrame]:
    """The four revenue tables, restricted to eligible orders."""
    keep = eligible_orders(wh).select("order_id")
    return {
        name: wh.stg(name).join(keep, "order_id", "left_semi")
        for name in ("orders", "invoices", "revenue_recognition", "refunds")
    }


# -- identity --------------------------------------------------------------------------
def observed_aliases(wh: Warehouse) -> DataFrame:
    """One row per source-native customer record, active or not."""

    def alias(system: str, table: str, column: str) -> DataFrame:
        df = wh.stg(table)
        has = set(df.columns)
        return df.select(
            F.lit(system).alias("source_system"),
            F.col(column).alias("source_customer_id"),
            F.col("created_date").alias("source_created_date"),
            (F.col("is_active") if "is_active" in has else F.lit(True)).alias("is_active"),
            (F.col("deactivated_date") if "deactivated_date" in has else F.lit(None).cast("date")).alias(
                "deactivated_date"
            ),
        )

    out = alias("app_db", "app_customers", "app_db_customer_id")
    for system in ("stripe", "shopify", "salesforce"):
        out = out.unionByName(alias(system, f"{system}_customers", f"{system}_customer_id"))
    return out


def resolution_status() -> Column:
    migrated = F.col("source_system").isin("shopify", "salesforce") & (
        F.col("source_created_date") < day(config.IDENTITY_MIGRATION)
    )
    return (
        F.when(F.col("app_db_customer_id").isNotNull(), F.lit("resolved"))
        .when(migrated, F.lit("unresolved_migration_gap"))
        .otherwise(F.lit("unresolved_sync_lag"))
    )


def int_customer_identity(wh: Warehouse) -> DataFrame:
    """Every observed alias, left joined to the crosswalk on the qualified key."""
    return (
        observed_aliases(wh)
        .join(wh.stg("customer_id_crosswalk"), ["source_system", "source_customer_id"], "left")
        .withColumn("resolution_status", resolution_status())
    )


def fct_identity_resolution_quality(wh: Warehouse) -> DataFrame:
    resolved = F.col("resolution_status") == "resolved"
    return (
        wh.mart("int_customer_identity")
        .groupBy("source_system")
        .agg(
            F.count(F.lit(1)).alias("observed_id_count"),
            F.count_if(resolved).alias("resolved_id_count"),
            F.count_if(~resolved).alias("unresolved_id_count"),
        )
        .withColumn(
            "resolution_null_rate",
            F.coalesce(F.try_divide("unresolved_id_count", "observed_id_count"), F.lit(0.0)),
        )
    )


# -- dimensions ---------------------------------------------------------------------------
def dim_customers(wh: Warehouse) -> DataFrame:
    identity = (
        wh.mart("int_customer_identity")
        .filter(F.col("resolution_status") == "resolved")
        .groupBy("app_db_customer_id")
        .agg(
            F.min("source_created_date").alias("seen"),
            F.count(F.lit(1)).alias("ids"),
            *[
                F.max((F.col("source_system") == system).cast("long")).alias(f"in_{system}")
                for system, _, _ in config.SOURCE_SYSTEMS
            ],
        )
    )
    orders = (
        wh.stg("orders")
        .groupBy(F.col("customer_id").alias("app_db_customer_id"))
        .agg(F.count(F.lit(1)).alias("order_count"), F.min("order_date").alias("first_order_date"))
    )
    present = [F.coalesce(f"in_{system}", F.lit(0)) for system, _, _ in config.SOURCE_SYSTEMS]
    return (
        wh.stg("app_customers")
        .join(identity, "app_db_customer_id", "left")
        .join(orders, "app_db_customer_id", "left")
        .select(
            "app_db_customer_id",
            F.coalesce("seen", "created_date").alias("first_seen_date"),
            "segment",
            "account_type",
            "acquisition_channel",
            "first_order_date",
            F.col("order_count").isNotNull().alias("has_order"),
            F.coalesce("ids", F.lit(0)).alias("resolved_source_id_count"),
            sum(present[1:], present[0]).alias("resolved_source_system_count"),
            *[
                (flag == 1).alias(f"has_{system}")
                for flag, (system, _, _) in zip(present, config.SOURCE_SYSTEMS, strict=True)
            ],
        )
    )


def dim_products(wh: Warehouse) -> DataFrame:
    suppliers = wh.stg("suppliers").select("supplier_id", "supplier_name")
    return (
        wh.stg("products")
        .join(suppliers, "supplier_id", "left")
        .select(
            "sku", "product_name", "category", "supplier_id", "supplier_name", "unit_cost", "list_price",
            "introduced_date",
        )
    )


def dim_plans(wh: Warehouse) -> DataFrame:
    latest = (
        wh.stg("plan_prices")
        .groupBy("plan_id")
        .agg(F.max_by("annual_price_per_seat", "effective_date").alias("current_annual_price_per_seat"))
    )
    return wh.stg("plans").join(latest, "plan_id", "left")


def dim_date(wh: Warehouse) -> DataFrame:
    """One row per calendar day, over the full years the data spans; ISO weekdays (Monday = 1)."""
    first = wh.stg("orders").agg(F.trunc(F.min("order_date"), "YEAR").alias("d")).scalar()
    last = (
        wh.stg("revenue_recognition")
        .agg(F.date_sub(F.add_months(F.trunc(F.max("recognition_date"), "YEAR"), 12), 1).alias("d"))
        .scalar()
    )
    d = F.col("date_day")
    return (
        wh.spark.range(1)
        .select(F.explode(F.sequence(first, last)).alias("date_day"))
        .select(
            "date_day",
            F.year(d).alias("year_number"),
            F.quarter(d).alias("quarter_number"),
            F.month(d).alias("month_number"),
            F.trunc(d, "MM").alias("month_start"),
            F.trunc(d, "QUARTER").alias("quarter_start"),
            F.trunc(d, "YEAR").alias("year_start"),
            quarter_key(d).alias("year_quarter"),
            F.date_format(d, "yyyy-MM").alias("year_month"),
            (F.weekday(d) + 1).alias("day_of_week"),
            (F.weekday(d) >= 5).alias("is_weekend"),
        )
    )


# -- facts ----------------------------------------------------------------------------------
def _orders_with_accounts(wh: Warehouse) -> DataFrame:
    """Every order, one without a customer included, with its customer's segment and account type."""
    profiles = wh.stg("app_customers").select(
        F.col("app_db_customer_id").alias("_customer"), "segment", "account_type"
    )
    orders = wh.stg("orders")
    return orders.join(profiles, orders["customer_id"] == F.col("_customer"), "left").select(
        "order_id",
        "customer_id",
        "segment",
        canonical_channel("channel").alias("channel"),
        F.col("channel").alias("channel_raw"),
        "order_date",
        "gross_amount",
        "take_rate",
        "net_amount",
        "promo_code",
        "subscription_id",
        "account_type",
    )


def int_orders(wh: Warehouse) -> DataFrame:
    """Every order with its account type, both channel labels and the first-order flag.

    One stored table serves the eligible orders and the unfiltered readings. The first date
    comes from a pre-aggregated rollup, not from a window over the customer, so one very
    large customer cannot fill a task. The first order of no customer is nobody's first.
    """
    first = wh.stg("orders").groupBy(F.col("customer_id").alias("_who")).agg(F.min("order_date").alias("_first"))
    first = first.withColumn("_who", fresh_key("_who"))
    orders = _orders_with_accounts(wh)
    is_first = F.coalesce(F.col("order_date") == F.col("_first"), F.lit(False)).alias("is_first_order")
    columns = [c for c in orders.columns if c != "account_type"]
    return orders.join(first, orders["customer_id"] == F.col("_who"), "left").select(*columns, is_first, "account_type")


def account_orders(wh: Warehouse) -> DataFrame:
    """``int_orders`` without the first-order flag: where that is not stored, only what is read of it is joined."""
    stored = wh.stored("int_orders")
    return _orders_with_accounts(wh) if stored is None else stored.drop("is_first_order")


def eligible_orders(wh: Warehouse) -> DataFrame:
    """``fct_orders`` without the first-order flag."""
    return account_orders(wh).filter(F.col("account_type") == "customer").drop("account_type")


def fct_orders(wh: Warehouse) -> DataFrame:
    """Eligible orders at canonical channel grain with the day-grained first-order flag."""
    return wh.mart("int_orders").filter(F.col("account_type") == "customer").drop("account_type")


def fct_order_lines(wh: Warehouse) -> DataFrame:
    lines = wh.stg("order_lines")  # before the orders, which add up the stored lines
    orders = wh.mart("fct_orders").select("order_id", "customer_id", "channel")
    products = wh.stg("products").select("sku", "category", "supplier_id", "unit_cost")
    cost = (F.col("quantity").cast("decimal(10,0)") * F.col("unit_cost")).cast("decimal(18,2)")
    return (
        lines.join(orders, "order_id")
        .join(products, "sku", "left")
        .select(
            "order_line_id", "order_id", "customer_id", "channel", "order_date", "sku", "category", "supplier_id",
            "quantity", "unit_price", "discount_pct", "line_amount", "unit_cost",
            cost.alias("line_cost"),
            (F.col("line_amount") - cost).cast("decimal(18,2)").alias("gross_margin"),
        )
    )


def revenue_legs(
    orders: DataFrame, refunds: DataFrame, invoices: DataFrame, recognized: DataFrame, *carried: str
) -> DataFrame:
    """Signed ``(activity_date, measure_name, amount)`` rows of eligible rows, with the columns ``carried``.

    Each source table is read once; the legs it feeds are unfolded from an array of structs instead of being
    separate scans in a nine-way union.
    """

    def legs(df: DataFrame, *parts: tuple[str, str, Column, Column | None]) -> DataFrame:
        rows = F.array(
            *[
                F.struct(
                    F.col(date).alias("activity_date"),
                    F.lit(measure).alias("measure_name"),
                    (F.when(cond, amount) if cond is not None else amount).cast("decimal(18,2)").alias("amount"),
                )
                for date, measure, amount, cond in parts
            ]
        )
        return df.select(*carried, F.inline(rows))

    consumer = F.col("channel") != "business_subscription"
    net, refund, amount = F.col("net_amount"), -F.col("refund_amount"), F.col("amount")
    return (
        legs(
            orders,
            ("order_date", "gmv", F.col("gross_amount"), None),
            ("order_date", "net_revenue", net, None),
            ("order_date", "billed_revenue", net, consumer),
            ("order_date", "collected_cash", net, consumer),
        )
        .filter(F.col("amount").isNotNull())
        .unionByName(legs(refunds, ("refund_date", "net_revenue", refund, None), ("refund_date", "collected_cash", refund, None)))
        .unionByName(
            legs(
                invoices,
                ("billed_date", "billed_revenue", amount, None),
                ("collected_date", "collected_cash", amount, None),
            ).filter(F.col("activity_date").isNotNull())
        )
        .unionByName(legs(recognized, ("recognition_date", "recognized_revenue", amount, None)))
    )


def fct_revenue(wh: Warehouse) -> DataFrame:
    """Signed ``(activity_date, measure_name, amount)`` rows of the five measures."""
    keep = eligible_orders(wh).select("order_id")
    eligible = lambda name: wh.stg(name).join(keep, "order_id", "left_semi")
    orders = eligible_orders(wh).select("order_date", "channel", "gross_amount", "net_amount")
    return revenue_legs(orders, eligible("refunds"), eligible("invoices"), eligible("revenue_recognition"))


def revenue_daily(wh: Warehouse) -> DataFrame:
    """``fct_revenue`` added up per day and measure: at most five rows per calendar day."""
    return (
        wh.mart("fct_revenue")
        .groupBy("activity_date", "measure_name")
        .agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))
    )


def customer_bitmaps(wh: Warehouse) -> DataFrame:
    """Who ordered in which month over which channel: a bitmap per bucket of 32,768 customer numbers.

    Customers are numbered densely by their creation, so that bitmaps are full. They are built map-side.
    """
    people = wh.stg("app_customers").select(
        "app_db_customer_id", "created_date", id_number("app_db_customer_id").alias("number"))
    numbers = chronological_ids(people, "created_date", "number").select(F.col("app_db_customer_id").alias("customer_id"), F.col("seq").cast("long").alias("seq"))
    return (
        wh.mart("fct_orders")
        .select("customer_id", F.trunc("order_date", "MM").alias("month"), "channel")
        .join(numbers, "customer_id")
        .groupBy("month", "channel", F.bitmap_bucket_number("seq").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("customers"))
    )


def fct_subscriptions(wh: Warehouse) -> DataFrame:
    customers = real_customers(wh).select(F.col("app_db_customer_id").alias("customer_id"), "segment")
    plans = wh.stg("plans").select("plan_id", "plan_name", "plan_generation", "tier")
    return (
        wh.stg("subscriptions")
        .join(customers, "customer_id")
        .join(plans, "plan_id", "left")
        .select(
            "subscription_id", "customer_id", "segment", "plan_id", "plan_name", "plan_generation", "tier", "seats",
            "term_start_date", "term_end_date", "price_per_seat", "acv", "order_id",
            "renewed_from_subscription_id",
            F.col("renewed_from_subscription_id").isNull().alias("is_first_term"),
            "status",
            "cancelled_date",
        )
    )


def fct_marketing_spend(wh: Warehouse) -> DataFrame:
    """Platform-days with the day total of new d2c customers repeated on every platform."""
    attributed = (
        wh.mart("fct_orders")
        .filter((F.col("channel") == "d2c") & F.col("is_first_order"))
        .groupBy(F.col("order_date").alias("spend_date"))
        .agg(F.count(F.lit(1)).alias("new_d2c"))
    )
    return (
        wh.stg("ad_spend")
        .join(attributed, "spend_date", "left")
        .withColumn("attributed_new_d2c_customers_day_total", F.coalesce("new_d2c", F.lit(0).cast("long")))
        .drop("new_d2c")
    )


def term_roots(wh: Warehouse) -> DataFrame:
    """``(subscription_id, root_id)``: the first term of every renewal chain."""
    return chain_roots(wh.mart("fct_subscriptions"))


MARTS = {
    f.__name__: f
    for f in (
        int_customer_identity, fct_identity_resolution_quality, dim_customers, dim_products, dim_plans, dim_date,
        int_orders, fct_orders, fct_order_lines, fct_revenue, revenue_daily, fct_subscriptions, term_roots,
        fct_marketing_spend, customer_bitmaps,
    )
}
# Marts that many metrics read and that need a shuffle to build. Order lines with their orders and products are not
# among them: stored whole, all their columns go through both joins, while a reader sends only its dates and columns.
STORED_MARTS = frozenset(
    {"int_customer_identity", "dim_customers", "int_orders", "revenue_daily", "fct_subscriptions", "term_roots", "customer_bitmaps"}
)
