"""Marketing and catalog metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import between_days, count_when, day, literal_table, month_key, month_start, n, ratio, sum_when, usd
from marketlens.functions.spines import side_by_side
from marketlens.operators.customers import month_spine
from marketlens.plans.warehouse import Warehouse


def _orders(wh: Warehouse, start: str, end: str) -> DataFrame:
    return wh.mart("fct_orders").filter(between_days("order_date", start, end))


def _lines(wh: Warehouse, start: str, end: str) -> DataFrame:
    return wh.mart("fct_order_lines").filter(between_days("order_date", start, end))


def _consumer() -> Column:
    return F.col("channel").isin(*config.CONSUMER_CHANNELS)


def _new_d2c() -> Column:
    return F.col("is_first_order") & (F.col("channel") == "d2c")


def discount() -> Column:
    """Unrounded discount dollars of a line."""
    return F.col("quantity").cast("decimal(10,0)") * F.col("unit_price") * F.col("discount_pct")


def line_discount() -> Column:
    """Discount dollars rounded per line, as the marketing and event reports count them."""
    return F.round(discount(), 2).cast("decimal(18,2)")


def _zero(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0))


def _spend(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Spend, reported conversions and the day totals repeated per platform (a fan-out)."""
    return (
        wh.mart("fct_marketing_spend")
        .filter(between_days("spend_date", start, end))
        .agg(
            _zero(F.sum("spend_usd")).alias("spend"),
            _zero(F.sum("reported_conversions")).alias("reported"),
            _zero(F.sum("attributed_new_d2c_customers_day_total")).alias("fanned"),
        )
    )


# -- acquisition -------------------------------------------------------------------------------------
def new_d2c_customers(wh: Warehouse, start: str, end: str) -> DataFrame:
    new = _orders(wh, start, end).agg(count_when(_new_d2c()).alias("value"))
    return side_by_side(new, _spend(wh, start, end)).select(
        "value",
        n("fanned").alias("fanned_out_marketing_spend_rows"),
        n("reported").alias("platform_reported_conversions"),
    )


def d2c_cac(wh: Warehouse, start: str, end: str) -> DataFrame:
    new = _orders(wh, start, end).agg(count_when(_new_d2c()).alias("new"))
    return side_by_side(new, _spend(wh, start, end)).select(
        ratio("spend", "new", 2).alias("value"),
        usd("spend").alias("ad_spend"),
        F.col("new").alias("new_d2c_customers"),
        ratio("spend", "reported", 2).alias("per_platform_reported_conversions"),
        ratio("spend", "fanned", 2).alias("fanned_out_attributed_customers"),
    )


def cac_reported_vs_attributed(wh: Warehouse, start: str, end: str) -> DataFrame:
    spend = (
        wh.stg("ad_spend")
        .filter(between_days("spend_date", start, end))
        .groupBy(month_key("spend_date").alias("month"))
        .agg(F.sum("spend_usd").alias("spend"), F.sum("reported_conversions").alias("platform_reported_conversions"))
    )
    acquired = (
        _orders(wh, start, end)
        .filter(_new_d2c())
        .groupBy(month_key("order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("new_d2c_customers"))
    )
    return (
        spend.join(acquired, "month", "left")
        .select(
            "month",
            usd("spend").alias("ad_spend"),
            "platform_reported_conversions",
            "new_d2c_customers",
            ratio("spend", "platform_reported_conversions", 2).alias("cac_per_platform_claims"),
            ratio("spend", "new_d2c_customers", 2).alias("cac_attributed"),
        )
        .orderBy("month")
    )


def ad_spend_by_platform(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        wh.stg("ad_spend")
        .filter(between_days("spend_date", start, end))
        .groupBy("platform")
        .agg(usd(F.sum("spend_usd")).alias("spend_usd"))
        .orderBy("platform")
    )


# -- promotions ----------------------------------------------------------------------------------------
def promo_usage(wh: Warehouse, code: str, start: str, end: str) -> DataFrame:
    mine = _orders(wh, start, end).filter(F.col("promo_code") == code)
    counts = mine.agg(F.count(F.lit(1)).alias("value"), usd(_zero(F.sum("gross_amount"))).alias("promo_gmv"))
    dollars = (
        _lines(wh, start, end)
        .join(mine.select("order_id"), "order_id", "left_semi")
        .agg(usd(_zero(F.sum(discount()))).alias("discount_dollars"))
    )
    return side_by_side(counts, dollars)


def promo_lift(wh: Warehouse, code: str, start: str, end: str) -> DataFrame:
    orders = (
        _orders(wh, start, end)
        .filter(_consumer())
        .groupBy(month_key("order_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("consumer_orders"),
            count_when(F.col("promo_code") == code).alias("promo_orders"),
            F.sum("gross_amount").alias("gross"),
        )
    )
    discounts = (
        _lines(wh, start, end)
        .groupBy(month_key("order_date").alias("month"))
        .agg(usd(F.sum(discount())).alias("discount_dollars"))
    )
    return (
        orders.join(discounts, "month", "left")
        .select(
            "month",
            "consumer_orders",
            "promo_orders",
            usd("gross").alias("consumer_gmv"),
            ratio("gross", "consumer_orders", 2).alias("aov"),
            "discount_dollars",
            ratio("promo_orders", "consumer_orders").alias("promo_attach_rate"),
        )
        .orderBy("month")
    )


def campaigns(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Promotions overlapping the window with the orders, GMV and discounts they carried."""
    running = wh.stg("promotions").filter((F.col("end_date") >= day(start)) & (F.col("start_date") <= day(end)))
    carrying = _orders(wh, start, end).filter(_consumer() & F.col("promo_code").isNotNull())
    orders = carrying.groupBy("promo_code").agg(F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gmv"))
    discounts = (
        _lines(wh, start, end)
        .join(carrying.select("order_id", "promo_code"), "order_id")
        .groupBy("promo_code")
        .agg(F.sum(line_discount()).alias("discounts"))
    )
    return (
        running.join(orders, "promo_code", "left")
        .join(discounts, "promo_code", "left")
        .select(
            "promo_code",
            "promo_name",
            "start_date",
            "end_date",
            F.col("discount_pct").cast("double").alias("discount_pct"),
            n(_zero("orders")).alias("orders"),
            usd(_zero("gmv")).alias("gmv"),
            usd(_zero("discounts")).alias("discount_dollars"),
        )
        .orderBy("start_date")
    )


# -- catalog ----------------------------------------------------------------------------------------------
def _margins(lines: DataFrame, *keys: str | Column) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.sum("line_amount").alias("revenue"),
        F.sum("line_cost").alias("cost"),
        F.sum("gross_margin").alias("margin"),
        F.sum("quantity").alias("units"),
    )


def category_margin(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        _margins(_lines(wh, start, end), "category")
        .select(
            "category",
            usd("revenue").alias("line_revenue"),
            usd("margin").alias("gross_margin"),
            ratio("margin", "revenue").alias("margin_pct"),
        )
        .orderBy("category")
    )


def category_mix(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Every category, also those without a sale in the window."""
    every = literal_table(wh.spark, "category string", [(c,) for c in config.CATEGORIES])
    sold = _margins(_lines(wh, start, end), "category")
    return every.join(sold, "category", "left").select(
        "category",
        usd(_zero("revenue")).alias("line_revenue"),
        n(_zero("units")).alias("units"),
        usd(_zero("cost")).alias("cogs"),
        usd(_zero("margin")).alias("gross_margin"),
        F.coalesce(ratio("margin", "revenue"), F.lit(0.0)).alias("margin_pct"),
    )


def category_gross_margin_by_year(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        _margins(_lines(wh, start, end), F.year("order_date").cast("long").alias("year"), "category")
        .select(
            "year",
            "category",
            usd("revenue").alias("line_revenue"),
            usd("cost").alias("cogs"),
            usd("margin").alias("gross_margin"),
            ratio("margin", "revenue").alias("margin_pct"),
            "units",
        )
        .orderBy("year", F.desc("gross_margin"))
    )


def supplier_product_sales_distribution(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Supplier and category shares of product sales; an unattributed line is an error."""
    lines = _lines(wh, start, end)
    grouped = lines.groupBy("supplier_id", "category").agg(
        F.sum("line_amount").alias("sales"), F.count_if(F.col("line_amount").isNull()).alias("missing")
    )
    total = grouped.agg(F.sum("sales").alias("t")).scalar()
    incomplete = F.col("supplier_id").isNull() | F.col("category").isNull() | (F.col("missing") > 0)
    stop = F.raise_error(F.lit("incomplete supplier, category or amount attribution")).cast("double")
    return grouped.select(
        "supplier_id",
        "category",
        F.when(incomplete, stop).otherwise(usd("sales")).alias("product_sales_usd"),
        ratio("sales", total).alias("sales_share"),
    ).orderBy(F.desc("product_sales_usd"), "supplier_id", "category")


def gmv_of_orders_with_category(wh: Warehouse, category: str, start: str, end: str) -> DataFrame:
    hit = (
        _lines(wh, start, end)
        .filter(F.col("category") == category)
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("line_amount").alias("amount"))
    )
    joined = _orders(wh, start, end).select("order_id", "gross_amount").join(hit, "order_id")
    return joined.agg(
        usd(_zero(F.sum("gross_amount"))).alias("value"),
        usd(_zero(F.sum(F.col("gross_amount") * F.col("lines").cast("decimal(10,0)")))).alias("summed_per_matching_line"),
        usd(_zero(F.sum("amount"))).alias("category_line_amount_only"),
    )


# -- dashboards -----------------------------------------------------------------------------------------------
def monthly_marketing(wh: Warehouse) -> DataFrame:
    orders = (
        wh.mart("fct_orders")
        .groupBy(month_start("order_date").alias("month"))
        .agg(
            F.sum("gross_amount").alias("gmv"),
            *[sum_when(F.col("channel") == c, "gross_amount").alias(f"gmv_{c}") for c in config.CHANNELS],
            count_when(_consumer()).alias("consumer_orders"),
            sum_when(_consumer(), "gross_amount").alias("consumer_gmv"),
            count_when(F.col("is_first_order")).alias("new_customers"),
            count_when(_new_d2c()).alias("new_d2c_customers"),
            count_when(_consumer() & F.col("promo_code").isNotNull()).alias("promo_orders"),
        )
    )
    spend = (
        wh.stg("ad_spend")
        .groupBy(month_start("spend_date").alias("month"))
        .agg(F.sum("spend_usd").alias("ad_spend"), F.sum("reported_conversions").alias("reported_conversions"))
    )
    lines = (
        wh.mart("fct_order_lines")
        .groupBy(month_start("order_date").alias("month"))
        .agg(
            F.sum(line_discount()).alias("discount_dollars"),
            *[sum_when(F.col("category") == c, "line_amount").alias(f"cat_{c}") for c in config.CATEGORIES],
        )
    )
    joined = month_spine(wh).join(orders, "month", "left").join(spend, "month", "left").join(lines, "month", "left")
    dollars = lambda c: usd(_zero(c))
    count = lambda c: n(_zero(c))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "month",
        dollars("gmv").alias("gmv"),
        dollars("gmv_d2c").alias("gmv_d2c"),
        dollars("gmv_business_subscription").alias("gmv_subscription"),
        dollars("gmv_marketplace").alias("gmv_marketplace"),
        count("consumer_orders").alias("consumer_orders"),
        dollars("consumer_gmv").alias("consumer_gmv"),
        count("new_customers").alias("new_customers"),
        count("new_d2c_customers").alias("new_d2c_customers"),
        count("promo_orders").alias("promo_orders"),
        dollars("ad_spend").alias("ad_spend"),
        count("reported_conversions").alias("reported_conversions"),
        dollars("discount_dollars").alias("discount_dollars"),
        *[dollars(f"cat_{c}").alias(f"cat_{c}") for c in config.CATEGORIES],
        or_zero(ratio("consumer_gmv", "consumer_orders", 2)).alias("aov"),
        or_zero(ratio("ad_spend", "new_d2c_customers", 2)).alias("cac"),
    ).orderBy("month")


def marketing_kpis(wh: Warehouse, start: str, end: str) -> DataFrame:
    orders = _orders(wh, start, end).agg(
        _zero(F.sum("gross_amount")).alias("gmv"),
        sum_when(_consumer(), "gross_amount").alias("consumer_gmv"),
        count_when(_consumer()).alias("consumer_orders"),
        count_when(F.col("is_first_order")).alias("new_customers"),
        count_when(_new_d2c()).alias("new_d2c_customers"),
        count_when(_consumer() & F.col("promo_code").isNotNull()).alias("promo_orders"),
    )
    lines = _lines(wh, start, end).agg(_zero(F.sum(line_discount())).alias("discounts"))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return side_by_side(orders, _spend(wh, start, end), lines).select(
        usd("gmv").alias("gmv"),
        usd("consumer_gmv").alias("consumer_gmv"),
        "consumer_orders",
        or_zero(ratio("consumer_gmv", "consumer_orders", 2)).alias("aov"),
        "new_customers",
        "new_d2c_customers",
        usd("spend").alias("ad_spend"),
        or_zero(ratio("spend", "new_d2c_customers", 2)).alias("cac"),
        "promo_orders",
        usd("discounts").alias("discount_dollars"),
    )
