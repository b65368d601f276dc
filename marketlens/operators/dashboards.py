"""Dashboard periods, KPI tiles and monthly series.

Window bounds follow from an anchor month. Figures that need distinct customers read one
row per customer with a flag per window, so seven windows cost one pass over the orders.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import between_days, count_when, day, literal_table, month_start, n, ratio, sum_when, usd
from marketlens.functions.spines import side_by_side
from marketlens.operators.customers import month_spine
from marketlens.operators.revenue import _months_back, measure_sums
from marketlens.plans.warehouse import Warehouse

KPIS = (
    "recognized_revenue", "gmv", "net_revenue", "billed_revenue", "collected_cash", "active_customers",
    "new_customers", "orders", "aov", "refund_amount", "refund_rate",
)


# -- periods -----------------------------------------------------------------------------------------
def last_elapsed_month(as_of: Column) -> Column:
    """Month start of the last fully elapsed month at ``as_of``."""
    month = F.trunc(as_of, "MM")
    return F.when(as_of == F.last_day(as_of), month).otherwise(F.add_months(month, -1))


def _last_order(wh: Warehouse) -> Column:
    return wh.stg("orders").agg(F.max("order_date").alias("d")).scalar()


def data_end(wh: Warehouse) -> DataFrame:
    return wh.stg("orders").agg(
        F.max("order_date").alias("last_order_date"), F.trunc(F.max("order_date"), "MM").alias("data_end_month")
    )


def elapsed(wh: Warehouse) -> DataFrame:
    """Last elapsed month as seen on every day an order was placed."""
    days = wh.stg("orders").select(F.col("order_date").alias("as_of")).distinct()
    return days.select("as_of", last_elapsed_month(F.col("as_of")).alias("last_elapsed_month"))


def _period_table(wh: Warehouse) -> DataFrame:
    return literal_table(wh.spark, "period string, months int", list(config.PERIODS.items()))


def period_bounds(wh: Warehouse) -> DataFrame:
    """Start and end of each named period, anchored at the last elapsed month of the data."""
    end_month = last_elapsed_month(F.col("last_order"))
    start = F.coalesce(
        F.add_months(F.col("end_month"), 1 - F.col("months")), day(config.TIMELINE_START)
    )
    return (
        _period_table(wh)
        .withColumn("last_order", _last_order(wh))
        .withColumn("end_month", end_month)
        .select(
            "period",
            F.col("months").cast("long").alias("months"),
            start.alias("start_date"),
            F.last_day("end_month").alias("end_date"),
        )
    )


def prior_bounds(wh: Warehouse) -> DataFrame:
    """The window of equal length right before each period; none for the open-ended one."""
    return (
        period_bounds(wh)
        .filter(F.col("months").isNotNull())
        .select(
            "period",
            F.add_months("start_date", -F.col("months").cast("int")).alias("prior_start"),
            F.date_sub("start_date", 1).alias("prior_end"),
        )
    )


def period_windows(anchor: str) -> dict[str, tuple[tuple[str, str], tuple[str, str] | None]]:
    """Current and prior window of each period for a given anchor month (``yyyy-MM``)."""
    month = date.fromisoformat(f"{anchor}-01")
    end = str(_months_back(month, -1) - timedelta(days=1))
    out = {}
    for period, months in config.PERIODS.items():
        if months is None:
            out[period] = ((config.TIMELINE_START, end), None)
            continue
        start = _months_back(month, months - 1)
        prior = (str(_months_back(start, months)), str(start - timedelta(days=1)))
        out[period] = ((str(start), end), prior)
    return out


# -- business page --------------------------------------------------------------------------------------
def _kpi_row(wh: Warehouse, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with ``<label>_<kpi>`` for every window."""
    inside = {w: between_days("order_date", *bounds) for w, bounds in windows.items()}
    people = (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_date"),
            *[count_when(c).alias(f"{w}_orders") for w, c in inside.items()],
        )
    )
    counts = people.agg(
        *[n(F.sum(f"{w}_orders")).alias(f"{w}_orders") for w in windows],
        *[count_when(F.col(f"{w}_orders") > 0).alias(f"{w}_active_customers") for w in windows],
        *[count_when(between_days("first_date", *b)).alias(f"{w}_new_customers") for w, b in windows.items()],
    )
    refunds = (
        wh.stg("refunds")
        .join(wh.mart("fct_orders").select("order_id"), "order_id", "left_semi")
        .agg(*[sum_when(between_days("refund_date", *b), "refund_amount").alias(f"{w}_refunds") for w, b in windows.items()])
    )
    row = side_by_side(measure_sums(wh, **windows), counts, refunds)
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    out: list[Column] = []
    for w in windows:
        out += [usd(f"{w}_{m}").alias(f"{w}_{m}") for m in config.MEASURES]
        out += [F.col(f"{w}_{c}") for c in ("active_customers", "new_customers", "orders")]
        out += [
            or_zero(ratio(f"{w}_gmv", f"{w}_orders", 2)).alias(f"{w}_aov"),
            usd(f"{w}_refunds").alias(f"{w}_refund_amount"),
            or_zero(ratio(f"{w}_refunds", f"{w}_gmv")).alias(f"{w}_refund_rate"),
        ]
    return row.select(*out)


def business_kpis(wh: Warehouse, anchor: str) -> DataFrame:
    """Eleven KPIs per period, the prior window's values and the relative change."""
    bounds = period_windows(anchor)
    windows, labels = {}, {}
    for i, (period, (current, prior)) in enumerate(bounds.items()):
        labels[period] = (f"c{i}", f"p{i}" if prior else None)
        windows[f"c{i}"] = current
        if prior:
            windows[f"p{i}"] = prior
    row = _kpi_row(wh, windows)
    structs = []
    for period, (cur, pri) in labels.items():
        start, end = bounds[period][0]
        fields = [F.lit(period).alias("period"), day(start).alias("start_date"), day(end).alias("end_date")]
        for k in KPIS:
            now = F.col(f"{cur}_{k}")
            before = F.col(f"{pri}_{k}") if pri else F.lit(None).cast(row.schema[f"{cur}_{k}"].dataType)
            change = F.try_divide((now - before).cast("double"), F.abs(before).cast("double"))
            fields += [now.alias(k), before.alias(f"prior_{k}"), F.round(change, 6).alias(f"{k}_delta")]
        structs.append(F.struct(*fields))
    return row.select(F.inline(F.array(*structs)))


def business_monthly(wh: Warehouse) -> DataFrame:
    """Every business chart's monthly series, empty months filled with zero."""
    revenue = (
        wh.mart("revenue_daily")
        .groupBy(month_start("activity_date").alias("month"))
        .pivot("measure_name", list(config.MEASURES))
        .sum("amount")
    )
    orders = (
        wh.mart("fct_orders")
        .groupBy(month_start("order_date").alias("month"), "customer_id")
        .agg(F.count(F.lit(1)).alias("orders"))
        .groupBy("month")
        .agg(F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("active_customers"))
    )
    new = (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(F.min("order_date").alias("d"))
        .groupBy(month_start("d").alias("month"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )
    refunds = (
        wh.stg("refunds")
        .join(wh.mart("fct_orders").select("order_id"), "order_id", "left_semi")
        .groupBy(month_start("refund_date").alias("month"))
        .agg(F.sum("refund_amount").alias("refund_amount"), F.count(F.lit(1)).alias("refund_count"))
    )
    joined = month_spine(wh)
    for side in (revenue, orders, new, refunds):
        joined = joined.join(side, "month", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # one row per calendar month: a single ordered frame stays small
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        "month",
        *[usd(zero(m)).alias(m) for m in config.MEASURES],
        n(zero("orders")).alias("orders"),
        n(zero("active_customers")).alias("active_customers"),
        n(zero("new_customers")).alias("new_customers"),
        n(F.sum(zero("new_customers")).over(so_far)).alias("cumulative_customers"),
        usd(zero("refund_amount")).alias("refund_amount"),
        n(zero("refund_count")).alias("refund_count"),
        F.coalesce(ratio("gmv", "orders"), F.lit(0.0)).alias("aov"),
        F.coalesce(ratio("refund_amount", "gmv", 6), F.lit(0.0)).alias("refund_rate"),
    ).orderBy("month")


def business_monthly_by_period(wh: Warehouse) -> DataFrame:
    """The monthly series once per dashboard period that shows it."""
    periods = period_bounds(wh).select("period", "start_date", "end_date")
    shown = F.col("month").between(F.col("start_date"), F.col("end_date"))
    return business_monthly(wh).join(periods, shown).drop("start_date", "end_date")
