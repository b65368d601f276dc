"""Customer metrics.

Distinct customer counts are taken from one row per customer (or per customer and month)
with a flag per channel, built with a single map-side combined aggregation. That avoids
the row expansion of several distinct counts and never gathers a customer's orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import between_days, count_when, day, month_start, n, quarter_key, ratio
from marketlens.functions.spines import side_by_side, spine
from marketlens.operators.revenue import _months_back, orders_with_account
from marketlens.plans.warehouse import Warehouse

SERIES = ("total", *config.CHANNELS)


def data_end_month(wh: Warehouse) -> Column:
    """Month of the last order, as a scalar subquery."""
    return wh.stg("orders").agg(F.trunc(F.max("order_date"), "MM").alias("m")).scalar()


def month_spine(wh: Warehouse) -> DataFrame:
    return spine(wh.spark, day(config.TIMELINE_START), data_end_month(wh), "month", "month")


def _any(cond: Column) -> Column:
    return F.max(F.coalesce(cond, F.lit(False)))


def _total(flags: list[Column]) -> Column:
    ints = [f.cast("long") for f in flags]
    return sum(ints[1:], ints[0])


def current_customers(wh: Warehouse, start: str, end: str) -> DataFrame:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    earlier = (str(_months_back(first, 1)), str(_months_back(last, 0) - timedelta(days=1)))
    inside = between_days("order_date", start, end)
    people = (
        orders_with_account(wh)
        .filter(between_days("order_date", earlier[0], end))
        .groupBy("customer_id", "is_real")
        .agg(
            _any(inside).alias("now"),
            _any(between_days("order_date", *earlier)).alias("earlier"),
            *[_any(inside & (F.col("channel") == c)).alias(c) for c in config.CHANNELS],
        )
    )
    real = F.col("is_real")
    counts = people.agg(
        count_when(real & F.col("now")).alias("value"),
        count_when(F.col("now")).alias("including_test_and_internal"),
        n(F.coalesce(F.sum(F.when(real, _total([F.col(c) for c in config.CHANNELS]))), F.lit(0))).alias(
            "sum_of_channel_counts"
        ),
        count_when(real & F.col("earlier")).alias("window_ending_prior_month"),
    )
    profiles = wh.stg("app_customers").agg(count_when(F.col("created_date") <= day(end)).alias("all_profiles_created"))
    return side_by_side(counts, profiles)


def new_customers(wh: Warehouse, start: str, end: str) -> DataFrame:
    firsts = (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("total"),
            *[F.min(F.when(F.col("channel") == c, F.col("order_date"))).alias(c) for c in config.CHANNELS],
        )
    )
    per_channel = [count_when(between_days(c, start, end)) for c in config.CHANNELS]
    counts = firsts.agg(
        count_when(between_days("total", start, end)).alias("value"),
        sum(per_channel[1:], per_channel[0]).alias("first_order_per_channel"),
    )
    profiles = wh.stg("app_customers").agg(
        count_when(between_days("created_date", start, end)).alias("profiles_created")
    )
    return side_by_side(counts, profiles)


def multi_channel_customers(wh: Warehouse, start: str, end: str) -> DataFrame:
    raw_labels = (config.LEGACY_D2C_LABEL, *config.CHANNELS)
    people = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", start, end))
        .groupBy("customer_id")
        .agg(
            _total([_any(F.col("channel") == c) for c in config.CHANNELS]).alias("channels"),
            _total([_any(F.col("channel_raw") == c) for c in raw_labels]).alias("raw_channels"),
        )
    )
    return people.agg(
        count_when(F.col("channels") >= 2).alias("value"), count_when(F.col("raw_channels") >= 2).alias("raw_channel_labels")
    )


def current_window(end_month: str) -> tuple[str, str]:
    """The trailing calendar months, as inclusive days, that make a customer current."""
    last = date.fromisoformat(end_month)
    return (
        str(_months_back(last, config.CURRENT_WINDOW_MONTHS - 1)),
        str(_months_back(last, -1) - timedelta(days=1)),
    )


def current_sets(wh: Warehouse, end_month: str) -> DataFrame:
    people = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", *current_window(end_month)))
        .groupBy("customer_id")
        .agg(*[_any(F.col("channel") == c).alias(c) for c in config.CHANNELS])
    )
    return people.agg(
        F.count(F.lit(1)).alias("total"), *[count_when(F.col(c)).alias(c) for c in config.CHANNELS]
    )


def current_sets_any_window(wh: Warehouse, windows: DataFrame) -> DataFrame:
    """Distinct customers, in all and per channel, of every window of whole months, from stored bitmaps alone.

    ``windows`` has ``first_month`` and ``last_month`` (first days, both included). A window meets the bitmaps of its months by
    equality; those of a bucket are joined by OR, which is exact and can be done in any order, and counted at the end.
    No customer is looked at, and what a window costs does not depend on the number of orders.
    """
    asked = windows.select("first_month", "last_month").distinct().withColumn(
        "month", F.explode(F.sequence("first_month", F.greatest("first_month", "last_month"), F.expr("interval 1 month"))))
    window = ["first_month", "last_month"]
    held = asked.join(wh.mart("customer_bitmaps"), "month").filter(F.col("last_month") >= F.col("first_month"))
    merged = held.groupBy(*window, "channel", "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))
    total = merged.groupBy(*window, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("customers")).alias("total"),
        *[F.sum(F.when(F.col("channel") == c, F.bitmap_count("customers"))).alias(c) for c in config.CHANNELS])
    counts = ("total", *config.CHANNELS)
    sums = total.groupBy(*window).agg(*[F.sum(c).alias(c) for c in counts])
    return windows.join(sums, window, "left").select(*window, *[n(F.coalesce(c, F.lit(0))).alias(c) for c in counts])


def trailing_windows(wh: Warehouse, lengths: Sequence[int] = (1, 3, 6, 12, 24)) -> DataFrame:
    """The windows of so many months that end with each month of the data."""
    return month_spine(wh).select(F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k"), F.col("month").alias("last_month")).select(
        F.add_months("last_month", 1 - F.col("k")).alias("first_month"), "last_month")


def monthly_customer_metrics(wh: Warehouse) -> DataFrame:
    """Active, new, returning and current customers per month.

    A customer active in month *m* is current until the earlier of *m + 12* and the next
    active month, which takes over. So each activity adds one at *m* and, unless it is
    continued, takes one off later: the trailing distinct count becomes a running sum of
    these steps. The window looks at one customer's months in one series (at most the
    length of the calendar), never at orders.
    """
    months = (
        wh.mart("fct_orders")
        .groupBy("customer_id", month_start("order_date").alias("m"))
        .agg(*[_any(F.col("channel") == c).alias(c) for c in config.CHANNELS])
    )
    in_series = F.array(F.lit("total"), *[F.when(F.col(c), F.lit(c)) for c in config.CHANNELS])
    activity = months.select("customer_id", "m", F.explode(F.array_compact(in_series)).alias("series"))
    own = Window.partitionBy("customer_id", "series").orderBy("m")
    activity = activity.select(
        "series",
        "m",
        F.lag("m").over(own).isNull().alias("is_new"),
        F.least(F.add_months("m", config.CURRENT_WINDOW_MONTHS), F.lead("m").over(own)).alias("until"),
    )
    active = activity.groupBy("m").agg(
        *[count_when(F.col("series") == s).alias(f"active_{s}") for s in SERIES],
        count_when((F.col("series") == "total") & F.col("is_new")).alias("new_customers"),
    )
    steps = activity.select(
        "series",
        F.inline(
            F.array(
                F.struct(F.col("m").alias("m"), F.lit(1).alias("step")),
                F.struct(F.col("until").alias("m"), F.lit(-1).alias("step")),
            )
        ),
    )
    steps = steps.groupBy("m").agg(
        *[F.sum(F.when(F.col("series") == s, F.col("step")).otherwise(0)).alias(f"step_{s}") for s in SERIES]
    )
    # At most one row per calendar month from here on, so a single ordered frame is small.
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: n(F.coalesce(c, F.lit(0)))
    joined = (
        month_spine(wh)
        .join(active.withColumnRenamed("m", "month"), "month", "left")
        .join(steps.withColumnRenamed("m", "month"), "month", "left")
    )
    current = {"total": "current_customers", "d2c": "current_d2c", "business_subscription": "current_subscribers",
               "marketplace": "current_marketplace"}
    return joined.select(
        "month",
        *[zero(f"active_{c}").alias(f"active_{c}") for c in config.CHANNELS],
        zero("active_total").alias("active_customers"),
        zero("new_customers").alias("new_customers"),
        (zero("active_total") - zero("new_customers")).alias("returning_customers"),
        *[n(F.sum(zero(f"step_{s}")).over(so_far)).alias(name) for s, name in current.items()],
    )


def _people(wh: Warehouse, start: str, end: str) -> DataFrame:
    """One row per customer with the flags every customer KPI needs."""
    now = between_days("order_date", *current_window(end[:8] + "01"))
    inside = between_days("order_date", start, end)
    flags = []
    for c in config.CHANNELS:
        mine = F.col("channel") == c
        flags += [
            _any(now & mine).alias(f"now_{c}"),
            _any(inside & mine).alias(f"in_{c}"),
            _any(inside & mine & F.col("is_first_order")).alias(f"new_{c}"),
        ]
    return (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(
            _any(now).alias("now"),
            _any(inside).alias("in_period"),
            between_days(F.min("order_date"), start, end).alias("is_new"),
            *flags,
        )
    )


def customer_kpis(wh: Warehouse, start: str, end: str) -> DataFrame:
    people = _people(wh, start, end)
    channels = _total([F.col(f"in_{c}") for c in config.CHANNELS])
    k = people.agg(
        count_when(F.col("now")).alias("current_customers"),
        count_when(F.col("now_business_subscription")).alias("current_subscribers"),
        count_when(F.col("now_d2c")).alias("current_d2c"),
        count_when(F.col("now_marketplace")).alias("current_marketplace"),
        count_when(F.col("in_period")).alias("active_customers"),
        count_when(F.col("is_new")).alias("new_customers"),
        count_when(channels >= 2).alias("multi_channel_customers"),
    )
    return k.withColumn("returning_share", _returning_share())


def _returning_share() -> Column:
    share = F.try_divide(F.col("new_customers").cast("double"), F.col("active_customers").cast("double"))
    return F.coalesce(F.round(1 - share, 4), F.lit(0.0))


def customer_kpis_by_channel(wh: Warehouse, start: str, end: str) -> DataFrame:
    """The same KPIs restricted to one channel each; figures undefined there are NULL."""
    one_row = _people(wh, start, end).agg(
        *[count_when(F.col(f"{f}_{c}")).alias(f"{f}_{c}") for c in config.CHANNELS for f in ("now", "in", "new")],
        count_when(F.col("now_d2c")).alias("current_d2c"),
        count_when(F.col("now_marketplace")).alias("current_marketplace"),
    )
    nothing = F.lit(None).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"),
                F.col(f"now_{c}").alias("current_customers"),
                (F.col(f"now_{c}") if c == "business_subscription" else nothing).alias("current_subscribers"),
                F.col("current_d2c").alias("current_d2c"),
                F.col("current_marketplace").alias("current_marketplace"),
                F.col(f"in_{c}").alias("active_customers"),
                F.col(f"new_{c}").alias("new_customers"),
            )
            for c in config.CHANNELS
        ]
    )
    return one_row.select(F.inline(rows)).withColumn("returning_share", _returning_share())


def consumer_cohort_repeat_rate(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Share of consumer-acquired customers who order again within 365 days.

    The first day, the number of consumer orders on it and the next order day of a customer
    come from one aggregation, so no self-join is needed. A customer counts once per
    consumer order on the first day.
    """
    first = F.col("is_first_order")
    people = (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_date"),
            count_when(first & F.col("channel").isin(*config.CONSUMER_CHANNELS)).alias("acquired"),
            F.min(F.when(~first, F.col("order_date"))).alias("next_date"),
        )
        .filter(between_days("first_date", start, end) & (F.col("acquired") > 0))
    )
    again = F.col("next_date") <= F.date_add("first_date", 365)
    return (
        people.groupBy(quarter_key("first_date").alias("cohort_quarter"))
        .agg(
            F.sum("acquired").alias("customers_acquired"),
            F.sum(F.when(again, F.col("acquired")).otherwise(0)).alias("repeated_within_12m"),
        )
        .withColumn("repeat_rate_12m", ratio("repeated_within_12m", "customers_acquired"))
        .orderBy("cohort_quarter")
    )
