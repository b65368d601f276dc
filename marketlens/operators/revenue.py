"""Revenue metrics. Next to each value stand the plausible-but-wrong readings of it.

Anything that only needs a measure over a window reads ``revenue_daily``, which holds at
most five rows per calendar day whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import (
    between_days,
    count_when,
    day,
    labelled,
    literal_table,
    month_key,
    month_start,
    quarter_key,
    quarter_start,
    ratio,
    sum_when,
    usd,
)
from marketlens.functions.prefix import RunningTotals
from marketlens.functions.spines import side_by_side, spine
from marketlens.plans.marts import account_orders, revenue_tables
from marketlens.plans.warehouse import Warehouse


# -- building blocks ----------------------------------------------------------------------
def measure_sums(wh: Warehouse, **windows: tuple[str, str]) -> DataFrame:
    """One row with ``<label>_<measure>`` totals of every window, from a single scan."""
    sums = [
        sum_when(
            (F.col("measure_name") == m) & between_days("activity_date", start, end), "amount"
        ).alias(f"{label}_{m}")
        for label, (start, end) in windows.items()
        for m in config.MEASURES
    ]
    return wh.mart("revenue_daily").agg(*sums)


def orders_with_account(wh: Warehouse) -> DataFrame:
    """Every order, filtered or not, with its account type and whether it is eligible."""
    real = F.coalesce(F.col("account_type") == "customer", F.lit(False))
    return account_orders(wh).withColumn("is_real", real)


def _months_back(d: date, months: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 - months, 12)
    return date(y, m + 1, 1)


# -- the five revenues -----------------------------------------------------------------------
def five_revenues(wh: Warehouse, start: str, end: str) -> DataFrame:
    sums = measure_sums(wh, w=(start, end))
    return sums.select(*[usd(f"w_{m}").alias(m) for m in config.MEASURES])


def revenue_measure(wh: Warehouse, measure: str, start: str, end: str) -> DataFrame:
    sums = measure_sums(wh, w=(start, end))
    wrong = [m for m in config.MEASURES if m != measure]
    return sums.select(
        F.lit(measure).alias("measure_name"),
        usd(f"w_{measure}").alias("value"),
        *[usd(f"w_{m}").alias(f"wrong_{m}") for m in wrong],
    )


def revenue_measure_hygiene(wh: Warehouse, start: str, end: str) -> DataFrame:
    staging = (
        wh.stg("orders").filter(between_days("order_date", start, end)).agg(F.sum("gross_amount").alias("gross"))
    )
    return side_by_side(measure_sums(wh, w=(start, end)), staging).select(
        usd("w_gmv").alias("value"), usd("gross").alias("staging_including_test_and_internal")
    )


def last_full_quarter_revenue(wh: Warehouse, measure: str, as_of: str) -> DataFrame:
    today = date.fromisoformat(as_of)
    current = date(today.year, 3 * ((today.month - 1) // 3) + 1, 1)
    last_end = current - timedelta(days=1)
    next_start = _months_back(current, -3)
    if today == next_start - timedelta(days=1):  # the running quarter has fully elapsed
        last_start, last_end = current, today
    else:
        last_start = _months_back(current, 3)
    sums = measure_sums(
        wh,
        last=(str(last_start), str(last_end)),
        running=(str(current), as_of),
        trailing=(str(today - timedelta(days=89)), as_of),
    )
    others = [m for m in config.MEASURES if m != measure]
    return sums.select(
        day(str(last_start)).alias("quarter_start"),
        usd(f"last_{measure}").alias("value"),
        usd(f"running_{measure}").alias("current_partial_quarter"),
        usd(f"trailing_{measure}").alias("trailing_90_days"),
        *[usd(f"last_{m}").alias(f"same_quarter_{m}") for m in others],
    )


def ytd_growth(wh: Warehouse, measure: str, as_of: str) -> DataFrame:
    end = date.fromisoformat(as_of)
    prior_day = min(end.day, 28) if end.month == 2 else end.day
    sums = measure_sums(
        wh,
        ytd=(f"{end.year}-01-01", as_of),
        prior=(f"{end.year - 1}-01-01", str(date(end.year - 1, end.month, prior_day))),
        full=(f"{end.year - 1}-01-01", f"{end.year - 1}-12-31"),
    )
    ytd, prior, full = (F.col(f"{w}_{measure}") for w in ("ytd", "prior", "full"))
    grown = lambda base: F.round(F.try_divide(ytd.cast("double"), base.cast("double")) - 1, 4)
    return sums.select(
        grown(prior).alias("value"),
        usd(ytd).alias("ytd"),
        usd(prior).alias("prior_ytd"),
        grown(full).alias("growth_vs_full_prior_year"),
        usd(full).alias("prior_full_year"),
    )


def five_revenues_by_quarter(wh: Warehouse, start: str, end: str) -> DataFrame:
    quarters = spine(wh.spark, F.trunc(day(start), "QUARTER"), F.trunc(day(end), "QUARTER"), "quarter", "q")
    pivoted = (
        wh.mart("revenue_daily")
        .filter(between_days("activity_date", start, end))
        .groupBy(quarter_start("activity_date").alias("q"))
        .pivot("measure_name", list(config.MEASURES))
        .sum("amount")
    )
    zero = {m: F.coalesce(m, F.lit(0)) for m in config.MEASURES}
    return (
        quarters.join(pivoted, "q", "left")
        .select(
            quarter_key("q").alias("quarter"),
            *[usd(zero[m]).alias(m) for m in config.MEASURES],
            usd(zero["recognized_revenue"] - zero["gmv"]).alias("recognized_minus_gmv"),
        )
        .orderBy("quarter")
    )


def five_revenues_from_tables(wh: Warehouse, start: str, end: str) -> DataFrame:
    """The five revenues per quarter straight from the four revenue tables.

    A second derivation next to ``fct_revenue``, for reconciling the two.
    """
    t = revenue_tables(wh)
    consumer = F.col("channel") != "business_subscription"

    def per_quarter(df: DataFrame, date_column: str, **sums: Column) -> DataFrame:
        return (
            df.filter(between_days(date_column, start, end))
            .groupBy(quarter_key(date_column).alias("quarter"))
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        )

    parts = (
        per_quarter(
            t["orders"], "order_date", gross=F.col("gross_amount"), net=F.col("net_amount"),
            paid=F.when(consumer, F.col("net_amount")),
        ),
        per_quarter(t["refunds"], "refund_date", refunds=F.col("refund_amount")),
        per_quarter(t["invoices"], "billed_date", billed=F.col("amount")),
        per_quarter(t["invoices"], "collected_date", collected=F.col("amount")),
        per_quarter(t["revenue_recognition"], "recognition_date", recognized=F.col("amount")),
    )
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "quarter", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "quarter",
        usd(z("gross")).alias("gmv"),
        usd(z("net") - z("refunds")).alias("net_revenue"),
        usd(z("recognized")).alias("recognized_revenue"),
        usd(z("paid") + z("billed")).alias("billed_revenue"),
        usd(z("paid") + z("collected") - z("refunds")).alias("collected_cash"),
    )


# -- orders and channels -----------------------------------------------------------------------
def orders_count(wh: Warehouse, start: str, end: str) -> DataFrame:
    o = orders_with_account(wh).filter(between_days("order_date", start, end))
    return o.agg(
        count_when(F.col("is_real")).alias("value"),
        F.count(F.lit(1)).alias("staging_including_test_and_internal"),
    )


def _marketplace(wh: Warehouse, start: str, end: str) -> DataFrame:
    return wh.mart("fct_orders").filter((F.col("channel") == "marketplace") & between_days("order_date", start, end))


def marketplace_take(wh: Warehouse, start: str, end: str) -> DataFrame:
    sums = _marketplace(wh, start, end).agg(F.sum("net_amount").alias("net"), F.sum("gross_amount").alias("gross"))
    return sums.select(
        usd("net").alias("value"),
        ratio("net", "gross").alias("effective_take_rate"),
        usd("gross").alias("marketplace_gmv"),
    )


def marketplace_gmv_take_rate(wh: Warehouse, start: str, end: str) -> DataFrame:
    o = orders_with_account(wh).filter(
        (F.col("channel") == "marketplace") & between_days("order_date", start, end)
    )
    sums = o.agg(
        sum_when(F.col("is_real"), "gross_amount").alias("gross"),
        sum_when(F.col("is_real"), "net_amount").alias("net"),
        F.sum("gross_amount").alias("raw_gross"),
    )
    rate = F.try_divide(F.col("net").cast("double"), F.col("gross").cast("double"))
    return sums.select(
        usd("gross").alias("value"),
        F.round(rate, 4).alias("effective_take_rate"),
        usd("net").alias("marketplace_take"),
        F.round(1 - rate, 4).alias("seller_payout_share"),
        usd("raw_gross").alias("staging_gmv_including_test_and_internal"),
    )


def marketplace_take_rate_by_month(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        _marketplace(wh, start, end)
        .groupBy(month_key("order_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("marketplace_orders"), F.sum("gross_amount").alias("g"), F.sum("net_amount").alias("t"))
        .select(
            "month",
            "marketplace_orders",
            usd("g").alias("marketplace_gmv"),
            usd("t").alias("marketplace_take"),
            ratio("t", "g").alias("effective_take_rate"),
        )
        .orderBy("month")
    )


def d2c_gmv_by_year(wh: Warehouse, first_year: int, last_year: int) -> DataFrame:
    years = wh.spark.range(first_year, last_year + 1).select(F.col("id").alias("year"))
    raw = F.col("channel_raw")
    sums = (
        wh.mart("fct_orders")
        .filter((F.col("channel") == "d2c") & between_days("order_date", f"{first_year}-01-01", f"{last_year}-12-31"))
        .groupBy(F.year("order_date").cast("long").alias("year"))
        .agg(
            F.sum("gross_amount").alias("canonical"),
            sum_when(raw == "d2c", "gross_amount").alias("new_label"),
            sum_when(raw == "direct", "gross_amount").alias("old_label"),
        )
    )
    zero = lambda c: usd(F.coalesce(c, F.lit(0)))
    return (
        years.join(sums, "year", "left")
        .select(
            "year",
            zero("canonical").alias("d2c_gmv"),
            zero("new_label").alias("raw_label_d2c_gmv"),
            zero("old_label").alias("raw_label_direct_gmv"),
        )
        .orderBy("year")
    )


def d2c_orders_by_year(wh: Warehouse, years: Sequence[int]) -> DataFrame:
    if not years or any(type(y) is not int or not 1 <= y <= int(config.SNAPSHOT[:4]) - 1 for y in years):
        raise ValueError("years must be full calendar years before the snapshot")
    raw = F.col("channel_raw")
    return (
        wh.mart("fct_orders")
        .withColumn("year", F.year("order_date").cast("long"))
        .filter(F.col("year").isin(*years))
        .groupBy("year")
        .agg(
            count_when(F.col("channel") == "d2c").alias("d2c_orders"),
            count_when(raw == "direct").alias("raw_label_direct_orders"),
            count_when(raw == "d2c").alias("raw_label_d2c_orders"),
        )
        .orderBy("year")
    )


def d2c_by_year_raw_vs_canonical(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        wh.mart("fct_orders")
        .filter((F.col("channel") == "d2c") & between_days("order_date", start, end))
        .groupBy(
            F.year("order_date").cast("long").alias("year"), "channel_raw", F.col("channel").alias("canonical_channel")
        )
        .agg(F.count(F.lit(1)).alias("orders"), usd(F.sum("gross_amount")).alias("gmv"))
        .orderBy("year", "channel_raw")
    )


def _check_full_months(start: str, end: str, before: str, after: str) -> None:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first.day != 1 or (last + timedelta(days=1)).day != 1 or first > last:
        raise ValueError("the window must consist of complete calendar months")
    if not (start[:7] <= before < after <= end[:7]):
        raise ValueError("comparison months must be ordered within the window")


def orders_channel_step_change(wh: Warehouse, start: str, end: str, before: str, after: str) -> DataFrame:
    """Order coverage and d2c label continuity per month, empty months included."""
    _check_full_months(start, end, before, after)
    months = spine(wh.spark, day(start), F.trunc(day(end), "MM"), "month", "m")
    # one row per day first: the distinct-day counts then need no second shuffle of orders
    daily = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", start, end))
        .groupBy("order_date")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[count_when(F.col("channel") == c).alias(c) for c in config.CHANNELS],
            count_when(F.col("channel_raw") == "direct").alias("raw_direct"),
            count_when(F.col("channel_raw") == "d2c").alias("raw_d2c"),
        )
    )
    monthly = daily.groupBy(month_start("order_date").alias("m")).agg(
        *[F.sum(c).alias(c) for c in ("total", *config.CHANNELS, "raw_direct", "raw_d2c")],
        F.count(F.lit(1)).alias("days"),
        count_when(F.col("d2c") > 0).alias("d2c_days"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    length = F.dayofmonth(F.last_day("m")).cast("long")
    return (
        months.join(monthly, "m", "left")
        .select(
            month_key("m").alias("month"),
            length.alias("calendar_days"),
            zero("total").alias("total_orders"),
            zero("d2c").alias("d2c_orders"),
            zero("marketplace").alias("marketplace_orders"),
            zero("business_subscription").alias("subscription_orders"),
            zero("raw_direct").alias("raw_direct_orders"),
            zero("raw_d2c").alias("raw_d2c_orders"),
            (length - zero("days")).alias("zero_order_days"),
            (length - zero("d2c_days")).alias("zero_d2c_days"),
            ratio(zero("total"), length).alias("orders_per_day"),
            ratio(zero("d2c"), length).alias("d2c_orders_per_day"),
        )
        .orderBy("month")
    )


def orders_channel_label_ranges(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        wh.mart("fct_orders")
        .filter((F.col("channel") == "d2c") & between_days("order_date", start, end))
        .groupBy("channel_raw")
        .agg(
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
            F.count(F.lit(1)).alias("orders"),
        )
    )


def orders_channel_comparison(wh: Warehouse, start: str, end: str, before: str, after: str) -> DataFrame:
    monthly = orders_channel_step_change(wh, start, end, before, after)

    def at(month: str, column: str) -> Column:
        return F.max(F.when(F.col("month") == month, F.col(column))).cast("double")

    def change(column: str, per_day: bool) -> Column:
        new, old = at(after, column), at(before, column)
        if per_day:
            new, old = new / at(after, "calendar_days"), old / at(before, "calendar_days")
        return F.round((F.try_divide(new, old) - 1) * 100, 4)

    return monthly.agg(
        F.lit(before).alias("before_month"),
        F.lit(after).alias("after_month"),
        *[
            change(c, per_day).alias(f"{c}_per_day_change_pct" if per_day else f"{c}_change_pct")
            for c in ("total_orders", "d2c_orders")
            for per_day in (False, True)
        ],
    )


def account_type_dollars(wh: Warehouse, start: str, end: str) -> DataFrame:
    by_type = (
        orders_with_account(wh)
        .filter(between_days("order_date", start, end) & F.col("account_type").isNotNull())
        .groupBy("account_type")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross"))
    )
    total = by_type.agg(usd(F.sum("gross")).alias("t")).scalar()
    mart = measure_sums(wh, w=(start, end)).select(usd("w_gmv").alias("g")).scalar()
    return by_type.select(
        "account_type",
        "orders",
        usd("gross").alias("gmv"),
        total.alias("staging_total_gmv"),
        mart.alias("gmv_in_fct_revenue"),
    ).orderBy(F.desc("gmv"))


# -- recognized revenue by channel -----------------------------------------------------------------
def recognized_by_channel(wh: Warehouse, start: str, end: str) -> DataFrame:
    rec = wh.stg("revenue_recognition").filter(between_days("recognition_date", start, end))
    owners = orders_with_account(wh).select("order_id", "channel", "is_real")
    split = (
        rec.join(owners, "order_id")
        .groupBy("channel")
        .agg(
            F.sum(F.when(F.col("is_real"), F.col("amount"))).alias("recognized"),
            F.sum("amount").alias("unfiltered"),
        )
        .filter(F.col("recognized").isNotNull())
    )
    net = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", start, end))
        .groupBy("channel")
        .agg(F.sum("net_amount").alias("net"))
    )
    return (
        split.join(net, "channel", "left")
        .select(
            "channel",
            usd("recognized").alias("recognized_revenue"),
            usd(F.coalesce("net", F.lit(0))).alias("order_date_net_amount"),
            usd("unfiltered").alias("unfiltered_recognized"),
        )
        .orderBy("channel")
    )


def recognized_by_channel_by_quarter(wh: Warehouse, start: str, end: str, as_of: str) -> DataFrame:
    """Recognized mix per quarter, next to the net and GMV mixes it is mistaken for."""
    channels = wh.mart("fct_orders").select("order_id", "channel")
    rec = wh.stg("revenue_recognition").join(channels, "order_id")
    in_quarters = (
        rec.filter(between_days("recognition_date", start, end))
        .groupBy(quarter_key("recognition_date").alias("quarter"), "channel")
        .agg(F.sum("amount").alias("rec"))
    )
    placed = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", start, end))
        .groupBy(quarter_key("order_date").alias("quarter"), "channel")
        .agg(F.sum("net_amount").alias("net"), F.sum("gross_amount").alias("gross"))
    )
    running = (
        rec.filter(F.col("recognition_date").between(F.trunc(day(as_of), "QUARTER"), day(as_of)))
        .groupBy("channel")
        .agg(F.sum("amount").alias("running"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = in_quarters.join(placed, ["quarter", "channel"], "full_outer").select(
        "quarter", "channel", zero("rec").alias("rec"), zero("net").alias("net"), zero("gross").alias("gross")
    )
    quarter = Window.partitionBy("quarter")
    share = lambda c: ratio(F.col(c), F.sum(c).over(quarter))
    return (
        both.join(running, "channel", "left")
        .select(
            "quarter",
            "channel",
            usd("rec").alias("recognized_revenue"),
            share("rec").alias("share_of_quarter"),
            usd("net").alias("order_date_net_amount"),
            share("net").alias("order_date_net_share"),
            share("gross").alias("gmv_share"),
            usd(zero("running")).alias("partial_quarter_recognized"),
        )
        .orderBy("quarter", "channel")
    )


def revenue_by_channel(wh: Warehouse, start: str, end: str) -> DataFrame:
    channels = wh.mart("fct_orders").select("order_id", "channel")
    return (
        wh.stg("revenue_recognition")
        .filter(between_days("recognition_date", start, end))
        .join(channels, "order_id")
        .groupBy("channel")
        .agg(usd(F.sum("amount")).alias("amount"))
        .withColumn("channel_label", labelled("channel", config.CHANNEL_LABELS))
        .orderBy(F.desc("amount"))
    )


# -- refunds ---------------------------------------------------------------------------------------
def refund_key_violations(wh: Warehouse) -> DataFrame:
    """Keys the refund rate relies on: null or repeated order and refund ids."""

    def bad(table: str, key: str) -> DataFrame:
        return (
            wh.stg(table)
            .groupBy(F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("key").isNull() | (F.col("rows") > 1))
            .select(F.lit(table).alias("table_name"), "key", "rows")
        )

    return bad("orders", "order_id").unionByName(bad("refunds", "refund_id"))


def refund_rate_by_quarter(wh: Warehouse, as_of: str) -> DataFrame:
    """Refund-date dollars over order-date GMV per quarter, with four other readings.

    The result raises when it is computed over keys that ``refund_key_violations`` lists.
    """
    broken = refund_key_violations(wh).agg(F.count(F.lit(1))).scalar()
    stop = F.raise_error(F.lit("order or refund ids are null or repeated")).cast("double")
    orders = orders_with_account(wh).filter(F.col("order_date") <= day(as_of))
    real = F.col("is_real")
    sold = orders.groupBy(quarter_start("order_date").alias("quarter_start")).agg(
        F.sum(F.when(real, F.col("gross_amount"))).alias("gross"),
        F.sum(F.when(real, F.col("net_amount"))).alias("net"),
        F.sum("gross_amount").alias("raw_gross"),
    )
    refunds = (
        wh.stg("refunds")
        .filter(F.col("refund_date") <= day(as_of))
        .join(orders.select("order_id", "order_date", "is_real"), "order_id")
    )
    returned = refunds.groupBy(quarter_start("refund_date").alias("quarter_start")).agg(
        F.sum(F.when(real, F.col("refund_amount"))).alias("returned"),
        F.sum("refund_amount").alias("raw_returned"),
    )
    by_order = (
        refunds.filter(real)
        .groupBy(quarter_start("order_date").alias("quarter_start"))
        .agg(F.sum("refund_amount").alias("by_order"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    amount = zero("returned")
    rate = lambda num, den: ratio(num, den, 9)
    return (
        sold.join(returned, "quarter_start", "full_outer")
        .join(by_order, "quarter_start", "left")
        .filter(F.col("gross").isNotNull() | F.col("returned").isNotNull())
        .select(
            "quarter_start",
            usd(amount).alias("refund_amount"),
            usd("gross").alias("gmv"),
            F.when(broken > 0, stop).otherwise(rate(amount, F.col("gross"))).alias("refund_rate"),
            (day(as_of) < F.date_sub(F.add_months("quarter_start", 3), 1)).alias("is_partial_quarter"),
            rate(amount, F.col("net") - amount).alias("net_revenue_denominator"),
            rate(amount, F.col("net")).alias("pre_refund_net_denominator"),
            rate(zero("by_order"), F.col("gross")).alias("refunds_at_order_date"),
            rate(zero("raw_returned"), F.col("raw_gross")).alias("including_test_internal"),
        )
        .orderBy("quarter_start")
    )


def net_by_order_day(wh: Warehouse) -> DataFrame:
    """Net revenue per order day when refunds move to the day of their order (unfiltered)."""
    orders = wh.stg("orders")
    sold = orders.groupBy(F.col("order_date").alias("activity_date")).agg(F.sum("net_amount").alias("amount"))
    back = (
        wh.stg("refunds")
        .join(orders.select("order_id", F.col("order_date").alias("activity_date")), "order_id")
        .groupBy("activity_date")
        .agg((-F.sum("refund_amount")).alias("amount"))
    )
    return sold.unionByName(back)


def net_revenue_order_keyed(wh: Warehouse, start: str, end: str) -> DataFrame:
    keyed = net_by_order_day(wh).filter(between_days("activity_date", start, end)).agg(F.sum("amount").alias("v"))
    return side_by_side(keyed, measure_sums(wh, w=(start, end))).select(
        usd("v").alias("value"), usd("w_net_revenue").alias("refund_date_net_revenue")
    )


# -- personas and replay ----------------------------------------------------------------------------
def revenue_for_persona(wh: Warehouse, start: str, end: str) -> DataFrame:
    """What each persona means by revenue; an unknown persona gets the default measure."""
    asked = [(p, m) for p, m in config.PERSONA_MEASURE.items()] + [("unknown", None)]
    personas = literal_table(wh.spark, "persona string, measure string", asked).select(
        "persona", F.coalesce("measure", F.lit(config.DEFAULT_MEASURE)).alias("measure_name")
    )
    totals = (
        wh.mart("revenue_daily")
        .filter(between_days("activity_date", start, end))
        .groupBy("measure_name")
        .agg(usd(F.sum("amount")).alias("value"))
    )
    return personas.join(totals, "measure_name", "left").select("persona", "measure_name", "value")


def _periods(unit: str, first: str, last: str) -> list[tuple[str, str, str]]:
    months = {"m": 1, "q": 3, "y": 12}[unit]
    out, d = [], date.fromisoformat(first)
    while str(d) <= last:
        nxt = _months_back(d, -months)
        label = {"m": f"{d:%Y-%m}", "q": f"{d.year}Q{(d.month + 2) // 3}", "y": f"{d.year}"}[unit]
        out.append((label, str(d), str(nxt - timedelta(days=1))))
        d = nxt
    return out


def replay_cases() -> list[tuple[str, str, str, str]]:
    """The 92 replayed cases: months, quarters and years per measure."""
    quarters = _periods("q", "1999-01-01", "2001-04-01")
    years = _periods("y", "1999-01-01", "2000-01-01")
    plan = {
        "recognized_revenue": _periods("m", "1999-01-01", "2001-07-01") + _periods("q", "1999-01-01", "2001-01-01"),
        "gmv": _periods("m", "2000-08-01", "2001-07-01") + quarters + years,
        "billed_revenue": quarters + years,
        "collected_cash": quarters + years,
        "net_revenue": _periods("q", "2000-07-01", "2001-04-01"),
    }
    return [(f"{m}_{label}", m, start, end) for m, windows in plan.items() for label, start, end in windows]


def _case_table(wh: Warehouse) -> DataFrame:
    return literal_table(
        wh.spark, "case_name string, measure_name string, start_date date, end_date date", replay_cases()
    )


def window_totals(windows: DataFrame, daily: DataFrame) -> DataFrame:
    """``windows`` (measure_name, start_date, end_date, ...) with ``value``: the measure's total from start to end.

    Two equi-joins on running totals, however many windows there are or days they hold.
    """
    totals = RunningTotals(daily, "measure_name", "activity_date", ["amount"]).between(windows, "start_date", "end_date", "value")
    return totals.withColumn("value", usd("value"))


def metric_replay(wh: Warehouse) -> DataFrame:
    return window_totals(_case_table(wh), wh.mart("revenue_daily")).select(
        "case_name", "measure_name", "start_date", "end_date", "value")


def drift_check(wh: Warehouse, tolerance: float = config.USD_TOLERANCE) -> DataFrame:
    """Net-revenue cases whose value moves when refunds are keyed to the order date."""
    moved = net_by_order_day(wh).groupBy("activity_date").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))
    both = wh.mart("revenue_daily").unionByName(moved.withColumn("measure_name", F.lit("net_by_order_day")))
    cases = _case_table(wh).filter(F.col("measure_name") == "net_revenue")
    asked = cases.withColumn("measure_name", F.explode(F.array(F.lit("net_revenue"), F.lit("net_by_order_day"))))
    value = lambda measure: F.max(F.when(F.col("measure_name") == measure, F.col("value")))
    totals = window_totals(asked, both).groupBy("case_name").agg(
        value("net_revenue").alias("expected"), value("net_by_order_day").alias("changed"))
    return (
        totals.withColumn("delta", F.round(F.col("changed") - F.col("expected"), 2))
        .filter(F.abs("delta") > tolerance)
        .select("case_name", "expected", "changed", "delta")
    )
