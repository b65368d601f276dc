"""Event diagnostics: tidy evidence rows ``(evidence, item, value)`` per planted event."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import between_days, count_when, day, month_key, month_start, quarter_key, ratio, sum_when, usd
from marketlens.functions.spines import spine
from marketlens.operators.marketing import line_discount
from marketlens.operators.operations import tickets_with_customer
from marketlens.plans.warehouse import Warehouse


def _evidence(df: DataFrame, item: Column, values: Mapping[str, Column | str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("evidence"),
                item.alias("item"),
                (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"),
            )
            for name, v in values.items()
        ]
    )
    return df.select(F.inline(rows))


def _months(wh: Warehouse, first: str, last: str) -> DataFrame:
    return spine(wh.spark, day(f"{first}-01"), day(f"{last}-01"), "month", "m")


def _month_window(col: str, first: str, last: str) -> Column:
    return (F.col(col) >= day(f"{first}-01")) & (F.col(col) <= F.last_day(day(f"{last}-01")))


def _zero(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0))


def event_supplier_outage(wh: Warehouse, first: str, last: str, start: str, end: str) -> DataFrame:
    lines = (
        wh.mart("fct_order_lines")
        .filter(_month_window("order_date", first, last))
        .groupBy(month_start("order_date").alias("m"))
        .agg(
            sum_when(F.col("category") == "paper", "line_amount").alias("paper"),
            F.sum("line_amount").alias("total"),
        )
    )
    orders = (
        wh.mart("fct_orders")
        .filter(_month_window("order_date", first, last) & (F.col("channel") != "business_subscription"))
        .groupBy(month_start("order_date").alias("m"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    monthly = _months(wh, first, last).join(lines, "m", "left").join(orders, "m", "left")
    shipments = wh.stg("supplier_shipments").filter(
        (F.col("category") == "paper") & between_days("expected_date", start, end)
    )
    totals = shipments.agg(
        F.count(F.lit(1)).alias("n"),
        _zero(F.sum("units_expected")).alias("expected"),
        _zero(F.sum("units_received")).alias("received"),
    )
    window = F.lit(f"{start}..{end}")
    return (
        _evidence(
            monthly,
            month_key("m"),
            {
                "paper_line_revenue_by_month": usd(_zero("paper")),
                "paper_share_of_line_revenue_by_month": ratio(_zero("paper"), "total"),
                "consumer_orders_by_month": _zero("orders"),
            },
        )
        .unionByName(
            _evidence(
                totals,
                window,
                {
                    "paper_shipments_in_window": "n",
                    "paper_units_expected_in_window": "expected",
                    "paper_units_received_in_window": "received",
                },
            )
        )
        .unionByName(_evidence(shipments, F.col("shipment_id"), {"delayed_shipment_ids": F.lit(1)}))
    )


def event_promo(wh: Warehouse, code: str, first: str, last: str) -> DataFrame:
    orders = (
        wh.mart("fct_orders")
        .filter(_month_window("order_date", first, last) & (F.col("channel") != "business_subscription"))
        .groupBy(month_start("order_date").alias("m"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("gross_amount").alias("gross"),
            count_when(F.col("promo_code") == code).alias("promo"),
        )
    )
    discounts = (
        wh.mart("fct_order_lines")
        .filter(_month_window("order_date", first, last))
        .groupBy(month_start("order_date").alias("m"))
        .agg(F.sum(line_discount()).alias("discount"))
    )
    monthly = _months(wh, first, last).join(orders, "m", "left").join(discounts, "m", "left")
    return _evidence(
        monthly,
        month_key("m"),
        {
            "consumer_orders_by_month": _zero("orders"),
            "consumer_gmv_by_month": usd(_zero("gross")),
            "consumer_aov_by_month": ratio("gross", "orders", 2),
            "promo_orders_by_month": _zero("promo"),
            "discount_dollars_by_month": usd(_zero("discount")),
        },
    )


def event_price_increase(
    wh: Warehouse, first: str, last: str, before: tuple[str, str], after: tuple[str, str]
) -> DataFrame:
    """Price history of the current generation and new starts around the price change.

    Terms are not filtered by account type here, as in the event reports.
    """
    current = wh.stg("plans").filter(F.col("plan_generation") == config.CURRENT_GENERATION).select("plan_id")
    prices = wh.stg("plan_prices").join(current, "plan_id", "left_semi")
    new = wh.stg("subscriptions").filter(
        F.col("renewed_from_subscription_id").isNull() & _month_window("term_start_date", first, last)
    )
    starts = new.groupBy(month_start("term_start_date").alias("m")).agg(
        F.count(F.lit(1)).alias("starts"), F.sum("acv").alias("acv"), F.sum("seats").alias("seats")
    )
    monthly = _months(wh, first, last).join(starts, "m", "left")
    label = (
        F.when(_month_window("term_start_date", *before), F.lit("..".join(before)))
        .when(_month_window("term_start_date", *after), F.lit("..".join(after)))
    )
    seats = (
        new.withColumn("label", label)
        .filter(F.col("label").isNotNull())
        .groupBy("label", "plan_id")
        .agg(F.sum("seats").alias("seats"))
    )
    shares = seats.withColumn("total", F.sum("seats").over(Window.partitionBy("label")))
    return (
        _evidence(
            prices,
            F.concat_ws(" ", "plan_id", F.col("effective_date").cast("string")),
            {"gen3_price_per_seat": "annual_price_per_seat"},
        )
        .unionByName(
            _evidence(
                monthly,
                month_key("m"),
                {
                    "new_subscription_starts_by_month": _zero("starts"),
                    "new_subscription_acv_per_seat_by_month": ratio("acv", "seats", 2),
                    "new_subscription_acv_by_month": usd(_zero("acv")),
                },
            )
        )
        .unionByName(
            _evidence(shares, F.concat_ws(" ", "label", "plan_id"), {"new_seat_share_by_plan": ratio("seats", "total")})
        )
    )


def event_enterprise_churn(wh: Warehouse, first_q: str, last_q: str, first: str, last: str) -> DataFrame:
    """Renewal outcomes per quarter and segment, and billing tickets in two definitions."""
    segments = wh.stg("app_customers").select(F.col("app_db_customer_id").alias("customer_id"), "segment")
    gone = F.col("status") == "churned"
    ended = (
        wh.stg("subscriptions")
        .filter(
            F.col("status").isin("renewed", "churned")
            & (F.col("term_end_date") >= day(first_q))
            & (F.col("term_end_date") <= F.last_day(F.add_months(day(last_q), 2)))
        )
        .join(segments, "customer_id")
        .groupBy(F.trunc("term_end_date", "QUARTER").alias("q"), "segment")
        .agg(
            F.count(F.lit(1)).alias("terms"),
            count_when(gone).alias("churned"),
            sum_when(gone, "acv").alias("acv"),
        )
    )
    cells = spine(wh.spark, day(first_q), day(last_q), "quarter", "q").select(
        "q", F.explode(F.array(*[F.lit(s) for s in config.SEGMENTS])).alias("segment")
    )
    outcomes = cells.join(ended, ["q", "segment"], "left")
    billing = F.col("category") == "billing"
    urgent = F.col("priority").isin("high", "urgent")
    enterprise = billing & (F.col("segment") == "enterprise") & (F.col("account_type") == "customer")
    business = billing & (F.col("requester_source_system") == "salesforce")
    tickets = (
        tickets_with_customer(wh)
        .filter(_month_window("created_date", first, last))
        .groupBy(month_start("created_date").alias("m"))
        .agg(
            count_when(enterprise).alias("e"),
            count_when(enterprise & urgent).alias("eh"),
            count_when(business).alias("b"),
            count_when(business & urgent).alias("bh"),
        )
    )
    return _evidence(
        outcomes,
        F.concat_ws("_", quarter_key("q"), "segment"),
        {
            "terms_up_for_renewal": _zero("terms"),
            "churned": _zero("churned"),
            "churn_rate": F.coalesce(ratio("churned", "terms"), F.lit(0.0)),
            "acv_churned": usd(_zero("acv")),
        },
    ).unionByName(
        _evidence(
            _months(wh, first, last).join(tickets, "m", "left"),
            month_key("m"),
            {
                "enterprise_billing_tickets_by_month": _zero("e"),
                "enterprise_high_priority_billing_tickets_by_month": _zero("eh"),
                "business_billing_tickets_by_month": _zero("b"),
                "business_high_priority_billing_tickets_by_month": _zero("bh"),
            },
        )
    )


def event_ad_spend_cut(wh: Warehouse, first: str, last: str) -> DataFrame:
    spend = (
        wh.stg("ad_spend")
        .filter(_month_window("spend_date", first, last))
        .groupBy(month_start("spend_date").alias("m"))
        .agg(F.sum("spend_usd").alias("spend"))
    )
    orders = (
        wh.mart("fct_orders")
        .filter((F.col("channel") == "d2c") & _month_window("order_date", first, last))
        .groupBy(month_start("order_date").alias("m"))
        .agg(F.count(F.lit(1)).alias("orders"), count_when(F.col("is_first_order")).alias("new"))
    )
    monthly = _months(wh, first, last).join(spend, "m", "left").join(orders, "m", "left")
    return _evidence(
        monthly,
        month_key("m"),
        {
            "ad_spend_by_month": usd(_zero("spend")),
            "d2c_orders_by_month": _zero("orders"),
            "new_d2c_customers_by_month": _zero("new"),
            "new_customer_share_of_d2c_orders_by_month": ratio("new", "orders"),
        },
    )


def event_category_margin(wh: Warehouse, year: int) -> DataFrame:
    by_category = (
        wh.mart("fct_order_lines")
        .filter(between_days("order_date", f"{year}-01-01", f"{year}-12-31"))
        .groupBy("category")
        .agg(
            F.sum("line_amount").alias("revenue"),
            F.sum("line_cost").alias("cogs"),
            F.sum("gross_margin").alias("margin"),
            F.sum("quantity").alias("units"),
        )
    )
    return _evidence(
        by_category,
        F.col("category"),
        {
            "revenue": usd("revenue"),
            "cogs": usd("cogs"),
            "gross_margin": usd("margin"),
            "gross_margin_pct": ratio("margin", "revenue"),
            "units": "units",
        },
    )


# -- events with their windows ------------------------------------------------------------------------
EVENTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "supplier_outage": lambda wh: event_supplier_outage(wh, "1999-01", "1999-06", *config.STOCKOUT),
    "promo_back_to_business": lambda wh: event_promo(wh, "BTB15", "2000-07", "2000-11"),
    "sub_price_increase": lambda wh: event_price_increase(
        wh, "2001-02", "2001-08", ("2001-02", "2001-04"), ("2001-05", "2001-07")
    ),
    "enterprise_churn": lambda wh: event_enterprise_churn(wh, "1998-04-01", "1999-04-01", "1998-07", "1999-01"),
    "ad_spend_cut": lambda wh: event_ad_spend_cut(wh, "1999-11", "2000-06"),
    "category_margin": lambda wh: event_category_margin(wh, 2000),
}


def event_evidence(wh: Warehouse, event: str, keys: Sequence[str]) -> DataFrame:
    return EVENTS[event](wh).filter(F.col("evidence").isin(*keys))


def event_detectability(wh: Warehouse) -> DataFrame:
    """Whether each event leaves the trace it should: one boolean row per assertion."""
    picked = ("supplier_outage", "promo_back_to_business", "sub_price_increase", "enterprise_churn", "ad_spend_cut")
    rows = None
    for event in picked:
        part = EVENTS[event](wh).withColumn("event", F.lit(event))
        rows = part if rows is None else rows.unionByName(part)

    def v(event: str, evidence: str, item: str | None = None) -> Column:
        at = (F.col("event") == event) & (F.col("evidence") == evidence)
        return F.max(F.when(at & (F.col("item") == item) if item else at, F.col("value")))

    share = lambda m: v("supplier_outage", "paper_share_of_line_revenue_by_month", m)
    promo = lambda k, m: v("promo_back_to_business", k, m)
    churn = lambda cell: v("enterprise_churn", "churn_rate", cell)
    spend = lambda m: v("ad_spend_cut", "ad_spend_by_month", m)
    fresh = lambda m: v("ad_spend_cut", "new_customer_share_of_d2c_orders_by_month", m)
    checks = {
        ("supplier_outage", "paper share halves in the stockout month"): share("1999-03") < 0.5 * share("1999-02"),
        ("supplier_outage", "no paper unit received in the window"): v(
            "supplier_outage", "paper_units_received_in_window"
        ) == 0,
        ("promo_back_to_business", "consumer orders above 1.25x the month before"): promo(
            "consumer_orders_by_month", "2000-09"
        ) > 1.25 * promo("consumer_orders_by_month", "2000-08"),
        ("promo_back_to_business", "consumer AOV falls"): promo("consumer_aov_by_month", "2000-09")
        < promo("consumer_aov_by_month", "2000-08"),
        ("enterprise_churn", "enterprise churn above 3x the quarter before"): churn("1998Q4_enterprise")
        > 3 * churn("1998Q3_enterprise"),
        ("enterprise_churn", "smb churn stays below 0.35"): churn("1998Q4_smb") < 0.35,
        ("ad_spend_cut", "spend more than halves"): spend("2000-02") < 0.5 * spend("2000-01"),
        ("ad_spend_cut", "new-customer share falls below 0.8x"): fresh("2000-03") < 0.8 * fresh("2000-01"),
    }
    price = (F.col("event") == "sub_price_increase") & (F.col("evidence") == "gen3_price_per_seat")
    for p in config.PLANS:
        if p[2] != config.CURRENT_GENERATION:
            continue
        mine = price & F.col("item").startswith(p[0] + " ")
        step = (F.count(F.when(mine, 1)) == 2) & (
            F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("item")))
            > F.min_by(F.when(mine, F.col("value")), F.when(mine, F.col("item")))
        )
        checks[("sub_price_increase", f"{p[0]} price steps up")] = step
    one = rows.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(e).alias("event"), F.lit(text).alias("assertion"), F.col(f"c{i}").alias("holds"))
                    for i, (e, text) in enumerate(checks)
                ]
            )
        )
    )
