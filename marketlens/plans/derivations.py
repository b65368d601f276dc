"""Deterministic derivations shared by the table mapping and the derivation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions import MONEY, RATE, canonical_channel, day
from marketlens.sources.store import cut_lineage


def id_number(col: str) -> Column:
    """The numeric tail of an id such as ``ord_17``."""
    return F.regexp_extract(col, r"(\d+)$", 1).cast("long")


# -- orders ------------------------------------------------------------------------------------------
def line_amount(quantity: Column, unit_price: Column, discount_pct: Column) -> Column:
    price = quantity.cast("decimal(10,0)") * unit_price * (F.lit(1).cast(RATE) - discount_pct)
    return F.round(price, 2).cast(MONEY)


def gross_from_lines(lines: DataFrame, order: str = "order_id") -> DataFrame:
    return lines.groupBy(order).agg(F.sum("line_amount").cast(MONEY).alias("gross_amount"))


def net_amount(gross: Column, take_rate: Column) -> Column:
    """Marketplace orders keep the take, all others the gross amount."""
    return F.coalesce(F.round(gross * take_rate, 2).cast(MONEY), gross)


def recognition_schedule(orders: DataFrame) -> DataFrame:
    """Twelve equal rounded months for a subscription, one row for anything else.

    The twelve parts need not add back to the order exactly.
    """
    ratable = F.col("channel") == "business_subscription"
    months = F.when(ratable, F.sequence(F.lit(0), F.lit(config.TERM_MONTHS - 1))).otherwise(F.array(F.lit(0)))
    part = F.round(F.col("net_amount") / F.lit(config.TERM_MONTHS), 2).cast(MONEY)
    return orders.select(
        "order_id",
        "order_date",
        F.when(ratable, part).otherwise(F.col("net_amount")).alias("amount"),
        F.explode(months).alias("m"),
    ).select("order_id", F.expr("add_months(order_date, m)").alias("recognition_date"), "amount")


def invoice_schedule(orders: DataFrame) -> DataFrame:
    """Subscription orders with the day they are billed and due, and the billed amount."""
    return orders.filter(F.col("channel") == "business_subscription").withColumns(
        {
            "billed_date": F.col("order_date"),
            "due_date": F.date_add("order_date", config.NET_TERMS_DAYS),
            "amount": F.col("net_amount"),
        }
    )


# -- subscriptions --------------------------------------------------------------------------------------
def term_chain(terms: DataFrame, customer: str, start: str, seq: str, width: int = 1_000_000) -> DataFrame:
    """Link every term to the customer's previous one and mark the last.

    Adds ``previous_seq``, ``is_last``, ``chain_start`` and ``chain_start_seq``. Windows run over the
    days of a customer, over the cells of a customer's day (``width`` consecutive numbers each) and over the terms of
    a cell: the calendar, the range of numbers and ``width`` bound them, however many terms a customer has.
    """
    terms = terms.withColumn("_cell", F.floor(F.col(seq) / F.lit(width)))
    cells = terms.groupBy(customer, start, "_cell").agg(F.min(seq).alias("_low"), F.max(seq).alias("_high"))
    days = cells.groupBy(customer, start).agg(F.min("_low").alias("_day_low"), F.max("_high").alias("_day_high"))
    by_day = Window.partitionBy(customer).orderBy(start)
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select(
        customer,
        start,
        F.lag("_day_high").over(by_day).alias("_day_before"),
        F.when(F.lead(start).over(by_day).isNull(), F.col("_day_high")).alias("_last"),
        F.first(start).over(whole).alias("chain_start"),
        F.first("_day_low").over(whole).alias("chain_start_seq"),
    )
    by_cell = Window.partitionBy(customer, start).orderBy("_cell")
    cells = cells.select(customer, start, "_cell", F.lag("_high").over(by_cell).alias("_cell_before"))
    in_cell = Window.partitionBy(customer, start, "_cell").orderBy(seq)
    return (
        terms.withColumn("_before", F.lag(seq).over(in_cell))
        .join(cells, [customer, start, "_cell"])
        .join(days, [customer, start])
        .withColumn("previous_seq", F.coalesce("_before", "_cell_before", "_day_before"))
        .withColumn("is_last", F.coalesce(F.col(seq) == F.col("_last"), F.lit(False)))
        .drop("_cell", "_before", "_cell_before", "_day_before", "_last")
    )


def chain_roots(terms: DataFrame) -> DataFrame:
    """``(subscription_id, root_id)``: the first term of every renewal chain, whoever the customers are.

    Pointer doubling: each round replaces a term's pointer by that of the term it points at, until
    none moves, so the rounds grow with the logarithm of the longest chain. The pointed-at side
    has unique keys; a long chain makes the other side skewed, which the adaptive skew join
    splits. Terms that renew each other in a circle raise an error.
    """
    terms = terms.select("subscription_id", "renewed_from_subscription_id")
    known = terms.select(F.col("subscription_id").alias("parent"))
    linked = terms.join(known, F.col("renewed_from_subscription_id") == F.col("parent"), "left")
    hops = linked.select("subscription_id", F.coalesce("parent", "subscription_id").alias("root_id"))
    hops = cut_lineage(hops.withColumn("moved", F.col("root_id") != F.col("subscription_id")))
    while moved := hops.filter("moved").count():
        nxt = hops.select(F.col("subscription_id").alias("root_id"), F.col("root_id").alias("further"))
        step = hops.join(nxt, "root_id").select(
            "subscription_id", F.col("further").alias("root_id"), (F.col("further") != F.col("root_id")).alias("moved"))
        last, hops = moved, cut_lineage(step)
        if hops.filter("moved").count() == last:  # each round brings the terms next to the roots home
            break
    heads = linked.filter(F.col("parent").isNull()).select(F.col("subscription_id").alias("head"))
    astray = hops.join(heads, F.col("root_id") == F.col("head"), "left")
    checked = F.when(F.col("head").isNotNull(), F.col("root_id")).otherwise(F.raise_error(F.lit("terms renew each other in a circle")))
    return astray.select("subscription_id", checked.cast("string").alias("root_id"))


def term_end(start: Column) -> Column:
    return F.date_sub(F.add_months(start, config.TERM_MONTHS), 1)


def term_status(start: Column, is_last: Column) -> Column:
    """Renewed unless it is the last term; that one churned if a renewal was possible."""
    return (
        F.when(~is_last, F.lit("renewed"))
        .when(F.add_months(start, config.TERM_MONTHS) <= day(config.TIMELINE_END), F.lit("churned"))
        .otherwise(F.lit("active"))
    )


def term_acv(seats: Column, price: Column) -> Column:
    return (seats.cast("decimal(10,0)") * price).cast(MONEY)


# -- customers ---------------------------------------------------------------------------------------------
def customer_rollup(orders: DataFrame) -> DataFrame:
    """First order date, first canonical channel and business flag per customer."""
    return orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_date"),
        F.max(F.col("channel") == "business_subscription").alias("is_business"),
        F.min_by(canonical_channel("channel"), F.struct("order_date", id_number("order_id"))).alias("first_channel"),
    )


def source_first_seen(orders: DataFrame, *channels: str) -> DataFrame:
    """First order date per customer over a set of canonical channels."""
    return (
        orders.filter(canonical_channel("channel").isin(*channels))
        .groupBy("customer_id")
        .agg(F.min("order_date").alias("created_at"))
    )


def is_migrated(system: Column, created: Column) -> Column:
    return system.isin("shopify", "salesforce") & (created < day(config.IDENTITY_MIGRATION))


def linked_date(system: Column, source_created: Column, app_created: Column, lag: Column) -> Column:
    """When a crosswalk link becomes visible: never before either endpoint."""
    earliest = F.greatest(source_created, app_created)
    return (
        F.when(system == "app_db", source_created)
        .when(is_migrated(system, source_created), F.greatest(earliest, day(config.IDENTITY_MIGRATION)))
        .otherwise(F.date_add(earliest, lag.cast("int")))
    )


def link_method(system: Column, source_created: Column) -> Column:
    return (
        F.when(system == "app_db", F.lit(config.LINK_PRIMARY))
        .when(is_migrated(system, source_created), F.lit(config.LINK_MIGRATION))
        .otherwise(F.lit(config.LINK_SYNC))
    )


def requester_system(segment: Column, salesforce_id: Column, stripe_id: Column) -> Column:
    """Business requesters use Salesforce, consumers Stripe, everyone else the app id."""
    business = segment.isin("smb", "enterprise")
    return (
        F.when(business & salesforce_id.isNotNull(), F.lit("salesforce"))
        .when(~business & stripe_id.isNotNull(), F.lit("stripe"))
        .otherwise(F.lit("app_db"))
    )


def chronological_ids(df: DataFrame, date: str, number: str, width: int = 1_000_000) -> DataFrame:
    """Number rows 1..n by ``(date, number)`` without sorting them in one partition.

    Rows fall into cells of one day and ``width`` consecutive key numbers. Each row's number
    is the size of all earlier days, plus that of earlier cells of its day, plus its rank
    in the cell; every window is bounded by the calendar, the key range or ``width``.
    """
    cells = df.withColumn("_cell", F.floor(F.col(number) / F.lit(width)))
    sizes = cells.groupBy(date, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(date).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    earlier = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = (
        sizes.groupBy(date)
        .agg(F.sum("_n").alias("_day_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_day_n").over(earlier), F.lit(0)))
        .select(date, "_earlier")
    )
    rank = F.row_number().over(Window.partitionBy(date, "_cell").orderBy(number))
    return (
        cells.withColumn("_rank", rank)
        .join(sizes.drop("_n"), [date, "_cell"])
        .join(days, date)
        .withColumn("seq", (F.col("_earlier") + F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_cell", "_rank", "_before", "_earlier")
    )
