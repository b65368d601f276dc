"""Derived columns recomputed from their inputs, as tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import MONEY, n
from marketlens.plans import derivations as dv
from marketlens.plans.temporal import as_of_lookup
from marketlens.plans.warehouse import Warehouse


def order_rollup_from_lines(wh: Warehouse) -> DataFrame:
    """Gross and net of every order that is sold by lines; one without any line has a gross of zero."""
    lines = wh.stg("order_lines")  # before the orders, which add up the stored lines
    takes = wh.stg("orders").filter(F.col("subscription_id").isNull()).select("order_id", "take_rate")
    gross = F.coalesce(F.col("gross_amount"), F.lit(0).cast(MONEY))
    return (
        takes.join(dv.gross_from_lines(lines), "order_id", "left")
        .select(
            "order_id",
            gross.cast("double").alias("gross_amount"),
            dv.net_amount(gross, F.col("take_rate")).cast("double").alias("net_amount"),
        )
    )


def line_amount(wh: Warehouse) -> DataFrame:
    amount = dv.line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return wh.stg("order_lines").select("order_line_id", amount.cast("double").alias("line_amount"))


def ratable_recognition(wh: Warehouse) -> DataFrame:
    return dv.recognition_schedule(wh.stg("orders")).withColumn("amount", F.col("amount").cast("double"))


def invoice_schedule(wh: Warehouse) -> DataFrame:
    return dv.invoice_schedule(wh.stg("orders")).select(
        "order_id", "billed_date", "due_date", F.col("amount").cast("double").alias("amount")
    )


def term_chain(wh: Warehouse) -> DataFrame:
    """Previous term, last-term flag, outcome and cancel date of every term."""
    terms = wh.stg("subscriptions").select(
        "subscription_id", "customer_id", "term_start_date", dv.id_number("subscription_id").alias("seq")
    )
    start = F.col("term_start_date")
    return (
        dv.term_chain(terms, "customer_id", "term_start_date", "seq")
        .withColumn("status", dv.term_status(start, F.col("is_last")))
        .select(
            "subscription_id",
            F.when(F.col("previous_seq").isNotNull(), F.concat(F.lit("sub_"), "previous_seq")).alias(
                "renewed_from_subscription_id"
            ),
            F.col("is_last").alias("is_last_term"),
            "status",
            F.when(F.col("status") == "churned", dv.term_end(start)).alias("cancelled_date"),
        )
    )


def term_bounds_acv(wh: Warehouse) -> DataFrame:
    return wh.stg("subscriptions").select(
        "subscription_id",
        "term_start_date",
        dv.term_end(F.col("term_start_date")).alias("term_end_date"),
        dv.term_acv(F.col("seats"), F.col("price_per_seat")).cast("double").alias("acv"),
    )


def customer_profile_from_orders(wh: Warehouse) -> DataFrame:
    """Creation date and acquisition channel every profile gets from its orders."""
    rollup = dv.customer_rollup(wh.stg("orders")).withColumnRenamed("customer_id", "app_db_customer_id")
    return (
        wh.stg("app_customers")
        .select("app_db_customer_id")
        .join(rollup, "app_db_customer_id", "left")
        .select(
            "app_db_customer_id",
            F.col("first_date").alias("first_order_date"),
            F.coalesce("first_channel", F.lit("signup")).alias("acquisition_channel"),
            F.coalesce("is_business", F.lit(False)).alias("is_business"),
        )
    )


def source_first_seen(wh: Warehouse) -> DataFrame:
    """When each customer first shows up in each source system."""
    out = None
    for system, channels in (
        ("stripe", ("d2c", "marketplace")),
        ("shopify", ("d2c",)),
        ("salesforce", ("business_subscription",)),
    ):
        part = dv.source_first_seen(wh.stg("orders"), *channels).select(
            F.lit(system).alias("source_system"), "customer_id", F.col("created_at").alias("first_seen_date")
        )
        out = part if out is None else out.unionByName(part)
    return out


def crosswalk_link_rules(wh: Warehouse) -> DataFrame:
    """Link date and method of every alias, before any link is lost."""
    return wh.source.complete_crosswalk().select(
        "source_system", "source_customer_id", "app_db_customer_id", F.col("linked_at").alias("linked_date"), "link_method"
    )


def ticket_requester_resolution(wh: Warehouse) -> DataFrame:
    """The customer behind each ticket and the system and id the rule assigns to it."""
    links = wh.stg("customer_id_crosswalk")
    owner = links.select(
        F.col("source_system").alias("requester_source_system"),
        F.col("source_customer_id").alias("requester_source_id"),
        F.col("app_db_customer_id").alias("customer_id"),
    )
    stripe = (
        links.filter(F.col("source_system") == "stripe")
        .join(wh.stg("stripe_customers"), F.col("source_customer_id") == F.col("stripe_customer_id"))
        .select(F.col("app_db_customer_id").alias("customer_id"), "stripe_customer_id", F.col("created_date").alias("since"))
    )
    salesforce = links.filter(F.col("source_system") == "salesforce").select(
        F.col("app_db_customer_id").alias("customer_id"), F.col("source_customer_id").alias("sf_id")
    )
    segments = wh.stg("app_customers").select(F.col("app_db_customer_id").alias("customer_id"), "segment")
    tickets = wh.stg("tickets").join(owner, ["requester_source_system", "requester_source_id"])
    tickets = as_of_lookup(
        tickets, stripe, key="customer_id", date="created_date", since="since", take=["stripe_customer_id"]
    )
    tickets = tickets.join(segments, "customer_id").join(salesforce, "customer_id", "left")
    system = dv.requester_system(F.col("segment"), F.col("sf_id"), F.col("stripe_customer_id"))
    return tickets.withColumn("system", system).select(
        "ticket_id",
        "customer_id",
        F.col("system").alias("requester_source_system"),
        F.when(F.col("system") == "salesforce", F.col("sf_id"))
        .when(F.col("system") == "stripe", F.col("stripe_customer_id"))
        .otherwise(F.col("customer_id"))
        .alias("requester_source_id"),
    )


def chronological_ids(wh: Warehouse) -> DataFrame:
    customers = wh.stg("app_customers").select(
        "app_db_customer_id", "created_date", dv.id_number("app_db_customer_id").alias("number")
    )
    return dv.chronological_ids(customers, "created_date", "number").select(
        "app_db_customer_id", "created_date", n("seq").alias("seq")
    )
