"""Data-quality tests, identity contract and table fingerprints.

Every test returns the violating rows; ``summary`` turns it into one row with the number
of rows checked and of violations, so that a passing test still shows what it looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import config
from marketlens.functions import between_days, canonical_channel, count_when, day, literal_table
from marketlens.functions.spines import side_by_side
from marketlens.operators.revenue import orders_with_account
from marketlens.plans.derivations import id_number, link_method
from marketlens.plans.marts import fct_identity_resolution_quality, observed_aliases
from marketlens.plans.staging import STAGING, staged_column
from marketlens.plans.visibility import LATE_UPDATES
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.registry import RAW_TABLES

MART_KEYS = {
    "dim_customers": ("app_db_customer_id",),
    "dim_products": ("sku",),
    "dim_plans": ("plan_id",),
    "fct_orders": ("order_id",),
    "fct_order_lines": ("order_line_id",),
    "fct_subscriptions": ("subscription_id",),
    "dim_date": ("date_day",),
    "fct_identity_resolution_quality": ("source_system",),
}
# Columns of marts and of the identity bridge that are never null (fixed values).
MART_NOT_NULL = {
    "int_customer_identity": ("source_system", "source_customer_id", "source_created_date", "is_active", "resolution_status"),
    "fct_revenue": ("activity_date", "measure_name", "amount"),
    "dim_customers": (
        "app_db_customer_id", "first_seen_date", "segment", "account_type", "acquisition_channel", "has_order",
        "resolved_source_id_count", "resolved_source_system_count", "has_app_db", "has_stripe", "has_shopify", "has_salesforce",
    ),
    "fct_identity_resolution_quality": (
        "source_system", "observed_id_count", "resolved_id_count", "unresolved_id_count", "resolution_null_rate",
    ),
    "dim_products": ("sku", "category", "unit_cost"),
    "dim_plans": ("plan_id", "plan_generation", "current_annual_price_per_seat"),
    "dim_date": ("date_day", "year_month"),
    "fct_orders": ("order_id", "customer_id", "channel", "channel_raw", "is_first_order"),
    "fct_order_lines": ("order_line_id", "order_id", "gross_margin"),
    "fct_subscriptions": ("subscription_id", "customer_id", "plan_generation", "status"),
    "fct_marketing_spend": ("spend_date", "platform", "attributed_new_d2c_customers_day_total"),
}
NULLABLE = {
    "app_customers": (),
    "stripe_customers": ("deactivated_date",),
    "orders": ("take_rate", "promo_code", "subscription_id"),
    "plans": ("retired_date",),
    "subscriptions": ("renewed_from_subscription_id", "cancelled_date"),
    "invoices": ("collected_date",),
    "supplier_shipments": ("received_date",),
    "tickets": ("resolved_date", "related_order_id", "related_subscription_id"),
}
ACCEPTED = (
    ("int_customer_identity", "source_system", ("app_db", "stripe", "shopify", "salesforce")),
    ("int_customer_identity", "resolution_status", tuple(config.STATUS_LABELS)),
    ("fct_revenue", "measure_name", config.MEASURES),
    ("fct_identity_resolution_quality", "source_system", ("app_db", "stripe", "shopify", "salesforce")),
    ("fct_orders", "channel", config.CHANNELS),
    ("fct_subscriptions", "status", ("renewed", "active", "churned")),
    ("app_customers", "segment", ("consumer", "smb", "enterprise")),
    ("app_customers", "account_type", ("customer", "test", "internal")),
    ("customer_id_crosswalk", "source_system", ("app_db", "stripe", "shopify", "salesforce")),
    ("customer_id_crosswalk", "link_method", (config.LINK_PRIMARY, config.LINK_MIGRATION, config.LINK_SYNC)),
    ("products", "category", config.CATEGORIES),
    ("plans", "plan_generation", config.GENERATIONS),
    ("subscriptions", "status", ("renewed", "active", "churned")),
    ("supplier_shipments", "status", ("received", "partial", "delayed", "in_transit")),
    ("ad_spend", "platform", config.PLATFORMS),
    ("tickets", "requester_source_system", ("salesforce", "stripe", "app_db")),
    ("tickets", "status", ("solved", "open")),
)
RELATIONSHIPS = (
    ("customer_id_crosswalk", "app_db_customer_id", "app_customers", "app_db_customer_id"),
    ("orders", "customer_id", "app_customers", "app_db_customer_id"),
    ("orders", "promo_code", "promotions", "promo_code"),
    ("orders", "subscription_id", "subscriptions", "subscription_id"),
    ("order_lines", "order_id", "orders", "order_id"),
    ("order_lines", "sku", "products", "sku"),
    ("products", "supplier_id", "suppliers", "supplier_id"),
    ("plan_prices", "plan_id", "plans", "plan_id"),
    ("subscriptions", "customer_id", "app_customers", "app_db_customer_id"),
    ("subscriptions", "plan_id", "plans", "plan_id"),
    ("subscriptions", "order_id", "orders", "order_id"),
    ("subscriptions", "renewed_from_subscription_id", "subscriptions", "subscription_id"),
    ("invoices", "order_id", "orders", "order_id"),
    ("invoices", "salesforce_customer_id", "salesforce_customers", "salesforce_customer_id"),
    ("revenue_recognition", "order_id", "orders", "order_id"),
    ("refunds", "order_id", "orders", "order_id"),
    ("refunds", "stripe_customer_id", "stripe_customers", "stripe_customer_id"),
    ("supplier_shipments", "supplier_id", "suppliers", "supplier_id"),
    ("fct_orders", "customer_id", "dim_customers", "app_db_customer_id"),
    ("fct_order_lines", "order_id", "fct_orders", "order_id"),
    ("fct_subscriptions", "customer_id", "dim_customers", "app_db_customer_id"),
)


def _table(wh: Warehouse, name: str) -> DataFrame:
    return wh.stg(name) if name in STAGING else wh.mart(name)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unique_keys() -> dict[str, tuple[str, ...]]:
    staged = {
        name: tuple(staged_column(name, k) for k in RAW_TABLES[raw].key) for name, (raw, _) in STAGING.items()
    }
    return {**staged, **MART_KEYS}


# -- generic tests ------------------------------------------------------------------------------------
def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") != 1)


def constraint_violations(
    table: Callable[[str], DataFrame],
    unique: Mapping[str, Sequence[str]],
    relationships: Sequence[tuple[str, str, str, str]],
) -> DataFrame:
    """(constraint, violations) of all constraints in one shuffle; they are numbered in order, unique keys first.

    Every table is read once. A row gives one (constraint, key, child, parent) per constraint that it takes part in; these
    are counted per key before and after the shuffle, so a hot key is one row of each task. A unique key is violated by
    a key that does not occur once, a relationship by every child row whose key, not null, no parent has.
    """
    given: dict[str, list[Column]] = {}

    def side(name: str, number: int, key: Column, child: int) -> Column:
        return F.struct(
            F.lit(number).alias("constraint"), key.alias("key"), F.lit(child).cast("long").alias("child"), F.lit(1 - child).cast("long").alias("parent"))

    for number, (name, key) in enumerate(unique.items()):
        whole = F.col(key[0]).cast("string") if len(key) == 1 else F.concat_ws("|", *[_text(c) for c in key])
        given.setdefault(name, []).append(side(name, number, whole, 1))
    for number, (child, column, parent, key) in enumerate(relationships, len(unique)):
        for name, c, is_child in ((child, column, 1), (parent, key, 0)):
            given.setdefault(name, []).append(side(name, number, F.col(c).cast("string"), is_child))
    rows = _union([table(name).select(F.inline(F.array(*sides))) for name, sides in given.items()])
    rows = rows.filter((F.col("constraint") < len(unique)) | F.col("key").isNotNull())
    keys = rows.groupBy("constraint", "key").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    once = (F.col("child") != 1).cast("long")
    orphaned = F.when(F.col("parent") == 0, F.col("child")).otherwise(0)
    broken = F.when(F.col("constraint") < len(unique), once).otherwise(orphaned)
    return keys.groupBy("constraint").agg(F.sum(broken).alias("violations"))


def _named(wh: Warehouse, violations: DataFrame, ddl: str, names: Sequence[tuple]) -> DataFrame:
    """Every constraint by its name; one without a row has no violation."""
    listed = literal_table(wh.spark, f"constraint int, {ddl}", [(i, *name) for i, name in enumerate(names)])
    columns = [c for c in listed.columns if c != "constraint"]
    return listed.join(violations, "constraint", "left").select(*columns, F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))


def dq_unique(wh: Warehouse) -> DataFrame:
    keys = unique_keys()
    found = constraint_violations(lambda name: _table(wh, name), keys, ())
    return _named(wh, found, "table_name string, columns string", [(name, ",".join(key)) for name, key in keys.items()])


def dq_constraints(wh: Warehouse) -> DataFrame:
    """All unique keys and all relationships together, in the one shuffle."""
    keys = unique_keys()
    found = constraint_violations(lambda name: _table(wh, name), keys, RELATIONSHIPS)
    names = [(f"unique {name}({','.join(key)})",) for name, key in keys.items()]
    names += [(f"{child}.{column} -> {parent}.{key}",) for child, column, parent, key in RELATIONSHIPS]
    return _named(wh, found, "name string", names)


def dq_not_null(wh: Warehouse) -> DataFrame:
    """Nulls per mandatory column; one pass per table covers all its columns."""
    parts = []
    for name in (*STAGING, *MART_NOT_NULL):
        df = _table(wh, name)
        checked = MART_NOT_NULL.get(name) or [c for c in df.columns if c not in NULLABLE.get(name, ())]
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in checked])
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("violations")) for c in checked]
        )
        parts.append(counts.select(F.lit(name).alias("table_name"), F.col("rows").alias("checked"), F.inline(pairs)))
    return _union(parts)


def dq_accepted_values(wh: Warehouse) -> DataFrame:
    parts = [
        _table(wh, name).agg(
            F.lit(name).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.count(column).alias("checked"),
            count_when(~F.col(column).isin(*values)).alias("violations"),
        )
        for name, column, values in ACCEPTED
    ]
    return _union(parts)


def dq_relationships(wh: Warehouse) -> DataFrame:
    found = constraint_violations(lambda name: _table(wh, name), {}, RELATIONSHIPS)
    names = [(f"{child}.{column} -> {parent}.{key}",) for child, column, parent, key in RELATIONSHIPS]
    return _named(wh, found, "relationship string", names)


# -- singular tests: violating rows -----------------------------------------------------------------------
def crosswalk_integrity(wh: Warehouse) -> DataFrame:
    """Links without both endpoints, or visible before one of them."""
    aliases = observed_aliases(wh).select("source_system", "source_customer_id", "source_created_date")
    customers = wh.stg("app_customers").select("app_db_customer_id", F.col("created_date").alias("app_created"))
    early = (F.col("linked_date") < F.col("source_created_date")) | (F.col("linked_date") < F.col("app_created"))
    return (
        wh.stg("customer_id_crosswalk")
        .join(aliases, ["source_system", "source_customer_id"], "left")
        .join(customers, "app_db_customer_id", "left")
        .filter(F.col("source_created_date").isNull() | F.col("app_created").isNull() | early)
        .select("source_system", "source_customer_id", "app_db_customer_id")
    )


def status_inconsistent(wh: Warehouse) -> DataFrame:
    """Identity rows whose status contradicts their crosswalk columns or migration rule."""
    fields = [F.col(c) for c in ("app_db_customer_id", "linked_date", "link_method")]
    any_null = reduce(Column.__or__, [f.isNull() for f in fields])
    any_set = reduce(Column.__or__, [f.isNotNull() for f in fields])
    status = F.col("resolution_status")
    migrated = F.col("source_system").isin("shopify", "salesforce") & (
        F.col("source_created_date") < day(config.IDENTITY_MIGRATION)
    )
    return wh.mart("int_customer_identity").filter(
        ((status == "resolved") & any_null)
        | ((status != "resolved") & any_set)
        | ((status == "unresolved_migration_gap") & ~migrated)
        | ((status == "unresolved_sync_lag") & migrated)
    )


def customers_out_of_range(wh: Warehouse) -> DataFrame:
    systems = F.col("resolved_source_system_count")
    return wh.mart("dim_customers").filter(F.col("has_order") & ((systems < 1) | (systems > 4)))


def quality_rate_off(wh: Warehouse) -> DataFrame:
    rate = F.col("resolution_null_rate")
    formula = F.coalesce(F.try_divide("unresolved_id_count", "observed_id_count"), F.lit(0.0))
    return wh.mart("fct_identity_resolution_quality").filter(
        (rate < 0) | (rate > 1) | (F.abs(rate - formula) > 0.000001)
    )


def quality_mismatch(wh: Warehouse) -> DataFrame:
    """The quality mart against a recount from the aliases and the crosswalk."""
    linked = wh.stg("customer_id_crosswalk").select("source_system", "source_customer_id", F.lit(1).alias("hit"))
    recount = (
        observed_aliases(wh)
        .join(linked, ["source_system", "source_customer_id"], "left")
        .groupBy("source_system")
        .agg(F.count(F.lit(1)).alias("o"), F.count("hit").alias("r"))
    )
    mart = fct_identity_resolution_quality(wh)
    both = recount.join(mart, "source_system", "full_outer")
    same = (
        (F.col("o") == F.col("observed_id_count"))
        & (F.col("r") == F.col("resolved_id_count"))
        & (F.col("o") - F.col("r") == F.col("unresolved_id_count"))
        & (F.col("resolved_id_count") + F.col("unresolved_id_count") == F.col("observed_id_count"))
    )
    return both.filter(~F.coalesce(same, F.lit(False))).select("source_system")


def legacy_channels(wh: Warehouse) -> DataFrame:
    return (
        wh.mart("fct_orders")
        .filter(~F.col("channel").isin(*config.CHANNELS))
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


SINGULAR: Mapping[str, tuple[Callable[[Warehouse], DataFrame], str]] = {
    "dq_crosswalk_integrity": (crosswalk_integrity, "customer_id_crosswalk"),
    "dq_crosswalk_no_duplicates": (
        lambda wh: duplicates(wh.stg("customer_id_crosswalk"), ["source_system", "source_customer_id"]),
        "customer_id_crosswalk",
    ),
    "dq_identity_key_unique": (
        lambda wh: duplicates(wh.mart("int_customer_identity"), ["source_system", "source_customer_id"]),
        "int_customer_identity",
    ),
    "dq_identity_status_consistency": (status_inconsistent, "int_customer_identity"),
    "dq_dim_customers_range": (customers_out_of_range, "dim_customers"),
    "dq_quality_rate": (quality_rate_off, "fct_identity_resolution_quality"),
    "dq_quality_reconciliation": (quality_mismatch, "fct_identity_resolution_quality"),
    "dq_no_legacy_channel": (legacy_channels, "fct_orders"),
}


def summary(wh: Warehouse, test: str) -> DataFrame:
    violations, checked = SINGULAR[test]
    return side_by_side(
        _table(wh, checked).agg(F.lit(test).alias("test"), F.count(F.lit(1)).alias("checked")),
        violations(wh).agg(F.count(F.lit(1)).alias("violations")),
    )


# -- aggregate tests ---------------------------------------------------------------------------------------
def dq_revenue_exclusion(wh: Warehouse, start: str, end: str) -> DataFrame:
    """Mart GMV equals the filtered orders and stays below the unfiltered ones."""
    mart = (
        wh.mart("revenue_daily")
        .filter((F.col("measure_name") == "gmv") & between_days("activity_date", start, end))
        .agg(F.sum("amount").alias("m"))
    )
    orders = (
        orders_with_account(wh)
        .filter(between_days("order_date", start, end))
        .agg(F.sum(F.when(F.col("is_real"), F.col("gross_amount"))).alias("f"), F.sum("gross_amount").alias("u"))
    )
    return side_by_side(mart, orders).select(
        F.col("m").cast("double").alias("mart_gmv"),
        F.col("f").cast("double").alias("filtered_gmv"),
        F.col("u").cast("double").alias("unfiltered_gmv"),
        (F.abs(F.col("m") - F.col("f")) <= config.USD_TOLERANCE).alias("mart_matches"),
        (F.col("m") < F.col("u")).alias("below_unfiltered"),
    )


def dq_join_preserves_metrics(wh: Warehouse, start: str, end: str) -> DataFrame:
    base = wh.stg("orders").filter(between_days("order_date", start, end))
    customers = wh.mart("dim_customers").select(F.col("app_db_customer_id").alias("customer_id"))
    sums = lambda df, p: df.agg(
        F.count(F.lit(1)).alias(f"{p}_orders"), F.sum("gross_amount").cast("double").alias(f"{p}_gmv")
    )
    return side_by_side(sums(base, "base"), sums(base.join(customers, "customer_id"), "joined")).withColumn(
        "preserved",
        (F.col("base_orders") == F.col("joined_orders"))
        & (F.abs(F.col("base_gmv") - F.col("joined_gmv")) <= config.USD_TOLERANCE),
    )


def dq_no_future_rows(wh: Warehouse, as_of: str) -> DataFrame:
    """What a snapshot must not show: later rows, leaked outcomes, links without endpoints."""
    snap, cut, parts = wh.as_of(as_of), day(as_of), []

    def check(name: str, bad: Column, df: DataFrame) -> DataFrame:
        return df.agg(
            F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("checked"), count_when(bad).alias("violations")
        )

    for name, (raw, _) in STAGING.items():
        arrival = staged_column(name, RAW_TABLES[raw].arrival)
        parts.append(check(f"{name}: later rows", F.col(arrival) > cut, snap.stg(name)))
    for name, (raw, _) in STAGING.items():
        if raw in LATE_UPDATES and raw != "app_db__subscriptions":
            changed = staged_column(name, LATE_UPDATES[raw][0])
            parts.append(check(f"{name}: later {changed}", F.col(changed) > cut, snap.stg(name)))
    leaked = (F.col("term_end_date") >= cut) & (F.col("status") != "active")
    parts.append(check("subscriptions: outcome of a running term", leaked, snap.stg("subscriptions")))
    seen = observed_aliases(snap).select("source_system", "source_customer_id", F.lit(1).alias("seen"))
    apps = snap.stg("app_customers").select("app_db_customer_id", F.lit(1).alias("app"))
    links = (
        snap.stg("customer_id_crosswalk")
        .join(seen, ["source_system", "source_customer_id"], "left")
        .join(apps, "app_db_customer_id", "left")
    )
    parts.append(check("crosswalk: endpoint not visible", F.col("seen").isNull() | F.col("app").isNull(), links))
    return _union(parts)


def dq_identity_contract(wh: Warehouse) -> DataFrame:
    """Rules the identity tables keep, one row per rule."""
    complete = wh.source.complete_crosswalk().select(
        "source_system", "source_customer_id", "app_db_customer_id", "source_created", "app_created"
    )
    aliases = observed_aliases(wh).select("source_system", "source_customer_id", "is_active")
    owned = complete.join(aliases, ["source_system", "source_customer_id"])
    systems = [s for s, _, _ in config.SOURCE_SYSTEMS]
    active = (
        owned.filter("is_active")
        .groupBy("app_db_customer_id")
        .agg(
            *[F.max((F.col("source_system") == s).cast("int")).alias(s) for s in systems],
            F.count(F.lit(1)).alias("active_rows"),
        )
    )
    channel = canonical_channel("channel")
    ordered = (
        wh.stg("orders")
        .groupBy(F.col("customer_id").alias("app_db_customer_id"))
        .agg(
            F.max(channel.isin(*config.CONSUMER_CHANNELS).cast("int")).alias("need_stripe"),
            F.max((channel == "d2c").cast("int")).alias("need_shopify"),
            F.max((channel == "business_subscription").cast("int")).alias("need_salesforce"),
        )
        .withColumn("need_app_db", F.lit(1))
        .join(active, "app_db_customer_id", "left")
    )
    needed = sum((F.col(f"need_{s}") for s in systems[1:]), F.col(f"need_{systems[0]}"))
    wrong_systems = reduce(Column.__or__, [F.coalesce(s, F.lit(0)) != F.col(f"need_{s}") for s in systems])
    wrong_rows = (F.col("active_rows") != needed) | ~needed.between(2, 4)

    stripe = (
        complete.filter(F.col("source_system") == "stripe")
        .join(
            wh.stg("stripe_customers").select(
                F.col("stripe_customer_id").alias("source_customer_id"), "created_date", "is_active"
            ),
            "source_customer_id",
        )
        .groupBy("app_db_customer_id")
        .agg(
            F.count(F.lit(1)).alias("ids"),
            count_when(F.col("is_active")).alias("live"),
            F.min(F.when(F.col("is_active"), F.col("created_date"))).alias("new_date"),
            F.max(F.when(~F.col("is_active"), F.col("created_date"))).alias("old_date"),
        )
    )
    twice = stripe.filter(F.col("ids") == 2)

    links = wh.stg("customer_id_crosswalk").join(
        complete.drop("app_db_customer_id"), ["source_system", "source_customer_id"]
    )
    migrated = F.col("source_system").isin("shopify", "salesforce") & (
        F.col("source_created") < day(config.IDENTITY_MIGRATION)
    )
    missing = complete.join(
        wh.stg("customer_id_crosswalk").select("source_system", "source_customer_id"),
        ["source_system", "source_customer_id"],
        "left_anti",
    )
    invoices = wh.stg("invoices").join(
        wh.stg("salesforce_customers").select("salesforce_customer_id", "created_date"), "salesforce_customer_id", "left"
    )
    refunds = wh.stg("refunds").join(
        wh.stg("stripe_customers").select("stripe_customer_id", "created_date"), "stripe_customer_id", "left"
    )
    expected = link_method(F.col("source_system"), F.col("source_created"))
    app_link = F.col("source_system") == "app_db"
    rules = (
        ("active systems match the channels ordered", ordered, wrong_systems),
        ("two to four active aliases, one per required system", ordered, F.coalesce(wrong_rows, F.lit(True))),
        ("at most one historical and one active Stripe id", stripe, F.col("ids") > 2),
        (
            "a re-created Stripe id is strictly later than the old one",
            twice,
            (F.col("live") != 1) | ~F.coalesce(F.col("new_date") > F.col("old_date"), F.lit(False)),
        ),
        ("missing links are pre-migration Shopify or Salesforce records", missing, ~migrated),
        (
            "kept pre-migration links arrive at the cut-off",
            links.filter(migrated),
            F.col("linked_date") != F.greatest("source_created", "app_created", day(config.IDENTITY_MIGRATION)),
        ),
        ("link method follows system and date", links, F.col("link_method") != expected),
        (
            "no link before its source or app customer",
            links,
            (F.col("linked_date") < F.col("source_created")) | (F.col("linked_date") < F.col("app_created")),
        ),
        ("app self-links arrive with the customer", links.filter(app_link), F.col("linked_date") != F.col("app_created")),
        (
            "invoices name a Salesforce customer visible by then",
            invoices,
            F.col("created_date").isNull() | (F.col("created_date") > F.col("billed_date")),
        ),
        (
            "refunds name a Stripe customer visible by then",
            refunds,
            F.col("created_date").isNull() | (F.col("created_date") > F.col("refund_date")),
        ),
    )
    return _union(
        [
            df.agg(
                F.lit(text).alias("rule"), F.count(F.lit(1)).alias("checked"), count_when(bad).alias("violations")
            )
            for text, df, bad in rules
        ]
    )


# -- nothing left out --------------------------------------------------------------------------------------------
def row_conservation(wh: Warehouse, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """What became of every given order, up to the orders mart, and of every order line, counted by outcome.

    Lines are counted per order on both sides before they meet, so a hot order key is one row.
    """
    key = id_number("order_id").alias("key")
    order_lines = wh.stg("order_lines")
    kept = wh.mart("int_orders").select(key, F.col("subscription_id").isNotNull().alias("subscription"))
    fate = (
        orders.select(F.col("o_orderkey").alias("key"))
        .join(kept, "key", "left")
        .select(
            F.lit("orders").alias("source_table"),
            F.when(F.col("subscription").isNull(), F.lit("missing"))
            .when(F.col("subscription"), F.lit("subscription order"))
            .otherwise(F.lit("consumer order"))
            .alias("outcome"),
            F.lit(1).cast("long").alias("n"),
        )
    )
    given = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("given"))
    staged = order_lines.groupBy(key).agg(F.count(F.lit(1)).alias("staged"))
    found = F.coalesce("staged", F.lit(0).cast("long"))

    def counted(what: str, how_many: Column) -> Column:
        return F.struct(F.lit(what).alias("outcome"), how_many.alias("n"))

    kept_lines = F.least("given", found)
    outcomes = (
        F.when(F.col("subscription").isNull(), F.array(counted("without an order", F.col("given"))))
        .when(F.col("subscription"), F.array(counted("of a subscription order", F.col("given"))))
        .otherwise(F.array(counted("order line", kept_lines), counted("missing", F.col("given") - kept_lines)))
    )
    line_fate = (
        given.join(kept, "key", "left")
        .join(staged, "key", "left")
        .select(F.lit("lineitem").alias("source_table"), F.inline(outcomes))
    )
    return (
        fate.unionByName(line_fate)
        .groupBy("source_table", "outcome")
        .agg(F.sum("n").alias("row_count"))
        .filter("row_count > 0")
    )


# -- fingerprints ----------------------------------------------------------------------------------------------
def _text(c: str) -> Column:
    """A value with its length in front; a null is the bare name. No two rows share a text."""
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.lit(f"{c}="), F.char_length(value).cast("string"), F.lit(":"), value), F.lit(c))


def _hash_sum(columns: Sequence[str]) -> Column:
    """Order-free combination of per-row hashes: the exact sum of 60-bit prefixes."""
    if not columns:
        return F.lit(None).cast("string")
    text = F.concat_ws("|", *[_text(c) for c in columns])
    value = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.sum(value).cast("decimal(38,0)").cast("string")


def table_fingerprint(wh: Warehouse) -> DataFrame:
    """Per table: columns, rows, key uniqueness and hashes of key, money, date and all columns.

    The hashes add up map-side, one row per task. The keys of all tables are counted in one shuffle of their own
    that only key columns enter.
    """
    keys = {name: unique_keys()[name] for name in STAGING}
    parts = []
    for name in STAGING:
        df = wh.stg(name)
        money = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
        dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        parts.append(df.agg(
            F.lit(name).alias("table_name"),
            F.lit(",".join(df.columns)).alias("columns"),
            F.count(F.lit(1)).alias("row_count"),
            _hash_sum(keys[name]).alias("key_hash"),
            _hash_sum(money).alias("money_hash"),
            _hash_sum(dates).alias("date_hash"),
            _hash_sum(df.columns).alias("content_hash"),
        ))
    repeated = _named(wh, constraint_violations(wh.stg, keys, ()), "table_name string", [(name,) for name in keys])
    return _union(parts).join(repeated.withColumn("key_is_unique", F.col("violations") == 0).drop("violations"), "table_name")


def fingerprint_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Which parts of each table's fingerprint differ between two table sets."""
    parts = ("columns", "row_count", "key_hash", "money_hash", "date_hash", "content_hash")
    renamed = right.select("table_name", *[F.col(p).alias(f"_{p}") for p in parts])
    return left.join(renamed, "table_name", "full_outer").select(
        "table_name", *[F.col(p).eqNullSafe(F.col(f"_{p}")).alias(f"same_{p}") for p in parts]
    )
