"""Identity resolution metrics at alias, customer and order grain.

The deliberately wrong "fan-out" figures repeat every order once per alias of its
customer. They are computed from the number of aliases per customer, which gives the same
totals without ever producing the repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import between_days, count_when, day, labelled, month_key, n, ratio, sum_when, usd
from marketlens.functions.spines import side_by_side, unpivot_row
from marketlens.operators.revenue import orders_with_account
from marketlens.plans.marts import eligible_orders, real_customers
from marketlens.plans.warehouse import Warehouse


def _resolved() -> Column:
    return F.col("app_db_customer_id").isNotNull()


def _pre_migration(system: str) -> Column:
    return (F.col("source_system") == system) & (F.col("source_created_date") < day(config.IDENTITY_MIGRATION))


def alias_rollup(wh: Warehouse) -> DataFrame:
    """Per canonical customer: number of resolved aliases and of distinct systems.

    System presence is a maximum per system, so the rollup combines map-side and needs a
    single shuffle instead of a distinct count.
    """
    flags = [
        F.max((F.col("source_system") == system).cast("long")).alias(f"in_{system}")
        for system, _, _ in config.SOURCE_SYSTEMS
    ]
    names = [F.col(f"in_{system}") for system, _, _ in config.SOURCE_SYSTEMS]
    return (
        wh.mart("int_customer_identity")
        .filter(_resolved())
        .groupBy(F.col("app_db_customer_id").alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("aliases"), *flags)
        .select("customer_id", "aliases", sum(names[1:], names[0]).alias("systems"))
    )


def identity_measures(wh: Warehouse, as_of: str, start: str, end: str) -> DataFrame:
    """All identity measures of a snapshot in one row; no observed alias is an error."""
    snap = wh.as_of(as_of)
    pre = _pre_migration("shopify")
    alias_counts = snap.mart("int_customer_identity").agg(
        F.count(F.lit(1)).alias("observed"),
        F.countDistinct("source_customer_id").alias("naive"),
        count_when(_resolved()).alias("resolved"),
        count_when(pre).alias("pre_observed"),
        count_when(pre & _resolved()).alias("pre_resolved"),
    )
    rollup = alias_rollup(snap)
    real = real_customers(snap).select(F.col("app_db_customer_id").alias("customer_id"), F.lit(True).alias("real"))
    rollup = rollup.join(real, "customer_id", "left").withColumn("real", F.coalesce("real", F.lit(False)))
    multi = F.col("systems") >= 2
    placed = (
        orders_with_account(snap)
        .groupBy("customer_id", "is_real")
        .agg(
            count_when(between_days("order_date", start, end)).alias("orders"),
            sum_when(between_days("order_date", start, end), "gross_amount").alias("gross"),
        )
    )
    # One full outer join of two per-customer tables serves every customer and order figure.
    good = multi & F.col("real")
    people = rollup.join(placed, "customer_id", "full_outer").agg(
        F.count("aliases").alias("canonical"),
        count_when(good).alias("multi_source"),
        count_when(F.col("is_real")).alias("ordered"),
        F.count("is_real").alias("ordered_all"),
        F.sum(F.when(good, F.col("orders"))).alias("safe_orders"),
        sum_when(good, "gross").alias("safe_gmv"),
        F.sum(F.when(good, F.col("orders") * F.col("aliases"))).alias("fan_rows"),
        F.sum(F.when(good, F.col("gross") * F.col("aliases").cast("decimal(10,0)"))).alias("fan_gmv"),
        F.sum(F.when(multi, F.col("gross"))).alias("all_gmv"),
    )
    zero = lambda c: n(F.coalesce(c, F.lit(0)))
    observed = F.when(
        F.col("observed") == 0, F.raise_error(F.lit("no observed source ids at the snapshot")).cast("long")
    ).otherwise(F.col("observed"))
    return side_by_side(alias_counts, people).select(
        observed.alias("observed_source_id_count"),
        F.col("naive").alias("naive_distinct_source_id_count"),
        F.col("resolved").alias("inner_join_retained_source_id_count"),
        F.col("resolved").alias("resolved_source_id_count"),
        (F.col("observed") - F.col("resolved")).alias("unresolved_source_id_count"),
        ratio(F.col("observed") - F.col("resolved"), "observed", 6).alias("resolution_null_rate"),
        F.col("canonical").alias("distinct_resolved_canonical_id_count"),
        F.col("ordered").alias("ordered_canonical_customer_count"),
        F.col("pre_observed").alias("pre_migration_shopify_observed_count"),
        F.col("pre_resolved").alias("pre_migration_shopify_resolved_count"),
        (F.col("pre_observed") - F.col("pre_resolved")).alias("pre_migration_shopify_missing_count"),
        F.col("multi_source").alias("multi_source_canonical_customer_count"),
        zero("safe_orders").alias("correct_multi_source_order_count"),
        usd("safe_gmv").alias("correct_multi_source_gmv"),
        zero("fan_rows").alias("unsafe_fanout_order_row_count"),
        usd(F.coalesce("fan_gmv", F.lit(0))).alias("unsafe_fanout_gmv"),
        F.col("ordered_all").alias("ordered_customer_count_including_test_internal"),
        usd(F.coalesce("all_gmv", F.lit(0))).alias("multi_source_gmv_including_test_internal"),
    )


def identity(
    wh: Warehouse, measure: str, as_of: str, start: str, end: str, components: list[str], wrong: list[str]
) -> DataFrame:
    """One identity measure with its components and the figures mistaken for it."""
    m = identity_measures(wh, as_of, start, end)
    return m.select(
        F.col(measure).alias("value"), *components, *[F.col(w).alias(f"wrong_{w}") for w in wrong]
    )


def identity_safe_vs_fanout_gmv(wh: Warehouse, start: str, end: str) -> DataFrame:
    per_customer = (
        wh.mart("fct_orders")
        .filter(between_days("order_date", start, end))
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross"))
    )
    both = per_customer.join(alias_rollup(wh).filter(F.col("systems") >= 2), "customer_id").agg(
        F.sum("orders").alias("safe_rows"),
        usd(F.sum("gross")).alias("safe_gmv"),
        F.sum(F.col("orders") * F.col("aliases")).alias("fan_rows"),
        usd(F.sum(F.col("gross") * F.col("aliases").cast("decimal(10,0)"))).alias("fan_gmv"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(text).alias("path"), F.col(f"{p}_rows").alias("order_rows"), F.col(f"{p}_gmv").alias("gmv"))
            for p, text in (
                ("safe", "safe (deduplicated customer set)"),
                ("fan", "fanout (orders x alias bridge)"),
            )
        ]
    )
    return both.select(F.inline(rows))


# -- quality of a snapshot ---------------------------------------------------------------------------
def identity_quality(wh: Warehouse, as_of: str) -> DataFrame:
    snap = wh.as_of(as_of)
    missing = F.col("resolution_status") == "unresolved_migration_gap"
    aliases = snap.mart("int_customer_identity").agg(
        F.count(F.lit(1)).alias("alias_count"),
        count_when(~_resolved()).alias("unresolved_count"),
        *[
            count_when(missing & (F.col("source_system") == s)).alias(f"pre_migration_{s}_missing")
            for s in ("shopify", "salesforce")
        ],
    )
    profiles = snap.stg("app_customers").agg(F.count(F.lit(1)).alias("canonical_profiles"))
    ordered = eligible_orders(snap).select("customer_id").distinct()
    ids = ordered.join(alias_rollup(snap), "customer_id", "left").agg(
        F.count(F.lit(1)).alias("ordered_customers"),
        F.round(F.avg("aliases"), 3).alias("avg_source_ids_per_ordered_customer"),
    )
    return side_by_side(aliases, profiles, ids).select(
        "alias_count",
        "unresolved_count",
        F.coalesce(ratio("unresolved_count", "alias_count", 6), F.lit(0.0)).alias("null_rate"),
        "canonical_profiles",
        "ordered_customers",
        "avg_source_ids_per_ordered_customer",
        "pre_migration_shopify_missing",
        "pre_migration_salesforce_missing",
    )


def identity_quality_by_system(wh: Warehouse, as_of: str) -> DataFrame:
    return (
        wh.as_of(as_of)
        .mart("int_customer_identity")
        .groupBy("source_system")
        .pivot("resolution_status", list(config.STATUS_LABELS))
        .count()
        .na.fill(0)
        .orderBy("source_system")
    )


def naive_vs_canonical(wh: Warehouse, as_of: str) -> DataFrame:
    labels = {
        "alias_count": "Σ per-system profiles (naive)",
        "canonical_profiles": "Canonical app profiles",
        "ordered_customers": "Ever-ordered customers",
    }
    return unpivot_row(identity_quality(wh, as_of), labels, "label", "customers")


def identity_health(wh: Warehouse) -> DataFrame:
    """Identity health of the current load (customers of every account type)."""
    aliases = wh.mart("int_customer_identity").agg(
        F.count(F.lit(1)).alias("source_aliases"),
        count_when(~_resolved()).alias("unresolved_aliases"),
        *[
            count_when(_pre_migration(s) & ~_resolved()).alias(f"pre_migration_{s}_unlinked")
            for s in ("shopify", "salesforce")
        ],
    )
    known = F.col("has_order") & (F.col("resolved_source_id_count") > 0)
    customers = wh.mart("dim_customers").agg(
        F.count(F.lit(1)).alias("canonical_profiles"),
        count_when(F.col("has_order")).alias("ordered_customers"),
        F.avg(F.when(known, F.col("resolved_source_id_count"))).alias("avg_ids_per_ordered_customer"),
    )
    return side_by_side(aliases, customers).withColumn(
        "resolution_null_rate", F.try_divide("unresolved_aliases", "source_aliases")
    )


def identity_by_system(wh: Warehouse) -> DataFrame:
    return (
        wh.mart("int_customer_identity")
        .groupBy("source_system", "resolution_status")
        .agg(F.count(F.lit(1)).alias("aliases"))
        .withColumn("status_label", labelled("resolution_status", config.STATUS_LABELS))
        .orderBy("source_system", "resolution_status")
    )


def identity_null_rate_overall(wh: Warehouse) -> DataFrame:
    q = wh.mart("fct_identity_resolution_quality").agg(
        F.sum("observed_id_count").alias("observed_source_ids"),
        F.sum("resolved_id_count").alias("resolved_source_ids"),
        F.sum("unresolved_id_count").alias("unresolved_source_ids"),
    )
    return q.withColumn("resolution_null_rate", F.try_divide("unresolved_source_ids", "observed_source_ids"))


def canonical_customer_count(wh: Warehouse) -> DataFrame:
    real = F.col("has_order") & (F.col("account_type") == "customer")
    return wh.mart("dim_customers").agg(count_when(real).alias("ordered_canonical_customers"))


# -- unmatched and duplicated ids ------------------------------------------------------------------------
def crosswalk_unmatched_by_signup_year(wh: Warehouse, as_of: str) -> DataFrame:
    snap = wh.as_of(as_of)
    buyers = snap.stg("orders").select("customer_id").distinct()
    profiles = snap.stg("app_customers").select(
        F.col("app_db_customer_id").alias("customer_id"),
        F.year("created_date").cast("long").alias("signup_year"),
        (F.col("account_type") == "customer").alias("is_real"),
    )
    linked = (
        snap.stg("customer_id_crosswalk")
        .select(F.col("app_db_customer_id").alias("customer_id"), F.lit(True).alias("linked"))
        .distinct()
    )
    real, missed = F.coalesce("is_real", F.lit(False)), F.col("linked").isNull()
    counts = (
        buyers.join(profiles, "customer_id", "left")
        .join(linked, "customer_id", "left")
        .groupBy("signup_year")
        .agg(
            F.count(F.lit(1)).alias("order_customers"),
            count_when(missed).alias("unmatched_customers"),
            count_when(real).alias("real_order_customers"),
            count_when(real & missed).alias("real_unmatched_customers"),
        )
    )
    return counts.withColumns(
        {
            "unmatched_rate": F.try_divide("unmatched_customers", "order_customers"),
            "real_unmatched_rate": F.try_divide("real_unmatched_customers", "real_order_customers"),
        }
    ).orderBy(F.asc_nulls_first("signup_year"))


def multi_stripe_id_customers(
    wh: Warehouse, as_of: str, cohort_start: str, cohort_end: str, start: str, end: str
) -> DataFrame:
    """Customers with several Stripe ids, and retention with and without counting them twice."""
    if cohort_end >= start or end > as_of:
        raise ValueError("the cohort window must precede the retention window, which ends by as_of")
    snap = wh.as_of(as_of)
    links = (
        snap.stg("customer_id_crosswalk")
        .filter(F.col("source_system") == "stripe")
        .select(F.col("source_customer_id").alias("stripe_customer_id"), F.col("app_db_customer_id").alias("customer_id"))
    )
    aliases = snap.stg("stripe_customers").join(links, "stripe_customer_id", "left")
    alias_row = aliases.agg(
        count_when(F.col("customer_id").isNull()).alias("unresolved_stripe_ids"),
        count_when(~F.col("is_active")).alias("deactivated_stripe_ids"),
    )
    per_customer = (
        aliases.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("ids"), count_when(F.col("is_active")).alias("active_ids"))
    )
    real = real_customers(snap).select(F.col("app_db_customer_id").alias("customer_id"), F.lit(True).alias("real"))
    per_customer = per_customer.join(real, "customer_id", "left")
    several = F.col("ids") > 1
    multi_row = per_customer.agg(
        count_when(several & F.col("real")).alias("value"), count_when(several).alias("including_test_and_internal")
    )
    cohort = (
        wh.mart("fct_orders")
        .groupBy("customer_id")
        .agg(
            F.max(between_days("order_date", cohort_start, cohort_end)).alias("in_cohort"),
            F.max(between_days("order_date", start, end)).alias("retained"),
        )
        .filter("in_cohort")
        .join(per_customer, "customer_id", "left")
    )
    kept = F.col("retained")
    cohort_row = cohort.agg(
        count_when(several & F.col("real")).alias("multi_in_retention_cohort"),
        F.count(F.lit(1)).alias("cohort_customers"),
        count_when(kept).alias("retained_customers"),
        F.sum("ids").alias("bridge_rows"),
        F.sum(F.when(kept, F.col("ids")).otherwise(0)).alias("bridge_kept"),
        F.sum(F.when(kept, F.col("active_ids")).otherwise(0)).alias("bridge_active"),
    )
    return side_by_side(multi_row, cohort_row, alias_row).select(
        "value",
        "multi_in_retention_cohort",
        "cohort_customers",
        "retained_customers",
        ratio("retained_customers", "cohort_customers").alias("canonical_retention"),
        "unresolved_stripe_ids",
        "including_test_and_internal",
        "deactivated_stripe_ids",
        ratio("bridge_kept", "bridge_rows").alias("alias_bridge_retention"),
        ratio("bridge_active", "bridge_rows").alias("alias_is_active_retention"),
    )


# -- support tickets ----------------------------------------------------------------------------------------
def unlinked_tickets(wh: Warehouse, as_of: str) -> DataFrame:
    """Tickets whose requester does not resolve, flagged by indirect linkage."""
    snap = wh.as_of(as_of)
    known = snap.stg("app_customers").select("app_db_customer_id")
    resolved = (
        snap.mart("int_customer_identity")
        .filter(_resolved())
        .join(known, "app_db_customer_id", "left_semi")
        .select(
            F.col("source_system").alias("requester_source_system"),
            F.col("source_customer_id").alias("requester_source_id"),
        )
    )
    owner = known.withColumnRenamed("app_db_customer_id", "customer_id")

    def owned(table: str, key: str) -> DataFrame:
        return (
            snap.stg(table)
            .join(owner, "customer_id", "left_semi")
            .select(F.col(key).alias(f"related_{key}"), F.lit(True).alias(f"via_{key}"))
        )

    return (
        snap.stg("tickets")
        .join(resolved, ["requester_source_system", "requester_source_id"], "left_anti")
        .join(owned("orders", "order_id"), "related_order_id", "left")
        .join(owned("subscriptions", "subscription_id"), "related_subscription_id", "left")
        .withColumn("via_order", F.coalesce("via_order_id", F.lit(False)))
        .withColumn("via_subscription", F.coalesce("via_subscription_id", F.lit(False)))
    )


def zendesk_tickets_unlinked(wh: Warehouse, as_of: str) -> DataFrame:
    return unlinked_tickets(wh, as_of).agg(
        F.count(F.lit(1)).alias("value"),
        F.min("created_date").alias("first_created_date"),
        F.max("created_date").alias("last_created_date"),
        count_when(F.col("via_order")).alias("linked_via_order"),
        count_when(F.col("via_subscription")).alias("linked_via_subscription"),
        count_when(~(F.col("via_order") | F.col("via_subscription"))).alias("completely_untraceable_tickets"),
    )


def zendesk_tickets_unlinked_by_source(wh: Warehouse, as_of: str) -> DataFrame:
    return (
        unlinked_tickets(wh, as_of)
        .groupBy(F.col("requester_source_system").alias("source_system"))
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.min("created_date").alias("first_created_date"),
            F.max("created_date").alias("last_created_date"),
        )
    )


def zendesk_tickets_unlinked_by_month(wh: Warehouse, as_of: str) -> DataFrame:
    return (
        unlinked_tickets(wh, as_of)
        .groupBy(month_key("created_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("tickets"))
        .orderBy("month")
    )
