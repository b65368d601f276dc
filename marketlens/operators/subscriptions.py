"""Subscription metrics: activity, renewal and churn, retention, plan migration."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import between_days, count_when, day, literal_table, month_start, n, quarter_key, ratio, sum_when, usd
from marketlens.functions.spines import side_by_side
from marketlens.operators.customers import month_spine
from marketlens.operators.revenue import _months_back
from marketlens.plans.warehouse import Warehouse

DECIDED = ("renewed", "churned")
_churned = lambda: F.col("status") == "churned"


def active_at(at: str | Column) -> Column:
    """A term is active on a day it contains, both ends included."""
    d = day(at) if isinstance(at, str) else at
    return (F.col("term_start_date") <= d) & (F.col("term_end_date") >= d)


def _terms(wh: Warehouse) -> DataFrame:
    return wh.mart("fct_subscriptions")


def _decided(wh: Warehouse, start: str, end: str) -> DataFrame:
    return _terms(wh).filter(between_days("term_end_date", start, end) & F.col("status").isin(*DECIDED))


def _current_generation() -> Column:
    return F.col("plan_generation") == config.CURRENT_GENERATION


# -- active subscribers --------------------------------------------------------------------------
def active_subscribers(wh: Warehouse, at: str) -> DataFrame:
    sold = wh.stg("plans").filter("is_current").select("plan_id", F.lit(True).alias("sold"))
    on = active_at(at)
    people = (
        _terms(wh)
        .join(sold, "plan_id", "left")
        .groupBy("customer_id")
        .agg(
            F.max(on).alias("active"),
            F.max(F.col("status") == "active").alias("status_active"),
            F.max(on & F.col("sold").isNotNull()).alias("active_current"),
            F.sum(F.when(on, F.col("seats")).otherwise(0)).alias("seats"),
        )
    )
    return people.agg(
        count_when(F.col("active")).alias("value"),
        count_when(F.col("status_active")).alias("status_active"),
        count_when(F.col("active_current")).alias("current_generation_only"),
        n(F.coalesce(F.sum("seats"), F.lit(0))).alias("seats"),
    )


def active_subscribers_by_generation(wh: Warehouse, at: str) -> DataFrame:
    active = _terms(wh).filter(active_at(at))
    current = active.filter(_current_generation()).agg(F.countDistinct("customer_id").alias("c")).scalar()
    return (
        active.groupBy("plan_generation")
        .agg(
            F.countDistinct("customer_id").alias("active_subscribers"),
            usd(F.sum("acv")).alias("acv_under_contract"),
        )
        .withColumn("current_generation_only_total", current)
        .orderBy("plan_generation")
    )


def _snapshots(terms: DataFrame, unit: str, name: str) -> DataFrame:
    """Each term once per month or quarter end it contains; no spine join is needed."""
    trunc, months = {"month": ("MM", 1), "quarter": ("QUARTER", 3)}[unit]
    starts = F.sequence(
        F.trunc("term_start_date", trunc), F.trunc("term_end_date", trunc), F.expr(f"interval {months} months")
    )
    ends = F.transform(starts, lambda s: F.last_day(F.add_months(s, months - 1)))
    covered = F.filter(ends, lambda e: (e >= F.col("term_start_date")) & (e <= F.col("term_end_date")))
    return terms.withColumn(name, F.explode(covered))


def active_by_quarter_end_generation(wh: Warehouse, first: str, last: str) -> DataFrame:
    per_customer = (
        _snapshots(_terms(wh), "quarter", "snapshot_date")
        .filter(between_days("snapshot_date", first, last))
        .groupBy("snapshot_date", "plan_generation", "customer_id")
        .agg(F.sum("acv").alias("acv"))
    )
    return (
        per_customer.groupBy("snapshot_date", "plan_generation")
        .agg(F.count(F.lit(1)).alias("active_subscribers"), usd(F.sum("acv")).alias("acv_under_contract"))
        .orderBy("snapshot_date", "plan_generation")
    )


def subscriptions_by_plan(wh: Warehouse, at: str) -> DataFrame:
    return (
        _terms(wh)
        .filter(active_at(at))
        .groupBy("plan_generation", "plan_id")
        .agg(
            F.countDistinct("customer_id").alias("active_subscribers"),
            F.sum("seats").alias("seats"),
            usd(F.sum("acv")).alias("acv"),
        )
        .orderBy("plan_generation", "plan_id")
    )


def avg_price_per_seat_active(wh: Warehouse, at: str, plan_id: str) -> DataFrame:
    paid = (
        _terms(wh)
        .filter(active_at(at) & (F.col("plan_id") == plan_id))
        .agg(F.sum("acv").alias("acv"), F.sum("seats").alias("seats"))
    )
    listed = (
        wh.stg("plan_prices")
        .filter(F.col("plan_id") == plan_id)
        .agg(F.max_by("annual_price_per_seat", "effective_date").cast("double").alias("current_catalog_price"))
    )
    return side_by_side(paid, listed).select(ratio("acv", "seats", 2).alias("value"), "current_catalog_price")


# -- renewal and churn -----------------------------------------------------------------------------
def renewal_rate(wh: Warehouse, start: str, end: str) -> DataFrame:
    ended = between_days("term_end_date", start, end) & F.col("status").isin(*DECIDED)
    started = between_days("term_start_date", start, end)
    renewed = ended & (F.col("status") == "renewed")
    s = _terms(wh).agg(
        count_when(ended).alias("decided"),
        count_when(renewed).alias("renewed"),
        sum_when(ended, "acv").alias("acv"),
        sum_when(renewed, "acv").alias("renewed_acv"),
        count_when(started).alias("started"),
        count_when(started & ~F.col("is_first_term")).alias("renewals"),
    )
    return s.select(
        ratio("renewed", "decided").alias("value"),
        F.col("decided").alias("terms_decided"),
        (F.col("decided") - F.col("renewed")).alias("churned_terms"),
        ratio("renewed_acv", "acv").alias("acv_weighted"),
        ratio("renewals", "started").alias("renewal_share_of_terms_started"),
    )


def new_subscriptions(wh: Warehouse, start: str, end: str) -> DataFrame:
    first = F.col("is_first_term")
    return (
        _terms(wh)
        .filter(between_days("term_start_date", start, end))
        .agg(
            count_when(first).alias("value"),
            usd(sum_when(first, "acv")).alias("new_acv"),
            F.count(F.lit(1)).alias("all_terms_started"),
        )
    )


def churn_by_segment_quarter(wh: Warehouse, start: str, end: str) -> DataFrame:
    return (
        _decided(wh, start, end)
        .groupBy(quarter_key("term_end_date").alias("quarter"), "segment")
        .agg(
            F.count(F.lit(1)).alias("terms_up_for_renewal"),
            count_when(_churned()).alias("churned"),
            usd(sum_when(_churned(), "acv")).alias("acv_churned"),
        )
        .withColumn("churn_rate", ratio("churned", "terms_up_for_renewal"))
        .orderBy("quarter", "segment")
    )


def _earlier(d: date, months: int) -> date:
    """The same day some months earlier, clamped to the end of that month."""
    month_end = _months_back(d, months - 1) - timedelta(days=1)
    return month_end.replace(day=min(d.day, month_end.day))


def churned_acv_recovery(wh: Warehouse, segment: str, start: str, end: str, as_of: str) -> DataFrame:
    """Churned ACV of a segment and the first quarter end that earned it back, in one scan."""
    first = date.fromisoformat(start)
    before = str(first - timedelta(days=1))
    year_start, month_early = str(_earlier(first, 12)), str(_earlier(first, 1))
    ends, q = [], date.fromisoformat(end)
    q = _months_back(q, (q.month - 1) % 3)
    while (quarter_end := _months_back(q, -3) - timedelta(days=1)) <= date.fromisoformat(as_of):
        ends.append(str(quarter_end))
        q = _months_back(q, -3)

    mine, decided = F.col("segment") == segment, F.col("status").isin(*DECIDED)
    inside = between_days("term_end_date", start, end)
    prior = mine & decided & between_days("term_end_date", year_start, before)
    s = _terms(wh).agg(
        count_when(mine & inside & decided).alias("decided"),
        count_when(mine & inside & _churned()).alias("churned"),
        sum_when(mine & inside & decided, "acv").alias("decided_acv"),
        sum_when(mine & inside & _churned(), "acv").alias("churned_acv"),
        sum_when(mine & active_at(before), "acv").alias("acv_before"),
        sum_when(mine & active_at(end), "acv").alias("acv_end"),
        sum_when(inside & _churned(), "acv").alias("all_churned"),
        sum_when(prior, "acv").alias("prior_acv"),
        sum_when(prior & _churned(), "acv").alias("prior_churned"),
        sum_when(mine & _churned() & between_days("term_end_date", month_early, end), "acv").alias("early"),
        *[sum_when(mine & active_at(e), "acv").alias(f"at_{e}") for e in ends],
    )
    recovered = F.coalesce(
        *[F.when(F.col(f"at_{e}") >= F.col("acv_before"), day(e)) for e in ends], F.lit(None).cast("date")
    )
    rate = F.try_divide(F.col("prior_churned").cast("double"), F.col("prior_acv").cast("double"))
    return s.select(
        usd("churned_acv").alias("value"),
        F.col("churned").alias("churned_terms"),
        F.col("decided").alias("terms_decided"),
        usd("acv_before").alias("acv_active_before"),
        usd("acv_end").alias("acv_active_at_end"),
        recovered.alias("recovered_at"),
        F.round(rate, 4).alias("prior_year_acv_churn_rate"),
        usd("all_churned").alias("all_segments"),
        F.round(F.col("churned_acv").cast("double") - rate * F.col("decided_acv").cast("double"), 2).alias(
            "excess_over_prior_year_rate"
        ),
        usd("early").alias("window_one_month_early"),
    )


# -- first-renewal retention --------------------------------------------------------------------------
def _cohort(terms: DataFrame, start: str, end: str) -> DataFrame:
    return terms.filter(
        between_days("term_start_date", start, end) & F.col("renewed_from_subscription_id").isNull()
    )


def first_renewal_violations(wh: Warehouse, start: str, end: str, as_of: str) -> DataFrame:
    """Why a cohort cannot be measured yet: undue terms and terms renewed twice."""
    terms = _terms(wh)
    undue = (
        _cohort(terms, start, end)
        .filter(F.col("term_end_date") >= day(as_of))
        .select(F.lit("term not yet due").alias("reason"), "subscription_id")
    )
    twice = (
        terms.filter((F.col("term_start_date") <= day(as_of)) & F.col("renewed_from_subscription_id").isNotNull())
        .groupBy(F.col("renewed_from_subscription_id").alias("subscription_id"))
        .count()
        .filter("count > 1")
        .select(F.lit("term renewed more than once").alias("reason"), "subscription_id")
    )
    return undue.unionByName(twice)


def first_renewal_nrr(wh: Warehouse, start: str, end: str, as_of: str) -> DataFrame:
    """ACV of first renewals over the initial ACV of a starting cohort.

    The result raises when it is computed over an empty cohort or over terms that
    ``first_renewal_violations`` lists.
    """
    cutoff = day(as_of)
    terms = _terms(wh)
    visible = terms.filter(F.col("term_start_date") <= cutoff)
    cohort = _cohort(terms, start, end).select(
        F.col("subscription_id").alias("root_id"), "customer_id", F.col("acv").alias("initial")
    )
    renewals = visible.filter(F.col("renewed_from_subscription_id").isNotNull())
    first = renewals.groupBy(F.col("renewed_from_subscription_id").alias("root_id")).agg(F.sum("acv").alias("renewed"))
    people = (
        cohort.join(first, "root_id", "left")
        .groupBy("customer_id")
        .agg(
            F.sum("initial").alias("initial"),
            F.sum("renewed").alias("renewed"),
            F.sum(F.when(F.col("renewed").isNotNull(), F.col("initial"))).alias("renewers_initial"),
            F.max(F.col("renewed").isNotNull()).alias("did_renew"),
        )
    )
    sums = people.agg(
        F.sum("initial").alias("initial"),
        F.coalesce(F.sum("renewed"), F.lit(0)).alias("renewed"),
        F.sum("renewers_initial").alias("renewers_initial"),
        F.count(F.lit(1)).alias("customers"),
        count_when(F.col("did_renew")).alias("renewers"),
    )
    roots = wh.mart("term_roots")
    chain = (
        renewals.select("subscription_id", "acv")
        .join(roots, "subscription_id")
        .join(cohort.select("root_id"), "root_id", "left_semi")
        .agg(F.coalesce(F.sum("acv"), F.lit(0)).alias("chain"))
    )
    raw = wh.stg("subscriptions").filter(F.col("term_start_date") <= cutoff)
    raw_cohort = _cohort(raw, start, end)
    raw_first = raw.join(
        raw_cohort.select(F.col("subscription_id").alias("renewed_from_subscription_id")),
        "renewed_from_subscription_id",
        "left_semi",
    )
    raw_sums = side_by_side(
        raw_cohort.agg(F.sum("acv").alias("raw_initial")), raw_first.agg(F.sum("acv").alias("raw_renewed"))
    )
    broken = first_renewal_violations(wh, start, end, as_of).agg(F.count(F.lit(1)).alias("violations"))
    stop = F.raise_error(F.lit(f"cohort {start}..{end} is empty or cannot be measured at {as_of}")).cast("double")
    usable = (F.col("violations") == 0) & (F.col("customers") > 0)
    return side_by_side(sums, chain, raw_sums, broken).select(
        F.when(~usable, stop).otherwise(ratio("renewed", "initial")).alias("value"),
        usd("initial").alias("initial_acv"),
        usd("renewed").alias("first_renewal_acv"),
        F.col("customers").alias("cohort_customers"),
        F.col("renewers").alias("renewed_customers"),
        ratio("renewed", "renewers_initial").alias("renewers_only_denominator"),
        ratio("chain", "initial").alias("all_chain_renewals"),
        ratio("raw_renewed", "raw_initial").alias("including_test_and_internal"),
    )


# -- plan migration ---------------------------------------------------------------------------------------
def _migration(wh: Warehouse, mapping: Mapping[str, str]) -> DataFrame:
    return literal_table(wh.spark, "plan_id string, destination string", sorted(mapping.items()))


def _prices_at(wh: Warehouse, at: str) -> DataFrame:
    return (
        wh.stg("plan_prices")
        .filter(F.col("effective_date") <= day(at))
        .groupBy(F.col("plan_id").alias("destination"))
        .agg(F.max_by("annual_price_per_seat", "effective_date").alias("destination_price"))
    )


def legacy_migration_violations(wh: Warehouse, at: str, generation: int, mapping: Mapping[str, str]) -> DataFrame:
    """Everything that makes the migration scenario undefined, one row per finding."""
    active = _terms(wh).filter(active_at(at))
    legacy = active.filter(F.col("plan_generation") < generation)
    moves = _migration(wh, mapping)
    targets = moves.select("destination").distinct()
    plans = wh.stg("plans").select(F.col("plan_id").alias("destination"), "plan_generation")
    finding = lambda df, text, key: df.select(F.lit(text).alias("reason"), F.col(key).alias("item"))
    out = finding(active.filter("plan_generation is null"), "missing plan generation", "subscription_id")
    for df, text, key in (
        (legacy.select("plan_id").distinct().join(moves, "plan_id", "left_anti"), "missing migration mapping", "plan_id"),
        (targets.join(plans, "destination", "left_anti"), "unknown destination plan", "destination"),
        (
            targets.join(plans, "destination").filter(F.col("plan_generation") != generation),
            "destination outside the current generation",
            "destination",
        ),
        (targets.join(_prices_at(wh, at), "destination", "left_anti"), "no destination price", "destination"),
        (
            wh.stg("plan_prices")
            .groupBy("plan_id", "effective_date")
            .count()
            .filter("count > 1")
            .join(targets.withColumnRenamed("destination", "plan_id"), "plan_id", "left_semi"),
            "duplicate price date",
            "plan_id",
        ),
        (legacy.filter("seats is null or acv is null"), "missing seats or ACV", "subscription_id"),
    ):
        out = out.unionByName(finding(df, text, key))
    return out


def legacy_subscribers_migration(wh: Warehouse, at: str, generation: int, mapping: Mapping[str, str]) -> DataFrame:
    """Active legacy subscribers and what the same seats would cost on current plans.

    The result raises when it is computed over a scenario that ``legacy_migration_violations`` finds undefined.
    """
    broken = legacy_migration_violations(wh, at, generation, mapping).agg(F.count(F.lit(1))).scalar()
    stop = F.raise_error(F.lit(f"the migration scenario at {at} is undefined")).cast("bigint")
    active = _terms(wh).filter(active_at(at))
    legacy = F.col("plan_generation") < generation
    offers = _migration(wh, mapping).join(_prices_at(wh, at), "destination", "left")
    moved = F.col("seats").cast("decimal(10,0)") * F.col("destination_price")
    people = (
        active.join(offers, "plan_id", "left")
        .groupBy("customer_id")
        .agg(
            F.max(legacy).alias("is_legacy"),
            F.sum(F.when(legacy, F.col("seats"))).alias("seats"),
            F.sum(F.when(legacy, F.col("acv"))).alias("acv"),
            F.sum(F.when(legacy, moved)).alias("moved"),
        )
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = people.agg(
        F.count(F.lit(1)).alias("total"),
        count_when(F.col("is_legacy")).alias("legacy"),
        zero("seats").alias("seats"),
        zero("acv").alias("acv"),
        zero("moved").alias("moved"),
    )
    return s.select(
        F.when(broken > 0, stop).otherwise(F.col("legacy")).alias("value"),
        F.col("total").alias("total_active_subscribers"),
        ratio("legacy", "total").alias("legacy_subscriber_share"),
        n("seats").alias("legacy_seats"),
        usd("acv").alias("legacy_acv"),
        usd("moved").alias("illustrative_migrated_acv"),
        usd(F.col("moved") - F.col("acv")).alias("illustrative_annual_uplift"),
        ratio(F.col("moved") - F.col("acv"), "acv").alias("illustrative_uplift_ratio"),
        n("seats").alias("count_legacy_seats_as_subscribers"),
    )


def legacy_subscribers_by_generation(wh: Warehouse, at: str) -> DataFrame:
    return (
        _terms(wh)
        .filter(active_at(at))
        .groupBy("plan_generation")
        .agg(
            F.countDistinct("customer_id").alias("active_subscribers"),
            F.sum("seats").alias("seats"),
            usd(F.sum("acv")).alias("acv_under_contract"),
        )
        .orderBy("plan_generation")
    )


# -- dashboards ---------------------------------------------------------------------------------------------
def monthly_subscriptions(wh: Warehouse) -> DataFrame:
    """One row per month: the book at month end, starts, renewals and decided terms."""
    terms = _terms(wh)
    book = (
        _snapshots(terms, "month", "month_end")
        .groupBy(F.trunc("month_end", "MM").alias("month"), "customer_id")
        .agg(
            F.sum("acv").alias("acv"),
            *[F.max(F.col("plan_generation") == g).alias(f"gen{g}") for g in config.GENERATIONS],
        )
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("active_subscribers"),
            F.sum("acv").alias("acv_under_contract"),
            *[count_when(F.col(f"gen{g}")).alias(f"active_gen{g}") for g in config.GENERATIONS],
        )
    )
    first = F.col("is_first_term")
    starts = terms.groupBy(month_start("term_start_date").alias("month")).agg(
        count_when(first).alias("new_starts"),
        count_when(~first).alias("renewals"),
        F.sum(F.when(first, F.col("acv"))).alias("new_acv"),
        F.sum(F.when(first, F.col("seats"))).alias("new_seats"),
    )
    ended = (
        terms.filter(F.col("status").isin(*DECIDED))
        .groupBy(month_start("term_end_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("terms_ended"),
            count_when(_churned()).alias("churned_terms"),
            sum_when(_churned(), "acv").alias("acv_churned"),
            *[
                F.round(F.avg(F.when(F.col("segment") == s, _churned().cast("double"))), 4).alias(f"churn_rate_{s}")
                for s in config.SEGMENTS
            ],
        )
    )
    zero = lambda c: n(F.coalesce(c, F.lit(0)))
    dollars = lambda c: usd(F.coalesce(c, F.lit(0)))
    joined = month_spine(wh).join(book, "month", "left").join(starts, "month", "left").join(ended, "month", "left")
    return joined.select(
        "month",
        zero("active_subscribers").alias("active_subscribers"),
        dollars("acv_under_contract").alias("acv_under_contract"),
        zero("new_starts").alias("new_starts"),
        zero("renewals").alias("renewals"),
        zero("terms_ended").alias("terms_ended"),
        zero("churned_terms").alias("churned_terms"),
        dollars("acv_churned").alias("acv_churned"),
        F.coalesce(ratio("new_acv", "new_seats", 2), F.lit(0.0)).alias("acv_per_seat_new"),
        *[zero(f"active_gen{g}").alias(f"active_gen{g}") for g in config.GENERATIONS],
        *[F.col(f"churn_rate_{s}") for s in config.SEGMENTS],
    ).orderBy("month")


def subscription_kpis(wh: Warehouse, start: str, end: str) -> DataFrame:
    on = active_at(end)
    new = between_days("term_start_date", start, end) & F.col("is_first_term")
    ended = between_days("term_end_date", start, end) & F.col("status").isin(*DECIDED)
    people = (
        _terms(wh)
        .groupBy("customer_id")
        .agg(
            F.max(on).alias("active"),
            F.max(on & ~_current_generation()).alias("grandfathered"),
            F.sum(F.when(on, F.col("acv"))).alias("acv"),
            count_when(new).alias("new_terms"),
            F.sum(F.when(new, F.col("acv"))).alias("new_acv"),
            F.sum(F.when(new, F.col("seats"))).alias("new_seats"),
            count_when(ended).alias("decided"),
            count_when(ended & _churned()).alias("churned"),
            F.sum(F.when(ended & _churned(), F.col("acv"))).alias("churned_acv"),
        )
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = people.agg(
        count_when(F.col("active")).alias("active"),
        count_when(F.col("grandfathered")).alias("grandfathered"),
        *[total(c).alias(c) for c in ("acv", "new_terms", "new_acv", "new_seats", "decided", "churned", "churned_acv")],
    )
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        F.col("active").alias("active_subscribers"),
        usd("acv").alias("acv_under_contract"),
        F.col("new_terms").alias("new_subscriptions"),
        usd("new_acv").alias("new_acv"),
        or_zero(ratio(F.col("decided") - F.col("churned"), "decided")).alias("renewal_rate"),
        F.col("churned").alias("churned_terms"),
        usd("churned_acv").alias("acv_churned"),
        or_zero(ratio("new_acv", "new_seats", 2)).alias("acv_per_seat_new"),
        or_zero(ratio("grandfathered", "active")).alias("grandfathered_share"),
    )
