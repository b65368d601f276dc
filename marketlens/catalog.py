"""Every query by name, with the parameters it is registered with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import between_days, day, literal_table, present
from marketlens.functions.text import url_path
from marketlens.operators import (
    customers,
    dashboards,
    derivations,
    diagnostics,
    hashtree,
    identity,
    increments,
    marketing,
    operations,
    quality,
    reconcile,
    revenue,
    subscriptions,
    temporal,
    textscan,
)
from marketlens.plans import marts
from marketlens.plans.staging import STAGING
from marketlens.plans.warehouse import Warehouse
from marketlens.sources import files
from marketlens.sources.store import scratch_folder
from marketlens.streaming import drip
from marketlens.streaming import revenue as revenue_stream

Query = Callable[[Warehouse], DataFrame]

Q1 = ("2000-01-01", "2000-03-31")
Y1999 = ("1999-01-01", "1999-12-31")
Y2000 = ("2000-01-01", "2000-12-31")
Q2 = ("2000-04-01", "2000-06-30")
LTM = ("2000-07-01", "2001-06-30")


def _revenue_tables(wh: Warehouse) -> DataFrame:
    money_of = {"orders": "gross_amount", "refunds": "refund_amount"}
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(money_of.get(name, "amount")).cast("double").alias("amount"),
        )
        for name, df in marts.revenue_tables(wh).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Tables of fixed values are no query of their own; the table-wide checks cover them.
FIXED = ("plans", "plan_prices", "promotions")


def _staging() -> dict[str, Query]:
    return {f"stg_{name}": (lambda wh, name=name: present(wh.stg(name))) for name in STAGING if name not in FIXED}


def _marts() -> dict[str, Query]:
    names = [m for m in marts.MARTS if m not in ("revenue_daily", "int_orders", "dim_plans", "customer_bitmaps")]
    return {
        **{name: (lambda wh, name=name: present(wh.mart(name))) for name in names},
        "observed_aliases": marts.observed_aliases,
        "eligible_order_ids": marts.eligible_order_ids,
        "real_customers": marts.real_customers,
        "revenue_tables": _revenue_tables,
        "in_window": lambda wh: wh.stg("orders").filter(between_days("order_date", *Q1)).select("order_id", "order_date"),
    }


def _revenue() -> dict[str, Query]:
    r = revenue
    step = ("1998-04-01", "1998-08-31")
    return {
        "five_revenues": lambda wh: r.five_revenues(wh, *Q1),
        "revenue_measure": lambda wh: r.revenue_measure(wh, "recognized_revenue", *Q1),
        "revenue_measure_hygiene": lambda wh: r.revenue_measure_hygiene(wh, *Y1999),
        "last_full_quarter_revenue": lambda wh: r.last_full_quarter_revenue(wh, "recognized_revenue", "2001-05-31"),
        "ytd_growth": lambda wh: r.ytd_growth(wh, "recognized_revenue", "2001-05-31"),
        "five_revenues_by_quarter": lambda wh: r.five_revenues_by_quarter(wh, "1998-01-01", "2001-06-30"),
        "orders_count": lambda wh: r.orders_count(wh, *Y2000),
        "marketplace_take": lambda wh: r.marketplace_take(wh, *Q2),
        "marketplace_gmv_take_rate": lambda wh: r.marketplace_gmv_take_rate(wh, *Q2),
        "marketplace_take_rate_by_month": lambda wh: r.marketplace_take_rate_by_month(wh, *Y2000),
        "d2c_gmv_by_year": lambda wh: r.d2c_gmv_by_year(wh, 1995, 2000),
        "d2c_orders_by_year": lambda wh: r.d2c_orders_by_year(wh, [1996, 1998, 2000]),
        "d2c_by_year_raw_vs_canonical": lambda wh: r.d2c_by_year_raw_vs_canonical(wh, "1995-01-01", "2000-12-31"),
        "orders_channel_step_change": lambda wh: r.orders_channel_step_change(wh, *step, "1998-05", "1998-06"),
        "orders_channel_label_ranges": lambda wh: r.orders_channel_label_ranges(wh, *step),
        "orders_channel_comparison": lambda wh: r.orders_channel_comparison(wh, *step, "1998-05", "1998-06"),
        "account_type_dollars": lambda wh: r.account_type_dollars(wh, *Q1),
        "recognized_by_channel": lambda wh: r.recognized_by_channel(wh, *Y2000),
        "recognized_by_channel_by_quarter": lambda wh: r.recognized_by_channel_by_quarter(wh, *Y2000, "2001-05-31"),
        "revenue_by_channel": lambda wh: r.revenue_by_channel(wh, *LTM),
        "refund_key_violations": r.refund_key_violations,
        "refund_rate_by_quarter": lambda wh: r.refund_rate_by_quarter(wh, "2001-05-31"),
        "net_revenue_order_keyed": lambda wh: r.net_revenue_order_keyed(wh, *Q1),
        "revenue_for_persona": lambda wh: r.revenue_for_persona(wh, *Q1),
        "metric_replay": r.metric_replay,
        "drift_check": r.drift_check,
    }


def _identity() -> dict[str, Query]:
    i, at = identity, config.SNAPSHOT
    return {
        "identity_measures": lambda wh: i.identity_measures(wh, at, *Y2000),
        "identity": lambda wh: i.identity(
            wh, "resolution_null_rate", at, *Y2000, ["unresolved_source_id_count"],
            ["inner_join_retained_source_id_count", "naive_distinct_source_id_count"],
        ),
        "identity_ordered_customers": lambda wh: i.identity(
            wh, "ordered_canonical_customer_count", at, *Y2000, [],
            ["ordered_customer_count_including_test_internal", "observed_source_id_count",
             "distinct_resolved_canonical_id_count"],
        ),
        "identity_premigration_missing": lambda wh: i.identity(
            wh, "pre_migration_shopify_missing_count", at, *Y2000,
            ["pre_migration_shopify_observed_count", "pre_migration_shopify_resolved_count"],
            ["unresolved_source_id_count"],
        ),
        "identity_multi_source_gmv": lambda wh: i.identity(
            wh, "correct_multi_source_gmv", at, *Y2000,
            ["correct_multi_source_order_count", "unsafe_fanout_order_row_count"],
            ["unsafe_fanout_gmv", "multi_source_gmv_including_test_internal"],
        ),
        "identity_safe_vs_fanout_gmv": lambda wh: i.identity_safe_vs_fanout_gmv(wh, *Y2000),
        "identity_quality": lambda wh: i.identity_quality(wh, at),
        "identity_quality_by_system": lambda wh: i.identity_quality_by_system(wh, at),
        "naive_vs_canonical": lambda wh: i.naive_vs_canonical(wh, at),
        "identity_health": i.identity_health,
        "identity_by_system": i.identity_by_system,
        "identity_null_rate_overall": i.identity_null_rate_overall,
        "canonical_customer_count": i.canonical_customer_count,
        "crosswalk_unmatched_by_signup_year": lambda wh: i.crosswalk_unmatched_by_signup_year(wh, at),
        "multi_stripe_id_customers": lambda wh: i.multi_stripe_id_customers(wh, at, *Y1999, *Y2000),
        "zendesk_tickets_unlinked": lambda wh: i.zendesk_tickets_unlinked(wh, at),
        "zendesk_tickets_unlinked_by_source": lambda wh: i.zendesk_tickets_unlinked_by_source(wh, at),
        "zendesk_tickets_unlinked_by_month": lambda wh: i.zendesk_tickets_unlinked_by_month(wh, at),
    }


def _customers() -> dict[str, Query]:
    c = customers
    half = ("2001-01-01", "2001-06-30")
    return {
        "current_customers": lambda wh: c.current_customers(wh, *LTM),
        "new_customers": lambda wh: c.new_customers(wh, *Y2000),
        "multi_channel_customers": lambda wh: c.multi_channel_customers(wh, "1998-01-01", "1998-12-31"),
        "current_sets": lambda wh: c.current_sets(wh, "2001-06-01"),
        "current_sets_any_window": lambda wh: c.current_sets_any_window(wh, c.trailing_windows(wh)),
        "monthly_customer_metrics": c.monthly_customer_metrics,
        "customer_kpis": lambda wh: c.customer_kpis(wh, *half),
        "customer_kpis_by_channel": lambda wh: c.customer_kpis_by_channel(wh, *half),
        "consumer_cohort_repeat_rate": lambda wh: c.consumer_cohort_repeat_rate(wh, "1998-01-01", "1999-12-31"),
    }


def _subscriptions() -> dict[str, Query]:
    s, at = subscriptions, "2000-12-31"
    # a scenario with gaps on purpose: two unmapped plans, one destination that is not sold
    partial = {"starter_v1": "essentials", "team_v2": "office_v2", "office_v2": "growth"}
    return {
        "active_subscribers": lambda wh: s.active_subscribers(wh, at),
        "active_subscribers_by_generation": lambda wh: s.active_subscribers_by_generation(wh, at),
        "active_by_quarter_end_generation": lambda wh: s.active_by_quarter_end_generation(wh, "1997-03-31", at),
        "subscriptions_by_plan": lambda wh: s.subscriptions_by_plan(wh, at),
        "avg_price_per_seat_active": lambda wh: s.avg_price_per_seat_active(wh, at, "growth"),
        "renewal_rate": lambda wh: s.renewal_rate(wh, *Y2000),
        "new_subscriptions": lambda wh: s.new_subscriptions(wh, *Y2000),
        "churn_by_segment_quarter": lambda wh: s.churn_by_segment_quarter(wh, "1998-01-01", "1999-12-31"),
        "churned_acv_recovery": lambda wh: s.churned_acv_recovery(wh, "smb", *Y1999, config.SNAPSHOT),
        "first_renewal_nrr": lambda wh: s.first_renewal_nrr(wh, "1998-01-01", "1998-12-31", config.SNAPSHOT),
        "first_renewal_violations": lambda wh: s.first_renewal_violations(wh, *Y2000, config.SNAPSHOT),
        "legacy_migration_violations": lambda wh: s.legacy_migration_violations(wh, at, 3, partial),
        "legacy_subscribers_migration": lambda wh: s.legacy_subscribers_migration(wh, at, 3, config.MIGRATION_MAP),
        "legacy_subscribers_by_generation": lambda wh: s.legacy_subscribers_by_generation(wh, at),
        "monthly_subscriptions": s.monthly_subscriptions,
        "subscription_kpis": lambda wh: s.subscription_kpis(wh, *LTM),
    }


def _marketing() -> dict[str, Query]:
    m, january = marketing, ("2000-01-01", "2000-01-31")
    promo = ("2000-07-01", "2000-11-30")
    return {
        "new_d2c_customers": lambda wh: m.new_d2c_customers(wh, *january),
        "d2c_cac": lambda wh: m.d2c_cac(wh, *january),
        "cac_reported_vs_attributed": lambda wh: m.cac_reported_vs_attributed(wh, *Y2000),
        "ad_spend_by_platform": lambda wh: m.ad_spend_by_platform(wh, *Y2000),
        "promo_usage": lambda wh: m.promo_usage(wh, "BTB15", "2000-09-01", "2000-09-30"),
        "promo_lift": lambda wh: m.promo_lift(wh, "BTB15", *promo),
        "campaigns": lambda wh: m.campaigns(wh, "1998-01-01", "2000-12-31"),
        "category_margin": lambda wh: m.category_margin(wh, *Y2000),
        "category_mix": lambda wh: m.category_mix(wh, "1999-03-10", "1999-03-20"),
        "category_gross_margin_by_year": lambda wh: m.category_gross_margin_by_year(wh, "1999-01-01", config.SNAPSHOT),
        "supplier_product_sales_distribution": lambda wh: m.supplier_product_sales_distribution(wh, *LTM),
        "gmv_of_orders_with_category": lambda wh: m.gmv_of_orders_with_category(wh, "paper", *Y2000),
        "monthly_marketing": m.monthly_marketing,
        "marketing_kpis": lambda wh: m.marketing_kpis(wh, "1999-07-01", "2000-06-30"),
    }


def _operations() -> dict[str, Query]:
    o = operations
    return {
        "open_tickets_at": lambda wh: o.open_tickets_at(wh, "2000-06-30"),
        "shipments_in_transit_at": lambda wh: o.shipments_in_transit_at(wh, "1999-03-31"),
        "tickets_by_category": lambda wh: o.tickets_by_category(wh, *Y2000),
        "tickets_vs_orders_monthly": lambda wh: o.tickets_vs_orders_monthly(wh, "1999-03", config.SNAPSHOT),
        "tickets_vs_orders_flags": lambda wh: o.tickets_vs_orders_flags(wh, "1999-03", config.SNAPSHOT),
        "billing_tickets_vs_enterprise_churn": lambda wh: o.billing_tickets_vs_enterprise_churn(
            wh, "1998-06-01", "1999-01-31"
        ),
    }


def _dashboards() -> dict[str, Query]:
    d, e = dashboards, diagnostics
    ad_keys = ["ad_spend_by_month", "new_d2c_customers_by_month", "new_customer_share_of_d2c_orders_by_month"]
    return {
        "data_end_month": d.data_end,
        "last_elapsed_month": d.elapsed,
        "period_bounds": d.period_bounds,
        "prior_bounds": d.prior_bounds,
        "business_kpis": lambda wh: d.business_kpis(wh, "2001-06"),
        "business_monthly": d.business_monthly,
        "business_monthly_by_period": d.business_monthly_by_period,
        "event_supplier_outage": e.EVENTS["supplier_outage"],
        "event_promo": e.EVENTS["promo_back_to_business"],
        "event_price_increase": e.EVENTS["sub_price_increase"],
        "event_enterprise_churn": e.EVENTS["enterprise_churn"],
        "event_ad_spend_cut": e.EVENTS["ad_spend_cut"],
        "event_category_margin": e.EVENTS["category_margin"],
        "event_evidence": lambda wh: e.event_evidence(wh, "ad_spend_cut", ad_keys),
        "event_detectability": e.event_detectability,
    }


def _month_ends() -> Column:
    return F.transform(F.sequence(day("1995-01-01"), day("2001-12-01"), F.expr("interval 1 month")), F.last_day)


STEPS = ("1999-06-30", "1999-09-30", "1999-10-01", "2000-12-31")


def _temporal() -> dict[str, Query]:
    t, d, at = temporal, derivations, "1999-06-30"
    masked = {
        "mask_invoices": "invoices", "mask_stripe": "stripe_customers", "mask_subscriptions": "subscriptions",
        "mask_shipments": "supplier_shipments", "mask_tickets": "tickets",
    }
    return {
        "visible_as_of": lambda wh: t.visible_as_of(wh, at),
        **{q: (lambda wh, name=name: present(wh.as_of(at).stg(name))) for q, name in masked.items()},
        "visible_as_of_series": lambda wh: increments.visible_as_of_series(wh, _month_ends()),
        "price_as_of": t.price_as_of,
        "alias_as_of": t.alias_as_of,
        "plan_generation_at": t.plan_generation_at,
        "promo_match": t.promo_match,
        "skus_available_at": lambda wh: t.skus_available_at(wh, "1995-01", "1995-12"),
        "snapshot_stability": lambda wh: t.snapshot_stability(
            wh, lambda w: subscriptions.churn_by_segment_quarter(w, *Y1999), ["quarter", "segment"], at
        ),
        "snapshot_parity": lambda wh: t.snapshot_parity(wh, "1997-01-01", at),
        "order_rollup_from_lines": d.order_rollup_from_lines,
        "line_amount": d.line_amount,
        "ratable_recognition": d.ratable_recognition,
        "invoice_schedule": d.invoice_schedule,
        "term_chain": d.term_chain,
        "term_bounds_acv": d.term_bounds_acv,
        "customer_profile_from_orders": d.customer_profile_from_orders,
        "source_first_seen": d.source_first_seen,
        "crosswalk_link_rules": d.crosswalk_link_rules,
        "ticket_requester_resolution": d.ticket_requester_resolution,
        "chronological_ids": d.chronological_ids,
    }


def _written_raw(wh: Warehouse) -> dict[str, DataFrame]:
    """The raw tables of a warehouse, written once and scanned back."""
    if wh.raw_folder is None:
        folder = scratch_folder(wh.spark, "raw")
        files.write_raw_tables(wh, folder)
        wh.raw_folder = folder
    return files.scan_raw_tables(wh.spark, wh.raw_folder)


def _raw_counts(wh: Warehouse) -> DataFrame:
    staged = {raw: name for name, (raw, _) in STAGING.items()}
    return files.table_counts({staged[raw]: df for raw, df in _written_raw(wh).items()})


def _scanned_orders(wh: Warehouse) -> DataFrame:
    return (
        _written_raw(wh)["app_db__orders"]
        .groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("gross_amount").cast("decimal(18,2)")).cast("double").alias("gross_amount"),
        )
    )


def _snapshot_counts(wh: Warehouse) -> DataFrame:
    folder, at = scratch_folder(wh.spark, "snapshots"), "1999-06-30"
    for as_of in ("1998-06-30", at):  # the second load leaves the first one in place
        files.snapshot_overwrite(wh, folder, as_of)
    return files.table_counts({n: files.read_snapshot(wh, folder, n, at) for n in STAGING})


def _layer_sql(wh: Warehouse) -> DataFrame:
    files.materialize_layer(wh)
    return wh.spark.sql(
        "SELECT channel, segment, count(*) AS orders, cast(sum(gross_amount) AS double) AS gmv "
        "FROM fct_orders GROUP BY channel, segment"
    )


def _stream(wh: Warehouse) -> DataFrame:
    """Two loads of the change log, each picked up by the same stream checkpoint."""
    folder, table = scratch_folder(wh.spark, "drip"), "invoices"
    paths = (f"{folder}/log", f"{folder}/table", f"{folder}/checkpoint")
    for after, upto in ((None, "1999-06-30"), ("1999-06-30", "2000-12-31")):
        drip.append_change_files(wh, table, paths[0], after, upto)
        out = drip.run_drip(wh, table, *paths)
    return present(out)


def _revenue_stream(wh: Warehouse) -> DataFrame:
    """Three loads of revenue events, late and repeated ones among them, through one stream checkpoint."""
    folder, s = scratch_folder(wh.spark, "revenue-stream"), revenue_stream
    log, target, checkpoint = f"{folder}/log", f"{folder}/slices", f"{folder}/checkpoint"
    days = ("1999-06-30", "1999-09-30", "2000-12-31")
    for load in s.loads(s.stored_events(wh, days[-1]), *days):
        s.take_in(load, log, target, checkpoint)
    return present(s.fold(wh.spark, target, f"{folder}/folded").drop("batch"))


def _files() -> dict[str, Query]:
    increment = ("1999-12-31", "2000-12-31")
    return {
        "write_raw_tables": _raw_counts,
        "scan_raw_tables": _scanned_orders,
        "snapshot_overwrite": _snapshot_counts,
        "materialize_layer": _layer_sql,
        "export_mart": lambda wh: present(
            files.export_mart(wh, "fct_subscriptions", scratch_folder(wh.spark, "export"))
        ),
        "mart_increment": lambda wh: present(increments.mart_increment(wh, *STEPS)),
        "mart_increment_customers": lambda wh: present(increments.mart_increment_customers(wh, *STEPS)),
        "drip_feed_increment": lambda wh: present(drip.drip_feed_increment(wh, "subscriptions", *increment)),
        "drip_feed_parity": lambda wh: drip.increment_parity(wh, *increment),
        "drip_feed_tickets": lambda wh: present(drip.drip_feed_increment(wh, "tickets", *increment)),
        "drip_feed_stream": _stream,
        "revenue_stream": _revenue_stream,
    }


def _traps(wh: Warehouse) -> DataFrame:
    """The wrong paths of ten metrics and whether each differs from the right value."""
    c, ratio = reconcile.trap_rows, config.RATIO_TOLERANCE
    get = catalog()
    parts = [
        c(name, get[name](wh), wrong, tolerance)
        for name, wrong, tolerance in (
            ("revenue_measure", [f"wrong_{m}" for m in config.MEASURES if m != "recognized_revenue"], config.USD_TOLERANCE),
            ("orders_count", ["staging_including_test_and_internal"], 0),
            ("current_customers", CURRENT_WRONG, 0),
            ("new_customers", ["profiles_created", "first_order_per_channel"], 0),
            ("multi_channel_customers", ["raw_channel_labels"], 0),
            ("active_subscribers", ["status_active", "current_generation_only", "seats"], 0),
            ("renewal_rate", ["acv_weighted", "renewal_share_of_terms_started"], ratio),
            ("new_subscriptions", ["all_terms_started"], 0),
            ("gmv_of_orders_with_category", ["summed_per_matching_line", "category_line_amount_only"], config.USD_TOLERANCE),
            ("open_tickets_at", ["status_open_at_snapshot", "created_in_month"], 0),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CURRENT_WRONG = ["including_test_and_internal", "sum_of_channel_counts", "all_profiles_created"]


def _quality() -> dict[str, Query]:
    q, at = quality, config.SNAPSHOT
    return {
        "dq_unique": q.dq_unique,
        "dq_not_null": q.dq_not_null,
        "dq_accepted_values": q.dq_accepted_values,
        "dq_relationships": q.dq_relationships,
        "dq_constraints": q.dq_constraints,
        **{test: (lambda wh, test=test: q.summary(wh, test)) for test in q.SINGULAR},
        "dq_revenue_exclusion": lambda wh: q.dq_revenue_exclusion(wh, *Q1),
        "dq_join_preserves_metrics": lambda wh: q.dq_join_preserves_metrics(wh, *Q1),
        "dq_no_future_rows": lambda wh: q.dq_no_future_rows(wh, "1999-06-30"),
        "dq_identity_contract": q.dq_identity_contract,
        "mapping_row_conservation": lambda wh: q.row_conservation(wh, wh.source.read("orders"), wh.source.read("lineitem")),
        "table_fingerprint": q.table_fingerprint,
        "fingerprint_diff": lambda wh: q.fingerprint_diff(q.table_fingerprint(wh), q.table_fingerprint(wh.as_of(at))),
        "fingerprint_locate": lambda wh: hashtree.fingerprint_locate(wh, wh.as_of("2001-03-31")),
        "metric_reconcile": lambda wh: reconcile.reconcile(
            revenue.five_revenues_by_quarter(wh, "1998-01-01", at).drop("recognized_minus_gmv"),
            revenue.five_revenues_from_tables(wh, "1998-01-01", at),
            ["quarter"],
        ),
        "trap_bites": _traps,
        "accepted_alternative_check": lambda wh: reconcile.accepted_alternative(
            "current_customers", customers.current_customers(wh, *LTM), "window_ending_prior_month", CURRENT_WRONG
        ),
    }


def _gold(wh: Warehouse) -> DataFrame:
    """Distinctive numbers of four metric results."""
    get = catalog()
    results = ("five_revenues_by_quarter", "category_gross_margin_by_year", "monthly_marketing", "monthly_subscriptions")
    return textscan.gold_numbers([get[name](wh).drop("year") for name in results])


def _path_rules(wh: Warehouse) -> DataFrame:
    """The forbidden patterns, then one for every beginning that paths of the pages have."""
    listed = literal_table(wh.spark, "priority int, pattern string", list(enumerate((*config.FORBIDDEN_PATHS, "*.html"))))
    path = url_path(F.col("url"))
    begins = wh.source.read("pages").select(F.lit(100).alias("priority"), F.concat(F.substring(path, 1, 5), F.lit("*")).alias("pattern"))
    return listed.unionByName(begins.filter(F.char_length("pattern") == 6).distinct())


def _text() -> dict[str, Query]:
    t = textscan
    rules = (*config.FORBIDDEN_PATHS, "*.html", "fr/*")
    return {
        "gold_number_collect": _gold,
        "gold_number_text_collect": lambda wh: t.gold_numbers_in_text(wh.source.read("benchmark")),
        "conversation_number_leaks": lambda wh: t.leak_findings(
            wh.source.read("conversations"), "conv_id", "text",
            _gold(wh).unionByName(t.gold_numbers_in_text(wh.source.read("benchmark"))).distinct(),
        ),
        "gold_number_leak_scan": lambda wh: t.scan_numbers(wh.source.read("documents"), "doc_id", "text", _gold(wh)),
        "path_pattern_scan": lambda wh: t.path_pattern_scan(wh.source.read("pages"), rules),
        "path_rule_scan": lambda wh: t.path_rule_scan(wh.source.read("pages"), _path_rules(wh)),
        "word_overlap_topk": lambda wh: t.word_overlap_topk(wh.source.read("documents"), wh.source.read("benchmark")),
    }


def catalog() -> dict[str, Query]:
    groups = (
        _staging, _marts, _revenue, _identity, _customers, _subscriptions, _marketing, _operations, _dashboards,
        _temporal, _files, _quality, _text,
    )
    return {name: query for group in groups for name, query in group().items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(Warehouse.open(spark, folder))

    return {name: bind(query) for name, query in catalog().items()}
