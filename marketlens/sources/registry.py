"""The ordered registry of the 19 raw tables: schema, key and arrival column."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RawTable:
    name: str
    key: tuple[str, ...]
    arrival: str
    ddl: str

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.ddl.split(",")]


_TS = "timestamp_ntz"

RAW_TABLES: dict[str, RawTable] = {
    t.name: t
    for t in (
        RawTable(
            "app_db__customers",
            ("app_db_customer_id",),
            "created_at",
            f"app_db_customer_id string, created_at {_TS}, segment string, account_type string, "
            "acquisition_channel string",
        ),
        RawTable(
            "app_db__products",
            ("sku",),
            "introduced_at",
            "sku string, product_name string, category string, supplier_id string, "
            f"unit_cost double, list_price double, introduced_at {_TS}",
        ),
        RawTable(
            "app_db__orders",
            ("order_id",),
            "order_date",
            f"order_id string, customer_id string, channel string, order_date {_TS}, "
            "gross_amount double, take_rate double, net_amount double, promo_code string, "
            "subscription_id string",
        ),
        RawTable(
            "app_db__order_lines",
            ("order_line_id",),
            "created_at",
            "order_line_id string, order_id string, sku string, quantity bigint, "
            f"unit_price double, discount_pct double, line_amount double, created_at {_TS}",
        ),
        RawTable(
            "app_db__plans",
            ("plan_id",),
            "launched_at",
            f"plan_id string, plan_name string, plan_generation bigint, tier string, "
            f"launched_at {_TS}, retired_at {_TS}, is_current boolean",
        ),
        RawTable(
            "app_db__plan_prices",
            ("plan_id", "effective_from"),
            "effective_from",
            f"plan_id string, effective_from {_TS}, annual_price_per_seat double",
        ),
        RawTable(
            "app_db__subscriptions",
            ("subscription_id",),
            "term_start",
            "subscription_id string, customer_id string, plan_id string, seats bigint, "
            f"term_start {_TS}, term_end {_TS}, price_per_seat double, acv double, "
            "order_id string, renewed_from_subscription_id string, status string, "
            f"cancelled_at {_TS}",
        ),
        RawTable(
            "app_db__invoices",
            ("invoice_id",),
            "billed_date",
            f"invoice_id string, order_id string, billed_date {_TS}, due_date {_TS}, "
            f"collected_date {_TS}, amount double, is_bad_debt boolean, "
            "salesforce_customer_id string",
        ),
        RawTable(
            "app_db__revenue_recognition",
            ("order_id", "recognition_date"),
            "recognition_date",
            f"order_id string, recognition_date {_TS}, amount double",
        ),
        RawTable(
            "app_db__promotions",
            ("promo_code",),
            "start_date",
            f"promo_code string, promo_name string, start_date {_TS}, end_date {_TS}, "
            "discount_pct double, eligible_channels string",
        ),
        RawTable(
            "stripe__refunds",
            ("refund_id",),
            "refund_date",
            f"refund_id string, order_id string, refund_date {_TS}, refund_amount double, "
            "stripe_customer_id string",
        ),
        RawTable(
            "erp__suppliers",
            ("supplier_id",),
            "onboarded_at",
            f"supplier_id string, supplier_name string, category string, onboarded_at {_TS}",
        ),
        RawTable(
            "erp__supplier_shipments",
            ("shipment_id",),
            "expected_date",
            f"shipment_id string, supplier_id string, category string, expected_date {_TS}, "
            f"received_date {_TS}, units_expected bigint, units_received bigint, status string",
        ),
        RawTable(
            "ads__daily_spend",
            ("spend_date", "platform"),
            "spend_date",
            f"spend_date {_TS}, platform string, spend_usd double, impressions bigint, "
            "clicks bigint, reported_conversions bigint",
        ),
        RawTable(
            "stripe__customers",
            ("stripe_customer_id",),
            "created_at",
            f"stripe_customer_id string, created_at {_TS}, is_active boolean, "
            f"deactivated_at {_TS}",
        ),
        RawTable(
            "shopify__customers",
            ("shopify_customer_id",),
            "created_at",
            f"shopify_customer_id string, created_at {_TS}, is_active boolean",
        ),
        RawTable(
            "salesforce__customers",
            ("salesforce_customer_id",),
            "created_at",
            f"salesforce_customer_id string, created_at {_TS}, is_active boolean",
        ),
        RawTable(
            "app_db__customer_id_crosswalk",
            ("source_system", "source_customer_id"),
            "linked_at",
            "source_system string, source_customer_id string, app_db_customer_id string, "
            f"linked_at {_TS}, link_method string",
        ),
        RawTable(
            "zendesk__tickets",
            ("ticket_id",),
            "created_at",
            "ticket_id string, requester_source_system string, requester_source_id string, "
            f"created_at {_TS}, category string, priority string, status string, "
            f"resolved_at {_TS}, related_order_id string, related_subscription_id string",
        ),
    )
}


def check_registry(names) -> None:
    """Raise when a table set is not exactly the registry, in its order."""
    if tuple(names) != tuple(RAW_TABLES):
        raise ValueError(f"expected tables {tuple(RAW_TABLES)}, got {tuple(names)}")
