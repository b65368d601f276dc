"""Staging projections: rename, cast, no filter.

Each entry lists ``output[=input][:type]``; money is DECIMAL(18,2), rates DECIMAL(5,4),
timestamps become calendar dates and ``*_at`` columns are renamed to ``*_date``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import MONEY, RATE

_TYPES = {"money": MONEY, "rate": RATE, "date": "date"}

STAGING: dict[str, tuple[str, str]] = {
    # Lines come first: whoever reads all tables has them stored when orders add up their amounts.
    "order_lines": (
        "app_db__order_lines",
        "order_line_id order_id sku quantity unit_price:money discount_pct:rate line_amount:money "
        "order_date=created_at:date",
    ),
    "app_customers": (
        "app_db__customers",
        "app_db_customer_id created_date=created_at:date segment account_type acquisition_channel",
    ),
    "stripe_customers": (
        "stripe__customers",
        "stripe_customer_id created_date=created_at:date is_active deactivated_date=deactivated_at:date",
    ),
    "shopify_customers": ("shopify__customers", "shopify_customer_id created_date=created_at:date is_active"),
    "salesforce_customers": (
        "salesforce__customers",
        "salesforce_customer_id created_date=created_at:date is_active",
    ),
    "customer_id_crosswalk": (
        "app_db__customer_id_crosswalk",
        "source_system source_customer_id app_db_customer_id linked_date=linked_at:date link_method",
    ),
    "orders": (
        "app_db__orders",
        "order_id customer_id channel order_date:date gross_amount:money take_rate:rate net_amount:money "
        "promo_code subscription_id",
    ),
    "products": (
        "app_db__products",
        "sku product_name category supplier_id unit_cost:money list_price:money introduced_date=introduced_at:date",
    ),
    "plans": (
        "app_db__plans",
        "plan_id plan_name plan_generation tier launched_date=launched_at:date retired_date=retired_at:date "
        "is_current",
    ),
    "plan_prices": (
        "app_db__plan_prices",
        "plan_id effective_date=effective_from:date annual_price_per_seat:money",
    ),
    "subscriptions": (
        "app_db__subscriptions",
        "subscription_id customer_id plan_id seats term_start_date=term_start:date term_end_date=term_end:date "
        "price_per_seat:money acv:money order_id renewed_from_subscription_id status "
        "cancelled_date=cancelled_at:date",
    ),
    "invoices": (
        "app_db__invoices",
        "invoice_id order_id billed_date:date due_date:date collected_date:date amount:money is_bad_debt "
        "salesforce_customer_id",
    ),
    "revenue_recognition": (
        "app_db__revenue_recognition",
        "order_id recognition_date:date amount:money",
    ),
    "refunds": (
        "stripe__refunds",
        "refund_id order_id refund_date:date refund_amount:money stripe_customer_id",
    ),
    "promotions": (
        "app_db__promotions",
        "promo_code promo_name start_date:date end_date:date discount_pct:rate eligible_channels",
    ),
    "suppliers": ("erp__suppliers", "supplier_id supplier_name category onboarded_date=onboarded_at:date"),
    "supplier_shipments": (
        "erp__supplier_shipments",
        "shipment_id supplier_id category expected_date:date received_date:date units_expected units_received "
        "status",
    ),
    "ad_spend": (
        "ads__daily_spend",
        "spend_date:date platform spend_usd:money impressions clicks reported_conversions",
    ),
    "tickets": (
        "zendesk__tickets",
        "ticket_id requester_source_system requester_source_id created_date=created_at:date category priority "
        "status resolved_date=resolved_at:date related_order_id related_subscription_id",
    ),
}


def _projection(item: str) -> Column:
    name, _, kind = item.partition(":")
    out, _, source = name.partition("=")
    col = F.col(source or out)
    return (col.cast(_TYPES[kind]) if kind else col).alias(out)


def stage(name: str, raw: DataFrame) -> DataFrame:
    return raw.select(*[_projection(item) for item in STAGING[name][1].split()])


def staged_column(name: str, raw_column: str) -> str:
    """The staged name of a raw column."""
    for item in STAGING[name][1].split():
        out, _, source = item.partition(":")[0].partition("=")
        if (source or out) == raw_column:
            return out
    raise KeyError(raw_column)
