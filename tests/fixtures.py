"""Hand-made raw tables: give the rows that matter, everything else stays empty."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

from marketlens.plans.warehouse import Warehouse
from marketlens.sources.registry import RAW_TABLES


def _value(v, kind):
    if v is not None and isinstance(kind, T.TimestampNTZType):
        return datetime.fromisoformat(v)
    if v is not None and isinstance(kind, T.DoubleType):
        return float(v)
    return v


def raw_tables(spark, **rows):
    """``rows``: staged-like short name -> list of dicts; missing columns are NULL."""
    tables = {}
    for name, spec in RAW_TABLES.items():
        schema = T.StructType.fromDDL(spec.ddl)
        given = rows.get(name, [])
        data = [tuple(_value(r.get(f.name), f.dataType) for f in schema) for r in given]
        tables[name] = spark.createDataFrame(data, schema)
    unknown = set(rows) - set(RAW_TABLES)
    assert not unknown, unknown
    return tables


def warehouse(spark, **rows) -> Warehouse:
    return Warehouse.of(spark, raw_tables(spark, **rows))


def customer(cid, account="customer", segment="consumer", created="1995-01-01"):
    return {
        "app_db_customer_id": cid, "created_at": created, "segment": segment, "account_type": account,
        "acquisition_channel": "d2c",
    }


def order(oid, cid, channel, date, gross, net=None, **more):
    return {
        "order_id": oid, "customer_id": cid, "channel": channel, "order_date": date, "gross_amount": gross,
        "net_amount": gross if net is None else net, **more,
    }


def term(sid, cid, start, end, acv, previous=None, status="renewed", plan="essentials", seats=10):
    return {
        "subscription_id": sid, "customer_id": cid, "plan_id": plan, "seats": seats, "term_start": start,
        "term_end": end, "price_per_seat": acv / seats, "acv": acv, "order_id": f"o_{sid}",
        "renewed_from_subscription_id": previous, "status": status,
    }


PLAN = {
    "plan_id": "essentials", "plan_name": "Essentials", "plan_generation": 3, "tier": "smb",
    "launched_at": "1995-01-01", "retired_at": None, "is_current": True,
}


def one(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()
