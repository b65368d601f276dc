"""Point-in-time visibility: what a table looked like at the end of a given day.

A row is visible from its arrival date on. Six tables also carry columns that change
later; a change dated after the cut-off is undone, so the row reads as it did then.
Everything is a filter plus a projection, so a snapshot never shuffles and the arrival
filter reaches the file scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.plans.staging import STAGING, staged_column
from marketlens.sources.registry import RAW_TABLES

# raw table -> (column that carries the later change, what to undo when it is later)
LATE_UPDATES: Mapping[str, tuple[str, Mapping[str, object]]] = {
    "app_db__invoices": ("collected_date", {"collected_date": None}),
    "stripe__customers": ("deactivated_at", {"deactivated_at": None, "is_active": True}),
    "app_db__subscriptions": ("term_end", {"status": "active", "cancelled_at": None}),
    "app_db__plans": ("retired_at", {"retired_at": None, "is_current": True}),
    "erp__supplier_shipments": ("received_date", {"received_date": None, "status": "in_transit"}),
    "zendesk__tickets": ("resolved_at", {"resolved_at": None, "status": "open"}),
}



def visible(df: DataFrame, raw_name: str, as_of: str, *, staged: str | None = None) -> DataFrame:
    """Rows of ``df`` visible at ``as_of`` (a date, or a timestamp for raw tables).

    ``staged`` is the staging name when ``df`` carries staged column names.
    """

    def name(column: str) -> str:
        return staged_column(staged, column) if staged else column

    def at(column: str) -> Column:
        return F.lit(as_of).cast(df.schema[name(column)].dataType)

    arrival = RAW_TABLES[raw_name].arrival
    out = df.filter(F.col(name(arrival)) <= at(arrival))
    if raw_name not in LATE_UPDATES:
        return out
    trigger, undo = LATE_UPDATES[raw_name]
    # A term still running on the cut-off day is active; other updates count on their day.
    when = F.col(name(trigger))
    later = when >= at(trigger) if raw_name == "app_db__subscriptions" else when > at(trigger)
    undone = {name(c): v for c, v in undo.items()}
    return out.select(
        *[
            F.when(later, F.lit(undone[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in undone
            else F.col(f.name)
            for f in out.schema
        ]
    )


RAW_OF = {staged: raw for staged, (raw, _) in STAGING.items()}
