"""Every version of a row with the days on which it was the one known, and signed changes between two days.

A row changes at most twice: when it arrives and when its late update happens. Both versions follow from the
row itself, so the version table of any staged table is one projection without a shuffle. What a snapshot of a
day shows is the versions whose interval holds the day; what changed between two days is the versions that
one of the snapshots shows and the other does not, with weight +1 or -1.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import day
from marketlens.plans.staging import staged_column
from marketlens.plans.visibility import LATE_UPDATES, RAW_OF
from marketlens.sources.registry import RAW_TABLES

if TYPE_CHECKING:
    from marketlens.plans.warehouse import Warehouse

FROM, TO, OPEN, WEIGHT = "known_from", "known_to", "is_open", "weight"


def change_columns(name: str) -> tuple[list[str], str, str | None]:
    """Key columns, arrival column and late-update column of a staged table."""
    raw = RAW_OF[name]
    key = [staged_column(name, k) for k in RAW_TABLES[raw].key]
    update = staged_column(name, LATE_UPDATES[raw][0]) if raw in LATE_UPDATES else None
    return key, staged_column(name, RAW_TABLES[raw].arrival), update


def update_known_on(name: str, update: str) -> Column:
    """The first day a late update shows; a term's outcome shows the day after it ends."""
    return F.date_add(update, 1) if RAW_OF[name] == "app_db__subscriptions" else F.col(update)


def _touched(name: str, after: str, upto: str) -> Column:
    """Rows that arrive or are updated in ``(after, upto]``; ranges on stored columns, so that they reach the scan."""
    _, arrival, update = change_columns(name)
    within = lambda c, late=0: (F.col(c) > F.date_sub(day(after), late)) & (F.col(c) <= F.date_sub(day(upto), late))
    if update is None:
        return within(arrival)
    return within(arrival) | within(update, int(RAW_OF[name] == "app_db__subscriptions"))


def versions(wh: Warehouse, name: str, changed: tuple[str, str] | None = None) -> DataFrame:
    """The staged columns with ``known_from``, ``known_to`` (null: until now) and ``is_open`` (update yet to come).

    ``changed`` keeps the rows that arrive or are updated after the first and up to the second day.
    """
    df = wh.stg(name)
    return versions_of(df.filter(_touched(name, *changed)) if changed else df, name)


def versions_of(df: DataFrame, name: str) -> DataFrame:
    """``versions`` of given rows of a staged table, which may carry more columns."""
    _, arrival, update = change_columns(name)
    df = df.filter(F.col(arrival).isNotNull())
    never = F.lit(None).cast("date")
    if update is None:
        return df.select("*", F.col(arrival).alias(FROM), never.alias(TO), F.lit(False).alias(OPEN))
    undo = {staged_column(name, c): v for c, v in LATE_UPDATES[RAW_OF[name]][1].items()}
    known = update_known_on(name, update)

    def version(since: Column, until: Column, waits: bool, undone: bool) -> Column:
        return F.struct(
            *[(F.lit(undo[f.name]).cast(f.dataType) if undone and f.name in undo else F.col(f.name)).alias(f.name) for f in df.schema],
            since.alias(FROM), until.alias(TO), F.lit(waits).alias(OPEN))

    as_is = version(F.col(arrival), never, True, False)
    both = F.array(version(F.col(arrival), F.date_sub(known, 1), True, True), version(known, never, False, False))
    # a change dated on or before the arrival is part of the row as it arrives
    only = F.array(version(F.col(arrival), never, False, False))
    rows = F.when(F.col(update).isNull(), F.array(as_is)).when(known > F.col(arrival), both).otherwise(only)
    return df.select(F.inline(rows))


def _shown(date: str) -> Column:
    return (F.col(FROM) <= day(date)) & (F.col(TO).isNull() | (F.col(TO) >= day(date)))


def signed_changes(wh: Warehouse, name: str, after: str, upto: str) -> DataFrame:
    """The staged columns with ``weight``: +1 for a version new in the snapshot of ``upto``, -1 for one gone since ``after``."""
    weight = _shown(upto).cast("int") - _shown(after).cast("int")
    return versions(wh, name, (after, upto)).withColumn(WEIGHT, weight).filter(F.col(WEIGHT) != 0).drop(FROM, TO, OPEN)
