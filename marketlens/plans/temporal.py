"""As-of lookups against effective-dated histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def effective_intervals(history: DataFrame, key: str, since: str) -> DataFrame:
    """Turn ``(key, since, …)`` rows into closed intervals ``[valid_from, valid_to]``.

    The first interval of a key is open to the left, so dates before the first row clip to
    it; the last one is open to the right. The window holds one key's history only (a
    plan's price changes, a customer's account re-creations), never its facts.
    """
    w = Window.partitionBy(key).orderBy(since)
    return history.withColumn("valid_from", F.when(F.lag(since).over(w).isNotNull(), F.col(since))).withColumn(
        "valid_to", F.date_sub(F.lead(since).over(w), 1)
    )


def fresh_key(key: str) -> Column:
    """A string key the planner takes for a new value.

    A table that was just aggregated or windowed by a key is not shuffled again for a join
    on it, and then the adaptive skew join (which needs a fresh shuffle on both sides) cannot
    split a hot key of the fact side. Hiding the key costs one more shuffle of the small side
    and keeps a key with a third of all facts from filling one task.
    """
    return F.concat(F.col(key), F.lit(""))


def as_of_lookup(
    facts: DataFrame,
    history: DataFrame,
    *,
    key: str,
    date: str,
    since: str,
    take: Sequence[str],
    fixed: bool = False,
) -> DataFrame:
    """Left join each fact to the history row in force on its ``date``.

    ``key`` is a string column. Intervals of a key do not overlap, so a fact meets at most one row and needs no
    aggregation afterwards: the join is an equi-join on ``key`` with a range residue.
    ``fixed`` marks a history of fixed values, whose size is known to be small.
    """
    spans = effective_intervals(history, key, since)
    if fixed:
        spans = F.broadcast(spans)
    return within(facts, spans, key=key, date=date, take=take)


def within(facts: DataFrame, spans: DataFrame, *, key: str, date: str, take: Sequence[str]) -> DataFrame:
    """Left join each fact to the span of its key that contains its ``date``."""
    spans = spans.select(fresh_key(key).alias("_key"), "valid_from", "valid_to", *take)
    hit = (
        (F.col(key) == F.col("_key"))
        & (F.col("valid_from").isNull() | (F.col(date) >= F.col("valid_from")))
        & (F.col("valid_to").isNull() | (F.col(date) <= F.col("valid_to")))
    )
    return facts.join(spans, hit, "left").drop("_key", "valid_from", "valid_to")
