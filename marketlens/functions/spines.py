"""Calendar spines and one-row results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = {"day": "1 day", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def spine(spark: SparkSession, start: Column, end: Column, unit: str, name: str) -> DataFrame:
    """One row per period start from ``start`` to ``end`` (both period starts)."""
    step = F.expr(f"interval {_STEP[unit]}")
    return spark.range(1).select(F.explode(F.sequence(start, end, step)).alias(name))


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row results next to each other, as scalar subqueries of the first."""
    out = first
    for df in others:
        packed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("packed")).scalar()
        out = out.select("*", packed.alias("_packed")).select(*out.columns, "_packed.*")
    return out


def unpivot_row(df: DataFrame, labels: Mapping[str, str], key: str, value: str) -> DataFrame:
    """One row with many columns -> one row per labelled column."""
    rows = F.array(*[F.struct(F.lit(text).alias(key), F.col(c).alias(value)) for c, text in labels.items()])
    return df.select(F.inline(rows))
