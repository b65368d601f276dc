"""Reconciling two derivations of the same figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import config


def _long(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """One row per key and value column, values as doubles."""
    columns = [f.name for f in df.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias(side)) for c in sorted(columns)]
    )
    return df.select(*[F.col(k) for k in keys], F.inline(pairs))


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerances: Mapping[str, float] | None = None,
    default: float = config.USD_TOLERANCE,
) -> DataFrame:
    """Full outer comparison by key of every numeric column, within a tolerance per column.

    A value missing on one side only disagrees, and so does a row missing on one side.
    """
    on = [*keys, "column_name"]
    joined = _long(left, keys, "left_value").join(_long(right, keys, "right_value"), on, "full_outer")
    tolerance = F.lit(default)
    for column, value in (tolerances or {}).items():
        tolerance = F.when(F.col("column_name") == column, F.lit(value)).otherwise(tolerance)
    close = F.abs(F.col("left_value") - F.col("right_value")) <= tolerance + 1e-9
    both_missing = F.col("left_value").isNull() & F.col("right_value").isNull()
    return joined.withColumn("agrees", F.coalesce(close, both_missing))


def trap_rows(metric: str, df: DataFrame, wrong: Sequence[str], tolerance: float = config.USD_TOLERANCE) -> DataFrame:
    """One row per wrong path of a one-row metric: does it differ from the right value?"""
    rows = F.array(
        *[F.struct(F.lit(w).alias("wrong_path"), F.col(w).cast("double").alias("wrong_value")) for w in wrong]
    )
    bites = F.abs(F.col("wrong_value") - F.col("value")) > tolerance
    return (
        df.select(F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"), F.inline(rows))
        .withColumn("bites", F.coalesce(bites, F.col("wrong_value").isNull() != F.col("value").isNull()))
    )


def accepted_alternative(
    metric: str, df: DataFrame, alternative: str, wrong: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    """An accepted alternative must differ from the value and from every wrong path."""
    rows = F.array(
        *[F.struct(F.lit(w).alias("against"), F.col(w).cast("double").alias("other")) for w in ("value", *wrong)]
    )
    return df.select(
        F.lit(metric).alias("metric"),
        F.lit(alternative).alias("alternative"),
        F.col(alternative).cast("double").alias("alternative_value"),
        F.inline(rows),
    ).withColumn("differs", F.abs(F.col("alternative_value") - F.col("other")) > tolerance)
