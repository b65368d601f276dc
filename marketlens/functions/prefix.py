"""Running totals by calendar day: any window is the difference of two of their rows.

A key's totals are kept for every day from the one before its first to its last, so that they are found by
equality. Their size is keys x calendar days, whatever the number of facts or of windows asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RunningTotals:
    """Totals of ``values`` up to and with each day, per key, of a table with one row per key and day."""

    def __init__(self, daily: DataFrame, key: str, date: str, values: Sequence[str]):
        self.key, self.values = key, list(values)
        daily = daily.select(F.col(key).alias("_key"), F.col(date).alias("_day"), *values).filter("_day IS NOT NULL")
        self.bounds = daily.groupBy("_key").agg(F.date_sub(F.min("_day"), 1).alias("_before"), F.max("_day").alias("_last"))
        days = self.bounds.select("_key", F.explode(F.sequence("_before", "_last")).alias("_day"))
        so_far = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
        self.totals = days.join(daily, ["_key", "_day"], "left").select(
            "_key", "_day", *[F.sum(v).over(so_far).alias(v) for v in values])

    def upto(self, asked: DataFrame, date: str, *names: str) -> DataFrame:
        """``asked`` with the totals up to and with its ``date``, named ``names``; days outside the data count as its ends."""
        held = asked.join(self.bounds.withColumnRenamed("_key", "_k"), F.col(self.key) == F.col("_k"), "left")
        held = held.withColumn("_at", F.when(F.col(date).isNotNull(), F.least(F.greatest(date, "_before"), "_last"))).drop("_k", "_before", "_last")
        found = self.totals.select(F.col("_key").alias("_k"), "_day", *[F.col(v).alias(f"_{v}") for v in self.values])
        out = held.join(found, (F.col(self.key) == F.col("_k")) & (F.col("_at") == F.col("_day")), "left")
        totals = [F.coalesce(f"_{v}", F.lit(0)).alias(name) for v, name in zip(self.values, names, strict=True)]
        return out.select(*asked.columns, *totals)

    def between(self, asked: DataFrame, start: str, end: str, *names: str) -> DataFrame:
        """``asked`` with the totals of its inclusive windows; a window that ends before it starts is empty."""
        before, until = [f"_{n}_before" for n in names], [f"_{n}_until" for n in names]
        out = self.upto(asked.withColumn("_eve", F.date_sub(start, 1)), "_eve", *before)
        out = self.upto(out, end, *until)
        open_ = F.col(end) >= F.col(start)
        return out.select(*asked.columns, *[
            F.when(open_, F.col(u) - F.col(b)).otherwise(F.lit(0)).alias(n) for n, b, u in zip(names, before, until, strict=True)])
