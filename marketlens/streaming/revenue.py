"""Revenue per day from a stream of events that may repeat and come late.

An event is one signed leg of ``fct_revenue`` with an identity of its own. The stream drops repeats of an event that
arrive within the watermark's delay and keeps the sums of the days that the watermark has not passed; both live
in the state store, whose size is the events of two delays and of what one run takes in, not of the history; so a long
load is taken in by periods, in the order of their days. The store is RocksDB, which keeps on local disk what does not
fit a bounded piece of memory. A day's sum is written whenever it changes, as a row of the micro-batch's slice; the
newest slice of a day counts. Slices are folded into one when a run ends, so that reading them costs one row per day and measure.

What arrives later than the delay is left out by the stream, repeats of passed days included. Null dates never
enter; an event without an identity is told apart by its values. A load that is cut into periods is no exception: events
of one id whose days lie further apart than the delay count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marketlens.functions import day
from marketlens.plans import marts
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.store import scratch_folder, shuffles_released

DELAY = "60 days"
EVENT = "event_id string, activity_date date, measure_name string, amount decimal(18,2)"
SLICE = "activity_date date, measure_name string, amount decimal(28,2), batch bigint"
EVENTS_PER_RUN = 10_000_000
_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKSDB}.boundedMemoryUsage": "true",
    f"{_ROCKSDB}.maxMemoryUsageMB": "500",  # of an executor
    f"{_ROCKSDB}.changelogCheckpointing.enabled": "false",  # the next run reads files, it does not repeat the changes
    "spark.sql.streaming.minBatchesToRetain": "2",  # a run begins where the last one ended
}


def revenue_events(wh: Warehouse) -> DataFrame:
    """Every leg of ``fct_revenue`` with an id that no other leg has: table, key and measure."""
    keep = wh.mart("fct_orders").select("order_id")

    def source(name: str, *key: str) -> DataFrame:
        df = wh.stg(name).join(keep, "order_id", "left_semi")
        return df.withColumn("event_id", F.concat_ws("/", F.lit(name), *key))

    orders = wh.mart("fct_orders").withColumn("event_id", F.concat_ws("/", F.lit("orders"), "order_id"))
    legs = marts.revenue_legs(
        orders, source("refunds", "refund_id"), source("invoices", "invoice_id"),
        source("revenue_recognition", "order_id", "recognition_date"), "event_id")
    return legs.withColumn("event_id", F.concat_ws("/", "event_id", "measure_name")).select(
        "event_id", "activity_date", "measure_name", "amount")


def stored_events(wh: Warehouse, upto: str) -> DataFrame:
    """``revenue_events`` up to a day, derived once and sorted by day in each file, so that a period reaches the scan."""
    path = scratch_folder(wh.spark, "revenue-events")
    events = revenue_events(wh).filter(F.col("activity_date") <= day(upto))
    with shuffles_released(wh.spark):
        events.sortWithinPartitions("activity_date").write.option("compression", "zstd").parquet(path)
    return wh.spark.read.schema(EVENT).parquet(path)


def append_events(events: DataFrame, folder: str) -> None:
    """One load: its files are picked up together by the next run."""
    events.write.mode("append").parquet(folder)


def daily_sums(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream of changed sums per day and measure; repeats within the delay count once."""
    same = F.coalesce("event_id", F.concat_ws("|", "activity_date", "measure_name", "amount"))
    timed = events.filter(F.col("activity_date").isNotNull()).select(
        same.alias("event_id"), F.col("activity_date").cast("timestamp").alias("happened"), "measure_name", "amount")
    once = timed.withWatermark("happened", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("happened", "1 day"), "measure_name").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))


def _write_slice(target: str, changed: DataFrame, number: int) -> None:
    rows = changed.select(F.col("window.start").cast("date").alias("activity_date"), "measure_name", "amount", F.lit(number).cast("long").alias("batch"))
    rows.write.mode("overwrite").parquet(f"{target}/slice={number}")


def newest(spark: SparkSession, target: str) -> DataFrame:
    """The last sum written of every day and measure."""
    slices = spark.read.schema(SLICE).option("recursiveFileLookup", "true").parquet(target)
    return slices.groupBy("activity_date", "measure_name").agg(F.max_by("amount", "batch").alias("amount"), F.max("batch").alias("batch"))


def _state_partitions(spark: SparkSession) -> int:
    """Each has a store of its own that is committed with every micro-batch: a few per core, not one per shuffle partition."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(12, 2 * spark.sparkContext.defaultParallelism))


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """A query takes over the session's settings as it starts; the session keeps its own."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def follow(spark: SparkSession, log: str, target: str, checkpoint: str, delay: str = DELAY, files_per_batch: int | None = None) -> StreamingQuery:
    """Take in the files not seen yet and end; the query tells how much state it holds."""
    feed = spark.readStream.schema(EVENT)
    if files_per_batch:
        feed = feed.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        daily_sums(feed.parquet(log), delay)
        .writeStream.outputMode("update")
        .foreachBatch(lambda changed, number: _write_slice(target, changed, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with _settings(spark, **_STATE, **{"spark.sql.shuffle.partitions": str(_state_partitions(spark))}):
        query = writer.start()
    query.awaitTermination()
    return query


def periods(load: DataFrame, most: int = EVENTS_PER_RUN) -> list[DataFrame]:
    """A load in the order of its days, in parts of about ``most`` events at most; a day is not cut. Events without a date go with the first."""
    per_day = load.groupBy("activity_date").count().orderBy(F.col("activity_date").asc_nulls_first()).collect()  # a row per calendar day
    starts, held = [], 0
    for r in per_day:
        if held and held + r["count"] > most:
            starts.append(r["activity_date"])
            held = 0
        held += r["count"]
    at = F.col("activity_date")

    def within(since: date | None, until: date | None) -> Column:
        if since is None:
            return F.lit(True) if until is None else at.isNull() | (at < F.lit(until))
        return at >= F.lit(since) if until is None else (at >= F.lit(since)) & (at < F.lit(until))

    return [load.filter(within(*ends)) for ends in zip([None, *starts], [*starts, None], strict=True)]


def take_in(load: DataFrame, log: str, target: str, checkpoint: str, delay: str = DELAY, most: int = EVENTS_PER_RUN) -> None:
    """Append a load and follow it period by period, so that the state never holds more than two delays (an event stays for one after the
    watermark, itself one behind) and one period."""
    for part in periods(load, most):
        append_events(part, log)
        follow(load.sparkSession, log, target, checkpoint, delay)


def fold(spark: SparkSession, target: str, folded: str) -> DataFrame:
    """All slices as one table in a folder of its own: what a reader needs, whatever the number of batches."""
    newest(spark, target).write.mode("overwrite").parquet(folded)
    return spark.read.schema(SLICE).parquet(folded)


def loads(events: DataFrame, *days: str, late: int = 30) -> list[DataFrame]:
    """Loads as a source would send them: up to each day, a part of the last ``late`` days held back for the next load
    and another part sent again with it."""
    part, out, before = F.pmod(F.xxhash64("event_id"), F.lit(10)), [], None
    for upto in days:
        at, recent = F.col("activity_date"), lambda d: F.col("activity_date") > F.date_sub(day(d), late)
        last = upto == days[-1]
        now = (at <= day(upto)) & (F.lit(last) | ~(recent(upto) & (part < 2)))
        if before:
            held, again = recent(before) & (part < 2), recent(before) & (part >= 7)
            now = now & ((at > day(before)) | ((at <= day(before)) & (held | again)))
        out.append(events.filter(now))
        before = upto
    return out
