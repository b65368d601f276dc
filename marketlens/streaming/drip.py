"""The daily drip: a change log, and merging it into a running snapshot.

A row changes at most twice: when it arrives and when its late update happens. The change
log holds one full row per change with the day it became known. Applying all changes up to
a day gives exactly the snapshot of that day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.functions import day, literal_table
from marketlens.plans.staging import STAGING, staged_column
from marketlens.plans.versions import change_columns, update_known_on
from marketlens.plans.visibility import LATE_UPDATES, RAW_OF
from marketlens.plans.warehouse import Warehouse

KNOWN = "known_on"
MOST_SLICES = 8


def change_log(wh: Warehouse, name: str) -> DataFrame:
    """Every change of a staged table: the row as first seen, and as updated later."""
    key, arrival, update = change_columns(name)
    df = wh.stg(name)
    if update is None:
        return df.withColumn(KNOWN, F.col(arrival))
    raw = RAW_OF[name]
    undo = {staged_column(name, c): v for c, v in LATE_UPDATES[raw][1].items()}
    known = update_known_on(name, update)
    # A change dated on or before the arrival is part of the row as it arrives.
    later = known > F.col(arrival)

    def version(undone: bool) -> Column:
        return F.struct(
            (F.col(arrival) if undone else F.greatest(known, F.col(arrival))).alias(KNOWN),
            *[
                (F.lit(undo[f.name]).cast(f.dataType) if undone and f.name in undo else F.col(f.name)).alias(f.name)
                for f in df.schema
            ],
        )

    first_then_final = F.array(version(True), version(False))
    only_final = F.array(version(False))
    unchanged = F.array(
        F.struct(F.col(arrival).alias(KNOWN), *[F.col(f.name).alias(f.name) for f in df.schema])
    )
    rows = F.when(F.col(update).isNull(), unchanged).when(later, first_then_final).otherwise(only_final)
    return df.select(F.inline(rows))


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    """The last known version of every key, combined map-side."""
    columns = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(
        F.max_by(F.struct(*columns), KNOWN).alias("_row")
    ).select(*key, "_row.*")


def drip_feed_increment(wh: Warehouse, name: str, after: str, upto: str) -> DataFrame:
    """The snapshot at ``upto``, made from the one at ``after`` and the changes in between."""
    key, arrival, _ = change_columns(name)
    base = wh.as_of(after).stg(name).withColumn(KNOWN, F.col(arrival))
    changes = change_log(wh, name).filter((F.col(KNOWN) > day(after)) & (F.col(KNOWN) <= day(upto)))
    merged = latest(base.unionByName(changes), key)
    return merged.select(*wh.stg(name).columns)


# -- as a stream ---------------------------------------------------------------------------------------
def append_change_files(wh: Warehouse, name: str, folder: str, after: str | None, upto: str) -> None:
    """Add the changes that became known in ``(after, upto]`` as new files of the log."""
    known = F.col(KNOWN) <= day(upto)
    if after:
        known = known & (F.col(KNOWN) > day(after))
    change_log(wh, name).filter(known).write.mode("append").parquet(folder)


def apply_changes(target: str, key: list[str], batch: DataFrame, batch_id: int) -> None:
    """Store a micro-batch's newest versions as its own slice of the target.

    Slices are only ever added or rewritten whole under the batch's number, never merged in
    place: a batch repeated after a failure gives the same slice, and no earlier row is at
    risk while it is written.
    """
    latest(batch, key).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def _folders(spark: SparkSession, target: str, kind: str) -> dict[int, str]:
    """Finished ``kind=number`` folders of a target by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    found = {int(name.partition("=")[2]): f"{target}/{name}" for name in names if name.startswith(f"{kind}=")}
    done = lambda folder: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"))
    return {number: folder for number, folder in found.items() if done(folder)}


def current(spark: SparkSession, target: str, schema: StructType, key: list[str]) -> DataFrame:
    """The table as of the last batch: the newest version of every key in the newest base and the slices."""
    bases, slices = _folders(spark, target, "base"), _folders(spark, target, "batch")
    folders = [bases[k] for k in sorted(bases)[-1:]] + [slices[k] for k in sorted(slices)]
    if not folders:
        return spark.createDataFrame([], schema)
    return latest(spark.read.schema(schema).parquet(*folders), key)


def compact(spark: SparkSession, target: str, schema: StructType, key: list[str]) -> None:
    """Fold the base and all slices into a new base, then drop what it holds.

    The new base counts once it is finished; slices go after that. If a run breaks off in between, or a batch is
    written again later, versions are read twice and the newest of a key is still the same.
    """
    bases, slices = _folders(spark, target, "base"), _folders(spark, target, "batch")
    if not slices:
        return
    current(spark, target, schema, key).write.mode("overwrite").parquet(f"{target}/base={max(bases, default=-1) + 1}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [*slices.values(), *bases.values()]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def run_drip(
    wh: Warehouse, name: str, log: str, target: str, checkpoint: str, files_per_batch: int = 1000, most_slices: int = MOST_SLICES
) -> DataFrame:
    """Feed the change files not seen yet into the target and return the table.

    More than ``most_slices`` slices are folded into one base, so that reading does not slow down with the batches.
    """
    key, _, _ = change_columns(name)
    spark = wh.spark
    schema = change_log(wh, name).schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    query = (
        feed.writeStream.foreachBatch(lambda batch, number: apply_changes(target, key, batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if len(_folders(spark, target, "batch")) > most_slices:
        compact(spark, target, schema, key)
    return current(spark, target, schema, key).select(*wh.stg(name).columns)


# -- does it hold for every table? -----------------------------------------------------------------------
def increment_parity(wh: Warehouse, after: str, upto: str) -> DataFrame:
    """Per table: rows of the increment and of the snapshot, and whether they are the same rows."""
    out = None
    for name, (raw, _) in STAGING.items():
        columns = wh.stg(name).columns
        rows = [drip_feed_increment(wh, name, after, upto), wh.as_of(upto).stg(name)]
        nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
        hashes = [F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(20,0)") for seed in (1, 2)]
        sides = [
            df.select(F.lit(raw).alias("table_name"), F.lit(k).alias("side"), hashes[0].alias("a"), hashes[1].alias("b")) for k, df in enumerate(rows)]
        part = sides[0].unionByName(sides[1])
        out = part if out is None else out.unionByName(part)
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("side") == k, F.col(c))), F.lit(0))
    same = (of(0, "a") == of(1, "a")) & (of(0, "b") == of(1, "b"))
    sums = out.groupBy("table_name").agg(
        F.count_if(F.col("side") == 0).alias("increment_rows"), F.count_if(F.col("side") == 1).alias("snapshot_rows"), same.alias("same_hash"))
    listed = literal_table(wh.spark, "table_name string", [(raw,) for raw, _ in STAGING.values()])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return listed.join(sums, "table_name", "left").select(
        "table_name", zero("increment_rows").alias("increment_rows"), zero("snapshot_rows").alias("snapshot_rows"),
        (F.coalesce("same_hash", F.lit(True)) & (zero("increment_rows") == zero("snapshot_rows"))).alias("same_rows"))
