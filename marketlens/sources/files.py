"""Reading and writing raw tables, snapshots and marts as Parquet folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import canonical_channel
from marketlens.plans.marts import MARTS
from marketlens.plans.staging import STAGING
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.registry import RAW_TABLES, check_registry


def write_raw_tables(wh: Warehouse, folder: str) -> None:
    """One Parquet folder per raw table, in registry order."""
    for name, df in wh.raw_tables().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def scan_raw_tables(spark: SparkSession, folder: str, *, canonical: bool = True) -> dict[str, DataFrame]:
    """Read all 19 tables with their contract schema; channels come at canonical grain."""
    tables = {}
    for name, spec in RAW_TABLES.items():
        df = spark.read.schema(T.StructType.fromDDL(spec.ddl)).parquet(f"{folder}/{name}")
        if canonical and name == "app_db__orders":
            df = df.withColumn("channel", canonical_channel("channel"))
        tables[name] = df
    check_registry(tables)
    return tables


def snapshot_overwrite(wh: Warehouse, folder: str, as_of: str) -> None:
    """Full refresh of the staged tables visible at ``as_of``.

    Each table is partitioned by ``as_of`` and only that partition is replaced, so a repeated
    load gives the same result and other snapshots stay.
    """
    snap = wh.as_of(as_of)
    for name in STAGING:
        (
            snap.stg(name)
            .withColumn("as_of", F.lit(as_of).cast("date"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("as_of")
            .parquet(f"{folder}/{name}")
        )


def read_snapshot(wh: Warehouse, folder: str, name: str, as_of: str) -> DataFrame:
    """One loaded snapshot of a staged table (empty when nothing was visible by then)."""
    schema = T.StructType([*wh.stg(name).schema.fields, T.StructField("as_of", T.DateType())])
    df = wh.spark.read.schema(schema).parquet(f"{folder}/{name}")
    return df.filter(F.col("as_of") == F.lit(as_of).cast("date")).drop("as_of")


def materialize_layer(wh: Warehouse) -> list[str]:
    """Register staging and marts for SQL: ``stg_*`` views and one view per mart.

    Staged tables and heavy marts are stored tables by then; the rest stay views.
    """
    views = {f"stg_{name}": wh.stg(name) for name in STAGING}
    views.update({name: wh.mart(name) for name in MARTS})
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)


def export_mart(wh: Warehouse, name: str, folder: str) -> DataFrame:
    """Write a mart for another consumer and read it back."""
    path = f"{folder}/{name}"
    df = wh.mart(name)
    df.write.mode("overwrite").parquet(path)
    return wh.spark.read.schema(df.schema).parquet(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
