"""Helpers the operators of this package share: scratch tables, fresh names, checked broadcasts, small batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 2 << 20


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the application, once, through Spark's file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    _SHIPPED[app] = tempfile.TemporaryDirectory(ignore_cleanup_errors=True)
    path = f"{_SHIPPED[app].name}/{package.name}-{app}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared folder of the session, removed when the application ends.

    ``spark.checkpoint.dir`` names the shared folder; where it is unset (tests), the folder
    of the session's warehouse is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Within, jobs hand rows to Python in Arrow batches of about so many bytes; a longer row is alone.

    A batch is held several times over, by the JVM beside its heap and by the Python worker, and neither gives
    all of it back before the executor ends. A size that the session has set itself stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` has made and nobody reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int, *sizes: str | Column, megabytes: int = 64) -> DataFrame:
    """Ask for a broadcast only where the table, counted first, has at most so many rows and bytes.

    ``sizes`` are what a row holds beside fixed values: names of text columns, or expressions of bytes.
    """
    each = [F.octet_length(c) if isinstance(c, str) else c for c in sizes]
    size = sum((F.coalesce(c, F.lit(0)).cast("bigint") for c in each), F.lit(0).cast("bigint"))
    found = df.select(size.alias("size")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= megabytes << 20 else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. Texts of ASCII only take the quicker way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
