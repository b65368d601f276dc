"""Finished tables in the cluster's shared folder.

Staged tables and marts are used by many metrics, so each is written once per application
to columnar files and read back. That cuts the lineage (a lost executor only re-reads
files), and lets date windows and column pruning reach a Parquet scan. The folder is the
one the session names in ``spark.checkpoint.dir``, or, where that is unset, its warehouse
folder; what kind of master runs makes no difference.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RELEASING: Counter[str] = Counter()
_GIVEN: dict[str, str] = {}
_LOCK = Lock()


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a write go as soon as it ends; else they stay until the driver happens to collect its
    garbage. Each write plans anew, so nothing reads them again. The session's own setting holds again afterwards."""
    who = spark.sparkContext.applicationId
    with _LOCK:
        if not _RELEASING[who]:
            _GIVEN[who] = spark.conf.get(_RELEASE)
            spark.conf.set(_RELEASE, "true")
        _RELEASING[who] += 1
    try:
        yield
    finally:
        with _LOCK:
            _RELEASING[who] -= 1
            if not _RELEASING[who]:
                spark.conf.set(_RELEASE, _GIVEN.pop(who))


def shared_folder(spark: SparkSession) -> str:
    """The folder for finished tables: ``spark.checkpoint.dir``, else the session's warehouse folder."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/marketlens/{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one, for tables a query writes and reads back."""
    return f"{application_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = scratch_folder(df.sparkSession, "cut")
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class TableStore:
    """Write-once tables of one application over one input folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        digest = hashlib.sha256(label.encode()).hexdigest()[:16]
        self.root = f"{application_folder(spark)}/{digest}"
        self._ready: dict[str, DataFrame] = {}

    def table(self, name: str, build: Callable[[], DataFrame], cluster: str | None = None) -> DataFrame:
        """Build and store a table on first use; ``cluster`` names its date column.

        Clustered tables are sorted by date within each file, so a date window skips row groups
        and pages by their statistics. The rows stay in the tasks that made them: a fact
        is not sent over the network once more to be stored, and a month with a third of all
        rows is spread like any other. Ids, digits that hardly repeat, take half the room in zstd.
        """
        if name not in self._ready:
            out = df = build()
            path = f"{self.root}/{name}"
            if cluster:
                out = df.sortWithinPartitions(cluster)
            with shuffles_released(self.spark):
                out.write.mode("overwrite").option("compression", "zstd").parquet(path)
            self._ready[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._ready[name]
