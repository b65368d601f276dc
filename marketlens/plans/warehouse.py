"""The warehouse: raw tables, staging, marts and point-in-time snapshots of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import count
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans.marts import MARTS, STORED_MARTS
from marketlens.plans.staging import STAGING, stage
from marketlens.plans.visibility import RAW_OF, visible
from marketlens.sources.mapping import MappedSource
from marketlens.sources.registry import RAW_TABLES
from marketlens.sources.store import TableStore

# Tables of fixed values: cheaper to keep as literals than to store.
_FIXED = frozenset({"plans", "plan_prices", "promotions"})
# Large fact tables and the date their metrics select on.
_CLUSTERED = {
    "stg_orders": "order_date",
    "stg_order_lines": "order_date",
    "stg_revenue_recognition": "recognition_date",
    "int_orders": "order_date",
}
_OPEN: dict[tuple[str, str], Warehouse] = {}
_OPENED = count()  # each opening stores its tables in a folder of its own


class Warehouse:
    """Named tables over one source of raw tables.

    ``raw`` hands out contract-typed raw tables, ``stg`` staged ones and ``mart`` marts.
    Staged tables and the heavier marts are stored once (see ``TableStore``); a snapshot
    made with ``as_of`` is a lazy view over the stored tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: Callable[[str], DataFrame],
        staged: Callable[[str], DataFrame] | None = None,
        store: TableStore | None = None,
    ):
        self.spark = spark
        self._raw = raw
        self._staged = staged
        self.store = store
        self.raw_folder: str | None = None  # where a copy of the raw tables has been written
        self._memo: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, RLock] = defaultdict(RLock)

    # -- ways in -----------------------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Warehouse:
        """The warehouse over an input folder; one per application and folder."""
        key = (spark.sparkContext.applicationId, folder)
        if key not in _OPEN:
            holder: list[Warehouse] = []
            source = MappedSource(spark, folder, lambda name: holder[0].stg(name), lambda name: holder[0].stored(name))
            holder.append(cls(spark, source.table, store=TableStore(spark, f"{folder}#{next(_OPENED)}")))
            holder[0].source = source
            _OPEN[key] = holder[0]
        return _OPEN[key]

    @classmethod
    def refresh(cls, spark: SparkSession, folder: str) -> Warehouse:
        """The warehouse over a folder whose files have changed: everything is derived anew."""
        _OPEN.pop((spark.sparkContext.applicationId, folder), None)
        return cls.open(spark, folder)

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Warehouse:
        """A lazy warehouse over raw tables given by name."""
        return cls(spark, tables.__getitem__)

    @classmethod
    def open_raw(cls, spark: SparkSession, folder: str) -> Warehouse:
        """The warehouse over 19 raw tables already written as Parquet folders."""
        from marketlens.sources.files import scan_raw_tables

        tables = scan_raw_tables(spark, folder, canonical=False)
        return cls(spark, tables.__getitem__, store=TableStore(spark, f"raw:{folder}"))

    # -- tables ------------------------------------------------------------------------
    def _get(self, name: str, build: Callable[[], DataFrame], stored: bool) -> DataFrame:
        with self._locks[name]:
            if name in self._memo:
                return self._memo[name]
            keep = stored and self.store is not None
            self._memo[name] = self.store.table(name, build, _CLUSTERED.get(name)) if keep else build()
        return self._memo[name]

    def stored(self, name: str) -> DataFrame | None:
        """A stored table if it is there by now, waiting for one that is being written; else None."""
        with self._locks[name]:
            return self._memo.get(name) if self.store is not None else None

    def raw(self, name: str) -> DataFrame:
        return self._raw(name)

    def stg(self, name: str) -> DataFrame:
        if self._staged is not None:
            return self._get(f"stg_{name}", lambda: self._staged(name), False)
        return self._get(f"stg_{name}", lambda: stage(name, self.raw(STAGING[name][0])), name not in _FIXED)

    def mart(self, name: str) -> DataFrame:
        return self._get(name, lambda: MARTS[name](self), name in STORED_MARTS)

    def raw_tables(self) -> dict[str, DataFrame]:
        return {name: self.raw(name) for name in RAW_TABLES}

    def build(self, workers: int = 6) -> None:
        """Derive and store every staged table and heavy mart, independent ones side by side.

        A table waits for the tables it needs; concurrent jobs keep executors busy while small
        tables finish.
        """
        with ThreadPoolExecutor(workers) as pool:
            jobs = [pool.submit(self.stg, name) for name in STAGING]
            first = ("int_orders",)  # others read it where it is stored
            jobs += [pool.submit(self.mart, name) for name in (*first, *sorted(STORED_MARTS.difference(first)))]
            for job in jobs:
                job.result()

    # -- snapshots ---------------------------------------------------------------------
    def as_of(self, date: str) -> Warehouse:
        """The warehouse as it looked at the end of ``date``."""
        return Warehouse(
            self.spark,
            raw=lambda name: visible(self.raw(name), name, date),
            staged=lambda name: visible(self.stg(name), RAW_OF[name], date, staged=name),
        )
