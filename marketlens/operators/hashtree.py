"""Where two table sets differ: a hash tree over ranges of keys, opened only where its hashes differ.

A row belongs to a leaf by the hash of its key; ``FANOUT`` neighbouring nodes make a node of the level above, and the
root is the table. A node's hash is the sum of its rows' hashes, so it depends on no order and is added up from
partial sums: a table is read once for it and only sums per leaf are sent. Trees are built once per table set and their
nodes stored. Two sets are compared from the roots down: of each level only the children of differing nodes are read,
and in the end the keys of differing leaves, portion by portion: neighbouring leaves with a bounded number of rows, whose
shuffle goes before the next one begins. Tables without a differing leaf are not read again. A tree asked for its ``rows()`` stores
the rows' keys and hashes in order of leaf, and is then opened there, as ranges that reach the scan.

Row hashes are two independent 64-bit ones over all columns with their nulls, and a count goes with them: rows that
differ are missed with a chance of 2^-128. A key that occurs several times counts as one key with
several rows. Tables that one set lacks are empty there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.plans.staging import STAGING
from marketlens.plans.versions import change_columns
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.store import cut_lineage, scratch_folder, shuffles_released

FANOUT_BITS, LEVELS = 4, 3
MOST_RANGES, ROWS_PER_FILE = 200, 5_000_000
ROWS_AT_ONCE = 60_000_000  # of both sides together, about 50 bytes each in a shuffle
_SUMS = ("a", "b", "n")


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    masks = [
        reduce(Column.bitwiseOR, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns[at : at + 62])])
        for at in range(0, len(columns), 62)
    ]
    return F.xxhash64(F.lit(seed), *masks, *columns)


def _key_text(key: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])


def _added(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(20,0)")).cast("decimal(38,0)")


def _pieces() -> list[Column]:
    """The 128 bits of ``a`` and ``b`` as five numbers of 26 bits at most, which sum up as longs over 2^37 rows of a key."""
    bits = lambda c, at, n: F.shiftrightunsigned(c, at).bitwiseAND((1 << n) - 1)
    return [bits("a", 0, 26), bits("a", 26, 26), bits("a", 52, 12) + F.shiftleft(bits("b", 0, 14), 12), bits("b", 14, 26), bits("b", 40, 24)]


class HashTree:
    """The tree of a table set; ``tables`` maps a name to its rows and key columns."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], levels: int = LEVELS):
        self.spark, self.levels, self.tables, self._stored = spark, levels, dict(tables), False
        self.folder = scratch_folder(spark, "hash-tree")
        hashed = reduce(DataFrame.unionByName, [self._hashed(name).drop("key") for name in self.tables])
        leaves = hashed.groupBy("table_name", F.col("leaf").alias("node")).agg(_added("a").alias("a"), _added("b").alias("b"), F.count(F.lit(1)).alias("n"))
        below = self._keep(leaves, levels)
        for level in range(levels - 1, -1, -1):
            above = below.groupBy("table_name", F.shiftright("node", FANOUT_BITS).alias("node")).agg(
                F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"), F.sum("n").alias("n"))
            below = self._keep(above, level)

    def _hashed(self, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """A table's rows as leaf, key and hashes, where wanted only those of a range of leaves."""
        df, key = self.tables[name]
        leaf = F.shiftrightunsigned(F.xxhash64(_key_text(key)), 64 - FANOUT_BITS * self.levels) if self.levels else F.lit(0)
        if low is not None:
            df = df.filter(leaf.cast("int").between(low, high))
        return df.select(
            F.lit(name).alias("table_name"), leaf.cast("int").alias("leaf"), _key_text(key).alias("key"),
            _row_hash(df.columns, 1).alias("a"), _row_hash(df.columns, 2).alias("b"))

    def _keep(self, nodes: DataFrame, level: int) -> DataFrame:
        with shuffles_released(self.spark):
            nodes.write.parquet(f"{self.folder}/level-{level}")
        return self.nodes(level)

    def rows(self) -> DataFrame:
        """All rows' keys and hashes, stored in order of leaf when first asked for."""
        if not self._stored:
            with shuffles_released(self.spark):
                (
                    reduce(DataFrame.unionByName, [self._hashed(name) for name in self.tables])
                    .repartitionByRange("table_name", "leaf")
                    .sortWithinPartitions("table_name", "leaf")
                    .write.option("maxRecordsPerFile", ROWS_PER_FILE)
                    .parquet(f"{self.folder}/rows")
                )
            self._stored = True
        return self.spark.read.parquet(f"{self.folder}/rows")

    def opened(self, leaves: DataFrame, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
        """The rows of some leaves, all within ``spans`` of their tables: from the stored rows where there are any, else from the tables."""
        if self._stored:
            ranges = _ranges(leaves)
            rows = self.rows().filter(F.lit(False) if ranges is None else ranges)
        else:
            parts = [self._hashed(name, *span) for name, span in spans.items() if name in self.tables]
            if not parts:
                return self._hashed(next(iter(self.tables))).limit(0)
            rows = reduce(DataFrame.unionByName, parts)
        return rows.join(leaves.withColumnRenamed("node", "leaf"), ["table_name", "leaf"], "left_semi")

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/level-{level}")


def tree_of(wh: Warehouse, levels: int = LEVELS) -> HashTree:
    """The tree of all staged tables of a warehouse or snapshot."""
    return HashTree(wh.spark, {name: (wh.stg(name), change_columns(name)[0]) for name in STAGING}, levels)


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(table_name, node) whose hashes or counts are not the same on both sides."""
    renamed = right.select("table_name", "node", *[F.col(c).alias(f"_{c}") for c in _SUMS])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SUMS])
    return left.join(renamed, ["table_name", "node"], "full_outer").filter(~same).select("table_name", "node")


def differing_leaves(left: HashTree, right: HashTree) -> DataFrame:
    """(table_name, node) of the leaves that differ, found from the roots down."""
    if left.levels != right.levels:
        raise ValueError("trees of different depth")
    found = cut_lineage(_differing(left.nodes(0), right.nodes(0)))
    for level in range(1, left.levels + 1):
        parent = found.withColumnRenamed("node", "parent")
        below = lambda tree, level=level, parent=parent: tree.nodes(level).withColumn(
            "parent", F.shiftright("node", FANOUT_BITS)).join(parent, ["table_name", "parent"], "left_semi").drop("parent")
        found = cut_lineage(_differing(below(left), below(right)))
    return found


def _ranges(leaves: DataFrame) -> Column | None:
    """The differing leaves as at most ``MOST_RANGES`` ranges of the stored order; None if there is no leaf.

    Only what is read depends on the ranges: neighbours are joined where there are more, and where nothing lies
    between them. A row is held against the ranges of its own table alone.
    """
    per_table = leaves.groupBy("table_name").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # a row per table
    if not per_table:
        return None
    share = max(1, MOST_RANGES // len(per_table))
    cells = leaves.join(F.broadcast(leaves.sparkSession.createDataFrame(per_table).select("table_name", "low", "high")), "table_name")
    width = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(share))
    ranges = cells.groupBy("table_name", F.floor((F.col("node") - F.col("low")) / width).alias("cell")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    merged: dict[str, list[list[int]]] = {}
    for r in ranges.orderBy("table_name", "low").collect():  # at most MOST_RANGES, or one per table
        mine = merged.setdefault(r["table_name"], [])
        if mine and mine[-1][1] + 1 == r["low"]:
            mine[-1][1] = r["high"]
        else:
            mine.append([r["low"], r["high"]])
    parts = [
        (F.col("table_name") == name) & reduce(Column.__or__, [(F.col("leaf") >= low) & (F.col("leaf") <= high) for low, high in mine])
        for name, mine in merged.items()
    ]
    return reduce(Column.__or__, parts)


def _portions(left: HashTree, right: HashTree, leaves: DataFrame, most: int) -> list[dict[str, tuple[int, int]]]:
    """The leaves as runs of neighbours: the span of each table in it, with about ``most`` rows of both sides at most.

    Rows are counted per node of a level with few nodes, so that the driver gets a bounded list; a run is not cut within
    such a node.
    """
    fine = FANOUT_BITS * max(0, left.levels - 2)
    counts = left.nodes(left.levels).unionByName(right.nodes(right.levels)).join(leaves, ["table_name", "node"], "left_semi")
    cells = counts.groupBy("table_name", F.shiftright("node", fine).alias("cell")).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.sum("n").alias("n"))
    out: list[dict[str, tuple[int, int]]] = []
    held = 0
    for r in cells.orderBy("table_name", "cell").collect():  # at most 256 a table
        if not out or held + r["n"] > most:
            out.append({})
            held = 0
        span = out[-1].get(r["table_name"])
        out[-1][r["table_name"]] = (span[0] if span else r["low"], r["high"])
        held += r["n"]
    return out


def _within(leaves: DataFrame, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    return leaves.filter(reduce(Column.__or__, [(F.col("table_name") == name) & F.col("node").between(*span) for name, span in spans.items()]))


def _differing_keys(left: HashTree, right: HashTree, leaves: DataFrame, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    sides = [tree.opened(leaves, spans).withColumn("side", F.lit(side)) for side, tree in enumerate((left, right))]
    sums = {f"_{i}": F.sum(F.when(F.col("side") == 0, c).otherwise(-c)) for i, c in enumerate(_pieces())}
    rows = sides[0].unionByName(sides[1]).groupBy("table_name", "key").agg(
        F.count_if(F.col("side") == 0).alias("left_rows"), F.count_if(F.col("side") == 1).alias("right_rows"),
        *[c.alias(name) for name, c in sums.items()])
    same = reduce(Column.__and__, [F.col(name) == 0 for name in sums]) & (F.col("left_rows") == F.col("right_rows"))
    kind = F.when(F.col("right_rows") == 0, "left only").when(F.col("left_rows") == 0, "right only").otherwise("changed")
    return rows.filter(~same).select("table_name", "key", "left_rows", "right_rows", kind.alias("difference"))


def locate(left: HashTree, right: HashTree, most: int = ROWS_AT_ONCE) -> DataFrame:
    """(table_name, key, left_rows, right_rows, difference) of every key whose rows differ.

    A key's rows lie in one leaf. Leaves with more than about ``most`` rows in all are opened portion by portion, and what each
    gives is stored, so that the room of a shuffle does not grow with the tables.
    """
    leaves = differing_leaves(left, right)
    portions = _portions(left, right, leaves, most)
    if len(portions) < 2:
        return _differing_keys(left, right, leaves, portions[0] if portions else {})
    path = scratch_folder(left.spark, "located")
    for spans in portions:
        found = _differing_keys(left, right, _within(leaves, spans), spans)
        with shuffles_released(left.spark):
            found.write.mode("append").option("compression", "zstd").parquet(path)
    return left.spark.read.schema(found.schema).parquet(path)


def fingerprint_locate(left: Warehouse, right: Warehouse) -> DataFrame:
    """The rows behind a difference of fingerprints: every key of all tables whose rows differ between two table sets."""
    return locate(tree_of(left), tree_of(right))
