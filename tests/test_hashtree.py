"""The hash tree names exactly the keys that differ and reads little else."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketlens.operators import hashtree
from marketlens.sources.store import cut_lineage

SCHEMA = "k1 string, k2 int, a string, b double, c date"


def trees(spark, left, right, levels=3):
    out = []
    for side in (left, right):
        tables = {name: (spark.createDataFrame(rows, SCHEMA).repartition(3), ["k1", "k2"]) for name, rows in side.items()}
        out.append(hashtree.HashTree(spark, tables, levels))
    return out


def by_hand(left, right):
    out = {}
    for name in left.keys() | right.keys():
        for i, side in enumerate((left, right)):
            for r in side.get(name, ()):
                out.setdefault((name, f"{r[0] if r[0] is not None else 'null'}/{r[1] if r[1] is not None else 'null'}"), ([], []))[i].append(r)
    kind = lambda x, y: "left only" if not y else "right only" if not x else "changed"
    return {(*k, len(x), len(y), kind(x, y)) for k, (x, y) in out.items() if sorted(map(str, x)) != sorted(map(str, y))}


def table(rng, n):
    return [(f"k{i}", rng.choice([0, 1]), rng.choice(["x", "", None]), rng.choice([0.0, 1.5, None]), None) for i in range(n)]


def test_finds_every_difference_and_nothing_else(spark):
    rng = random.Random(3)
    same, rows = table(rng, 500), table(rng, 800)
    other = [r for r in rows if r[0] not in ("k7", "k8")]
    other = [(r[0], r[1], None if r[2] == "" else "", r[3], r[4]) if r[0] in ("k100", "k200") else r for r in other]
    other += [("new", 1, "x", 1.0, None), ("k5", 9, "x", 1.0, None), (None, None, "x", 1.0, None)]
    twice = [("d", 1, "x", 1.0, None)] * 2 + [("e", 1, "x", 1.0, None)]
    left = {"same": same, "changed": rows, "twice": twice, "gone": same[:5], "swap": [("s", 1, "x", None, None)]}
    right = {"same": same[::-1], "changed": other, "twice": twice[1:] + twice[2:], "swap": [("s", 1, None, None, None)], "fresh": same[:3]}
    got = {tuple(r) for r in hashtree.locate(*trees(spark, left, right)).collect()}
    assert got == by_hand(left, right) and len(got) > 12


def test_equal_sets_and_depths(spark):
    rows = table(random.Random(1), 50)
    for levels in (0, 1, 4):
        left, right = trees(spark, {"t": rows}, {"t": rows[::-1]}, levels)
        assert hashtree.locate(left, right).collect() == []
        changed = [(*rows[0][:2], "other", 2.0, None), *rows[1:]]
        left, right = trees(spark, {"t": rows}, {"t": changed}, levels)
        assert [r["key"] for r in hashtree.locate(left, right).collect()] == [f"{rows[0][0]}/{rows[0][1]}"]
    with pytest.raises(ValueError, match="depth"):
        hashtree.differing_leaves(left, trees(spark, {"t": rows}, {"t": rows}, 2)[0])
    empty = trees(spark, {"t": []}, {"t": []})
    assert hashtree.locate(*empty).collect() == []


def test_only_differing_ranges_are_opened(spark):
    """One changed key among many: below each level only its node's children are compared, and one range is read."""
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k1"), F.lit(1).alias("k2"), F.col("id").cast("string").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("date").alias("c"))
    changed = rows.withColumn("b", F.when(F.col("k1") == "k777", 2.0).otherwise(F.col("b")))
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        left, right = (hashtree.HashTree(spark, {"t": (df, ["k1", "k2"])}) for df in (rows, changed))
    finally:
        spark.conf.unset("parquet.block.size")
    leaves = hashtree.differing_leaves(left, right).collect()
    assert len(leaves) == 1
    out = hashtree.locate(left, right)
    assert [r["key"] for r in out.collect()] == ["k777/1"]
    wanted = hashtree._ranges(hashtree.differing_leaves(left, right))
    scanned = left.rows().filter(wanted)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(table_name,t)" in plan or "PushedFilters: [IsNotNull" in plan
    assert "OrEqual(leaf" in plan
    files = set(scanned.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert scanned.count() < n / 500 and len(files) == 1


def test_neighbouring_ranges_are_one(spark):
    """Two tables that differ in all leaves are read as one range each, one with a gap as two."""
    every = spark.range(4096).select(F.explode(F.array(F.lit("t"), F.lit("u"))).alias("table_name"), F.col("id").cast("int").alias("node"))
    gap = spark.createDataFrame([("v", 3), ("v", 4), ("v", 900), ("v", 901)], "table_name string, node int")
    leaves = every.unionByName(gap)
    wanted = hashtree._ranges(leaves)
    assert str(wanted).count("<=") == 4 and str(wanted).count(">=") == 4
    rows = spark.range(4096).select(F.explode(F.array(*map(F.lit, "tuvw"))).alias("table_name"), F.col("id").cast("int").alias("leaf"))
    got = {r["table_name"]: (r["n"], r["low"], r["high"]) for r in rows.filter(wanted).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("leaf").alias("low"), F.max("leaf").alias("high")).collect()}
    assert got == {"t": (4096, 0, 4095), "u": (4096, 0, 4095), "v": (4, 3, 901)}


def test_portions_give_what_one_pass_gives(spark):
    """However few rows are opened at once, every key is found; no tree stores its rows for it."""
    rng = random.Random(5)
    rows, more = table(rng, 400), table(rng, 300)
    left = {"t": rows, "u": more, "v": rows[:9], "same": more, "twice": [("d", 1, "x", 1.0, None)] * 3}
    right = {"t": [(*r[:3], 7.0, None) if i % 3 else r for i, r in enumerate(rows)], "u": more[150:], "same": more, "w": rows[:7], "twice": [("d", 1, "x", 1.0, None), ("d", 1, "y", 1.0, None)]}
    sides = trees(spark, left, right)
    portions = hashtree._portions(*sides, hashtree.differing_leaves(*sides), 200)
    assert 2 < len(portions) < 8 and not any("same" in spans for spans in portions)
    assert {tuple(r) for r in hashtree.locate(*sides, 200).collect()} == by_hand(left, right)
    assert not any(Path(tree.folder.removeprefix("file:"), "rows").exists() for tree in sides)
    for tree in sides:
        assert tree.rows().count() == sum(tree.nodes(0).toPandas()["n"])
    assert {tuple(r) for r in hashtree.locate(*sides, 10**9).collect()} == by_hand(left, right)  # opened where the rows are stored


def test_hashes_are_cut_into_pieces_without_loss(spark):
    rng = random.Random(2)
    given = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(200)] + [(-1, -1), (0, 0), (-(2**63), 2**63 - 1)]
    for row, (a, b) in zip(spark.createDataFrame(given, "a long, b long").select(*hashtree._pieces()).collect(), given, strict=True):
        assert all(0 <= p < 2**26 for p in row)
        assert sum(p << at for p, at in zip(row, (0, 26, 52, 78, 104), strict=True)) == (a % 2**64) + (b % 2**64 << 64)


def test_shuffles_of_stored_tables_go_at_once(spark):
    """The shuffle files of a table that has been stored do not wait for the driver's garbage collector."""
    folders = [Path(str(d)) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting)
    df = spark.range(10_000).repartition(5, "id")
    kept = cut_lineage(df)
    assert spark.conf.get(setting) == was
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == cut_lineage(df).count() == df.count() == df.count() == 10_000  # what comes later plans anew
