"""Constraints, bitmaps and rule tables against plain Python, and the plans they promise."""

import random
import re
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from marketlens.operators import customers, quality, textscan
from marketlens.plans.warehouse import Warehouse

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.open(spark, FOLDER)


def test_constraints_by_hand_with_hot_and_null_keys(spark):
    rng = random.Random(5)
    child = [(i, rng.choice([1, 1, 1, 2, 99, None])) for i in range(3000)] + [(7, 1), (7, 2), (None, 98), (None, 1)]
    parent = [(1, "a"), (2, "a"), (2, "b"), (3, None), (None, "a"), (None, "a")]
    tables = {"c": spark.createDataFrame(child, "id int, p int").repartition(6), "p": spark.createDataFrame(parent, "id int, t string").repartition(3)}
    unique = {"c": ("id",), "p": ("id", "t")}
    relations = [("c", "p", "p", "id"), ("p", "id", "c", "id"), ("c", "p", "c", "id")]
    out = quality.constraint_violations(tables.__getitem__, unique, relations)
    got = {r["constraint"]: r["violations"] for r in out.collect()}
    count = lambda keys: sum(n != 1 for n in Counter(keys).values())
    orphans = lambda keys, known: sum(k is not None and k not in known for k in keys)
    ids = {i for i, _ in child}
    assert got == {
        0: count(i for i, _ in child), 1: count(parent), 2: orphans([p for _, p in child], {1, 2, 3}),
        3: orphans([i for i, _ in parent], ids), 4: orphans([p for _, p in child], ids)}
    plan = out._jdf.queryExecution().sparkPlan().toString()  # before exchanges are put in
    assert plan.count("Join") == 0
    final = quality.constraint_violations(tables.__getitem__, unique, relations * 20)
    text = final._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_constraints_agree_with_one_query_each(wh):
    got = {r["name"]: r["violations"] for r in quality.dq_constraints(wh).collect()}
    for name, key in quality.unique_keys().items():
        table = wh.stg(name) if name in quality.STAGING else wh.mart(name)
        assert got[f"unique {name}({','.join(key)})"] == quality.duplicates(table, key).count()
    assert len(got) == len(quality.unique_keys()) + len(quality.RELATIONSHIPS)


def test_any_window_from_bitmaps_equals_distinct_customers(spark, wh):
    rng, months = random.Random(6), [date(y, m, 1) for y in range(1994, 2004) for m in range(1, 13)]
    windows = sorted({tuple(sorted(rng.sample(months, 2))) for _ in range(60)} | {(date(2000, 1, 1), date(2000, 1, 1)), (date(2000, 5, 1), date(2000, 2, 1)), (date(1960, 1, 1), date(1961, 1, 1))})
    orders = [(r[0], r[1], date(r[2].year, r[2].month, 1)) for r in wh.mart("fct_orders").select("customer_id", "channel", "order_date").collect()]
    out = customers.current_sets_any_window(wh, spark.createDataFrame(windows + windows[:1], "first_month date, last_month date"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(windows) + 1
    for a, b, *counts in got:
        inside = [(c, ch) for c, ch, m in orders if a <= m <= b]
        assert counts == [len({c for c, _ in inside}), *(len({c for c, ch in inside if ch == x}) for x in customers.config.CHANNELS)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "customer_id" not in plan and "NestedLoop" not in plan


def test_bitmaps_of_several_buckets(spark, wh):
    month = F.lit(date(2000, 1, 1))
    many = spark.range(100_000).select(month.alias("month"), F.lit("d2c").alias("channel"), (F.col("id") * 3).alias("seq"))
    bits = many.groupBy("month", "channel", F.bitmap_bucket_number("seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("seq")).alias("customers"))
    fake = Warehouse(spark, wh.raw)
    fake._memo["customer_bitmaps"] = bits
    windows = spark.createDataFrame([(date(1999, 12, 1), date(2000, 2, 1))], "first_month date, last_month date")
    assert customers.current_sets_any_window(fake, windows).first()["total"] == 100_000


def fits(pattern, path):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path, re.S) is not None


def test_rules_as_a_table_by_hand(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab/.Q\\E[") for _ in range(rng.randint(0, 5)))
    rules = [(rng.randint(0, 9), "*".join(word() for _ in range(rng.randint(1, 3)))) for _ in range(150)]
    rules += [(50, "*"), (3, ""), (2, "é*"), (1, None), (0, "a\\Eb"), (4, "**a"), (7, "ab*"), (7, "ab*")]
    urls = [f"http://h/{word()}{word()}{word()}" for _ in range(300)] + [None, "no url", "http://h", "http://h/éa", "http://h/a\nb", "http://h/a\\Eb"] + ["http://h/abab"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, "http://h/ab")], "page_id int, url string").repartition(4)
    paths = [tuple(r) for r in pages.select("page_id", textscan.url_path(F.col("url"))).collect()]
    want = Counter()
    for page, path in paths:
        best = min(((p, g) for p, g in rules if g is not None and path is not None and fits(g, path)), default=None)
        if best:
            want[page, path, best[1]] += 1
    got = textscan.path_rule_scan(pages, spark.createDataFrame(rules, "priority int, pattern string"))
    assert Counter(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "priority int, pattern string")
    assert textscan.path_rule_scan(pages, none).collect() == [] and textscan.path_rule_scan(pages.limit(0), none).columns == ["page_id", "path", "pattern"]


def test_fifty_thousand_rules_without_a_product(spark):
    rules = spark.range(50_000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("*/dir"), F.col("id") % 25_000, F.lit("x/*")).alias("pattern"))
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example.com/a/dir"), F.col("id") * 5, F.lit("x/file")).alias("url"))
    out = textscan.path_rule_scan(pages, rules)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    got = {r["page_id"]: r["pattern"] for r in out.collect()}
    assert got == {i: f"*/dir{i * 5}x/*" for i in range(4000)}
