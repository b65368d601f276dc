"""URL filters as a sort-merge range join: rules are intervals of reversed-host keys, swept with a stack.

The key of a host is its labels in reverse, each with a dot behind it (``org.example.``), so a rule's host
and all subdomains are the interval of keys that begin with the rule's key, and intervals nest or are disjoint.
URLs are dealt into ranges of (key, a hash), which splits a host with very many URLs too; the bounds come from a
bounded sample and decide nothing but the balance. Each range is a task of its own (its number is the
partition, so no two ranges meet by chance of a hash). A rule goes to every range its interval meets. Each
range is sorted by key, rules first, and swept once: the stack holds the active
rules, those of the nested intervals around the current key; the longest whose path begins the
URL's path decides.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits;
among rules of the same length the longer host wins, then block; repeated rows are judged each; without
rules the default holds everywhere. A null rule host or path counts as empty; a rule with an empty host fits nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, ship

DEFAULT = "allow"
SAMPLE_PER_RANGE = 50
_PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def _judged(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict, list[int]]] = []  # key, host, {path: verdict}, lengths of the paths
        part = None
        for batch in batches:
            at, rules, verdicts = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "is_url", "host", "path", "verdict")]
            for i, (p, key, is_url, name, where, verdict) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, name, {}, []))
                    known = stack[-1][2]
                    if known.get(where) != "block":
                        known[where] = verdict
                    if len(where) not in stack[-1][3]:
                        stack[-1][3].append(len(where))
                        stack[-1][3].sort(reverse=True)
                    continue
                best = None
                for _, rule_host, known, lengths in stack:
                    for n in lengths:
                        if n <= len(where) and where[:n] in known:
                            if best is None or len(rule_host) + n >= best[0]:
                                best = (len(rule_host) + n, rule_host + where[:n], known[where[:n]])
                            break
                at.append(i)
                rules.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("host"), rows.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) per page; rules have columns host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    ship(spark)
    given = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"))
    urls = given.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)).alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = ranges * SAMPLE_PER_RANGE
    share = min(1.0, wanted / max(pages.count(), 1))  # the count reads no column
    drawn = F.pmod(F.xxhash64("salt"), F.lit(1 << 30)) < share * (1 << 30)
    keys = sorted((r["key"], r["salt"]) for r in urls.filter(drawn).select("key", "salt").limit(2 * wanted).collect())
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if len(keys) >= ranges else []

    @F.pandas_udf("int")
    def range_of(key, salt):
        return key.__class__([bisect_right(bounds, (k, s)) for k, s in zip(key, salt, strict=True)], dtype="int32")

    clean = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"),
    ).filter(F.col("host") != "").withColumn("key", host_key(F.col("host")))
    last = F.concat("key", F.lit("\U0010ffff"))
    clean = clean.withColumn("part", F.explode(F.sequence(range_of("key", F.lit(0).cast("bigint")), range_of(last, F.lit(1 << 30).cast("bigint")))))
    none = F.lit(None)
    both = urls.select(range_of("key", "salt").alias("part"), "key", F.lit(True).alias("is_url"), "id", "host", "path", none.cast("string").alias("verdict")).unionByName(
        clean.select("part", "key", F.lit(False).alias("is_url"), none.cast(given.schema["id"].dataType).alias("id"), "host", "path", "verdict"))
    swept = both.repartitionById(ranges, "part").sortWithinPartitions("part", "key", "is_url").mapInArrow(
        _judged(default), f"id {given.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", page_id)
