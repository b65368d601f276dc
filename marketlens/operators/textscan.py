"""Text jobs: number leaks, path rules and word overlap over whole texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marketlens import config
from marketlens.functions.text import distinctive, distinctive_value, glob_pattern, numbers, url_path, words
from marketlens.sources.store import cut_lineage


# -- numbers ------------------------------------------------------------------------------------------
def numbers_in(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Distinct distinctive numbers per document."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(numbers(F.col(text)))).alias("n"))
    return (
        found.select("doc_id", distinctive(F.col("n")).alias("number")).filter(F.col("number").isNotNull()).distinct()
    )


def gold_numbers(results: Sequence[DataFrame]) -> DataFrame:
    """Every distinctive number that appears in a set of metric results."""

    def values(df: DataFrame) -> DataFrame:
        numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
        cells = F.explode(F.array(*[F.col(c).cast("double") for c in numeric]))
        return df.select(cells.alias("v")).filter(F.col("v").isNotNull())

    cells = reduce(DataFrame.unionByName, [values(df) for df in results])
    return (
        cells.select(distinctive_value(F.col("v")).alias("number")).filter(F.col("number").isNotNull()).distinct()
    )


def gold_numbers_in_text(items: DataFrame, text: str = "text") -> DataFrame:
    """Every distinctive number written in a set of texts."""
    return numbers_in(items, "item_id", text).select("number").distinct()


def scan_numbers(docs: DataFrame, doc_id: str, text: str, gold: DataFrame) -> DataFrame:
    """Every distinctive number of every document, flagged when it is a gold number.

    Both sides are distinct before they meet, so a number repeated in a third of all
    documents joins against one gold row; the planner broadcasts the gold side when its
    measured size allows and otherwise splits the hot number's partition.
    """
    marked = gold.withColumn("is_gold", F.lit(True))
    return (
        numbers_in(docs, doc_id, text)
        .join(marked, "number", "left")
        .select("doc_id", "number", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))
    )


def leak_findings(docs: DataFrame, doc_id: str, text: str, gold: DataFrame) -> DataFrame:
    return numbers_in(docs, doc_id, text).join(gold, "number", "left_semi").select("doc_id", "number")


# -- paths ----------------------------------------------------------------------------------------------
def path_findings(pages: DataFrame, key: str, path: Column, forbidden: Sequence[str]) -> DataFrame:
    """Agent instruction files, agent folders and forbidden patterns (the first that fits).

    The rules are a fixed list, so they are one expression over the page row: no join.
    """
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    first = F.coalesce(
        *[F.when(path.rlike(glob_pattern(g)), F.lit(f"matches {g}")) for g in forbidden], F.lit(None).cast("string")
    )

    def finding(cond: Column, rule: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    rows = F.array_compact(
        F.array(
            finding(name.isin(*config.INSTRUCTION_FILES), "instruction-file", F.lit("auto-loaded by some agents")),
            finding(
                F.arrays_overlap(folders, F.array(*[F.lit(d) for d in config.INSTRUCTION_DIRS])),
                "instruction-file",
                F.lit("agent configuration directory"),
            ),
            finding(first.isNotNull(), "eval-material", first),
        )
    )
    return pages.select(F.col(key), path.alias("path"), F.inline(rows))


def path_pattern_scan(pages: DataFrame, forbidden: Sequence[str] = config.FORBIDDEN_PATHS) -> DataFrame:
    return path_findings(pages, "page_id", url_path(F.col("url")), forbidden)


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The different pieces of so many characters of a text."""
    places = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def path_rule_scan(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The first rule that fits the path of each page, of any number of rules (priority, pattern).

    ``*`` matches any run of characters, all else is literal; the smallest priority wins, then the smaller pattern. A pattern is
    filed under one piece of ``GRAM`` characters of its literal parts (fewer where they are shorter), the one that the
    fewest pages hold. A page looks its own pieces up in that index, and only the patterns found are matched, so
    there is no product of pages and rules. A pattern without any literal character meets every page. A null
    URL has no path and fits no rule; null patterns fit nothing; each row of pages is judged by itself.
    """
    rules = rules.filter(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.min("priority").alias("priority"))
    parts = F.split("pattern", r"\*")
    length = F.least(F.lit(GRAM), F.array_max(F.transform(parts, F.char_length)))
    rules = cut_lineage(rules.select("pattern", "priority", parts.alias("parts"), length.alias("size")))
    sizes = sorted(r[0] for r in rules.select("size").distinct().collect())  # at most GRAM + 1 numbers
    if not sizes:
        return pages.select(key, url_path(F.col(url)).alias("path"), F.lit(None).cast("string").alias("pattern")).limit(0)

    def pieces(of: Column, size: int) -> Column:
        return _grams(of, size) if size else F.array(F.lit(""))

    def of_rule(size: int) -> Column:
        return F.array_distinct(F.flatten(F.transform("parts", lambda p: pieces(p, size))))

    own = F.coalesce(*[F.when(F.col("size") == k, of_rule(k)) for k in sizes])
    filed = rules.select("pattern", "priority", "parts", F.explode(own).alias("piece"))
    paths = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), url_path(F.col(url)).alias("path"))
    met = paths.filter(F.col("path").isNotNull()).withColumn("piece", F.explode(F.concat(*[pieces(F.col("path"), k) for k in sizes])))
    often = met.join(filed.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("pages"))
    rarest = F.min_by(F.struct("piece", "parts"), F.struct(F.coalesce("pages", F.lit(0)), "piece"))
    index = filed.join(often, "piece", "left").groupBy("pattern", "priority").agg(rarest.alias("r")).select("pattern", "priority", "r.*")
    quoted = F.transform("parts", lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    index = index.withColumn("regex", F.concat(F.lit("(?s)^"), F.array_join(quoted, ".*"), F.lit(r"\z"))).drop("parts")
    fits = met.join(index, "piece").filter(F.expr("path RLIKE regex"))
    first = F.min(F.struct("priority", "pattern"))
    return fits.groupBy("row").agg(F.first("key").alias(key), F.first("path").alias("path"), first.alias("rule")).select(key, "path", "rule.pattern")


# -- word overlap ----------------------------------------------------------------------------------------
def word_overlap_topk(docs: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """For every document the ``k`` items with the highest word overlap (Jaccard).

    Every row is a document or an item of its own, whatever ids repeat or are null. Documents are dealt once, by their
    number; each word meets the inverted index of the items, and what does not occur in an item ends there. As all words
    of a document stay in its task, so do the counts per pair and the ranking: nothing that grows with
    documents x items is shuffled. Ties go by item id, null last, then by more shared words. A document with fewer
    than ``k`` overlapping items is filled up with the first items in that order at overlap zero, as a full
    ranking would; the first ``2k - 1`` items are always enough.
    """
    numbered = items.select("item_id", words(F.col("text")).alias("iw"), F.monotonically_increasing_id().alias("item"))
    i = cut_lineage(numbered)  # read twice, so the numbers are written down
    index = i.select("item", "item_id", F.size("iw").alias("item_words"), F.explode("iw").alias("token"))
    first = i.select("item_id", "item").orderBy(F.col("item_id").asc_nulls_last(), "item").limit(2 * k - 1)
    spare = first.agg(F.sort_array(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "item")))).scalar()
    d = docs.select("doc_id", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row")).repartition("row")
    each = d.select("row", "doc_id", F.size("w").alias("doc_words"), F.explode(F.concat("w", F.array(F.lit("")))).alias("token"))
    hits = each.join(index, "token", "left").filter((F.col("token") == "") | F.col("item").isNotNull())
    pairs = hits.groupBy("row", "doc_id", "doc_words", "item", "item_id", "item_words").agg(F.count(F.lit(1)).alias("shared"))
    union = (F.col("doc_words") + F.col("item_words") - F.col("shared")).cast("double")
    overlap = F.when(F.col("item").isNotNull(), F.col("shared").cast("double") / union)  # null: the document itself
    best = Window.partitionBy("row").orderBy(F.desc("overlap"), F.col("item_id").asc_nulls_last(), F.desc("shared"), "item")
    ranked = pairs.withColumn("overlap", overlap).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    found = F.struct("rank", "item_id", "shared", "overlap", "item")
    own = ranked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull() & (F.col("rank") <= k), found))).alias("found"))
    taken = F.transform("found", lambda x: x["item"])
    fill = F.filter(F.coalesce("spare", F.array().cast(_SPARE.format(items.schema["item_id"].dataType.simpleString()))), lambda x: ~F.array_contains(taken, x["item"]))
    more = F.transform(fill, lambda x: F.struct(F.lit(None).cast("int").alias("rank"), x["item_id"].alias("item_id"), F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("overlap"), x["item"].alias("item")))
    out = own.withColumn("spare", spare).select("doc_id", F.posexplode(F.slice(F.concat("found", more), 1, k)).alias("at", "x"))
    return out.select(
        "doc_id", (F.col("at") + 1).cast("long").alias("rank"), "x.item_id", "x.shared", F.round("x.overlap", 6).alias("overlap"))


_SPARE = "array<struct<none:boolean,item_id:{},item:bigint>>"
