"""Benchmark decontamination: drop documents, or cut spans, that repeat passages of test items.

Words are runs of digits, Latin letters and characters beyond ASCII, with A-Z in lower case.
A window is ten consecutive words of an item; an item of fewer words, but not none, is one
window of its own. A hash of each window makes the set that is broadcast; every document
slides windows of the lengths in use over its words, looks each hash up, and compares the
words themselves where a hash is found. A broadcast is used for up to ``BROADCAST_WINDOWS``
windows, four times as many item ids and ``BROADCAST_MEGABYTES`` of words, counted first (a word beyond ASCII has no
longest length); a larger set is joined by a shuffle on the hashes, and the windows
found are compared afterwards by the words of the documents that hold them. Either way only
windows found leave a task, and a document gets one row before anything is shuffled.
DataFrame functions only.

Defined results: a null or wordless text has no words and is never hit; a null or wordless
item has no window; an item without an id hits words but adds nothing to the list of items;
repeated documents each get their own row; empty tables give empty results or no hit.
Columns beyond those named are kept as they are by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, broadcast_if_small, stored

WINDOW_WORDS = 10
BROADCAST_WINDOWS = 200_000
BROADCAST_MEGABYTES = 64
BROADCAST_TEXTS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def windows(bench: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(hash, length, window, items) of every different window of the items."""
    w = bench.select(F.col(item).alias("item"), words(F.col(text)).alias("words"))
    length = F.least(F.size("words"), F.lit(size))
    each = w.filter(F.size("words") > 0).select(
        "item", length.alias("length"),
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size("words") - length + 1), lambda p: F.slice("words", p, length)
        )).alias("window"),
    )
    return each.groupBy("length", "window").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64("window").alias("hash"), "length", "window", "items"
    )


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans (start, length)."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("bigint").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"] - 1
        more = F.greatest(F.lit(0), end - F.greatest(acc["until"], s["start"] - 1))
        return F.struct(F.greatest(acc["until"], end).alias("until"), (acc["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def scan(docs: DataFrame, bench: DataFrame, doc_text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = WINDOW_WORDS, keep: tuple[str, ...] = ("doc_id",),
         broadcast_windows: int = BROADCAST_WINDOWS, broadcast_megabytes: int = BROADCAST_MEGABYTES) -> DataFrame:
    """Per document: the columns ``keep``, n_words, n_hit, items (sorted as strings) and hits (start word, length)."""
    table = windows(bench, item, item_text, size)
    letters = F.octet_length(F.array_join("window", " ")).cast("bigint")
    small = table.select(F.size("items").alias("k"), letters.alias("bytes")).limit(broadcast_windows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes")
    ).first()
    fits_memory = small["n"] <= broadcast_windows and (small["k"] or 0) <= 4 * broadcast_windows and (small["bytes"] or 0) <= broadcast_megabytes << 20
    lengths = [r[0] for r in table.select("length").distinct().collect()]  # at most ``size`` numbers
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"),
        words(F.col(doc_text)).alias("words"),
    )
    n = F.size("words")
    k = max(len(lengths), 1)
    here = F.slice("words", F.col("start"), F.col("length"))

    def grid(base: DataFrame) -> DataFrame:
        """A row for each window that starts at a word, and one (i = 0) for the document itself."""
        at = base.select("row", "kept", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), n * k)).alias("i"))
        start = F.when(F.col("i") > 0, F.floor((F.col("i") - 1) / k).cast("int") + 1)
        pick = F.element_at(F.array(*[F.lit(x) for x in sorted(lengths)]), F.pmod(F.col("i") - 1, F.lit(k)) + 1) if k > 1 else F.lit((lengths or [size])[0])
        at = at.select("row", "kept", "words", "n", "i", start.alias("start"), pick.alias("length"))
        fits = F.col("start") + F.col("length") - 1 <= F.col("n")
        return at.withColumn("hash", F.when(fits, F.xxhash64(here)))

    if fits_memory:
        t = F.broadcast(table.withColumnRenamed("hash", "h").withColumnRenamed("length", "len"))
        found = grid(base).join(t, (F.col("hash") == F.col("h")) & (F.col("length") == F.col("len"))
                                & (here == F.col("window")), "left")
        found = found.filter((F.col("i") == 0) | F.col("h").isNotNull())
    else:  # read three times, so the row numbers are written down
        base = stored(base, "document-words")
        at = grid(base)
        probe = at.filter(F.col("hash").isNotNull()).select("row", "start", "length", "hash")
        some = probe.join(table, ["hash", "length"]).select("row", "start", "length", "window", "items")
        spot = base.join(some.select("row").distinct(), "row", "left_semi").select("row", "words")
        some = some.join(spot, "row").filter(here == F.col("window"))
        found = some.select("row", F.lit(None).cast(base.schema["kept"].dataType).alias("kept"), F.lit(None).cast("int").alias("n"), "start", "length", "items")
        none = F.lit(None)
        found = found.unionByName(base.select(
            "row", "kept", n.alias("n"), none.cast("int").alias("start"), none.cast("int").alias("length"),
            none.cast(table.schema["items"].dataType).alias("items")))
    per = found.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"),
        F.max("n").alias("n"),
        F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("hits"),
        F.collect_set("items").alias("items"),  # a window hit again, or its neighbour of the same items, adds nothing
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    return per.select(
        *[F.col(f"kept.{c}").alias(c) for c in keep], F.col("n").cast("bigint").alias("n_words"),
        _covered(F.col("hits")).alias("n_hit"), ids.alias("items"), "hits",
    )


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", text: str = "text",
                  item: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """The documents without those that hold a window of an item, or (``remove="spans"``) without the words hit.

    Cutting a span takes its words and the separators between them; the rest of the text,
    separators included, stays letter for letter.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.char_length("text").alias("n"))
    boxed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text")).withColumn("key", key)
    # what is hit follows from the text alone, so texts are matched by their hashes and not shuffled themselves
    found = scan(boxed, bench, "text", item, item_text, size, keep=("key",)).filter(F.col("n_hit") > 0)
    found = stored(found.select(F.col("key").alias("hit_key"), "hits").dropDuplicates(["hit_key"]), "contaminated-texts")
    if remove == "documents":
        found = broadcast_if_small(found.select("hit_key"), BROADCAST_TEXTS)
        return boxed.join(found, F.col("key") == F.col("hit_key"), "left_anti").select("doc.*")
    out = boxed.join(broadcast_if_small(found, BROADCAST_TEXTS, 8 * F.size("hits")), F.col("key") == F.col("hit_key"), "left")
    rest = F.when(F.col("hits").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("hits")))
    return out.select(*[rest.alias(c) if c == text else F.col(f"doc.{c}").alias(c) for c in docs.columns])


def _without(text: Column, hits: Column) -> Column:
    """A text without the words of the spans. Piece 2i is word i, the pieces around it its separators."""
    gaps = F.split(text, WORD, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array(F.lit("")))
    pieces = F.flatten(F.zip_with(gaps, found, lambda s, w: F.array(s, w)))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        before = 2 * s["start"] - 1
        part = F.struct(acc["next"].alias("a"), before.alias("b"))
        kept = F.when(before >= acc["next"], F.array_append(acc["kept"], part)).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["next"], 2 * (s["start"] + s["length"]) - 1).alias("next"), kept.alias("kept"))

    end = F.struct((F.lit(2) + F.size(gaps)).alias("start"), F.lit(0).alias("length"))
    parts = F.aggregate(F.concat(F.array_sort(hits), F.array(end)), zero, step, lambda acc: acc["kept"])
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice(pieces, p["a"], p["b"] - p["a"] + 1), "")), "")
