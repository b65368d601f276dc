"""Secret scans: credentials found by their form, and weak parts linked where they complement each other.

Base spans stand for themselves: ``assign`` (a key word, a separator and a value of 6 or
more characters), ``access`` (an access identifier, 20 or more characters) and ``hex``
(24 or more hexadecimal digits). Weak parts alone mean nothing: ``id`` (16 to 40 capitals
and digits, at least one of either), ``secret`` (32 or more base64 characters with a small
letter, a capital and a digit) and ``endpoint`` (a scheme and a host). They are reported only
where complementary parts lie within the same scope, ``SCOPE`` code points to either side:
an id with a secret, a secret with an id, an endpoint with both. Access spans count as ids,
assign and hex spans as secrets. A weak part that overlaps a base span is not reported.

The interval join is a sorted sweep: the parts of a document in order of their start, each
looking at the furthest end before it and the nearest start after it: one row per part, no
pairs. Only texts with complementary parts take it, each different text once; everything
else stays within the row of the document. DataFrame functions only.

Positions are code points, the end exclusive. Null texts are empty; empty ones have no
span. Repeated documents each get their own row; an empty table gives an empty result; all
columns of the documents travel in one column, so no name clashes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, stored

SCOPE = 200
BROADCAST_TEXTS = 100_000
SPAN_BYTES = 32
MASK = "[SECRET]"
#: Kinds in the order in which spans with the same start are listed. The first three are base spans.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ID = r"(?<![A-Za-z0-9])(?=[A-Z0-9]{0,39}[0-9])(?=[A-Z0-9]{0,39}[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9])"
SECRET, CLASSES = r"[A-Za-z0-9+/]{32,}={0,2}", ("[0-9]", "[a-z]", "[A-Z]")
ENDPOINT = r"(?:https?|wss?|amqps?|postgres|mysql|redis|mongodb)://[A-Za-z0-9.-]+(?::[0-9]+)?"

_SPANS = "array<struct<start:int,end:int,kind:int>>"


def _found(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0, hint: str | None = None, classes: tuple[str, ...] = ()) -> Column:
    """Spans of a pattern's matches, leftmost and non-overlapping; shorter ones drop out afterwards.

    The lengths of the matches and of the pieces between them add up to the positions.
    ``hint`` is a cheaper pattern that any text with a long enough match has; a match must have all of ``classes`` somewhere.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.transform(whole, F.char_length) if not group else F.zip_with(
        whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda a, b: F.char_length(a) * 2 + F.when(F.char_length(b) >= least, 1).otherwise(0))
    if classes:
        measured = F.transform(whole, lambda m: F.char_length(m) * 2 + F.when(reduce(and_, [m.rlike(c) for c in classes]), 1).otherwise(0))
    coded = group or classes  # twice the length, and one more for a match that counts
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(whole)), measured,
        lambda p, m: F.struct(F.char_length(p).alias("gap"), (F.floor(m / 2).cast("int") if coded else m).alias("len"),
                              (F.pmod(m, F.lit(2)) == 1 if coded else m >= least).alias("ok")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["len"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + s["len"]).alias("at"), F.when(s["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(hint or pattern), out).otherwise(F.array().cast(_SPANS))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(order, one), ",")


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(doc, text, key, base) of every document, and (key, linked) of the texts with reported weak parts."""
    body = F.coalesce(F.col("text"), F.lit(""))
    boxed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.char_length("text").alias("n"))
    base = boxed.select("doc", "text", key.alias("key"), F.concat(
        _found(body, ASSIGN, 0, 6, 1, ASSIGN[:-2] + "{6})"),
        _found(body, r"AKIA[A-Z0-9]{16,}", 1), _found(body, r"[0-9a-f]{24,}", 2),
    ).alias("base"))
    weak = F.concat(_found(body, ID, 3, hint="[A-Z0-9]{16}"), _found(body, SECRET, 4, hint="[A-Za-z0-9+/]{32}", classes=CLASSES), _found(body, ENDPOINT, 5, hint="://"))
    # a text needs a weak part, an id and a secret, weak or not, or nothing can be linked; copies are judged once
    held = base.withColumn("weak", weak).filter(F.size("weak") > 0).select("key", "base", "weak").dropDuplicates(["key"])
    kinds = F.transform(F.concat("base", "weak"), lambda s: s["kind"])
    overlap = lambda k: F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in k]))
    some = held.filter(overlap((1, 3)) & overlap((0, 2, 4)))
    parts = some.select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.*")
    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)

    def near(kinds: tuple[int, ...]) -> Column:
        mine = F.col("kind").isin(*kinds)
        last, first = F.max(F.when(mine, F.col("end"))).over(before), F.min(F.when(mine, F.col("start"))).over(after)
        return F.coalesce(last >= F.col("start") - scope, F.lit(False)) | F.coalesce(first <= F.col("end") + scope, F.lit(False))

    hidden = F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(F.col("kind") < 3, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    judged = parts.select("key", "start", "end", "kind", near((1, 3)).alias("ids"), near((0, 2, 4)).alias("secrets"), hidden.alias("hidden"))
    linked = judged.filter((F.col("kind") >= 3) & ~F.col("hidden") & (
        ((F.col("kind") == 3) & F.col("secrets")) | ((F.col("kind") == 4) & F.col("ids"))
        | ((F.col("kind") == 5) & F.col("ids") & F.col("secrets"))))
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    return base, linked


def report(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: the columns ``keep``, counts of the base spans, their digest, all spans."""
    base, linked = scan(docs, text, scope)
    linked = broadcast_if_small(stored(linked, "linked-parts"), BROADCAST_TEXTS, SPAN_BYTES * F.size("linked"))
    box = F.struct(*[F.col(f"doc.{c}").alias(c) for c in keep]).alias("kept")
    rows = base.select("key", box, "base").join(linked, "key", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    every = F.concat("base", F.coalesce("linked", F.array().cast(_SPANS)))
    return rows.select(*[F.col(f"kept.{c}").alias(c) for c in keep], count(0), count(1), count(2), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = MASK, scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span masked; spans that touch or overlap share one mask. Null stays null."""
    base, linked = scan(docs, text, scope)
    linked = broadcast_if_small(stored(linked, "linked-parts"), BROADCAST_TEXTS, SPAN_BYTES * F.size("linked"))
    rows = base.join(linked, "key", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS))))
    zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        part = F.struct(acc["next"].alias("a"), s["start"].alias("b"))
        grown = F.when((s["start"] > acc["next"]) | (F.size(acc["kept"]) == 0), F.array_append(acc["kept"], part)).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["next"], s["end"]).alias("next"), grown.alias("kept"))

    end = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(0).alias("kind"))
    kept = F.aggregate(F.concat(spans, F.array(end)), zero, step, lambda acc: acc["kept"])
    body = F.array_join(F.transform(kept, lambda p: F.substring(F.col("text"), p["a"] + 1, p["b"] - p["a"])), mask)
    clean = F.when(F.size(spans) == 0, F.col("text")).otherwise(body)
    return rows.select(*[clean.alias(c) if c == text else F.col(f"doc.{c}").alias(c) for c in docs.columns])
