"""Source divergence audit: how far the term rates of the sources of a language lie apart.

Terms are runs of Latin letters and characters beyond ASCII, A-Z in lower case. A language keeps the terms in at
least ``LEAST_DOCUMENTS`` of its documents. A group is a language and a source; its smoothed rate of a kept
term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N the group's count of all V kept terms, and two rates
are f(p, q) = floor((p - q)^2 / (p + q)) apart. Part ``pair`` sums f over all kept terms for every two sources
of a language, part ``term`` lists the terms that a group uses most beyond its language's rate.

The sums are accumulated row by row: blocks of the term-major index (a term with the counts of all
groups) are dealt to tasks, with the totals of the language's groups. Within a block each group takes its terms,
runs through their postings and scatters what they add into one dense accumulator with a place per peer,
so that no pair of postings is ever a row. A term that a group lacks has a rate above zero all the same: the
accumulator starts from these zero baselines, taken over the different counts of a group only, and a posting adds the
difference between its true distance and the baselines of both sides. Blocks give one number per pair, and these are
summed. A language is dealt into as many blocks as its postings need, by a hash of the term, so neither a hot
language or source nor a frequent term is gathered; a posting list is as long as there are sources at most.

Texts are counted in the tasks that read them, into (language, source, term) counts, so that a word costs no row.

Defined results: null texts, languages and sources are empty strings; empty texts make a group without terms;
repeated rows count each; a language without kept terms gives pairs of value 0; a language of one source gives no
pair; ties are ranked by the UTF-8 of the item. Numbers are exact up to 9 x 10^15 words in a language. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.blocks import groups as by_key
from marketlens.llm.common import broadcast_if_small, ship, stored

LEAST_DOCUMENTS, TOP_TERMS = 10, 10
BLOCK, LARGEST_BLOCK = 1 << 14, 1 << 22
HELD_TERMS, BROADCAST_GROUPS = 500_000, 50_000
_DOCUMENT = 1 << 44  # a count of documents and one of words in one number

#: Bytes of terms in lower case, everything else as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _flushed(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in held.items():
        counts = np.fromiter(terms.values(), np.int64, len(terms))
        n = len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()).view(pa.string()),
             pa.array(counts % _DOCUMENT), pa.array(counts // _DOCUMENT)],
            names=["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task, in parts of a bounded number of terms."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            own = held.setdefault((lang, source), {})
            get, before = own.get, len(own)
            for term, n in Counter(text.as_py().translate(_LETTERS).split()).items():
                own[term] = get(term, 0) + n + _DOCUMENT
            size += len(own) - before
            if size > HELD_TERMS:
                yield from _flushed(held)
                held, size = {}, 0
    yield from _flushed(held)


def _rate(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), by long division in three steps of three digits."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 2
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_sums(peers: int, totals: np.ndarray, terms: int, starts: np.ndarray, group: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """For each group of a block the sum of f over the block's terms, one number per peer.

    ``totals`` is N + 2 V of every group; postings ``starts[t]`` to ``starts[t + 1]`` are those of term t.
    """
    p, none = _rate(count, totals[group]), _rate(np.zeros(peers, np.int64), totals)
    own_terms = np.bincount(group, minlength=peers)
    order = np.lexsort((p, group))
    fresh = np.flatnonzero(np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (p[order][1:] != p[order][:-1])))) if len(order) else order
    kind_group, kind_p, kind_n = group[order][fresh], p[order][fresh], np.diff(np.append(fresh, len(order)))
    first_kind = np.searchsorted(kind_group, np.arange(peers + 1))
    term_of = np.repeat(np.arange(terms), np.diff(starts))
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], np.arange(peers + 1))
    for g in range(peers):
        # as if no two groups shared a term: the zero baselines of both sides
        base = _apart(none[g], none)
        row = (terms - own_terms[g] - own_terms) * base
        np.add.at(row, kind_group, _apart(none[g], kind_p) * kind_n)
        for k in range(first_kind[g], first_kind[g + 1]):
            row += _apart(kind_p[k], none) * kind_n[k]
        # the terms of the group through the term-major index
        mine = by_group[first[g] : first[g + 1]]
        begin, size = starts[term_of[mine]], np.diff(starts)[term_of[mine]]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
        here, there, peer = np.repeat(p[mine], size), p[at], group[at]
        np.add.at(row, peer, _apart(here, there) - _apart(none[g], there) - _apart(here, none[peer]) + base[peer])
        yield row


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in by_key(batches, "key"):
        is_group = pc.is_valid(table.column("source"))
        own, index = table.filter(is_group), table.filter(pc.invert(is_group))
        names = own.column("source").combine_chunks()
        peers, lang, kept = len(names), own.column("lang")[0].as_py(), own.column("kept")[0].as_py()
        lists = index.column("postings").combine_chunks()
        flat = lists.flatten()
        group = pc.index_in(flat.field("source"), names).to_numpy(zero_copy_only=False).astype(np.int64)
        count = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        totals = own.column("total").to_numpy() + 2 * kept
        rows = block_sums(peers, totals, len(lists), starts, group, count) if kept else iter(np.zeros((peers, peers), np.int64))
        for g, row in enumerate(rows):
            others = np.flatnonzero(np.arange(peers) != g)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(others), pa.string()), pa.array([names[g].as_py()] * len(others), pa.string()),
                 names.take(pa.array(others)), pa.array(row[others])],
                names=["lang", "source", "item", "value"])


def _sql_rate(count: str, total: str) -> Column:
    wide = "CAST(1000000000 AS DECIMAL(10, 0))"
    return F.expr(f"1 + ({wide} * CAST({count} + 2 AS DECIMAL(18, 0))) DIV ({total} + 2 * kept)")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every pair of sources and the foremost terms of every group."""
    ship(docs.sparkSession)
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = docs.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).cast("binary").alias("text"))
    parts = given.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("docs").alias("docs"))
    index = stored(index.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "term-index")

    postings = index.select("lang", "term", F.explode("postings").alias("p")).select("lang", "term", "p.source", "p.n")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    kept = index.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("kept"))
    groups = groups.join(kept, F.col("lang") == F.col("of"), "left").drop("of").fillna(0, ["kept"])
    sizes = groups.groupBy(F.col("lang").alias("of")).agg(
        F.sum("total").alias("lang_total"), F.sum("terms").alias("all_terms"), F.count(F.lit(1)).alias("peers"))
    most = F.greatest(F.lit(BLOCK), F.least(F.col("peers") * F.col("peers"), F.lit(LARGEST_BLOCK)))
    sizes = sizes.select("of", "lang_total", F.greatest(F.ceil(F.col("all_terms") / most), F.lit(1)).cast("int").alias("blocks"))
    groups = stored(groups.join(sizes, F.col("lang") == F.col("of")).drop("of"), "groups")

    key = F.concat_ws("\0", "block", "lang")
    blocks = groups.select("lang", "blocks").distinct()
    dealt = index.join(broadcast_if_small(blocks, BROADCAST_GROUPS, "lang"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "postings",
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("kept"))
    none = F.lit(None).cast(index.schema["postings"].dataType)
    peers = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none.alias("postings"), "source", "total", "kept")
    work = dealt.unionByName(peers).withColumn("key", key).drop("block").repartition("key").sortWithinPartitions("key")
    partial = work.mapInArrow(_accumulated, "lang string, source string, item string, value bigint")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    whole = F.aggregate("postings", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    used = index.select("lang", "term", whole.alias("lang_n"), F.explode("postings").alias("p")).select("lang", "term", "lang_n", "p.source", "p.n")
    totals = groups.select("lang", "source", "total", "lang_total", "kept")
    used = used.join(broadcast_if_small(totals, BROADCAST_GROUPS, "lang", "source"), ["lang", "source"])
    used = used.withColumn("p", _sql_rate("n", "total")).withColumn("q", _sql_rate("lang_n", "lang_total")).filter("p > q")
    terms = used.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) DIV (p + q)").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    number = F.row_number().over(ranked)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", number.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", number.alias("rank")).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
