"""N-gram Jaccard join: pairs of texts whose sets of word n-grams are alike, found by MinHash banding.

Texts with the same set form a class and travel as one row. Minimum hashes of a class are
grouped in bands; the number of rows a band has, and of bands, follow from the recall asked
for at the threshold. Classes are shuffled on the hashes of their bands, and those that
meet in a band form candidate groups, whose pairs are verified on the full sets. Groups that hang together are
compared as one, each set travelling once, where they fit one block or where that takes at most twice the pairs that the
bands propose, as among near copies. Where they hang together by shared passages only, each band's group is
compared by itself, and a pair that meets in several is taken in the first.

No group is held whole and no pair is written out. A group is dealt by the size of its sets (a
pair's sizes differ by at most the threshold's factor) and then by hash into blocks of bounded
size; a task compares two blocks through products of presence matrices and gives back, per
class, its number of links and one representative it is linked with. A set is shuffled once per
block that it meets. Links and groups are thus complete for whatever candidates there
are, however large a group of near copies is.

Defined results: a null or wordless text links with nothing and is kept; the same set, in
whatever order, is a link of similarity 1; of a group the row with the smallest doc_id stays
(null ids last, then the first row read); repeated rows count as further documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, ship, small_batches, stored
from marketlens.llm.components import components
from marketlens.llm.shingles import mixed, shingle_sets, text_slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
MOST_HASHES = 160
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 1_000
BROADCAST_CLASSES = 500_000
BROADCAST_NUMBERS = 4_000_000


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall with so many hashes at most."""
    fit = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 30)]
    return max((x for x in fit if x[0] * x[1] <= most), key=lambda x: x[1])


def _signatures(n_words: int, n_bands: int, n_rows: int):
    rng = np.random.default_rng(20240501)
    factors = rng.integers(0, 2**63, n_bands * n_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = mixed(np.arange(1, n_bands * n_rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                flat, at = shingle_sets(batch.column("text"), n_words)
                sizes = np.diff(at)
                some = np.flatnonzero(sizes)
                starts = at[:-1][some]
                keys = np.zeros((2, batch.num_rows), np.uint64)
                found = np.zeros((batch.num_rows, n_bands), np.uint64)
                if len(some):
                    keys[0, some] = np.add.reduceat(mixed(flat ^ np.uint64(0x1234567)), starts)
                    keys[1, some] = np.add.reduceat(mixed(flat * np.uint64(3)), starts)
                    for i, factor in enumerate(factors):
                        least = np.minimum.reduceat(flat * factor, starts)
                        found[some, i // n_rows] += least * weights[i]
                    found[some] = mixed(found[some] + np.arange(1, n_bands + 1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), batch.column("doc_id"),
                    pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * n_bands).astype(np.int32)), pa.array(found.reshape(-1).view(np.int64))),
                ], names=["row", "doc_id", "a", "b", "n", "bands"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                flat, at = shingle_sets(batch.column("text"), n_words)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                offsets = np.concatenate((at[:-1][some], at[-1:])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(some)), batch.column("groups").take(pa.array(some)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                    names=["cid", "groups", "grams"])

    return run


def _compare(threshold: float):
    """Links between two blocks: per class the rows it is linked with and the smallest class reached within the blocks."""

    def common(left: list, right: list | None) -> np.ndarray:
        """How many values each list on the left shares with each on the right, or with each other on the left."""
        sides = (left,) if right is None else (left, right)
        counts = np.zeros((len(left), len(sides[-1])), np.float32)
        values, places = np.unique(np.concatenate([*left, *(right or [])]), return_inverse=True)
        rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides]
        cols = [places] if right is None else np.split(places, [len(rows[0])])
        if right is None:
            shared = np.bincount(places, minlength=len(values)) > 1
        else:
            shared = (np.bincount(cols[0], minlength=len(values)) > 0) & (np.bincount(cols[1], minlength=len(values)) > 0)
        number = np.cumsum(shared) - 1
        cells = [(r[k], number[c[k]]) for r, c in zip(rows, cols, strict=True) for k in [shared[c]]]
        width = 2048
        by_col = [(r[o], c[o]) for r, c in cells for o in [np.argsort(c, kind="stable")]]
        for at in range(0, int(shared.sum()), width):
            parts = []
            for (r, c), s in zip(by_col, sides, strict=True):
                i, j = np.searchsorted(c, (at, at + width))
                m = np.zeros((len(s), width), np.float32)
                m[r[i:j], c[i:j] - at] = 1
                parts.append(m)
            counts += parts[0] @ parts[-1].T
        return counts

    def some(side: dict, rows: np.ndarray) -> dict:
        return {k: v[rows] if isinstance(v, np.ndarray) else [v[i] for i in rows] for k, v in side.items()}

    def links(x: dict, y: dict | None, part: int) -> tuple[list, list, list]:
        taken = None
        earlier = [[g[g < part] for g in s["groups"]] for s in ((x, y) if y else (x,))]
        if sum(map(len, earlier[0])) and sum(map(len, earlier[-1])):  # pairs that meet in an earlier group were taken there
            taken = common(earlier[0], earlier[1] if y else None) > 0
            free = ~taken
            if not y:
                np.fill_diagonal(free, False)
            i, j = np.flatnonzero(free.any(1)), np.flatnonzero(free.any(0))
            taken, x, y = taken[np.ix_(i, j)], some(x, i), some(y, j) if y else None
        left, right = x, y or x
        if not len(left["cid"]) or not len(right["cid"]):
            return [], [], []
        counts = common(left["grams"], y["grams"] if y else None)
        both = np.array([len(g) for g in left["grams"]])[:, None] + np.array([len(g) for g in right["grams"]])[None, :]
        linked = counts >= threshold * (both - counts) - 1e-6
        if not y:
            np.fill_diagonal(linked, False)
        linked &= left["cid"][:, None] != right["cid"][None, :]
        if taken is not None:
            linked &= ~taken
        top = np.iinfo(np.int64).max
        lab_l, lab_r = left["cid"].copy(), right["cid"].copy()
        while True:
            new_l = np.minimum(lab_l, np.where(linked, lab_r[None, :], top).min(1))
            new_r = np.minimum(lab_r, np.where(linked, new_l[:, None], top).min(0))
            if not y:
                new_l = new_r = np.minimum(new_l, new_r)
            if (new_l == lab_l).all() and (new_r == lab_r).all():
                break
            lab_l, lab_r = new_l, new_r
        out = [(left["cid"], linked @ right["size"], lab_l)] + ([(right["cid"], left["size"] @ linked, lab_r)] if y else [])
        cid, n, root = (np.concatenate(z) for z in zip(*out, strict=True))
        return cid[n > 0], n[n > 0], root[n > 0]

    def block(table: pa.Table, side: int) -> dict | None:
        rows = table.filter(pa.compute.equal(table.column("side"), side)).combine_chunks()
        cid = rows.column("cid").to_numpy()
        if not len(cid):
            return None

        def lists(name: str) -> list[np.ndarray]:
            values = rows.column(name).combine_chunks()
            flat, at = values.flatten().to_numpy(), np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy())))
            return [flat[at[i] : at[i + 1]] for i in range(len(cid))]

        return {"cid": cid, "size": rows.column("size").to_numpy(), "grams": lists("grams"), "groups": lists("groups")}

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = block(table, 0), block(table, 1)
        if not left or (right is None and not table.column("own")[0].as_py()):
            return
        cid, n, root = links(left, right, table.column("part")[0].as_py())
        if len(cid):
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n.astype(np.int64)), pa.array(root)], names=["cid", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = batch.column("pair").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    if keys[i] != key and held:
                        yield from group(pa.Table.from_batches(held))
                        held = []
                    key = keys[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from group(pa.Table.from_batches(held))

    return run


def _meetings(heads: DataFrame) -> DataFrame:
    """(cid, h, v) of the classes that share a band's hash with another; v is the smallest of them."""
    met = heads.groupBy("h").agg(F.min("cid").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return stored(heads.join(met, "h").select("cid", "h", "v"), "meetings")


def _parts(members: DataFrame, meetings: DataFrame, n_bands: int) -> DataFrame:
    """(cid, n, size, part, groups): the parts within which classes (cid, n, size, root) are compared.

    A component that fits one block, or has at most twice as many pairs as its bands propose, is one part. Any other has a part for
    each group of a band, one for groups of the same members; ``groups`` lists those of a class, at most one per band.
    """
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    groups = meetings.groupBy("h").agg(
        F.min("v").alias("cid"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
    ids = members.select("cid", "root")
    proposed = groups.join(ids, "cid").groupBy("root").agg(F.sum(pairs("c")).alias("proposed"))
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams")).filter(
        (F.col("k") > BLOCK_ROWS) | (F.col("grams") > BLOCK_SHINGLES))
    # a pair meets in n_bands groups at most, so the sum divided by them is at most the number of different pairs
    loose = stored(large.join(proposed, "root").filter(pairs("k") > 2 * F.col("proposed") / n_bands).select("root"), "loose-components")
    none = F.array().cast("array<bigint>")
    if loose.isEmpty():
        return members.select("cid", "n", "size", F.xxhash64(F.lit("component"), "root").alias("part"), none.alias("groups"))
    loose = broadcast_if_small(loose, BROADCAST_CLASSES)
    apart = stored(members.join(loose, "root", "left_semi").select("cid", "n", "size"), "loose-classes")
    whole = members.join(loose, "root", "left_anti").select("cid", "n", "size", F.xxhash64(F.lit("component"), "root").alias("part"), none.alias("groups"))
    chosen = groups.join(apart.select("cid"), "cid", "left_semi").groupBy("c", "x", "y").agg(F.min("h").alias("h"))
    found = stored(meetings.join(chosen.select("h"), "h", "left_semi").select("cid", F.col("h").alias("part")), "loose-groups")
    lists = found.groupBy("cid").agg(F.sort_array(F.collect_list("part")).alias("groups"))
    return whole.unionByName(found.join(apart, "cid").join(lists, "cid").select("cid", "n", "size", "part", "groups"))


def _block_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """A row for each pair of blocks that a class takes part in: (pair, side, own)."""
    level = F.floor(F.log("n") / (math.log(1 / threshold) + 1e-9)).cast("int")
    members = members.withColumn("level", level)
    cells = members.groupBy("part", "level").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    near = lambda by, name: cells.select("part", (F.col("level") + by).alias("level"), F.col("blocks").alias(name))
    cells = cells.join(near(1, "below"), ["part", "level"], "left").join(near(-1, "above"), ["part", "level"], "left")
    cells = broadcast_if_small(stored(cells, "cells"), BROADCAST_CLASSES)  # a large group is not gathered by its number
    m = members.join(cells, ["part", "level"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def pair(low_level, low, high_level, high, side, own):
        return F.struct(F.xxhash64("part", low_level, low, high_level, high).alias("pair"), side.alias("side"), own.alias("own"))

    own = F.transform(upto("blocks"), lambda j: pair(
        F.col("level"), F.least("block", j), F.col("level"), F.greatest("block", j),
        F.when(j < F.col("block"), 1).otherwise(0), j == F.col("block")))
    above = F.transform(upto("above"), lambda j: pair(F.col("level"), F.col("block"), F.col("level") + 1, j, F.lit(0), F.lit(False)))
    below = F.transform(upto("below"), lambda j: pair(F.col("level") - 1, j, F.col("level"), F.col("block"), F.lit(1), F.lit(False)))
    return m.select("cid", "size", "part", F.explode(F.concat(own, above, below)).alias("p")).select("cid", "size", "part", "p.*")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS,
         threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(row, doc_id, n_links, class_id, group_id, kept) per document; ``row`` is a number of its own for each."""
    return _joined(_numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "doc_id", "text", n_words, threshold, recall)


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc) written down: numbers are given once, as another read of ``docs`` may deal its rows out differently."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered-documents")


def _joined(numbered: DataFrame, doc_id: str, text: str, n_words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    ship(numbered.sparkSession)
    n_bands, n_rows = bands(threshold, recall)
    given = numbered.select("row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    with small_batches(numbered.sparkSession):
        rows = stored(given.mapInArrow(
            _signatures(n_words, n_bands, n_rows), f"row bigint, doc_id {kind}, a bigint, b bigint, n int, bands array<bigint>"), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = stored(rows.filter("n > 0").groupBy("a", "b", "n").agg(
        F.min("row").alias("cid"), F.count(F.lit(1)).alias("size"), F.min(first).alias("first")), "classes")

    heads = rows.join(classes.select(F.col("cid").alias("row")), "row").select(F.col("row").alias("cid"), F.explode("bands").alias("h"))
    meetings = _meetings(heads)
    candidates = components(meetings.select(F.col("cid").alias("u"), "v"))

    members = classes.join(candidates.withColumnRenamed("node", "cid"), "cid").select("cid", "n", "size", "root")
    parts = stored(_parts(members, meetings, n_bands), "parts")
    pairs = stored(_block_pairs(parts, threshold), "block-pairs")
    wanted = stored(parts.select(F.col("cid").alias("row"), "groups").dropDuplicates(["row"]), "candidates")
    numbers = wanted.agg(F.sum(F.size("groups") + 2)).first()[0] or 0
    texts = given.select("row", "text").join(F.broadcast(wanted) if numbers <= BROADCAST_NUMBERS else wanted, "row")  # the one row of each class
    sets = texts.mapInArrow(_sets(n_words), "cid bigint, groups array<bigint>, grams array<bigint>")
    work = sets.join(broadcast_if_small(pairs, BROADCAST_CLASSES), "cid").select("pair", "side", "own", "part", "cid", "size", "groups", "grams")
    with small_batches(numbered.sparkSession):
        found = stored(work.repartition("pair").sortWithinPartitions("pair").mapInArrow(_compare(threshold), "cid bigint, links bigint, root bigint"), "links")

    linked = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    info = classes.join(counts, "cid", "left").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = info.groupBy("root").agg(F.min("first").alias("head"))
    info = info.join(heads, "root").select(
        "a", "b", "n", "first", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("row", "doc_id", "a", "b", "n").join(info, ["a", "b", "n"], "left")
    alone = F.col("n") == 0
    return out.select(
        "row", "doc_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that ``join`` keeps, one of each group, with all their columns. ``docs`` is read once."""
    boxed = _numbered(docs)
    gone = _joined(boxed, doc_id, text, **how).filter(~F.col("kept")).select(F.col("row").alias("gone"))
    gone = broadcast_if_small(stored(gone, "dropped-rows"), BROADCAST_CLASSES)
    return boxed.join(gone, F.col("row") == F.col("gone"), "left_anti").select("doc.*")
