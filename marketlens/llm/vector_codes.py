"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are scaled to integers, rounded down, and a vector is cut into ``PARTS`` consecutive parts. Each part
position has a codebook, which starts as that part of the smallest ids and is moved by ``ROUNDS`` of assigning
every part and taking the means. All arithmetic is in whole numbers.

Entries are found by an equal-average search: the squared distance of two parts is at least the squared
difference of their component sums over their dimension. Entries are sorted by component sum; every part of a
batch starts at its own sum and looks at the next entry on either side, the nearer sum first, until that bound is
strictly above its best distance, so that an equally near entry of a lower index is still met.

A round is one scan of the vectors. Tasks send sums and counts per entry only, which are added up before and
after the shuffle; what reaches the driver is one row per component of an entry. Nothing is gathered by label:
errors are summed per label and joined back.

Defined results: vectors that are null or hold a null or non-finite component are dropped. Ids decide the
first entries in ascending order, null ids last, equal ids by their vectors; repeated rows count each. Fewer vectors
than entries give fewer entries. Vectors of one length share codebooks, each length has its own (lengths are
collected: there are few of them); where a length is no multiple of the parts, the first parts are one longer,
and an empty vector has empty parts at a distance of zero. Components of any finite size are
exact; an error above the largest long is given as that. Null labels are one label. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, ship, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BROADCAST_LABELS = 100_000
ROWS, LIMB, TOP = 8_192, 31, (1 << 63) - 1

Books = dict[int, list[np.ndarray]]  # by length of the vectors: the entries of each part position


def bounds(length: int) -> list[int]:
    """Where the parts of a vector begin, and the end."""
    size, longer = divmod(length, PARTS)
    return [i * size + min(i, longer) for i in range(PARTS + 1)]


def integers(flat: np.ndarray, length: int) -> np.ndarray:
    """Rows of whole numbers; as Python's own where squared sums might not fit 64 bits."""
    rows = (-1, length) if length else (0, 0)
    scaled = flat * SCALE
    if not len(flat) or np.abs(scaled).max() < (1 << 30) // -(-length // PARTS):
        return np.floor(scaled).astype(np.int64).reshape(rows)
    whole = [int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE) for x in flat.tolist()]
    return np.array(whole, object).reshape(rows)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the nearest row of entries, the lowest of equals, and the squared distance."""
    if parts.dtype != entries.dtype:
        parts, entries = parts.astype(object), entries.astype(object)
    n, dim = parts.shape
    sums, own = entries.sum(1), parts.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, sorted_entries = sums[order], entries[order]
    right = np.searchsorted(sums, own)
    left = right - 1
    best, index = np.full(n, -1, parts.dtype), np.full(n, len(order))
    live = np.arange(n)
    while True:
        lo, hi, mid = left[live], right[live], own[live]
        below, above = mid - sums[np.maximum(lo, 0)], sums[np.minimum(hi, len(sums) - 1)] - mid
        down = (lo >= 0) & ((hi >= len(sums)) | (below <= above))
        gap, known = np.where(down, below, above), best[live]
        on = ((lo >= 0) | (hi < len(sums))) & ((known < 0) | (gap * gap <= known * dim)).astype(bool)
        live, down, at, known = live[on], down[on], np.where(down, lo, hi)[on], known[on]
        if not len(live):
            return index, best
        apart = parts[live] - sorted_entries[at]
        found, entry = (apart * apart).sum(1), order[at]
        closer = ((known < 0) | (found < known) | ((found == known) & (entry < index[live]))).astype(bool)
        best[live[closer]], index[live[closer]] = found[closer], entry[closer]
        left[live] -= down
        right[live] += ~down


def _assigned(batch: pa.RecordBatch, books: Books) -> Iterator[tuple[np.ndarray, int, np.ndarray, list]]:
    """For the rows of each length: their places, the length, their whole numbers, (entry, distance) per part."""
    vectors = batch.column("vector")
    sizes = np.diff(vectors.offsets.to_numpy())
    for length in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == length)
        rows = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        rows = integers(rows, length) if length else np.zeros((len(places), 0), np.int64)
        cuts = bounds(length)
        yield places, length, rows, [nearest(rows[:, a:b], books[length][k]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in limbs that can be summed as longs."""
    sign, rest, at = (-1, -value, 0) if value < 0 else (1, value, 0)
    while rest:
        yield at, sign * (rest & ((1 << LIMB) - 1))
        rest, at = rest >> LIMB, at + 1


def _sums(books: Books):
    """(length, part, entry, component, limb, total) of a task; component -1 holds the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                for _, length, rows, found in _assigned(whole.slice(start, ROWS), books):
                    cuts = bounds(length)
                    for k, (entry, _) in enumerate(found):
                        own = rows[:, cuts[k] : cuts[k + 1]]
                        counted = np.column_stack([np.ones(len(own), own.dtype), own])
                        now = np.zeros((len(books[length][k]), counted.shape[1]), counted.dtype)
                        np.add.at(now, entry, counted)
                        before = totals.get((length, k))
                        totals[length, k] = now.astype(object) if before is None else before + now
        out = [
            (length, k, entry, at - 1, limb, value) for (length, k), rows in totals.items()
            for entry, row in enumerate(rows.tolist()) if row[0] for at, total in enumerate(row) for limb, value in _limbs(total)
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ["length", "part", "entry", "component", "limb", "total"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def _moved(books: Books, sums: list) -> Books:
    """Entries at the means, rounded down, of the parts assigned to them; an unused entry stays."""
    totals: dict[tuple[int, int, int, int], int] = {}
    for r in sums:
        at = (r["length"], r["part"], r["entry"], r["component"])
        totals[at] = totals.get(at, 0) + (r["total"] << (LIMB * r["limb"]))
    out = {length: [b.astype(object) for b in own] for length, own in books.items()}
    for (length, part, entry, component), count in totals.items():
        if component < 0:
            for i in range(out[length][part].shape[1]):
                out[length][part][entry, i] = totals.get((length, part, entry, i), 0) // count
    return {length: [_narrow(b, length) for b in own] for length, own in out.items()}


def _narrow(entries: np.ndarray, length: int) -> np.ndarray:
    small = not entries.size or abs(entries).max() < (1 << 30) // max(-(-length // PARTS), 1)
    return entries.astype(np.int64) if small else entries.astype(object)


def _coded(books: Books):
    digest = {
        length: hashlib.sha256(",".join(str(x) for entries in own for row in entries.tolist() for x in row).encode()).hexdigest()
        for length, own in books.items()
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                for places, length, _, found in _assigned(part, books):
                    codes = np.column_stack([entry for entry, _ in found]).astype(np.uint8)
                    text = codes.tobytes().hex()
                    error = sum(distance for _, distance in found).tolist()
                    take = pa.array(places)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take), part.column("label").take(take),
                         pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
                         pa.array([min(e, TOP) for e in error], pa.int64()), pa.array([digest[length]] * len(places), pa.string())],
                        names=["id", "label", "code", "error", "digest"])

    return run


def train(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Books:
    """The codebooks of rows (id, vector)."""
    books: Books = {}
    for (length,) in rows.select(F.size("vector")).distinct().collect():
        first = rows.filter(F.size("vector") == length).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries)
        flat = np.array([x for r in first.select("vector").collect() for x in r[0]], np.float64)
        whole = integers(flat, length) if length else np.zeros((min(entries, max(first.count(), 1)), 0), np.int64)
        cuts = bounds(length)
        books[length] = [_narrow(whole[:, a:b], length) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds if books else 0):
        partial = rows.select("vector").mapInArrow(_sums(books), "length int, part int, entry int, component int, limb int, total bigint")
        totals = partial.groupBy("length", "part", "entry", "component", "limb").agg(F.sum("total").alias("total"))
        books = _moved(books, totals.collect())  # some rows per component of an entry
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per vector that is kept."""
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(fine(x), F.lit(False))))
    books = train(rows)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    coded = rows.mapInArrow(_coded(books), f"id {kinds[0]}, label {kinds[1]}, code string, error bigint, digest string")
    coded = stored(coded, "vector-codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.least(whole, F.lit(TOP).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    out = coded.join(broadcast_if_small(errors, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(vec_id), "code", "error", "label_error", F.col("digest").alias("codebooks_sha256"))
