"""Exact metric range join of embeddings: every pair of vectors with a cosine of at least the threshold.

Equal vectors form a class and travel as one row. On the unit sphere the angle is a metric: each vector
belongs to the cell of its nearest pivot, and a vector can be within reach of one on the
other side of the boundary between two cells only if its own angle to that boundary is no more
than the threshold's. So much is replicated, to cells of a lower number only, which sees each
pair once; cells are then joined independently of each other. Pivots come from a
bounded sample and decide nothing but the work; vectors with no structure at all (uniform
in many dimensions) leave no boundary out of reach, and the join is then a full comparison in blocks.

A cell is dealt into blocks of at most about ``BLOCK`` vectors; a task compares two of them by one
matrix product in single precision, and decides pairs near the threshold in double precision.
It returns per class its number of links and one class it is connected with, never pairs.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are a component of their own; vectors of different length never link; equal vectors are links of
each other, also under a repeated id; null ids do not name a component unless nothing else does, and
only then such a row is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.blocks import groups, labels
from marketlens.llm.common import ship, stored
from marketlens.llm.components import components

THRESHOLD = 0.9
CELL, MOST_PIVOTS = 4_000, 512
BLOCK = 2_048


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of unit length, in double precision. All lists have the same length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _cells(pivots: list[list[float]], threshold: float):
    """(cell, home) rows: each vector in its own cell, and in lower ones whose boundary it is near."""
    by_length: dict[int, np.ndarray] = {}
    for p in pivots:
        by_length.setdefault(len(p), []).append(p)
    by_length = {k: _matrix(pa.array(v, pa.list_(pa.float64()))) for k, v in by_length.items()}
    reach = math.sqrt(1 - threshold**2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column("vector").offsets.to_numpy())
            for length in np.unique(sizes):
                for start in range(0, whole.num_rows, 8192):
                    part = whole.slice(start, 8192)
                    pick = np.flatnonzero(sizes[start : start + 8192] == length)
                    if not len(pick):
                        continue
                    batch = part.take(pa.array(pick))
                    p = by_length.get(int(length))
                    if p is None:
                        row, cell, home = np.arange(len(pick)), np.zeros(len(pick), np.int64), np.ones(len(pick), bool)
                    else:
                        near = _matrix(batch.column("vector")) @ p.T
                        own = near.argmax(1)
                        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                        lean = near[np.arange(len(pick)), own][:, None] - near
                        # the slack: pivots of one direction are apart by rounding only, and lean is noise between them
                        inside = (lean <= reach * apart[own] + 1e-7) & (np.arange(len(p))[None, :] < own[:, None])
                        inside[np.arange(len(pick)), own] = True
                        row, cell = np.nonzero(inside)
                        home = cell == own[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), length, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home),
                         *[batch.column(c).take(pa.array(row)) for c in ("cid", "size", "vector")]],
                        names=["length", "cell", "home", "cid", "size", "vector"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    slack = 1e-6 + 2e-7 * x.shape[1]
    close = x.astype(np.float32) @ y.astype(np.float32).T
    out = close >= threshold + slack
    near = np.flatnonzero(np.abs(close.ravel() - threshold) < slack)
    i, j = np.divmod(near, close.shape[1])
    for at in range(0, len(near), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        out[a, b] = (x[a] * y[b]).sum(1) >= threshold
    return out


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "pair"):
            side = table.column("side").to_numpy()
            cid, size = (table.column(c).to_numpy() for c in ("cid", "size"))
            m = _matrix(table.column("vector").combine_chunks())
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            own = bool(table.column("own")[0].as_py())
            if not len(left) or not (own or len(right)):
                continue
            if own:
                linked = _linked(m[left], m[left], threshold)
                linked |= linked.T
                np.fill_diagonal(linked, False)
                found = [(cid[left], linked @ size[left], labels(linked, cid[left], None)[0])]
            else:
                linked = _linked(m[left], m[right], threshold)
                a, b = labels(linked, cid[left], cid[right])
                found = [(cid[left], linked @ size[right], a), (cid[right], size[left] @ linked, b)]
            ids, n, root = (np.concatenate(z) for z in zip(*found, strict=True))
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(z[n > 0].astype(np.int64)) for z in (ids, n, root)], names=["cid", "links", "root"])

    return run


def join(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = (F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(ok, F.lit(False)), F.col("vector")))
    classes = rows.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    n = classes.count()
    wanted = min(MOST_PIVOTS, -(-n // CELL))
    sample = classes.orderBy(F.xxhash64("vector"), "cid").limit(wanted).select("vector") if wanted > 1 else None
    pivots = [list(r[0]) for r in sample.collect()] if sample else []  # at most MOST_PIVOTS vectors
    kind = classes.schema["vector"].dataType.simpleString()
    dealt = classes.select("cid", "size", "vector").mapInArrow(
        _cells(pivots, threshold), f"length int, cell int, home boolean, cid bigint, size bigint, vector {kind}")
    counts = dealt.groupBy("length", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("guests"))
    m = dealt.join(F.broadcast(stored(counts, "cells")), ["length", "cell"])  # at most MOST_PIVOTS rows per length
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    spot = F.pmod(F.xxhash64("cid"), F.greatest(F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")), F.lit(1))).cast("int")

    def pair(kind: int, i, j, side, own):
        return F.struct(F.xxhash64("length", "cell", F.lit(kind), i, j).alias("pair"), side.alias("side"), own.alias("own"))

    among = F.transform(upto("homes"), lambda j: pair(
        0, F.least("spot", j), F.greatest("spot", j), F.when(j < F.col("spot"), 1).otherwise(0), j == F.col("spot")))
    host = F.transform(upto("guests"), lambda j: pair(1, F.col("spot"), j, F.lit(0), F.lit(False)))
    guest = F.transform(upto("homes"), lambda i: pair(1, i, F.col("spot"), F.lit(1), F.lit(False)))
    m = m.withColumn("spot", spot).select("cid", "size", "vector", F.explode(F.when(F.col("home"), F.concat(among, host)).otherwise(guest)).alias("p"))
    work = m.select("cid", "size", "vector", "p.*").repartition("pair").sortWithinPartitions("pair")
    found = stored(work.mapInArrow(_compare(threshold), "cid bigint, links bigint, root bigint"), "vector-links")

    parts = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    info = classes.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(parts, "cid", "left")
    info = info.withColumn("root", F.coalesce("root", "cid"))
    heads = info.groupBy("root").agg(F.min("first").alias("head"))
    info = info.join(heads, "root").select("vector", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(info, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("head"))
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
