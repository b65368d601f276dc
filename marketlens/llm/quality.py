"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

A text gives ``len(STATISTICS)`` numbers, computed for whole batches by array arithmetic. They are
written down once; training reads the few that have a label, scoring all of them. Training bins each
statistic at quantiles and grows trees of fixed depth on histograms of gradients; the trees are complete,
so a model is three arrays and a batch is scored by walking all its rows down one tree at a
time, level by level.

Learning takes a bounded sample, ``MOST_ROWS`` labelled rows chosen by a hash of their id; statistics
and scores cover every text in whole.

Defined results: a null text counts as empty; empty texts have statistics of zero and a score like any
other; labels other than 0 and 1 are not learned from; several labels of a document count by their mean;
with no label at all every score is 0.5; a null id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ship, stored
from marketlens.llm.language_id import held_out
from marketlens.llm.shingles import MOST_ROWS as SLICE
from marketlens.llm.shingles import _buffer, text_slices, word_hashes

FOLDS, HELD_OUT, CUT = 4, 2, 0.7
MOST_ROWS = 50_000
TREES, DEPTH, BINS, RATE, PENALTY, LEAST = 120, 4, 64, 0.1, 1.0, 5.0

#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "line": b"\n\r", "stop": b".,;:", "loud": b"!?", "sign": b"#$%&*@^~_=+", "bar": b"|<>{}[]\\/()",
    "quote": b"\"'`-",
}
STATISTICS = (
    *CLASSES, "beyond_ascii", "log_bytes", "log_words", "word_bytes", "words_per_line", "different_words", "different_pairs",
    "commonest_word", "word_repeats", "sign_per_word", "bar_per_word", "loud_per_word", "upper_per_letter", "stop_per_word",
)

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _letters in enumerate(CLASSES.values()):
    _CLASS[list(_letters)] = _k
_CLASS[128:] = len(CLASSES) + 1


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different values, and how often the commonest occurs. ``text_slices`` hands out 2^14 rows at most."""
    if n > SLICE:
        raise ValueError(f"{n} rows at once, {SLICE} at most")
    if not len(value):
        return np.zeros(n), np.zeros(n)
    key = np.sort(row.astype(np.uint64) << np.uint64(50) | value >> np.uint64(14))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner = (key[first] >> np.uint64(50)).astype(np.int64)
    often = np.diff(np.append(first, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, owner, often)
    return np.bincount(owner, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    data, offsets = _buffer(texts)
    n, size = len(texts), np.diff(offsets).astype(np.float64)
    kind = _CLASS[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * 16 + kind, minlength=16 * n).reshape(n, 16).astype(np.float64)
    words, at = word_hashes(texts)
    n_words = np.diff(at).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(at))
    different, most = _distinct(owner, words, n)
    same = owner[1:] == owner[:-1]
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ (words[1:] >> np.uint64(31))))[same]
    different_pairs, _ = _distinct(owner[:-1][same], pairs, n)
    repeats = np.bincount(owner[:-1][same], weights=(words[1:] == words[:-1])[same], minlength=n)
    some, any_word = np.maximum(size, 1), np.maximum(n_words, 1)
    c = dict(zip(CLASSES, counts.T, strict=False))
    beyond = counts[:, len(CLASSES) + 1]
    letters = np.maximum(c["upper"] + c["lower"] + beyond / 2, 1)
    return np.column_stack([
        *[c[k] / some for k in CLASSES], beyond / some, np.log1p(size), np.log1p(n_words),
        (c["upper"] + c["lower"] + c["digit"] + beyond) / any_word, n_words / (c["line"] + 1), different / any_word,
        different_pairs / np.maximum(n_words - 1, 1), most / any_word, repeats / any_word, c["sign"] / any_word, c["bar"] / any_word,
        c["loud"] / any_word, c["upper"] / letters, c["stop"] / any_word,
    ]).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(STATISTICS)
    for whole in batches:
        for batch in text_slices(whole, "text"):
            values = statistics(batch.column("text"))
            offsets = pa.array((np.arange(len(values) + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))], names=["id", "stats"])


class Trees:
    """Complete trees of one depth: the statistic and the cut of each inner node, the value of each leaf."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.cut, self.leaf = start, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees of the logistic loss on binned statistics."""
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if not len(y):
        return none
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    none.start = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin b: up to and with cut b
    n, width = x.shape
    flat = binned + np.arange(width) * BINS
    total = np.full(n, none.start)
    model = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, width), many * width * BINS).reshape(many, width, BINS).cumsum(2)
            h = np.bincount(at, np.repeat(hess, width), many * width * BINS).reshape(many, width, BINS).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (gt - g) ** 2 / (ht - h + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(h < LEAST * 0.05) | (ht - h < LEAST * 0.05)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, grad, leaves) / (np.bincount(leaf_of, hess, leaves) + PENALTY)
        total += leaf[leaf_of]
        model.append((feature, cut, leaf))
    return Trees(none.start, *(np.array(z) for z in zip(*model, strict=True)))


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document, learned from the labels of rows that are not held out."""
    ship(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    stats = stored(given.mapInArrow(_measured, f"id {kind}, stats array<float>"), "statistics")
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
    marks = marks.filter(F.col("id").isNotNull() & ~held_out("id", FOLDS, HELD_OUT)).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = marks.count()
    if n > MOST_ROWS:
        marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(MOST_ROWS / n * (1 << 30)))
    rows = stats.join(marks, "id").select("id", "stats", "label").limit(2 * MOST_ROWS).toArrow().sort_by("id")
    x = rows.column("stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    model = fit(x, rows.column("label").to_numpy().astype(np.float64))
    out = stats.mapInArrow(_scored(model), f"id {kind}, score double")
    return out.select(
        F.col("id").alias(doc_id), held_out("id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
