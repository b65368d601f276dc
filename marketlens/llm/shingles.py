"""Word n-grams of Arrow text columns as 64-bit hashes, by whole-array arithmetic.

Words are runs of digits, Latin letters and characters beyond ASCII, A-Z in lower case. A
word's hash is a polynomial of its bytes, got from running sums over the whole buffer; an
n-gram's hash is a polynomial of its words' hashes. A text of fewer words than n, but
not none, has one n-gram of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT, MOST_ROWS = 1 << 18, 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_CODE = np.zeros(256, np.uint64)  # 0: between words
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _CODE[_b] = _b + 1
    elif 65 <= _b <= 90:
        _CODE[_b] = _b + 33
_IS_WORD = _CODE > 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            cache[key] = np.multiply.accumulate(steps)
    return cache["p"], cache["i"]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20, rows: int = MOST_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows whose texts hold about ``limit`` bytes at most; a longer text is alone."""
    sizes = np.diff(_buffer(batch.column(column))[1])
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        stop = min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each row's first word and the end)."""
    data, offsets = _buffer(texts)
    found, places, at = [], [], 0
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        while stop < len(data) and not row_start[stop] and _IS_WORD[data[stop]] and _IS_WORD[data[stop - 1]]:
            more = np.flatnonzero(~_IS_WORD[data[stop : stop + 4096]] | row_start[stop : stop + len(data[stop : stop + 4096])])
            stop = stop + int(more[0]) if len(more) else min(len(data), stop + 4096)
        part, first = data[at:stop], row_start[at : stop + 1]
        word = _IS_WORD[part]
        begins = word & np.concatenate(([True], ~word[:-1] | first[1:-1]))
        ends = word & np.concatenate((~word[1:] | first[1:-1], [True]))
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        power, inverse = _powers(max(len(part), SEGMENT + 4096))
        sums = np.cumsum(_CODE[part] * power[: len(part)], dtype=np.uint64)
        values = (sums[e] - np.where(b > 0, sums[np.maximum(b, 1) - 1], np.uint64(0))) * inverse[b]
        found.append(mixed(values))
        places.append(b + at)
        at = stop
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, each row's without repeats and sorted; index of each row's first and the end)."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    grams = np.zeros(len(words), np.uint64)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    for j, factor in enumerate(np.multiply.accumulate(np.full(n, _STEP, np.uint64))):
        grams += padded[j : j + len(words)] * factor
    grams = mixed(grams)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for row, (start, count) in enumerate(zip(at[:-1], counts, strict=True)):
        if count >= n:
            own = np.unique(grams[start : start + count - n + 1])
        elif count:
            own = np.array([_short(words[start : start + count])], np.uint64)
        else:
            continue
        sets.append(own)
        sizes[row] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def _short(words: np.ndarray) -> np.uint64:
    factors = np.multiply.accumulate(np.full(len(words), _STEP, np.uint64))
    return mixed((words * factors).sum(keepdims=True) + np.uint64(len(words)))[0]
