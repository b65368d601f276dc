"""Comparing two bounded blocks of rows within a task: groups of a sorted partition, labels of linked rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of a partition sorted by it. One group is held at a time."""
    held, last = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j == i:
                continue
            if held and keys[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the left and right block the smallest id that links within the blocks reach.

    ``right`` is None where a block is compared with itself.
    """
    top = np.iinfo(np.int64).max
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    out_l, out_r = left.copy(), (left if right is None else right).copy()
    if not len(rows):
        return out_l, out_r
    sub = linked[np.ix_(rows, cols)]
    a, b = out_l[rows], out_r[cols]
    while True:
        new_a = np.minimum(a, np.where(sub, b[None, :], top).min(1))
        new_b = np.minimum(b, np.where(sub, new_a[:, None], top).min(0))
        if right is None:  # rows and columns are the same ids
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    out_l[rows], out_r[cols] = a, b
    return out_l, out_r
