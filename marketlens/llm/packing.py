"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

A document is its token ids and one end id. Only one longer than a sequence is cut, into pieces of
the full length; its first piece may be shorter. What decides a packing is how many pieces there are of each length,
a table of at most ``limit`` rows however large the corpus, so that alone goes to the driver.
There, bin completion takes the largest length left and goes through its fillings of every sum, the highest
sum and the largest pieces first. A filling is dominated, and left out, where one or two of its pieces could be
exchanged for one left over that is as large together or larger and fits. A filling is used as often as the counts
allow, and in other branches fewer times; fillings of the same length follow each other in their order,
as their sequences can be exchanged. The branch-and-bound search
starts from the better of two incumbents, best-fit decreasing and completion from the small side: pieces beyond a cut
are packed among themselves, and of the others the largest is joined by the smallest ones and then by the pair that wastes least,
so that sequences hold as many pieces as they can; the cut is sought among quantiles. The search follows the best filling first and prunes branches whose
waste already costs a sequence more than the incumbent may. It runs twice: with the first ``FIRST`` fillings of the
highest sum for a better incumbent, then with all of them. It ends at the lower bound, when all is searched (the
plan is then optimal) or after looking at ``NODES`` fillings each time; the best plan found is used.

The pieces then find their places by their number among those of the same length: numbers
within a task come from tokenising, those of the tasks before it from a sum of counts per task. No
length, however common, is gathered anywhere.

A null text is empty; an empty one is a piece of the end id alone. Repeated documents are
packed each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import bpe
from marketlens.llm.common import ship, small_batches, stored
from marketlens.llm.shingles import text_slices

LIMIT, END_ID = 2048, 0
NODES, FIRST, OPEN = 10_000, 3, 50
CUTS = 24

Pattern = list[tuple[int, int]]  # (length, how many)


def _tokenised(path: str, limit: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = bpe.encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
                rows = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32", "nth")}
                for at, text in enumerate(texts):
                    ids = encode(text).tobytes() + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % limit or limit, n + 1, limit)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for k, v in zip(rows, (at, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]), strict=True):
                            rows[k].append(v)
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()),
                     *[pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32", "nth")],
                     pa.array(np.full(len(rows["at"]), task, np.int32))],
                    names=["id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return run


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over lengths: (times, pattern). A pattern takes the largest piece that fits, again and again."""
    left, plan = dict(sorted(counts.items(), reverse=True)), []
    while left:
        room, pattern = limit, []
        for length, n in left.items():
            c = min(n, room // length)
            if c:
                pattern.append((length, c))
                room -= c * length
        plan.append(_use(left, pattern))
    return plan


def _best_pair(lengths: list[int], free: Callable[[int], int], room: int) -> tuple[int, ...]:
    """The two free pieces that fill the room best, the more unequal of equals; otherwise the largest one that fits."""
    i, j, best = 0, bisect_right(lengths, room) - 1, (room + 1,)
    top = j
    while i <= j:
        a, b = lengths[i], lengths[j]
        if not free(a):
            i += 1
        elif not free(b) or a + b > room:
            j -= 1
        elif i == j and free(a) < 2:
            break
        else:
            if room - a - b < best[0]:
                best = (room - a - b, a, b)
            if not best[0]:
                break
            i += 1
    if len(best) > 1:
        return best[1:]
    return next(((lengths[k],) for k in range(top, -1, -1) if free(lengths[k])), ())


def small_side(counts: dict[int, int], limit: int, cut: int) -> list[tuple[int, Pattern]]:
    """Pieces beyond the cut by best fit; then the largest one left, the smallest ones, and the best pair last."""
    plan = best_fit({x: n for x, n in counts.items() if x > cut}, limit)
    left = dict(sorted((x, n) for x, n in counts.items() if x <= cut))
    lengths = list(left)
    while lengths:
        own, room, i = {lengths[-1]: 1}, limit - lengths[-1], 0
        free = lambda x: left[x] - own.get(x, 0)  # noqa: B023, E731
        while True:
            while i < len(lengths) and not free(lengths[i]):
                i += 1
            if i == len(lengths) or lengths[i] > room:
                break
            for x in (lengths[i],) if 3 * lengths[i] <= room else _best_pair(lengths, free, room):
                own[x] = own.get(x, 0) + 1
                room -= x
        step = _use(left, sorted(own.items(), reverse=True))
        for x, _ in step[1]:
            if x not in left:
                del lengths[bisect_left(lengths, x)]
        plan.append(step)
    return plan


def _incumbent(counts: dict[int, int], limit: int, least: int) -> list[tuple[int, Pattern]]:
    """The best plan of best fit and of the small side at several cuts, the best cut's neighbours among them."""
    size = lambda plan: sum(t for t, _ in plan)
    best = best_fit(counts, limit)
    if size(best) == least:
        return best
    lengths, ends = sorted(counts), []
    for x in lengths:
        ends.append(counts[x] + (ends[-1] if ends else 0))
    at = lambda share: lengths[bisect_left(ends, share * ends[-1])]
    tried = {}
    for shares in ([k / CUTS for k in range(1, CUTS + 1)], None):
        if shares is None:  # between the neighbours of the best so far
            middle = min(tried, key=lambda share: size(tried[share]))
            shares = [middle + k / (4 * CUTS) for k in (-3, -2, -1, 1, 2, 3) if 0 < middle + k / (4 * CUTS) <= 1]
        tried.update({share: small_side(counts, limit, at(share)) for share in shares})
    return min([best, *tried.values()], key=size)


def _use(left: dict[int, int], pattern: Pattern) -> tuple[int, Pattern]:
    times = min(left[length] // c for length, c in pattern)
    for length, c in pattern:
        left[length] -= times * c
        if not left[length]:
            del left[length]
    return times, pattern


def _fillings(left: dict[int, int], limit: int, waste: int, every: bool = False) -> Iterator[Pattern | None]:
    """The largest piece with its fillings that waste so much at most: highest sum first, then larger pieces first.

    None stands for a dominated one, unless ``every`` one is wanted.
    """
    largest = max(left)
    room = limit - largest
    lengths = sorted((x for x in left if x <= room), reverse=True)
    have = [left[x] - (x == largest) for x in lengths]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length, n in zip(reversed(lengths), reversed(have), strict=True):  # bit s: the sum s can be made
        sums, n, step = reach[-1], min(n, room // length), 1
        while n:
            step = min(step, n)
            sums |= sums << (step * length) & mask
            n, step = n - step, step * 2
        reach.append(sums)
    reach.reverse()
    spare = dict(zip(lengths, have, strict=True))
    rising = lengths[::-1]

    def dominated(pattern: Pattern, slack: int) -> bool:
        own = dict(pattern)

        def exchange(low: int, high: int) -> bool:
            """Is a piece of a length from low to high left over?"""
            for x in rising[bisect_left(rising, low):]:
                if x > high:
                    return False
                if spare[x] > own.get(x, 0):
                    return True
            return False

        if exchange(1, slack) or any(exchange(x + 1, x + slack) for x, _ in pattern):
            return True
        return any(exchange(x + y, x + y + slack) for i, (x, c) in enumerate(pattern) for y, _ in pattern[i + (c < 2) :])

    def walk(i: int, rest: int, pattern: Pattern) -> Iterator[Pattern]:
        stack = [(i, rest, pattern)]
        while stack:
            i, rest, pattern = stack.pop()
            if not rest:
                yield pattern
                continue
            while i < len(lengths) and lengths[i] > rest:
                i += 1
            if i < len(lengths):
                for c in range(min(have[i], rest // lengths[i]) + 1):  # the most pieces are taken up first
                    if reach[i + 1] >> (rest - c * lengths[i]) & 1:
                        stack.append((i + 1, rest - c * lengths[i], [*pattern, (lengths[i], c)] if c else pattern))

    for total in range(room, max(room - waste, 0) - 1, -1):
        if reach[0] >> total & 1:
            for pattern in walk(0, total, []):
                if not every and dominated(pattern, room - total):
                    yield None
                    continue
                same = dict(pattern)
                same[largest] = same.get(largest, 0) + 1
                yield sorted(same.items(), reverse=True)
                if not every and total == room and sum(c for _, c in pattern) <= 1:  # full with one piece more: dominates all others
                    return


def _order(pattern: Pattern) -> tuple[int, Pattern]:
    return sum(x * c for x, c in pattern), pattern


def _branches(left: dict[int, int], limit: int, waste: int, last: Pattern | None) -> Iterator[tuple[int, Pattern] | None]:
    """(times, filling) of the largest piece, each as often as it can be, and in turn with the next filling one time fewer."""
    fillings, fewer = _fillings(left, limit, waste), deque()
    before = _order(last) if last and last[0][0] == max(left) else None
    while fillings or fewer:
        pattern = next(fillings, False) if fillings else False
        if pattern is False:
            fillings = None
        elif pattern is None or (before and _order(pattern) >= before):
            yield None
        else:
            times = min(left[x] // c for x, c in pattern)
            lost = limit - sum(x * c for x, c in pattern)
            times = min(times, waste // lost) if lost else times
            yield times, pattern
            if times > 1:
                fewer.append((times - 1, pattern))
        if fewer:
            times, pattern = fewer.popleft()
            yield times, pattern
            if times > 1:
                fewer.append((times - 1, pattern))


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """Sequences needed at least: by the sum, or by the pieces over half a sequence and what cannot join them."""
    total = sum(length * n for length, n in counts.items())
    bound = -(-total // limit)
    for k in sorted({x for x in counts if 2 * x <= limit} | {0}):
        big = sum(n for x, n in counts.items() if x > limit - k)
        half = sum(n for x, n in counts.items() if limit - k >= x > limit // 2)
        space = sum(n * (limit - x) for x, n in counts.items() if limit - k >= x > limit // 2)
        small = sum(n * x for x, n in counts.items() if k <= x <= limit // 2)
        bound = max(bound, big + half + max(0, -(-(small - space) // limit)))
    return bound


def _highest(left: dict[int, int], limit: int, waste: int, last: Pattern | None) -> Iterator[tuple[int, Pattern] | None]:
    """The first fillings of the highest sum, each as often as it can be."""
    best = None
    for pattern in islice(_fillings(left, limit, waste, every=True), FIRST):
        total = sum(x * c for x, c in pattern)
        best = best or total
        if total < best:
            return
        times, lost = min(left[x] // c for x, c in pattern), limit - total
        yield min(times, waste // lost) if lost else times, pattern


def bin_completion(counts: dict[int, int], limit: int, nodes: int = NODES) -> list[tuple[int, Pattern]]:
    """The best plan found: (times, pattern) until all pieces are used."""
    counts = {x: n for x, n in counts.items() if n}
    least = lower_bound(counts, limit)
    best = _incumbent(counts, limit, least)
    fewest = sum(t for t, _ in best)
    total = sum(x * n for x, n in counts.items())
    spare = lambda waste: (fewest - 1) * limit - total - waste  # noqa: E731  what may be wasted yet by a plan with fewer sequences
    left, plan, used, waste = dict(counts), [], 0, 0

    def apply(step: tuple[int, Pattern], sign: int) -> None:
        nonlocal used, waste
        times, pattern = step
        for length, c in pattern:
            left[length] = left.get(length, 0) - sign * times * c
            if not left[length]:
                del left[length]
        used += sign * times
        waste += sign * times * (limit - sum(x * c for x, c in pattern))

    for some in (_highest, _branches):
        while plan:
            apply(plan.pop(), -1)
        # branches that are open, what they were made from and how many were taken; all but the last ``OPEN`` are made anew
        path = [[None, (spare(0), None), 0]]
        looks = nodes
        while path and fewest > least and looks > 0:
            top = path[-1]
            if top[0] is None:
                top[0] = islice(some(left, limit, *top[1]), top[2], None)
            step = next(top[0], False)
            if step is False:
                path.pop()
                if plan:
                    apply(plan.pop(), -1)
                continue
            looks -= 1
            top[2] += 1
            if step is None:
                continue
            apply(step, 1)
            if spare(waste) < 0:  # the incumbent has become better since
                apply(step, -1)
                continue
            plan.append(step)
            if left:
                path.append([None, (spare(waste), step[1]), 0])
                if len(path) > OPEN:
                    path[-OPEN - 1][0] = None
                continue
            if used < fewest:
                fewest, best = used, list(plan)
            apply(plan.pop(), -1)
    return best


def _placed(plan: list[tuple[int, Pattern]], limit: int):
    """Pieces get their sequence and offset from their number among those of their length."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used, base = {}, 0
    for times, pattern in plan:
        offset = 0
        for length, c in pattern:
            table.setdefault(length, []).append((used.get(length, 0), base, c, offset))
            used[length] = used.get(length, 0) + times * c
            offset += length * c
        base += times
    arrays = {length: np.array(rows, np.int64).T for length, rows in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, bases, c, at = arrays[int(x)]
                k = np.searchsorted(first, number[mine], "right") - 1
                within = number[mine] - first[k]
                sequence[mine] = bases[k] + within // c[k]
                offset[mine] = at[k] + within % c[k] * x
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    ship(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    piece = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    with small_batches(docs.sparkSession):
        pieces = stored(given.mapInArrow(_tokenised(tokenizer, limit, end_id), f"{piece}, nth bigint, task int"), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["task", "length"]).withColumn("number", F.col("nth") + F.col("first")).drop("nth", "first", "task")
    out = numbered.mapInArrow(_placed(bin_completion(counts, limit), limit), f"{piece}, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", doc_id)
