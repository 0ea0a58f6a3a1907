"""Best-fit packing by bin completion.

Texts are tokenised once. Documents longer than a sequence are cut into full pieces, the first
piece taking the rest. Pieces are dealt at random, by a hash, into groups of about GROUP pieces,
so that a group can be searched in one task; each group wastes about one sequence at most. In a
group, best-fit decreasing gives the incumbent. If it has more sequences than the sum of lengths
asks for, branch and bound completes one sequence at a time around the largest piece left, over
all fillings that no other filling dominates, and drops branches whose waste can't beat the
incumbent. The search stops after NODES sequences filled and dominated fillings dropped, and
nowhere else; the incumbent is always whole.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import tokens
from logloom.llm.common import materialise

LENGTH = 2048
GROUP = 16_384
NODES = 20_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket long"
_RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty: its one piece holds just the end id. Repeated rows and null ids are
    documents of their own. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # six numbers a piece: written once, so that groups are told from pieces and not from documents of any length
    pieces = materialise(rows.mapInArrow(lambda batches: _cut(batches, length, end_id, vocabulary), _PIECES))
    groups = max(1, math.ceil(pieces.count() / GROUP))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "bucket"), F.lit(groups)))
    # few bytes and much work: a task for each group, or as many as shuffles have
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda group: _pack_group(group, length), _RESULT)


def _cut(batches: Iterator[pa.RecordBatch], length: int, end_id: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    tok, seen = tokens.load(vocabulary), 0
    end = np.array([end_id], "<u4")
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate([tok.ids(text.as_py() or ""), end])
            n = len(ids)
            cuts = [0, *range(n % length or length, n, length), n]
            for k in range(len(cuts) - 1):
                out.append((doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()), seen))
            seen += 1
        if out:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])


def _pack_group(group: pa.Table, length: int) -> pa.Table:
    # a fixed order, so that reruns agree
    group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    sizes = group.column("length").to_pylist()
    bucket = group.column("bucket")[0].as_py()
    sequence, offset = [0] * len(sizes), [0] * len(sizes)
    for k, filled in enumerate(pack(sizes, length)):
        at = 0
        for i in filled:
            sequence[i], offset[i] = (bucket << 32) | k, at
            at += sizes[i]
    return group.drop_columns(["bucket"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of indexes into ``sizes`` (each from 1 to ``capacity``), as few as the search finds."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    best = best_fit_decreasing(sizes, capacity)
    if len(best) > math.ceil(sum(sizes) / capacity):
        best = _complete(Counts({s: len(x) for s, x in by_size.items()}), capacity, best, nodes)
    places = {s: iter(x) for s, x in by_size.items()}
    return [[next(places[s]) for s in b] for b in best]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes. ``room`` has bit r set while a bin with r places left is open, so the tightest bin is one bit scan away."""
    bins: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    room = 0
    for s in sorted(sizes, reverse=True):
        if fits := room >> s:
            r = s + (fits & -fits).bit_length() - 1
            k = open_[r].pop()
            if not open_[r]:
                room &= ~(1 << r)
        else:
            r, k = capacity, len(bins)
            bins.append([])
        bins[k].append(s)
        if left := r - s:
            open_.setdefault(left, []).append(k)
            room |= 1 << left
    return bins


class Counts:
    """How many pieces of each size are left; bit s of ``bits`` is set while there is one of size s."""

    def __init__(self, n: dict[int, int]) -> None:
        self.n, self.bits = n, sum(1 << s for s in n)

    def take(self, s: int) -> None:
        self.n[s] -= 1
        if not self.n[s]:
            self.bits ^= 1 << s

    def put(self, s: int) -> None:
        if not self.n[s]:
            self.bits ^= 1 << s
        self.n[s] += 1

    def largest(self, most: int) -> int:
        """The largest size that is at most ``most``; 0 if there is none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0


def next_filling(left: Counts, room: int, most: int, after: list[int] | None = None, budget: list[int] | None = None) -> list[int] | None:
    """The first undominated filling of ``room`` behind ``after``, with a waste of ``most`` at most; None if there is no other.

    Fillings come by waste, then with larger pieces first. One is dominated if a piece outside it
    can take the place of some of its pieces, or the room left, without more waste and with a
    larger sum or fewer pieces. Nothing else is left out. ``budget`` pays one for each start of a
    filling that is dropped as dominated; at nothing left the answer is None.
    """
    budget = [1 << 62] if budget is None else budget
    largest = left.largest(room)
    if not largest or largest == room:  # no piece fits, or one fills the room and dominates all
        return ([room] if largest else []) if after is None and (largest or room <= most) else None
    bits, sizes = left.bits & ((1 << (room + 1)) - 1), []
    while bits:
        sizes.append(bits.bit_length() - 1)
        bits ^= 1 << sizes[-1]
    # reach[i] has a bit for each sum of pieces from the i-th size on
    keep, reach = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        sums, n = reach[-1], min(left.n[s], room // s)
        k = 1
        while n:
            k = min(k, n)
            sums |= sums << (k * s) & keep
            n, k = n - k, 2 * k
        reach.append(sums)
    reach.reverse()
    index = {s: i for i, s in enumerate(sizes)}

    def find(start: int, target: int, waste: int, bound: list[tuple[int, int]] | None, one: int, more: int, outside: int) -> list[int] | None:
        """``one``, ``more``: sums of one and of several chosen pieces. ``outside``: sizes that are left out for good. ``bound``: what to be behind."""
        if not target:
            return None if bound is not None else []
        first = bound[0] if bound else (0, 0)
        at = index[first[0]] if bound else bisect_left(sizes, -target, lo=start, key=lambda x: -x)
        skipped = outside
        for x in sizes[start:at]:
            skipped |= 1 << x
        for i in range(at, len(sizes)):
            if not reach[i] >> target & 1:
                break
            s = sizes[i]
            held = left.n[s]
            for c in range(first[1] if bound and i == at else min(held, target // s), 0, -1):
                if not reach[i + 1] >> (target - c * s) & 1:
                    continue
                o, m = one, more
                for _ in range(c):
                    m |= (m | o) << s
                    o |= 1 << s
                out = skipped | (1 << s if c < held else 0)
                if not target - c * s:
                    for x in sizes[i + 1 :]:
                        out |= 1 << x
                if _dominated(o, m, out, waste):
                    budget[0] -= 1
                    if budget[0] <= 0:
                        return None
                    continue
                tight = bound[1:] if bound and i == at and c == first[1] else None
                got = find(i + 1, target - c * s, waste, tight, o, m, out)
                if got is not None:
                    return [s] * c + got
                if budget[0] <= 0:
                    return None
            skipped |= 1 << s
        return None

    bound = None if after is None else [(s, len(list(x))) for s, x in groupby(after)]
    for waste in range(room - sum(after) if after is not None else 0, min(most, room - 1) + 1):
        if reach[0] >> (room - waste) & 1:
            got = find(0, room - waste, waste, bound, 0, 0, 0)
            if got is not None or budget[0] <= 0:
                return got
        bound = None
    return None


def _dominated(one: int, more: int, outside: int, waste: int) -> bool:
    """Whether a size of ``outside`` is the sum of several chosen pieces, or over a sum of any of them, or of none, by 1 to ``waste``."""
    if more & outside:
        return True
    near, width = (1 | one | more) << 1, 1  # sums that are over by 1 to width
    if not waste:
        return False
    while width < waste:
        step = min(width, waste - width)
        near |= near << step
        width += step
    return bool(near & outside)


def _complete(left: Counts, capacity: int, best: list[list[int]], nodes: int) -> list[list[int]]:
    """Depth first over the completions, with a stack in place of recursion; ``best`` is the incumbent."""
    total = sum(s * n for s, n in left.n.items())
    least = math.ceil(total / capacity)
    path: list[tuple[list[int], int]] = []  # bin, its waste
    waste = 0
    # a dive costs as many nodes as it fills bins; the bound leaves room for several dives in large groups
    budget = [max(nodes, 3 * len(best))]

    def step(head: int, after: list[int] | None) -> bool:
        """Fills a bin around ``head`` in the next way whose waste the bound allows."""
        nonlocal waste
        left.take(head)
        filling = next_filling(left, capacity - head, (len(best) - 1) * capacity - total - waste, after, budget)
        left.put(head)
        if filling is None:
            return False
        chosen = [head, *filling]
        for x in chosen:
            left.take(x)
        path.append((chosen, capacity - sum(chosen)))
        waste += path[-1][1]
        return True

    def back() -> bool:
        nonlocal waste
        while path:
            chosen, w = path.pop()
            for x in chosen:
                left.put(x)
            waste -= w
            if step(chosen[0], chosen[1:]):
                return True
        return False

    while budget[0] > 0:
        budget[0] -= 1
        head = left.bits.bit_length() - 1
        if head <= 0:
            if len(path) < len(best):
                best = [b for b, _ in path]
            if len(best) <= least or not back():
                break
        elif not step(head, None) and not back():
            break
    return best
