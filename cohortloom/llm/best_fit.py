"""Pack documents into few sequences: match the large ones in pairs, best-fit the rest.

Only a document longer than a sequence is cut, into pieces of a whole sequence and a rest.
A piece above one third of a sequence is large; a sequence holds at most two of them. They
are matched greedily, from the largest down, each with the largest other one that fits.
Smaller pieces then go, from the largest down, into the gap that they fill best.

Which sequence a piece gets follows from its length and its rank among the pieces of that
length. So the plan is made from a histogram, one count per length, and is a table of rank
ranges; its size follows the capacity, never the rows. A rank is a piece's number within
its writing task plus the pieces of that length in earlier tasks, so that no window ever
sorts the pieces of one length, however many share it.

Defined results: a null or empty text is one piece of one end token. Null and repeated ids,
and repeated rows, are packed like any other; each row's pieces stand on their own. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import store
from .vocab import default_path, worker_words
from .words import slices

CAPACITY = 4096


@dataclass
class Plan:
    """Rank ranges: items `rank`.. of a length go to sequences from `bin` on, `each` to a sequence,
    the first at `offset`."""

    capacity: int
    bins: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, bin, each, offset
    gaps: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # gap -> (first bin, bins)
    order: list[int] = field(default_factory=list)  # gaps that exist, sorted

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def leave(self, gap: int, first: int, count: int) -> None:
        """So many sequences from `first` on have this gap now."""
        if gap and count:
            if gap not in self.gaps:
                insort(self.order, gap)
            self.gaps.setdefault(gap, []).append((first, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Sequences with the smallest gap that holds the length: (gap, first, count)."""
        at = bisect_left(self.order, length)
        if at == len(self.order):
            return None
        gap = self.order[at]
        first, count = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap], self.order[at]
        return gap, first, count

    def put(self, length: int, rank: int, first: int, count: int, each: int, offset: int) -> None:
        if count:
            self.rows.append((length, rank, first, each, offset))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Columns sorted by (length, rank)."""
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(c) for c in table.T)


def match_large(plan: Plan, counts: dict[int, int]) -> None:
    """Pair lengths above a third of the capacity, from the largest down."""
    left = {s: c for s, c in counts.items() if 3 * s > plan.capacity and c}
    placed = dict.fromkeys(left, 0)
    order = sorted(left)
    for a in sorted(left, reverse=True):
        while left[a]:
            order = [s for s in order if left[s]] if not left[order[-1]] else order
            at = bisect_left(order, plan.capacity - a + 1) - 1
            while at >= 0 and left[order[at]] < (2 if order[at] == a else 1):
                at -= 1
            b = order[at] if at >= 0 else None
            if b is None:
                first = plan.open(left[a])
                plan.put(a, placed[a], first, left[a], 1, 0)
                plan.leave(plan.capacity - a, first, left[a])
                placed[a] += left[a]
                left[a] = 0
            else:
                pairs = left[a] // 2 if a == b else min(left[a], left[b])
                first = plan.open(pairs)
                for s, offset in ((a, 0), (b, a)):
                    plan.put(s, placed[s], first, pairs, 1, offset)
                    placed[s] += pairs
                    left[s] -= pairs
                plan.leave(plan.capacity - a - b, first, pairs)


def fill_gaps(plan: Plan, counts: dict[int, int]) -> None:
    """Best-fit the other lengths, from the largest down; sequences of equal gap fill together."""
    for s in sorted((s for s, c in counts.items() if 3 * s <= plan.capacity and c), reverse=True):
        rank, left = 0, counts[s]
        while left:
            found = plan.take(s)
            if found is None:
                each = plan.capacity // s
                found = plan.capacity, plan.open(-(-left // each)), -(-left // each)
            gap, first, count = found
            each = gap // s  # best fit stays with a sequence while it can: its gap is now the smallest
            full = min(count, left // each)
            plan.put(s, rank, first, full, each, plan.capacity - gap)
            plan.leave(gap - each * s, first, full)
            rank, left = rank + full * each, left - full * each
            first, count = first + full, count - full
            if count and left:  # the last of this length share one more sequence
                plan.put(s, rank, first, 1, left, plan.capacity - gap)
                plan.leave(gap - left * s, first, 1)
                first, count, rank, left = first + 1, count - 1, rank + left, 0
            plan.leave(gap, first, count)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for so many pieces of each length, 1 to capacity."""
    plan = Plan(capacity)
    match_large(plan, counts)
    fill_gaps(plan, counts)
    return plan


def place(plan: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    sizes, ranks, bins, each, offset = plan
    # Two searches make one: a length's ranges are neighbours, shifted so that they never overlap.
    top = int(max(ranks.max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(sizes * top + ranks, length * top + rank, "right") - 1
    past = rank - ranks[at]
    return bins[at] + past // each[at], offset[at] + past % each[at] * length


_PIECES = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]
_IDS = [T.StructField("ids", T.BinaryType())]
_RANK = [T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]
_PLACE = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str | None, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece, with its number among the pieces of its length that the same task wrote."""
    schema = T.StructType(_PIECES + _RANK + _IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words("json", vocabulary or default_path("word_bpe_49k.json"))
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                flat, sizes = words.ids(words.codes(part, part.hashes()))
                ends = np.concatenate([[0], np.cumsum(sizes)])[part.first].tolist()
                rows = []
                for row, low, high in zip(range(part.low, part.low + len(part)), ends[:-1], ends[1:], strict=True):
                    ids = np.append(flat[low:high], np.int32(end_id)).astype("<u4")
                    for number, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        length = len(raw) // 4
                        rows.append((doc_ids[row], number, start, length, zlib.crc32(raw), task, int(seen[length]), raw if with_ids else None))
                        seen[length] += 1
                columns = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], schema.fieldNames())

    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, schema)


_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece with its sequence and offset. `ids` are little-endian unsigned 32-bit
    integers (absent without `with_ids`). Sequences are numbered from 0 without a gap."""
    pieces = store(pieces_of(docs, capacity, vocabulary, end_id, with_ids), "pieces")
    tasks = store(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("rows")), "lengths")
    counts = {r["length"]: r["rows"] for r in tasks.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    plan = make_plan(counts, capacity).arrays()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("length", "task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    fields = _PIECES + (_IDS if with_ids else [])
    names = [f.name for f in fields]
    # A row per length and task grows with the input, so it is shuffled, never broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).select(*names, (F.col("earlier") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = place(plan, batch["length"].to_numpy(), batch["rank"].to_numpy())
                yield pa.record_batch([*(batch[n] for n in names), *map(pa.array, found)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType(fields + _PLACE))
