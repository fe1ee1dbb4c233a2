"""Repeated word windows by level-wise doubling, and their removal.

A window of 35 words that occurs twice contains shorter ones that do. Level 0 looks at
9-word windows only, one inside each 35-word window (the one with the least hash, so equal
35-word windows choose the same one). Those that occur once are done. Around those that
occur again the window is extended to twice the length, 18 words inside the same 35, then
to 35; each level counts only what the level before found repeated, and a text without
candidates takes no further part.

Counting meets in hash buckets. What repeats inside a sending batch is decided there and
sends one witness, so a passage in a third of all texts reaches its bucket once per batch.
Texts are shuffled once, into small slots; every level reads that shuffle again.

Defined results: null text has no words. Texts shorter than a window are kept whole. Each
row counts as a text of its own, so a repeated row makes its windows repeated; null ids are
kept. Removal is judged on the input. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .stored import partitions
from .words import Slice, mix, repeated, slices, window_hashes

WINDOW = 35
_ROW = "slot int, key long, doc_id long, text string"


def lengths(window: int) -> list[int]:
    """Window lengths of the levels; each is about half the next."""
    out = [window]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """The windows of a slice, and for each the place that stands for it at each level."""

    def __init__(self, part: Slice, window: int):
        self.part, self.window, self.levels = part, window, lengths(window)
        self.hashes = part.hashes()
        last = np.repeat(part.first[1:], part.counts) - window
        n = len(self.hashes)
        self.at = np.flatnonzero(np.arange(n) <= last) if n else np.empty(0, np.int64)
        self._first: np.ndarray | None = None

    def _least(self) -> np.ndarray:
        """Place of the least level-0 window in each window; the leftmost of equal ones."""
        short, n = self.levels[0], len(self.hashes)
        span = self.window - short + 1
        keys = window_hashes(self.hashes, np.arange(n - short + 1), short)
        mask = np.uint64((1 << n.bit_length()) - 1)
        low = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = span - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        return (low[self.at] & mask).astype(np.int64)

    def places(self, level: int) -> np.ndarray:
        if level == len(self.levels) - 1:
            return self.at
        if self._first is None:
            self._first = self._least() if len(self.at) else self.at
        out = self._first
        for j in range(1, level + 1):
            out = np.minimum(out, self.at + self.window - self.levels[j])
        return out

    def hashes_at(self, places: np.ndarray, level: int) -> np.ndarray:
        return mix(window_hashes(self.hashes, places, self.levels[level], seed=level + 1))


def _send(keys: np.ndarray, places: np.ndarray, hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of entries (key of the row, word place, hash)."""
    again = repeated(hashes)
    witness = np.unique(hashes[again])
    once = ~again
    sections: dict[int, list] = {}
    blank = [np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint64)]

    def section(b: int) -> list:
        return sections.setdefault(b, [*blank, np.empty(0, np.uint64), *blank[:3]])

    for b, (k, p, h) in exchange.parted(exchange.buckets_of(hashes[once], n_buckets), (keys[once], places[once], hashes[once])):
        section(b)[:4] = [*exchange.runs(k), p.astype(np.uint32), h]
    for b, (h,) in exchange.parted(exchange.buckets_of(witness, n_buckets), (witness,)):
        section(b)[4] = h
    # What is decided here passes through buckets dealt by row, not by hash.
    for b, (k, p) in exchange.parted(exchange.slots_of_keys(keys[again], n_buckets), (keys[again], places[again])):
        section(b)[5:] = [*exchange.runs(k), p.astype(np.uint32)]
    for b, columns in sections.items():
        yield b, exchange.pack(columns)


_SENT = ("<i8", "<u4", "<u4", "<u8", "<u8", "<i8", "<u4", "<u4")
_BACK = ("<i8", "<u4", "<u4")


def _decide(n_slots: int) -> Callable:
    """Repeated places of a bucket, as blobs per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, hashes, known, done = [], [], [], [], []
        for b in batches:
            for blob in b.column(1):
                k, n, p, h, w, dk, dn, dp = exchange.unpack(blob.as_buffer().to_pybytes(), _SENT)
                keys.append(np.repeat(k, n))
                places.append(p)
                hashes.append(h)
                known += [w, w]
                done.append((np.repeat(dk, dn), dp))
        if not keys:
            return
        sent = np.concatenate(hashes)
        flags = repeated(np.concatenate([sent, *known]))[: len(sent)]
        key = np.concatenate([np.concatenate(keys)[flags], *(k for k, _ in done)])
        place = np.concatenate([np.concatenate(places)[flags], *(p for _, p in done)])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        found = [(s, exchange.pack([*exchange.runs(k), p])) for s, (k, p) in exchange.parted(exchange.slots_of_keys(key, n_slots), (key, place))]
        for low in range(0, len(found), 256):
            yield exchange.batch(*map(list, zip(*found[low : low + 256], strict=True)), name="slot")

    return run


def _marked(part: Slice, keys: np.ndarray, marks: pa.ChunkedArray) -> np.ndarray:
    """True at each word place of the slice that a bucket marked."""
    flags = np.zeros(int(part.first[-1]) + 1, np.bool_)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    for blob in marks:
        k, n, p = exchange.unpack(blob.as_buffer().to_pybytes(), _BACK)
        owner, place = np.repeat(k, n), p.astype(np.int64)
        low = np.searchsorted(ranked, owner, "left")
        high = np.searchsorted(ranked, owner, "right")
        while (more := low < high).any():  # repeated rows share a key
            low, high, place = low[more], high[more], place[more]
            flags[part.first[order[low]] + place] = True
            low = low + 1
    return flags


def _pieces(table: pa.Table) -> Iterator[tuple[Slice, np.ndarray, list]]:
    for b in table.combine_chunks().to_batches():
        keys = b.column("key").to_numpy(zero_copy_only=False)
        ids = b.column("doc_id").to_pylist()
        for part in slices(b.column("text")):
            rows = slice(part.low, part.low + len(part))
            yield part, keys[rows], ids[rows]


def _entries(windows: Windows, keys: np.ndarray, level: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row key, word place in its text, hash) of the windows that stand for a level."""
    places = windows.places(level)
    places = np.unique(places if alive is None else places[alive])
    text = np.searchsorted(windows.part.first, places, "right") - 1
    return keys[text], places - windows.part.first[text], windows.hashes_at(places, level) if len(places) else np.empty(0, np.uint64)


def _first_level(window: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for part, keys, _ in _pieces(pa.Table.from_batches([b])):
                held.append(_entries(Windows(part, window), keys, 0, None))
                size += len(held[-1][0])
                if size >= exchange.FLUSH:
                    yield _flush(held, n_buckets)
                    held, size = [], 0
        if size:
            yield _flush(held, n_buckets)

    return run


def _flush(held: list[tuple], n_buckets: int) -> pa.RecordBatch:
    sent = list(_send(*(np.concatenate(c) for c in zip(*held, strict=True)), n_buckets))
    return exchange.batch([b for b, _ in sent], [x for _, x in sent])


def _next_level(window: int, level: int, n_buckets: int) -> Callable:
    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        held = []
        if rows.num_rows and marks.num_rows:
            for part, keys, _ in _pieces(rows):
                windows = Windows(part, window)
                flags = _marked(part, keys, marks.column("blob"))
                held.append(_entries(windows, keys, level, flags[windows.places(level - 1)]))
        if not sum(len(h[0]) for h in held):
            return pa.Table.from_batches([exchange.batch([], [])])
        return pa.Table.from_batches([_flush(held, n_buckets)])

    return run


def _remove(window: int, with_text: bool) -> Callable:
    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        for part, keys, ids in _pieces(rows):
            flags = _marked(part, keys, marks.column("blob"))[:-1]
            edge = np.zeros(len(flags) + window + 1, np.int64)
            at = np.flatnonzero(flags)
            edge[at] += 1
            edge[at + window] -= 1
            gone = np.cumsum(edge)[: len(flags)] > 0
            for i, doc_id in enumerate(ids):
                words = part.text(i).split()
                drop = gone[part.first[i] : part.first[i + 1]]
                kept = b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if drop.any() else words)
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(drop.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(str(kept, "utf-8", "replace") if with_text else None)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document."""
    spark = docs.sparkSession
    n, n_slots = partitions(spark), exchange.slots(spark)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    key = F.xxhash64("doc_id", "text")
    rows = own.select(F.pmod(_unsigned_mod(key, n_slots), F.lit(n_slots)).cast("int").alias("slot"), key.alias("key"), "doc_id", "text")
    rows = rows.repartition(n, "slot")
    sent = rows.mapInArrow(_first_level(window, n), exchange.BLOBS)
    levels = lengths(window)
    for level in range(1, len(levels)):
        marks = exchange.meet(sent).mapInArrow(_decide(n_slots), exchange.SLOTS)
        sent = rows.groupBy("slot").cogroup(marks.groupBy("slot")).applyInArrow(_next_level(window, level, n), exchange.BLOBS)
    marks = exchange.meet(sent).mapInArrow(_decide(n_slots), exchange.SLOTS)
    return (
        rows.groupBy("slot")
        .cogroup(marks.groupBy("slot"))
        .applyInArrow(_remove(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )


def _unsigned_mod(key, n: int):
    """The long read as unsigned, modulo n, as numpy does for the same bits."""
    return F.pmod(key, F.lit(n)) + F.when(key < 0, F.lit(pow(2, 64, n))).otherwise(F.lit(0))
