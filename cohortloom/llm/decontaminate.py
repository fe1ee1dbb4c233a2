"""Benchmark decontamination with SimHash over windows of the items' own sizes.

For every item length there is a window at each place of a document. Windows get a 64-bit
SimHash of their words and word pairs. For each length a multi-index by four 16-bit blocks
joins windows and items: the shorter list looks up all values within 4 bits of its own
blocks in the index of the longer one, so that each pair within RADIUS (19) bits is found:
19 differing bits leave some block with at most 4.
Candidates are then verified by the exact similarity of their word shingles weighted by how
often they occur (twice the shared weight over the sum of both weights).

A window can only reach the similarity if enough of its shingles occur in some item at all;
windows that fail this count are not fingerprinted, which loses no verified match.

The benchmark is the query set: it is read in blocks of ITEM_BLOCK items, and a block's
index (shingles and a fingerprint an item, under 1 kB for a hundred words) is what tasks
receive; a block is one pass. Documents are never shuffled. Windows of one length are worked
on at a time and fingerprinted in stretches, so memory follows a slice of text and the
longest item, not the number of lengths.

Defined results: null, empty and wordless texts or items match nothing. Items under five
words are one shingle. Repeated items or documents are matched one by one; null ids stay
null. Words are split at ASCII white space and compared with A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import Slice, mix, ragged, slices, window_hashes

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 19
BLOCKS, BLOCK_BITS, NEAR = 4, 16, 4  # RADIUS // BLOCKS == NEAR
ITEM_BLOCK = 50_000
STRETCH = 4096  # windows, and words between their beginnings, fingerprinted at once
LOOKUPS = 256  # fingerprints looked up at once
_SCREEN_BITS = 22
_PAIR = np.uint64(0xA0761D6478BD642F)


@cache
def _near_masks() -> np.ndarray:
    """Every 16-bit word with at most NEAR bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64)


def _votes(features: np.ndarray) -> np.ndarray:
    """Running sums, per bit, of +1 for a set and -1 for a clear bit."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(features) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=out[1:])
    return out


def fingerprints(words: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """SimHash of the windows (at, length) over word hashes; `at` ascends."""
    out = np.empty(len(at), np.uint64)
    low = 0
    while low < len(at):
        high = min(low + STRETCH, int(np.searchsorted(at, at[low] + STRETCH)))
        begin, size = at[low:high] - at[low], length[low:high]
        inside = words[at[low] : at[low] + (begin + size).max()]
        single, pair = _votes(mix(inside)), _votes(mix(inside[:-1] * _PAIR + inside[1:]))
        total = single[begin + size] - single[begin] + pair[begin + size - 1] - pair[begin]
        out[low:high] = np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()
        low = high
    return out


def _shingles(words: np.ndarray, at: int, length: int) -> np.ndarray:
    size = min(SHINGLE, length)
    return np.sort(window_hashes(words, at + np.arange(length - size + 1), size))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted shingle lists, each occurrence counting."""
    left, n = np.unique(a, return_counts=True)
    right, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    return 2.0 * float(np.minimum(n[i], m[j]).sum()) / (len(a) + len(b))


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)


def near_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in one, place in two) of all fingerprints within RADIUS bits."""
    if len(one) > len(two):
        j, i = near_pairs(two, one)
        return i, j
    masks, found = _near_masks(), [np.empty(0, np.int64)]
    for b in range(BLOCKS):
        index = _block(two, b)
        order = np.argsort(index, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=1 << BLOCK_BITS))])
        for low in range(0, len(one), LOOKUPS):
            value = (_block(one[low : low + LOOKUPS], b)[:, None] ^ masks).ravel()
            size = begin[value + 1] - begin[value]
            hit = np.flatnonzero(size)
            i = np.repeat(hit // len(masks) + low, size[hit])
            j = order[ragged(begin[value[hit]], size[hit])]
            near = np.bitwise_count(one[i] ^ two[j]) <= RADIUS
            found.append(i[near] * len(two) + j[near])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(two)), pairs % max(1, len(two))


class ItemIndex:
    """A block of items: fingerprints by block value, shingles, and the screen."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids: list[int | None] = []
        self.shingles: list[np.ndarray] = []
        lengths, prints = [], []
        for part in slices(pa.array([text for _, text in items], pa.string())):
            hashes = part.hashes(lower=True)
            for i in range(len(part)):
                words = hashes[part.first[i] : part.first[i + 1]]
                if not len(words):
                    continue
                self.ids.append(items[part.low + i][0])
                self.shingles.append(_shingles(words, 0, len(words)))
                lengths.append(len(words))
                prints.append(fingerprints(words, np.array([0]), np.array([len(words)]))[0])
        self.length = np.array(lengths, np.int64)
        self.print = np.array(prints, np.uint64)
        self.of_length = {n: np.flatnonzero(self.length == n) for n in set(lengths)}
        #: By shingle size: the lengths that have it, and their shingles.
        self.sizes: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for size in sorted({min(SHINGLE, n) for n in lengths}):
            own = [s for s, n in zip(self.shingles, lengths, strict=True) if min(SHINGLE, n) == size]
            known = np.unique(np.concatenate(own))
            screen = np.zeros(1 << _SCREEN_BITS, np.bool_)
            screen[known >> np.uint64(64 - _SCREEN_BITS)] = True
            self.sizes[size] = (sorted({n for n in lengths if min(SHINGLE, n) == size}), known, screen)

    def _windows(self, part: Slice, words: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, int]]:
        """For each length of an item, where windows begin in which enough shingles are known."""
        for size, (own, known, screen) in self.sizes.items():
            at, keys = part.windows(words, size)
            maybe = np.flatnonzero(screen[keys >> np.uint64(64 - _SCREEN_BITS)])
            hits = at[maybe[np.isin(keys[maybe], known)]]
            if not len(hits):
                continue
            count = np.zeros(len(words) + 1, np.int32)
            count[hits + 1] = 1
            count = np.cumsum(count, dtype=np.int32)
            text = np.searchsorted(part.first, hits, "right") - 1
            first, last = part.first[text], part.first[text + 1]
            after = np.concatenate([[0], hits[:-1] + 1])
            for n in own:
                # A window holds n - size + 1 shingles; it begins at or before one that is known.
                back = n - size
                low = np.maximum(np.maximum(hits - back, after), first)
                high = np.minimum(hits, last - n)
                some = low <= high
                near = ragged(low[some], (high - low)[some] + 1)
                near = near[count[near + back + 1] - count[near] >= least * (back + 1)]
                if len(near):
                    yield near, n

    def matches(self, part: Slice, least: float) -> Iterator[tuple]:
        """(text, item id, first word, words, similarity, distance): the best window per item."""
        if not self.ids:
            return
        words = part.hashes(lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for at, n in self._windows(part, words, least):
            # Of windows of the same words in a text the first one stands for all.
            texts = np.searchsorted(part.first, at, "right").astype(np.uint64)
            at = at[np.sort(np.unique(mix(window_hashes(words, at, n) + mix(texts)), return_index=True)[1])]
            prints, items = fingerprints(words, at, np.full(len(at), n)), self.of_length[n]
            for w, i in zip(*near_pairs(prints, self.print[items]), strict=True):
                item = int(items[i])
                distance = int(np.bitwise_count(prints[w] ^ self.print[item]))
                text = int(np.searchsorted(part.first, at[w], "right")) - 1
                place = int(at[w] - part.first[text])
                alike = similarity(_shingles(words, int(at[w]), n), self.shingles[item])
                held = best.get((text, item))
                if alike >= least and (held is None or (-alike, distance, place) < (-held[4], held[5], held[2])):
                    best[text, item] = (text, self.ids[item], place, n, alike, distance)
        yield from best.values()


MATCHES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "first_word", "n_words")]
    + [T.StructField("similarity", T.DoubleType()), T.StructField("hamming", T.LongType())]
)


def _indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    items = []
    for row in benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"].cast("string")).toLocalIterator():
        items.append((row[0], row[1]))
        if len(items) == ITEM_BLOCK:
            yield ItemIndex(items)
            items = []
    yield ItemIndex(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each document and item with a window of at least that similarity."""
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = None
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[part.low + m[0]], *m[1:]) for part in slices(batch.column(1)) for m in shared.value.matches(part, least)]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], MATCHES.fieldNames())

        found = columns.mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, that match no item."""
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, np.bool_)
                for part in slices(batch.column("text")):
                    for m in shared.value.matches(part, least):
                        clean[part.low + m[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
