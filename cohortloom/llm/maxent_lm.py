"""Language model: hashed maximum entropy, a softmax over classes and one over a class's words.

P(word | context) = P(class | context) * P(leaf | class, context) * (count + 1) / T(leaf).
Both softmaxes have the same features: the last word, the word before it and the one before
that (skips), the last two words, and the two before the last (skip pair), all hashed. The
class factor is a softmax over CLASSES classes. The word factor is a hierarchical softmax:
DEPTH two-way softmaxes lead from the class to one of its LEAVES leaves, each with a hashed
weight per feature and node, on top of the odds that plain counts give. T(leaf) is the sum of
count + 1 over the leaf's words in the training texts, plus one for a word never seen; words
that share a leaf differ by their counts alone. The end of text and the most frequent words
are classes of their own, without leaves; every other word's class is a hash of its last two
letters and its leaf a hash of the word, so a word needs no table to have them.

The weight tables grow with the distinct words of the training texts, from LEAST_ROWS to
MOST_ROWS rows of CLASSES weights and PAIRS times as many weights of nodes: 8 MB at most,
which bounds what is broadcast and what a task sends.

Counts are taken over all training texts: each task adds up its words, buckets add up the
tasks. Up to COMMON of the most frequent words, down to a count that a histogram of counts
gives, are broadcast; the rest are counted once more next to the texts they occur in, so
nothing as large as the vocabulary is held in one place.

Weights are trained in ROUNDS rounds over disjoint parts of the training texts. In a round
every task makes AdaGrad steps on its own texts from the same weights. Block by block, the
cluster takes each weight's mean change over the tasks that moved it, by their tokens, so a
rare feature keeps what one task learned. So a score depends a little on how texts fall into
tasks; the base score does not.

Defined results: a null or empty text is one end token. A null id is a training document.
Repeated rows count and are scored one by one. Without training text every count is zero.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .stored import drop_stored, partitions, store
from .words import Slice, mix, slices

CLASSES = 32
SINGLE = 15  # most frequent words that are classes of their own; class 0 is the end of text
DEPTH = 6
LEAVES = 1 << DEPTH
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 15
PAIRS = 32  # weights of nodes for each row of class weights
COMMON = 1 << 16
ROUNDS = 3
STEP = 0.3
BATCH = 4096
_GROUP = 8 * BATCH  # tokens whose features are held at once
_PLAIN = 60.0  # scores nearer to zero than this have exponentials that add up without a shift
_FEW = 3
_SLOT = np.uint64(64 - 18)  # a hash's bits below those that name its slot
_PLACE = 24  # bits of an entry's number below its place

_END = np.uint64(0x5851F42D4C957F2D)
_BEFORE = np.uint64(0x14057B7EF767814F)
_SUFFIX = SINGLE + 1
_MARKS = np.zeros(256, np.bool_)
_MARKS[[ord(c) for c in ".,;:!?\"')]|"]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
# Spreads a feature's hash over the node weights; the root of a class is its node 1.
_SPREAD = mix(np.arange(CLASSES * LEAVES, dtype=np.uint64)) | np.uint64(1)


def leaves(hashes: np.ndarray) -> np.ndarray:
    """Leaf of each word inside its class."""
    return (mix(hashes + np.uint64(6)) >> np.uint64(64 - DEPTH)).astype(np.int64)


def _paths(classes: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes from the class to the leaf, whether the path leaves each to the right), level by token."""
    level = np.arange(DEPTH)[:, None]
    node = (1 << level) + (leaf >> (DEPTH - level))
    return classes * LEAVES + node, (leaf >> (DEPTH - 1 - level)) & 1 > 0


def _suffix_class(part: Slice) -> np.ndarray:
    """Class of each word by its last two bytes, a closing mark left aside."""
    start, end = part.starts, part.ends.copy()
    end -= _MARKS[part.data[end - 1]] & (end - start > 1)
    last = _LOWER[part.data[end - 1]]
    second = np.where(end - start > 1, _LOWER[part.data[np.maximum(end - 2, 0)]], np.uint64(0))
    return (_SUFFIX + mix(second * np.uint64(256) + last) % np.uint64(CLASSES - _SUFFIX)).astype(np.int64)


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first token of each text): the words of each text and its end."""
    words, kinds = part.hashes(lower=True), _suffix_class(part)
    where = part.first[1:]
    return np.insert(words, where, _END), np.insert(kinds, where, 0), part.first + np.arange(len(part) + 1)


@dataclass
class Counts:
    """What all tasks share: frequent words, totals, and each class's mass."""

    common: np.ndarray  # sorted hashes
    count: np.ndarray
    single: np.ndarray  # hashes of the classes of one word, sorted
    single_class: np.ndarray
    tokens: int
    distinct: int
    mass: np.ndarray  # T of each class's leaves; the whole class in leaf 0 where it is one word

    @cached_property
    def slots(self) -> np.ndarray:
        """The place of the most frequent word for each value of a hash's leading bits."""
        slots = np.zeros(1 << (64 - int(_SLOT)), np.int32)
        order = np.argsort(self.count, kind="stable")
        slots[(self.common[order] >> _SLOT).view(np.int64)] = order
        return slots

    @cached_property
    def crowded(self) -> np.ndarray:
        """Whether the slot of each frequent word has others."""
        slot = self.common >> _SLOT
        same = slot[1:] == slot[:-1]
        return np.append(same, False) | np.insert(same, 0, False)

    def classes(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        if not len(self.single):
            return kinds
        place = np.minimum(np.searchsorted(self.single, hashes), len(self.single) - 1)
        return np.where(self.single[place] == hashes, self.single_class[place], kinds)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Place on the list of frequent words, or -1."""
        if not len(self.common):
            return np.full(len(hashes), -1)
        slot = self.slots.take((hashes >> _SLOT).view(np.int64))
        place = np.where(self.common.take(slot) == hashes, slot, -1)
        # A slot names one of its words; the others are looked for.
        other = np.flatnonzero((place < 0) & self.crowded.take(slot))
        if len(other):
            found = np.minimum(np.searchsorted(self.common, hashes[other]), len(self.common) - 1)
            place[other] = np.where(self.common[found] == hashes[other], found, -1)
        return place


def _add_up(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, counts, kinds = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(hashes)
    found, sizes = exchange.runs(hashes[order])
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    total = np.add.reduceat(counts[order].astype(np.int64), starts) if len(starts) else starts
    return found, total, kinds[order[starts]]


def count_words(docs: DataFrame) -> Counts:
    """Word counts of all given texts; their frequent end and their totals come back."""
    n_buckets = partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found, counts, kinds = _add_up(held)
            sent = list(exchange.parted(exchange.buckets_of(found, n_buckets), (found, counts.astype(np.uint32), kinds.astype(np.uint8))))
            return exchange.batch([b for b, _ in sent], [exchange.pack(c) for _, c in sent])

        for batch in batches:
            for part in slices(batch.column("text")):
                hashes, kinds, _ = tokens(part)
                held.append(_add_up([(hashes, np.ones(len(hashes)), kinds)]))
                size += len(held[-1][0])
                if size >= exchange.FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [exchange.unpack(x.as_buffer().to_pybytes(), ("<u8", "<u4", "u1")) for b in batches for x in b.column("blob")]
        if blobs:
            found, counts, kinds = _add_up(blobs)
            leaf = np.where(kinds > 0, leaves(found), 0)
            arrays = [pa.array(c) for c in (found.view(np.int64), counts, kinds.astype(np.int32), leaf.astype(np.int32))]
            yield pa.record_batch(arrays, ["word", "n", "kind", "leaf"])

    counts = store(exchange.meet(docs.mapInArrow(send, exchange.BLOBS)).mapInArrow(total, "word long, n long, kind int, leaf int"), "counts")
    mass = np.ones((CLASSES, LEAVES))
    n_tokens = distinct = 0
    for row in counts.groupBy("kind", "leaf").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():  # one row a leaf
        mass[row["kind"], row["leaf"]] += row["n"] + row["d"]
        n_tokens += row["n"]
        distinct += row["d"]
    # Sixteen steps a doubling of the count: some hundreds of rows, whatever the vocabulary.
    step = F.floor(16 * F.log2("n")).cast("int")
    listed, least = 0, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        listed += row["count"]
        if listed > COMMON:
            break
        least = row["step"]
    top = counts.where(step >= F.lit(least)).toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most COMMON rows
    drop_stored(counts)
    word, n, kind = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["kind"].to_numpy(np.int64)
    own = np.flatnonzero(word != _END)[:SINGLE]
    leaf = top["leaf"].to_numpy(np.int64)
    mass[:_SUFFIX, 1:] = 0
    for i, at in enumerate(own.tolist()):
        mass[kind[at], leaf[at]] -= n[at] + 1
        mass[1 + i, 0] += n[at] + 1
    order, single = np.argsort(word), np.argsort(word[own])
    return Counts(word[order], n[order], word[own][single], 1 + single, n_tokens, distinct, mass)


def features(hashes: np.ndarray, first: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Hashes of the five features of each token, or of those from `begin` to `end`."""
    end = len(hashes) if end is None else min(end, len(hashes))
    since = np.full(len(hashes), 3, np.int8)  # tokens of the text before each, three at most
    for j in (2, 1, 0):
        at = first[:-1] + j
        since[at[at < len(hashes)]] = j
    out = np.empty((5, end - begin), np.uint64)
    scale = np.uint64(0x9E3779B97F4A7C15)
    for low in range(begin, end, BATCH):
        place = np.arange(low, min(low + BATCH, end))
        one, two, three = (np.where(since[place] >= j, hashes.take(np.maximum(place - j, 0)), _BEFORE) for j in (1, 2, 3))
        rows = [one + np.uint64(1), two + np.uint64(2), three + np.uint64(3), one * scale + two + np.uint64(4), two * scale + three + np.uint64(5)]
        for j, r in enumerate(rows):
            out[j, low - begin : low - begin + len(place)] = mix(r)
    return out.T


class Weights:
    """Class weights by row, the class bias, and the nodes' weights in one vector; `odds` are
    the nodes' log odds of going right by plain counts."""

    def __init__(self, flat: np.ndarray, odds: np.ndarray):
        self.flat, self.odds = flat, odds
        n_rows = len(flat) // (CLASSES + PAIRS)
        self.rows = flat[: n_rows * CLASSES].reshape(n_rows, CLASSES)
        self.pairs = flat[n_rows * CLASSES : n_rows * (CLASSES + PAIRS)]
        self.bias = flat[n_rows * (CLASSES + PAIRS) :]
        self.whole = self.rows.view(f"V{4 * CLASSES}")[:, 0]  # a row as one item
        self._mask = np.uint64(n_rows - 1)
        self._shift = np.uint64(65 - len(self.pairs).bit_length())

    @classmethod
    def start(cls, mass: np.ndarray, distinct: int) -> Weights:
        n_rows = min(max(LEAST_ROWS, 1 << max(0, distinct // 8).bit_length()), MOST_ROWS)
        flat = np.zeros(n_rows * (CLASSES + PAIRS) + CLASSES, np.float32)
        flat[-CLASSES:] = np.log(mass.sum(axis=1) / mass.sum())
        odds = np.zeros((CLASSES, LEAVES), np.float32)
        for level in range(DEPTH):
            halves = np.maximum(mass.reshape(CLASSES, 1 << level, 2, -1).sum(axis=3), 1.0)
            odds[:, 1 << level : 2 << level] = np.log(halves[:, :, 1] / halves[:, :, 0])
        return cls(flat, odds.ravel())

    def at_rows(self, at: np.ndarray) -> np.ndarray:
        return (at & self._mask).astype(np.int64)

    def shares(self, at: np.ndarray) -> np.ndarray:
        """Softmax over classes for each token's features."""
        _, e = _powers(self.rows, self.at_rows(at), self.bias)
        e /= np.einsum("ij->i", e)[:, None]
        return e

    def log_share(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural log of the share of each token's own class."""
        z, e = _powers(self.rows, self.at_rows(at), self.bias)
        return z[np.arange(len(wanted)), wanted] - np.log(np.einsum("ij->i", e))

    def at_nodes(self, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Places of the node weights: feature by level by token."""
        return ((at.T[:, None, :] * _SPREAD[node]) >> self._shift).view(np.int64)

    def log_leaf(self, at: np.ndarray, wanted: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of the share of each token's leaf inside its class."""
        out = np.zeros(len(wanted))
        many = np.flatnonzero(wanted >= _SUFFIX)
        node, right = _paths(wanted[many], leaf[many])
        z = _lean(self.pairs.take(self.at_nodes(at.T[:, many].T, node)), self.odds[node])
        out[many] = -_softplus(np.where(right, -z, z)).sum(axis=0)
        return out


def _powers(rows: np.ndarray, at: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, less their maximum where that is needed, their exponentials) over classes for
    each token."""
    z = rows.take(at[:, 0], axis=0)
    for j in range(1, at.shape[1]):
        z += rows.take(at[:, j], axis=0)
    z += bias
    if z.size and not (z.max() < _PLAIN and z.min() > -_PLAIN):
        z -= z.max(axis=1, keepdims=True)
    return z, np.exp(z)


def _lean(weights: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log odds of going right at each node of each token's path."""
    for w in weights:
        odds = odds + w
    return odds


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))


def _run_sums(values: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of `values[at]` over each run of `counts` neighbours, a few at a time; the last row of
    `values` is zero."""
    out = values.take(at.take(np.cumsum(counts) - counts), axis=0)
    more = counts > 1
    if more.any():
        sizes, members = counts[more], at[np.repeat(more, counts)]
        parts = -(-sizes // _FEW)
        shift = _FEW * (np.cumsum(parts) - parts) - (np.cumsum(sizes) - sizes)
        padded = np.full(_FEW * int(parts.sum()), len(values) - 1)
        padded[np.repeat(shift, sizes) + np.arange(len(members))] = members
        sums = np.zeros((len(padded) // _FEW + 1, values.shape[1]), values.dtype)
        for j in range(_FEW):
            sums[:-1] += values.take(padded[j::_FEW], axis=0)
        out[more] = _run_sums(sums, np.arange(len(sums) - 1), parts)
    return out


class Learner:
    """AdaGrad steps on one task's copy of the weights."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self._rows = np.ones(len(weights.rows), np.float32)  # squared gradients so far
        self._pairs = np.ones(len(weights.pairs), np.float32)
        self._bias = 1.0

    def learn(self, at: np.ndarray, wanted: np.ndarray, leaf: np.ndarray, step: float = STEP) -> None:
        self.learn_classes(at, wanted, leaf, step)
        self.learn_leaves(at, wanted, leaf, step)

    def learn_classes(self, at: np.ndarray, wanted: np.ndarray, leaf: np.ndarray, step: float = STEP) -> None:
        w = self.weights
        # Row numbers have 16 bits at most, which numpy sorts by counting.
        flat = w.at_rows(at).T.astype(np.uint16).ravel()
        order = np.argsort(flat, kind="stable")
        rows, counts = exchange.runs(flat[order])
        rows = rows.astype(np.int64)
        place = np.empty(len(flat), np.int64)
        place[order] = np.repeat(np.arange(len(rows)), counts)
        held = w.rows.take(rows, axis=0)
        _, e = _powers(held, place.reshape(-1, len(wanted)).T, w.bias)
        gradient = np.zeros((len(wanted) + 1, CLASSES), np.float32)
        np.divide(e, np.einsum("ij->i", e)[:, None], out=gradient[:-1])
        gradient[np.arange(len(wanted)), wanted] -= 1
        token = np.tile(np.arange(len(wanted)), at.shape[1])
        total = _run_sums(gradient, token.take(order), counts.astype(np.int64))
        scale = self._rows.take(rows) + np.einsum("ij,ij->i", total, total)
        self._rows[rows] = scale
        total *= (step / np.sqrt(scale + 1e-6))[:, None]
        held -= total
        w.whole[rows] = held.view(w.whole.dtype)[:, 0]
        total = gradient.sum(axis=0)
        self._bias += float((total * total).sum())
        w.bias -= step * total / np.sqrt(self._bias)

    def learn_leaves(self, at: np.ndarray, wanted: np.ndarray, leaf: np.ndarray, step: float = STEP) -> None:
        """Places are sorted, so that the tables are read and written once a place and in order."""
        w = self.weights
        many = np.flatnonzero(wanted >= _SUFFIX)
        if not len(many):
            return
        at, wanted, leaf = at.T[:, many].T, wanted[many], leaf[many]
        node, right = _paths(wanted, leaf)
        places = w.at_nodes(at, node)
        keys = np.sort((places.ravel() << _PLACE) + np.arange(places.size))
        entry = keys & ((1 << _PLACE) - 1)
        keys >>= _PLACE
        new = np.ones(len(keys), np.bool_)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        place, run = keys[new], np.cumsum(new) - 1
        held = w.pairs.take(place)
        weights = np.empty(places.size, np.float32)
        weights[entry] = held.take(run)
        gradient = np.empty(places.shape, np.float32)
        gradient[:] = 1 / (1 + np.exp(-_lean(weights.reshape(places.shape), w.odds.take(node)))) - right
        total = np.bincount(run, weights=gradient.ravel().take(entry)).astype(np.float32)
        scale = self._pairs.take(place) + total * total
        self._pairs[place] = scale
        w.pairs[place] = held - step * total / np.sqrt(scale)


_BLOCK = 1 << 14


def train(docs: DataFrame, counts: Counts, part_of: Column) -> Weights:
    """Weights after ROUNDS rounds; round r uses the texts where `part_of` is r."""
    weights = Weights.start(counts.mass, counts.distinct)
    n_blocks = -(-len(weights.flat) // _BLOCK)
    context = docs.sparkSession.sparkContext
    for r in range(ROUNDS):
        shared = context.broadcast((counts, weights.flat, weights.odds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, given, odds = shared.value
            local = Weights(given.copy(), odds)
            learner = Learner(local)
            seen = 0
            for batch in batches:
                for part in slices(batch.column("text"), 1_000_000):
                    hashes, kinds, first = tokens(part)
                    wanted, leaf = known.classes(hashes, kinds), leaves(hashes)
                    for low in range(0, len(wanted), _GROUP):
                        at = features(hashes, first, low, low + _GROUP)
                        # The two softmaxes share no weights; one after the other they need less cache.
                        for learn in (learner.learn_classes, learner.learn_leaves):
                            for here in range(0, len(at), BATCH):
                                own = slice(low + here, low + here + BATCH)
                                learn(at[here : here + BATCH], wanted[own], leaf[own])
                    seen += len(wanted)
            if seen:
                change = (local.flat - given).astype("<f2")
                blocks = [change[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in range(n_blocks)]
                arrays = [pa.array(range(n_blocks), pa.int32()), pa.array([seen] * n_blocks, pa.int64()), pa.array(blocks, pa.binary())]
                yield pa.record_batch(arrays, ["block", "seen", "change"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for p, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    change = np.frombuffer(raw.as_buffer(), "<f2").astype(np.float64)
                    sums[p] = sums.get(p, 0.0) + change * n
                    seen[p] = seen.get(p, 0.0) + (change != 0) * float(n)
            for p, total in sums.items():
                mean = (total / np.maximum(seen[p], 1.0)).astype("<f4").tobytes()
                yield pa.record_batch([pa.array([p], pa.int32()), pa.array([mean], pa.binary())], ["block", "change"])

        changes = docs.where(part_of == F.lit(r)).mapInArrow(run, "block int, seen long, change binary")
        summed = store(changes.repartition(n_blocks, "block").mapInArrow(add, "block int, change binary"), "weights")
        for row in summed.collect():  # the weights, 8 MB at most
            low = row["block"] * _BLOCK
            weights.flat[low : low + _BLOCK] += np.frombuffer(row["change"], "<f4")
        drop_stored(summed)
    return weights


def _rare_sums(docs: DataFrame, counts) -> DataFrame:
    """key, sum of log10(count + 1) and tokens with a count, over a text's words that aren't
    on the list of frequent words. `docs` has key, text and whether the row is for training."""
    n_buckets = partitions(docs.sparkSession)
    kinds = ("<i8", "<u4", "<u8", "<u4", "u1")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, hashes, times, learn = (np.concatenate(c) for c in zip(*held, strict=True))
            sent = []
            for b, (k, h, t, v) in exchange.parted(exchange.buckets_of(hashes, n_buckets), (keys, hashes, times, learn)):
                sent.append((b, exchange.pack([*exchange.runs(k), h, t, v])))
            return exchange.batch([b for b, _ in sent], [x for _, x in sent])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            learn = batch.column("training").to_numpy(zero_copy_only=False)
            for part in slices(batch.column("text")):
                words = part.hashes(lower=True)
                rare = counts.value.known(words) < 0
                words, owner = words[rare], part.owner[rare]
                order = np.lexsort((words, owner))
                words, owner = words[order], owner[order]
                new = np.ones(len(words), np.bool_)
                new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(words))).astype(np.uint32)
                row = owner[new] + part.low
                held.append((keys[row], words[new], times, learn[row].astype(np.uint8)))
                size += len(times)
                if size >= exchange.FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for x in b.column("blob"):
                k, n, *rest = exchange.unpack(x.as_buffer().to_pybytes(), kinds)
                rows.append((np.repeat(k, n), *rest))
        if not rows:
            return
        keys, hashes, times, learn = (np.concatenate(c) for c in zip(*rows, strict=True))
        _, inverse = np.unique(hashes, return_inverse=True)
        count = np.bincount(inverse, weights=times * (learn > 0))[inverse]
        order = np.lexsort((hashes, keys))
        keys, hashes, times, count = keys[order], hashes[order], times[order].astype(np.float64), count[order]
        new = np.ones(len(keys), np.bool_)  # a repeated row sends the same words again
        new[1:] = (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])
        keys, times, count = keys[new], times[new], count[new]
        own, sizes = exchange.runs(keys)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]])
        logs = np.add.reduceat(times * np.log10(count + 1), starts)
        found = np.add.reduceat(times * (count > 0), starts).astype(np.int64)
        sent = list(exchange.parted(exchange.slots_of_keys(own, n_buckets), (own, logs, found)))
        yield exchange.batch([s for s, _ in sent], [exchange.pack(c) for _, c in sent])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a text over all buckets of words."""
        blobs = [exchange.unpack(x.as_buffer().to_pybytes(), ("<i8", "<f8", "<i8")) for b in batches for x in b.column("blob")]
        if blobs:
            keys, logs, found = (np.concatenate(c) for c in zip(*blobs, strict=True))
            own, inverse = np.unique(keys, return_inverse=True)
            totals = (np.bincount(inverse, weights=logs), np.bincount(inverse, weights=found).astype(np.int64))
            for low in range(0, len(own), 50_000):
                part = slice(low, low + 50_000)
                yield pa.record_batch([pa.array(c[part]) for c in (own, *totals)], ["key", "rare_log", "rare_known"])

    by_word = exchange.meet(docs.mapInArrow(send, exchange.BLOBS)).mapInArrow(total, exchange.BLOBS)
    return exchange.meet(by_word).mapInArrow(add, "key long, rare_log double, rare_known long")


def _score(counts, weights) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = counts.value, Weights(*weights.value)
        logs = np.append(np.log10(known.count + 1.0), 0.0)
        mass = np.log10(np.maximum(known.mass, 1.0))
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for part in slices(batch.column("text"), 500_000):
                hashes, kinds, first = tokens(part)
                place = known.known(hashes)
                wanted, at = known.classes(hashes, kinds), features(hashes, first)
                leaf = np.where(wanted >= _SUFFIX, leaves(hashes), 0)
                gain = np.empty(len(hashes))
                for low in range(0, len(hashes), BATCH):
                    gain[low : low + BATCH] = model.log_share(at[low : low + BATCH], wanted[low : low + BATCH])
                for low in range(0, len(hashes), BATCH):
                    one, own, end = at[low : low + BATCH], wanted[low : low + BATCH], leaf[low : low + BATCH]
                    gain[low : low + BATCH] = (gain[low : low + BATCH] + model.log_leaf(one, own, end)) / np.log(10) - mass[own, end]
                columns[0] += np.diff(first).tolist()
                columns[1] += np.add.reduceat(gain, first[:-1]).tolist()
                columns[2] += np.add.reduceat(logs[place], first[:-1]).tolist()
                columns[3] += np.add.reduceat((place >= 0).astype(np.int64), first[:-1]).tolist()
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.record_batch(
                [batch.column("key"), batch.column("doc_id"), batch.column("held_out"), *arrays],
                ["key", "doc_id", "held_out", "n_tokens", "gain", "common_log", "common_known"],
            )

    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    document, learning from those that are not held out."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    learning = rows.where(~F.col("held_out"))
    found = count_words(learning.select("text"))
    weights = train(learning.select("text", "key"), found, F.pmod("key", F.lit(ROUNDS)))
    counts, model = context.broadcast(found), context.broadcast((weights.flat, weights.odds))
    scored = rows.mapInArrow(
        _score(counts, model), "key long, doc_id long, held_out boolean, n_tokens long, gain double, common_log double, common_known long"
    )
    rare = _rare_sums(rows.select("key", "text", (~F.col("held_out")).alias("training")), counts)
    logs = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(found.tokens + found.distinct + 1))).alias("base_score"),
        (logs + F.col("gain")).alias("score"),
    )
