"""Pack examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Each task
fills its sequences one after another from a bounded pool of waiting examples. The next
example is the one whose demand, measured against what is still free in every dimension,
has the largest dot product; where cutting is allowed, an example that no longer fits whole
is cut at the limit that binds, and the rest goes back to the pool. So only the last
sequence of a task has padding, and no example meets another task: there is no shuffle.

Defined results: a null or empty text is one piece of one end token; null and repeated ids
are packed like any other. Without cutting, an example over a limit is cut all the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vocab import default_path, worker_words
from .words import slices


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 4096


# Examples that wait in a task; a pool this deep always has something that fits. Fewer wait
# when they are long: beyond so many tokens the pool takes no more.
POOL = 512
POOL_TOKENS = 1 << 21


class Packer:
    """Sequences of one task. Takes (key, ids, loss mask) and gives finished pieces."""

    def __init__(self, limits: Limits, first_sequence: int, cut: bool = True, pool: int = POOL, pool_tokens: int = POOL_TOKENS):
        self.limits, self.cut, self.depth, self.most = limits, cut, pool, pool_tokens
        self.sequence = first_sequence
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.free = self.full.copy()
        self.keys: list = []
        self.ids: list[np.ndarray] = []
        self.borne: list[np.ndarray] = []  # loss-bearing tokens before each place
        self.at: list[int] = []  # place in what is held; `gone` places before it are not held any more
        self.gone: list[int] = []
        self.size = np.zeros(0)
        self.lossy = np.zeros(0)

    def _next_sequence(self) -> None:
        self.sequence += 1
        self.free = self.full.copy()

    def _choose(self) -> int:
        """The waiting example with the best dot product among those that fit whole, else -1."""
        room = self.free / self.full
        fits = (self.size <= self.free[0]) & (self.lossy <= self.free[2])
        if self.free[1] < 1 or not fits.any():
            return -1
        score = room[0] * self.size / self.full[0] + room[1] / self.full[1] + room[2] * self.lossy / self.full[2]
        return int(np.where(fits, score, -1.0).argmax())

    def _reach(self, i: int) -> int:
        """Tokens of example i that still fit."""
        n = int(min(self.size[i], self.free[0]))
        if self.free[2] < self.lossy[i]:
            ahead = self.borne[i][self.at[i] : self.at[i] + n + 1]  # at most a sequence of places
            n = int(np.searchsorted(ahead - ahead[0], self.free[2], "right")) - 1
        return n if self.free[1] >= 1 else 0

    def _place(self, i: int, n: int) -> tuple:
        begin = self.at[i]
        piece = self.ids[i][begin : begin + n]
        borne = int(self.borne[i][begin + n] - self.borne[i][begin])
        out = (self.keys[i], self.gone[i] + begin, piece, borne, self.gone[i] + len(self.ids[i]), self.sequence, int(self.full[0] - self.free[0]))
        self.free -= (n, 1, borne)
        self.at[i] += n
        self.size[i] -= n
        self.lossy[i] -= borne
        if self.size[i] <= 0:
            for kept in (self.keys, self.ids, self.borne, self.at, self.gone):
                kept[i] = kept[-1]
                kept.pop()
            self.size[i], self.lossy[i] = self.size[-1], self.lossy[-1]
            self.size, self.lossy = self.size[:-1], self.lossy[:-1]
        elif 2 * self.size[i] < len(self.ids[i]):  # let go of what is placed, each id being copied once or twice
            self.ids[i], self.borne[i] = self.ids[i][self.at[i] :].copy(), self.borne[i][self.at[i] :].copy()
            self.gone[i], self.at[i] = self.gone[i] + self.at[i], 0
        if self.free[0] < 1 or self.free[1] < 1:
            self._next_sequence()
        return out

    def _step(self) -> tuple:
        """Place one piece."""
        i = self._choose()
        if i >= 0:
            return self._place(i, int(self.size[i]))
        largest = int(self.size.argmax())
        if self.cut or self.size[largest] > self.full[0] or self.lossy[largest] > self.full[2]:
            if n := self._reach(largest):
                return self._place(largest, n)
        self._next_sequence()
        return self._step()

    def add(self, keys: list, ids: list[np.ndarray], loss: list[np.ndarray]) -> Iterator[tuple]:
        for low in range(0, len(keys), self.depth):
            part = slice(low, low + self.depth)
            self.keys += keys[part]
            self.ids += ids[part]
            borne = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in loss[part]]
            self.borne += borne
            self.at += [0] * len(keys[part])
            self.gone += [0] * len(keys[part])
            self.size = np.concatenate([self.size, [len(x) for x in ids[part]]])
            self.lossy = np.concatenate([self.lossy, [int(x[-1]) for x in borne]])
            while len(self.keys) > self.depth or self.size.sum() > self.most:
                yield self._step()

    def finish(self) -> Iterator[tuple]:
        while self.keys:
            yield self._step()


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pack(
    docs: DataFrame,
    limits: Limits = Limits(),
    vocabulary: str | None = None,
    end_id: int = 2,
    cut: bool = True,
    with_ids: bool = True,
    prompt_tokens: str | None = None,
) -> DataFrame:
    """One row per piece. `ids` are little-endian unsigned 32-bit integers (null without
    `with_ids`). `prompt_tokens` names a column with the number of leading tokens of a text
    that bear no loss; without it every token bears loss. `sequence_id` is unique over tasks."""
    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    columns += [docs[prompt_tokens].cast("long").alias("prompt")] if prompt_tokens else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words("json", vocabulary or default_path("word_bpe_49k.json"))
        packer = Packer(limits, TaskContext.get().partitionId() << 33, cut)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            prompts = batch.column(2).to_pylist() if prompt_tokens else None
            for part in slices(batch.column(1)):
                flat, sizes = words.ids(words.codes(part, part.hashes()))
                ends = np.concatenate([[0], np.cumsum(sizes)])[part.first]
                ids = [np.append(flat[a:b], np.int32(end_id)).astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                loss = [np.ones(len(x), np.bool_) for x in ids]
                rows = range(part.low, part.low + len(part))
                if prompts:
                    for mask, row in zip(loss, rows, strict=True):
                        mask[: max(0, prompts[row] or 0)] = False
                yield from _table(packer.add([doc_ids[r] for r in rows], ids, loss), with_ids)
        yield from _table(packer.finish(), with_ids)

    return docs.select(*columns).mapInArrow(run, PIECES)


def _table(pieces: Iterator[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    rows = [
        (key, begin, len(x), whole, sequence, offset, borne, zlib.crc32(raw := x.tobytes()), raw if with_ids else None)
        for key, begin, x, borne, whole, sequence, offset in pieces
    ]
    if rows:
        kinds = [pa.int64()] * 8 + [pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PIECES.fieldNames())
