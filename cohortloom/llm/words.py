"""Words, their hashes and their windows for whole Arrow columns of text, in numpy.

A word is a run of bytes other than space and tab..carriage return. Texts stay UTF-8
bytes; nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about so many bytes, so memory does not follow the batch.
SLICE_BYTES = 2_000_000
# Hashing steps over so many bytes at once, which keeps its tables small for any text length.
_STEP = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, np.bool_)
LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base = np.full(n, _BASE, np.uint64)
    base[0] = 1
    inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


class Slice:
    """Consecutive texts of a batch: bytes, text offsets, word bounds, first word of each text."""

    def __init__(self, low: int, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE):
        self.low, self.data, self.offsets = low, data, offsets
        self.size = len(offsets) - 1
        inside = ~gap[data]
        begins = np.empty(len(data) + 1, np.bool_)
        begins[0], begins[-1] = True, True
        begins[1:-1] = ~inside[:-1]
        begins[offsets] = True  # a text never continues a word of the text before it
        self.starts = np.flatnonzero(inside & begins[:-1])
        closes = np.empty(len(data), np.bool_)
        closes[:-1] = ~inside[1:]
        closes[-1:] = True
        closes |= begins[1:] & inside
        self.ends = np.flatnonzero(inside & closes) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words before each text
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return self.size

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.size), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag of each byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; with `lower`, A-Z count as a-z."""
        table = _BYTE_LOWER if lower else _BYTE
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + _STEP, "right")))
            end = self.ends[stop - 1]
            up, down = powers(end - begin + 1)
            total = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(table[self.data[begin:end]] * up[:-1], out=total[1:])
            s, e = self.starts[at:stop] - begin, self.ends[at:stop] - begin
            out[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = stop
        return out

    def windows(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of `length` words inside one text."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts) - length
        at = np.flatnonzero(np.arange(n) <= last)
        return at, window_hashes(hashes, at, length)


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the `length` words from each place in `at`; another seed is another function."""
    values = mix(hashes + np.uint64(seed * int(_ODD) % (1 << 64))) if seed else hashes
    if length <= 8:
        total = np.zeros(len(at), np.uint64)
        for j in range(length):
            total = total * _BASE + values[at + j]
        return mix(total + np.uint64(length))
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[at + length] - total[at]) * down[at] + np.uint64(length))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES, gap: np.ndarray = _SPACE) -> Iterator[Slice]:
    """The texts of a column in order; null is an empty text. A text is never cut. `gap` marks
    the bytes between words."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        kind = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, kind, len(chunk) + 1, chunk.offset * np.dtype(kind).itemsize).astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        low = 0
        while low < len(chunk):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
            high = min(high, low + 20_000, len(chunk))
            part = bounds[low : high + 1]
            yield Slice(low, raw[part[0] : part[-1]], part - part[0], gap)
            low = high


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+size-1."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(shift, sizes) + np.arange(total)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, np.bool_)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), np.bool_)
    out[order] = same[1:] | same[:-1]
    return out


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """True for each of n places that lies in a window of `length` from a place in `at`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0
