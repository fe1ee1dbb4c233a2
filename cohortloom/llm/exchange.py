"""Compact shuffles of numpy columns.

Entries that meet by a hash travel in blobs, one per sending batch and bucket, so that a
shuffled entry costs little more than its hash. What a bucket finds goes back to the rows
it came from in blobs per slot; a slot is a small set of rows that are read together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stored import partitions

BLOBS = "bucket int, blob binary"
SLOTS = "slot int, blob binary"
# A sending batch is flushed at about so many entries.
FLUSH = 1_000_000


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Columns as bytes, each with its length; the reader knows their types."""
    sizes = np.array([len(c) for c in columns], "<u4").tobytes()
    return sizes + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", len(kinds))
    out, at = [], 4 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, run lengths) of neighbouring equal keys."""
    if not len(keys):
        return keys, np.empty(0, np.uint32)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.diff(np.append(edge, len(keys))).astype(np.uint32)


def parted(target: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(target, its entries of each column), in stable order."""
    order = np.argsort(target, kind="stable")
    names, sizes = runs(target[order])
    ends = np.cumsum(sizes, dtype=np.int64)
    ordered = [c[order] for c in columns]
    for name, end, size in zip(names.tolist(), ends.tolist(), sizes.tolist(), strict=True):
        yield name, [c[end - size : end] for c in ordered]


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high half of the hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def batch(targets: list[int], blobs: list[bytes], name: str = "bucket") -> pa.RecordBatch:
    return pa.record_batch([pa.array(targets, pa.int32()), pa.array(blobs, pa.binary())], [name, "blob"])


def meet(blobs: DataFrame) -> DataFrame:
    """All blobs of a bucket in one partition."""
    return blobs.repartition(partitions(blobs.sparkSession), "bucket")


def slots(spark) -> int:
    return partitions(spark)


def slots_of_keys(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(n)).astype(np.int32)
