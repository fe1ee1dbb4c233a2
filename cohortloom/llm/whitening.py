"""Whiten embeddings by a polarisation covariance.

For any two dimensions a and b, var(a+b) - var(a) - var(b) = 2 cov(a, b). So the scan only
adds up squares: for every dimension and for every sum of two dimensions, the squared values
after centring. Entries are whole numbers and so are all the sums; the covariances are exact
fractions until each is rounded once to a double for `eigh`.

An entry x is centred by the whole part c of its mean S/n. With r = S - n*c the exact sum
follows: sum (n*x - S)^2 = n^2 * sum (x - c)^2 - n * r^2.

The driver holds d(d+1)/2 sums and the d x d matrix (d: dimensions of a vector), whatever
the number of rows. Only the distinct vectors are shuffled, after merging on the map side.

Defined results: rows whose vector is null, or holds a null or non-finite entry, go. A vector
shorter than the longest counts as if zeros followed. An entry beyond the range of a long
counts as the nearest long. Null and repeated ids stay. A component without variance has
`whitened` null and `explained` 0; without any variance `explained` and `identity_error` are
null too. Equal eigenvalues share a plane, in which the choice of axes is arbitrary. A
`deviation` beyond the range of a long is null, and `deviation_text` has its digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import drop_stored, store

SCALE = 256
# Rows that are worked on together; memory follows it, results do not.
ROWS = 4096
_LONG = 2**63 - 1
# Sums travel as two whole numbers, value = high * _SPLIT + low, each far below 10^38.
_SPLIT = 10**18


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: sizes, sums, eigenvalues by falling size, and their vectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def axes(self, k: int) -> np.ndarray:
        """First k components over the square root of their variance; nan without variance."""
        values = self.values[:k]
        floor = len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0) if len(self.values) else 0.0
        spread = np.where(values > floor, values, np.nan)
        return self.vectors[:, :k] / np.sqrt(spread)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        shifted = (x - np.array(self.whole, x.dtype)).astype(np.float64)
        return (shifted - np.array([r / self.n for r in self.rest])) @ self.axes(k)


def whole_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is usable, all of one length."""
    raw = embeddings.select(
        embeddings[id_column].cast("long").alias("vec_id"), embeddings[vector].cast("array<double>").alias("v")
    ).where("v is not null and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))")
    longest = raw.agg(F.max(F.size("v"))).first()[0] or 0
    scaled = F.transform("v", lambda e: F.floor(e * F.lit(float(SCALE))).cast("long"))
    padded = F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v")))
    return raw.select("vec_id", padded.alias("x"))


def _matrix(column: pa.Array, low: int, high: int, d: int) -> np.ndarray:
    return column.slice(low, high - low).flatten().to_numpy(zero_copy_only=False).reshape(high - low, d)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            high = min(low + ROWS, batch.num_rows)
            yield batch, low, high, _matrix(batch.column(column), low, high, d)


def _narrow(x: np.ndarray, shift: list[int], factor: int = 1) -> np.ndarray:
    """factor * x - shift per column, exact: longs where they hold twice that, else Python integers."""
    if not len(x):
        return x
    tops = [max(abs(factor * int(lo) - s), abs(factor * int(hi) - s), factor * abs(int(lo)), factor * abs(int(hi))) for lo, hi, s in zip(x.min(0), x.max(0), shift, strict=True)]
    wide = max(tops, default=0) > 2**61 or max(map(abs, shift), default=0) > 2**61
    kind = object if wide else np.int64
    return x.astype(kind) * factor - np.array(shift, kind)


def square_sums(t: np.ndarray) -> list[int]:
    """Exact sum of squares of each column."""
    if not t.size:
        return [0] * t.shape[1]
    top = max(abs(int(t.max())), abs(int(t.min())))
    if t.dtype == object or top >= 2**31:
        return [sum(int(v) ** 2 for v in column) for column in t.T]
    step = max(1, min(len(t), (2**63 - 1) // max(1, top * top)))
    total = [0] * t.shape[1]
    for low in range(0, len(t), step):
        part = t[low : low + step]
        total = [a + b for a, b in zip(total, np.einsum("ij,ij->j", part, part).tolist(), strict=True)]
    return total


_TOTALS = T.StructType([T.StructField("place", T.LongType()), T.StructField("high", T.DecimalType(38, 0)), T.StructField("low", T.DecimalType(38, 0))])


def _emit(totals: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    parts = [divmod(v, _SPLIT) for v in totals]
    columns = [pa.array(range(len(totals)), pa.int64())]
    columns += [pa.array([Decimal(p[i]) for p in parts], pa.decimal128(38, 0)) for i in (0, 1)]
    return pa.record_batch(columns, _TOTALS.fieldNames())


def _add_up(x: DataFrame, length: int, totals) -> list[int]:
    """Sum over all tasks of the whole numbers that `totals(batches)` gives for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _emit(totals(batches))

    rows = x.mapInArrow(run, _TOTALS).groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [0] * length
    for r in rows:
        out[r["place"]] = int(r["high"]) * _SPLIT + int(r["low"])
    return out


def _plus(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def fit(distinct: DataFrame, d: int) -> Whitening:
    """Fit on a column x of d longs, each vector once."""

    def first(batches):
        total = [0] * (d + 1)
        for _, _, _, x in _blocks(batches, 0, d):
            sums = x.sum(0).tolist() if x.size and max(abs(int(x.max())), abs(int(x.min()))) < 2**50 else [sum(map(int, c)) for c in x.T]
            total = _plus(total, [len(x), *sums])
        return total

    n, *sums = _add_up(distinct, d + 1, first)
    if not n or not d:
        return Whitening(n, tuple(sums), np.zeros(0), np.zeros((d, 0)), 0.0)
    whole, rest = [s // n for s in sums], [s % n for s in sums]

    def squares(batches):
        total = [0] * (d * (d + 1) // 2)
        for _, _, _, x in _blocks(batches, 0, d):
            z = _narrow(x, whole)
            found = square_sums(z)
            for a in range(d - 1):
                found += square_sums(z[:, a : a + 1] + z[:, a + 1 :])
            total = _plus(total, found)
        return total

    # Sums in the order: dimensions, then the pairs (0,1), (0,2), ..., (1,2), ...
    found = _add_up(distinct, d * (d + 1) // 2, squares)
    pairs = [(a, b) for a in range(d) for b in range(a + 1, d)]
    deviation = [n * n * found[a] - n * rest[a] ** 2 for a in range(d)]
    matrix = np.zeros((d, d))
    for a in range(d):
        matrix[a, a] = deviation[a] / n**3
    for (a, b), q in zip(pairs, found[d:], strict=True):
        both = n * n * q - n * (rest[a] + rest[b]) ** 2
        matrix[a, b] = matrix[b, a] = (both - deviation[a] - deviation[b]) / (2 * n**3)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[lead, np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), values, vectors, sum(deviation) / n**3)


def identity_error(distinct: DataFrame, model: Whitening, d: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for _, _, _, x in _blocks(batches, 0, d):
            w = model.project(_narrow(x, [0] * d), k)
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.record_batch([pa.array(range(len(total)), pa.int64()), pa.array(total)], ["place", "value"])

    rows = dict(distinct.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect())
    total = np.array([rows[i] for i in range(k + k * k)]) / model.n
    error = total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)
    return None if np.isnan(error).all() else float(np.nanmax(np.abs(error)))


WHITENED = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
        T.StructField("deviation_text", T.StringType()),
    ]
)


def _deviations(x: np.ndarray, model: Whitening) -> list[int]:
    centred = _narrow(x, list(model.sums), model.n)
    top = max(abs(int(centred.max())), abs(int(centred.min()))) if centred.size else 0
    if centred.dtype == object or top * top * max(1, x.shape[1]) > _LONG:
        return [sum(int(v) ** 2 for v in row) for row in centred]
    return np.einsum("ij,ij->i", centred, centred).tolist()


def whiten(embeddings: DataFrame, components: int = 4, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component. The fit list is each distinct whole vector once."""
    x = whole_vectors(embeddings, id_column, vector)
    distinct = store(x.select("x").distinct(), "vectors")
    head = distinct.select(F.size("x")).first()
    d = head[0] if head else 0
    model = fit(distinct, d)
    k = min(components, d)
    error = identity_error(distinct, model, d, k) if model.n and k else None
    drop_stored(distinct)
    values = [max(0.0, float(v)) for v in model.values[:k]]
    explained = [v / model.trace if model.trace else None for v in values]
    names = WHITENED.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, rows in _blocks(batches, 1, d):
            deviations = _deviations(rows, model)
            w = model.project(_narrow(rows, [0] * d), k).ravel()
            ids = batch.column(0).slice(low, high - low).take(pa.array(np.repeat(np.arange(high - low), k)))
            each = [v for v in deviations for _ in range(k)]
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), high - low)),
                pa.array([model.n] * len(each), pa.int64()),
                pa.array([v if v <= _LONG else None for v in each], pa.int64()),
                pa.array(w, mask=np.isnan(w)),
                pa.array(explained * (high - low), pa.float64()),
                pa.array([error] * len(each), pa.float64()),
                pa.array([str(v) for v in each], pa.string()),
            ]
            yield pa.record_batch(columns, names)

    return x.mapInArrow(run, WHITENED) if k else embeddings.sparkSession.createDataFrame([], WHITENED)
