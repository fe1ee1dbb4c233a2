"""Batched Newton passes: many logistic models per scan of the frame.

A pass sends the coefficients of all active models with the task, reads each
Arrow batch once, and returns per-model sums (gradient, Hessian, loss). The sums
combine in Spark; the driver only solves p x p systems.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

# weights(cell counts, fold ids, chunk ids or None, model ids) -> cells x models
Weights = Callable[[np.ndarray, np.ndarray, "np.ndarray | None", np.ndarray], np.ndarray]


def all_rows(n: np.ndarray, fold: np.ndarray, chunk: np.ndarray | None, models: np.ndarray) -> np.ndarray:
    return np.repeat(n[:, None], len(models), axis=1)


@dataclass(frozen=True)
class OutsideFold:
    """Model m trains on every fold but its own; -1 stands for all rows."""

    folds: tuple[int, ...]

    def __call__(self, n, fold, chunk, models):
        own = np.asarray(self.folds)[models]
        return n[:, None] * (fold[:, None] != own[None, :])


@dataclass(frozen=True)
class InsideFold:
    """Model m is assessed on its own fold only."""

    folds: tuple[int, ...]

    def __call__(self, n, fold, chunk, models):
        own = np.asarray(self.folds)[models]
        return n[:, None] * (fold[:, None] == own[None, :])


def sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -fv.SIGMOID_CLIP, fv.SIGMOID_CLIP)))


def batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(X with intercept, y, n, fold, chunk) of one Arrow batch."""
    column = batch.column(batch.schema.get_field_index("x"))
    rows = batch.num_rows
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = np.column_stack([np.ones(rows), flat.reshape(rows, -1)])
    y, n, fold, chunk = (
        batch.column(at).to_numpy(zero_copy_only=False) if (at := batch.schema.get_field_index(name)) >= 0 else None
        for name in ("label", "n", "fold", "chunk")
    )
    return x, y.astype(float), n.astype(float), np.zeros(rows, dtype=int) if fold is None else fold, chunk


def whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order; where there is a column ``chunk``, none is split over batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if "chunk" not in batch.schema.names:
            yield batch
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        chunk = batch.column(batch.schema.get_field_index("chunk")).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(chunk != chunk[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield held


@dataclass
class PassSums:
    """Per active model: gradient, Hessian, log-likelihood, weight and event weight."""

    gradient: np.ndarray
    hessian: np.ndarray
    loglik: np.ndarray
    weight: np.ndarray
    events: np.ndarray


_SUM_SCHEMA = "model int, sums binary"
_BLOCK_ELEMENTS = 4_000_000


def _curvature(x: np.ndarray, w: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper triangle of X'WX for each column of weights."""
    if len(upper[0]) <= w.shape[1] * x.shape[1]:
        return w.T @ (x[:, upper[0]] * x[:, upper[1]])
    return np.stack([((x * w[:, [m]]).T @ x)[upper] for m in range(w.shape[1])])


def newton_sums(
    cells: DataFrame,
    betas: np.ndarray,
    models: np.ndarray,
    weights: Weights = all_rows,
    second_order: bool = True,
) -> PassSums:
    """One scan: sums of all ``models`` at ``betas`` (models x terms)."""
    p = betas.shape[1]
    upper = np.triu_indices(p)
    width = p + len(upper[0]) + 3
    floor = fv.PROBABILITY_FLOOR

    def rows_of(sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(models.astype(np.int32)), pa.array([r.tobytes() for r in sums], pa.binary())], ["model", "sums"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), width))
        seen = False
        enter = getattr(weights, "enter", None)  # draws that are made once a batch
        for batch in whole_chunks(batches):
            seen = True
            x, y, n, fold, chunk = batch_arrays(batch)
            if enter:
                enter(n, chunk)
            # Blocks of models keep the cells x models matrices small.
            step = max(1, _BLOCK_ELEMENTS // len(y))
            for at in range(0, len(models), step):
                part = slice(at, at + step)
                prob = np.clip(sigmoid(x @ betas[part].T), floor, 1 - floor)
                w = weights(n, fold, chunk, models[part])
                sums[part, :p] += (w * (y[:, None] - prob)).T @ x
                if second_order:
                    rows = max(1, _BLOCK_ELEMENTS // max(p, min(len(upper[0]), w.shape[1] * p)))
                    for low in range(0, len(y), rows):
                        some = slice(low, low + rows)
                        sums[part, p:-3] += _curvature(x[some], w[some] * prob[some] * (1 - prob[some]), upper)
                logs = np.where(y[:, None] == 1, np.log(prob), np.log(1 - prob))
                sums[part, -3] += (w * logs).sum(axis=0)
                sums[part, -2] += w.sum(axis=0)
                sums[part, -1] += (w * y[:, None]).sum(axis=0)
        if seen:
            yield rows_of(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[model] = total.get(model, 0.0) + np.frombuffer(raw.as_buffer())
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["model", "sums"])

    needed = [c for c in ("x", "label", "n", "fold", "chunk") if c in cells.columns]
    partial = cells.select(*needed).mapInArrow(scan, _SUM_SCHEMA)
    place = {int(m): i for i, m in enumerate(models)}
    out = np.zeros((len(models), width))
    # One row a model; the driver holds the sums it needs for the solve, and no more.
    for row in partial.repartition("model").mapInArrow(add, _SUM_SCHEMA).collect():
        out[place[row["model"]]] = np.frombuffer(row["sums"])
    hessian = np.zeros((len(models), p, p))
    hessian[:, upper[0], upper[1]] = out[:, p:-3]
    hessian[:, upper[1], upper[0]] = out[:, p:-3]
    return PassSums(out[:, :p], hessian, out[:, -3], out[:, -2], out[:, -1])


def solved(information: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, bool]:
    """(Newton move, whether the matrix was singular)."""
    try:
        return np.linalg.solve(information, gradient), False
    except np.linalg.LinAlgError:
        return np.linalg.pinv(information) @ gradient, True


def wald_errors(information: np.ndarray) -> np.ndarray | None:
    """Root of the diagonal of the inverse; None where that has a negative entry."""
    p = len(information)
    variance = np.column_stack([solved(information, column)[0] for column in np.eye(p)])
    diagonal = np.diag(variance)
    return np.sqrt(diagonal) if (diagonal >= 0).all() else None


@dataclass
class LogisticFits:
    betas: np.ndarray
    converged: np.ndarray
    pseudo_inverse: np.ndarray
    usable: np.ndarray


def fit_batch(cells: DataFrame, terms: int, models: int, weights: Weights = all_rows) -> LogisticFits:
    """Ridge-stabilized Newton for many models at once; settled models leave the pass."""
    p = terms + 1
    ridge = np.eye(p) * fv.RIDGE
    ridge[0, 0] = 0.0
    betas = np.zeros((models, p))
    converged = np.zeros(models, dtype=bool)
    pseudo = np.zeros(models, dtype=bool)
    usable = np.ones(models, dtype=bool)
    active = np.arange(models)
    for _ in range(fv.NEWTON_STEPS):
        sums = newton_sums(cells, betas[active], active, weights)
        one_class = (sums.events <= 0) | (sums.events >= sums.weight)
        usable[active[one_class]] = False
        still = []
        for i, model in enumerate(active):
            if one_class[i]:
                continue
            move, singular = solved(sums.hessian[i] + ridge, sums.gradient[i])
            pseudo[model] |= singular
            betas[model] += move
            if np.max(np.abs(move)) < fv.NEWTON_TOLERANCE:
                converged[model] = True
            else:
                still.append(model)
        active = np.array(still, dtype=int)
        if not len(active):
            break
    return LogisticFits(betas, converged, pseudo, usable)


def standard_errors(cells: DataFrame, beta: np.ndarray) -> np.ndarray | None:
    return wald_errors(newton_sums(cells, beta[None, :], np.array([0])).hessian[0])


def linear_score(beta: np.ndarray, x: str = "x"):
    """Predicted probability of one model as a column expression."""
    eta = F.lit(float(beta[0]))
    for i, b in enumerate(beta[1:]):
        eta = eta + F.get(x, F.lit(i)) * F.lit(float(b))
    clip = F.lit(fv.SIGMOID_CLIP)
    bounded = F.greatest(F.least(eta, clip), -clip)
    return 1.0 / (1.0 + F.exp(-bounded))
