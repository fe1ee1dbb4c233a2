"""L1 logistic regression over a penalty path, with fold choice of the penalty.

All (training set, penalty) models advance together: one scan returns each
model's gradient and Hessian, and the driver takes a proximal Newton step by
coordinate descent on the small quadratic. The optimum is the one a first-order
method reaches after many scans; here a handful suffices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.stats import clipped_exp
from .frame import ModelFrame
from .logistic import fold_count, folded_cells
from .newton import InsideFold, OutsideFold, newton_sums

_OUTER_STEPS = 100
_TOLERANCE = 1e-7


@dataclass
class LassoResult:
    frame: ModelFrame
    cells: DataFrame
    beta: np.ndarray
    intercept: float
    standardized: np.ndarray
    penalty: float
    converged: bool
    selection_method: str
    selection_rule: str
    folds: int
    fallback_reason: str | None
    penalties: np.ndarray
    mean_loss: np.ndarray | None
    se_loss: np.ndarray | None
    lambda_min: float | None
    lambda_1se: float | None
    bic: np.ndarray
    path_coefficients: np.ndarray
    scaling: _Scaling | None = None
    warnings: list[str] = field(default_factory=list)


@dataclass
class _Scaling:
    """Training-set means and scales as a map from raw to standardized terms."""

    mean: np.ndarray
    scale: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        p = len(self.mean)
        t = np.zeros((p + 1, p + 1))
        t[0, 0] = 1.0
        t[1:, 0] = -self.mean / self.scale
        t[1:, 1:] = np.diag(1.0 / self.scale)
        return t


def _moments(cells: DataFrame, terms: int) -> DataFrame:
    x = [F.get("x", F.lit(i)) for i in range(terms)]
    return cells.groupBy("fold").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("label")).alias("events"),
        *[F.sum(F.col("n") * c).alias(f"a{i}") for i, c in enumerate(x)],
    )


def _centred_squares(cells: DataFrame, centre: np.ndarray) -> DataFrame:
    gaps = [F.get("x", F.lit(i)) - F.lit(float(c)) for i, c in enumerate(centre)]
    return cells.groupBy("fold").agg(
        *[F.sum(F.col("n") * g).alias(f"d{i}") for i, g in enumerate(gaps)],
        *[F.sum(F.col("n") * g * g).alias(f"q{i}") for i, g in enumerate(gaps)],
    )


def _scalings(cells: DataFrame, terms: int, folds: int) -> tuple[list[_Scaling], np.ndarray, np.ndarray]:
    """Scaling, rows and events of each fold's complement, then of all rows.

    Squares are summed around the overall means, so no precision is lost.
    """
    first = {r["fold"]: r for r in _moments(cells, terms).collect()}
    n_all = sum(r["n"] for r in first.values())
    centre = np.array([sum(r[f"a{i}"] for r in first.values()) / n_all for i in range(terms)])
    second = {r["fold"]: r for r in _centred_squares(cells, centre).collect()}
    scalings, sizes, events = [], [], []
    for left_out in [*range(folds), -1]:
        kept = [f for f in first if f != left_out]
        n = sum(first[f]["n"] for f in kept)
        d = np.array([sum(second[f][f"d{i}"] for f in kept) for i in range(terms)]) / n
        q = np.array([sum(second[f][f"q{i}"] for f in kept) for i in range(terms)]) / n
        scale = np.sqrt(np.maximum(q - d * d, 0.0))
        scale = np.where(np.isfinite(scale) & (scale > fv.MIN_SPREAD), scale, 1.0)
        scalings.append(_Scaling(centre + d, scale))
        sizes.append(n)
        events.append(sum(first[f]["events"] for f in kept))
    return scalings, np.array(sizes, dtype=float), np.array(events, dtype=float)


def _descend(gradient: np.ndarray, hessian: np.ndarray, beta: np.ndarray, penalty: float) -> np.ndarray:
    """Minimize the penalized quadratic around ``beta``; term 0 is unpenalized."""
    new = beta.copy()
    slope = -gradient.copy()
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(beta)):
            curvature = hessian[j, j]
            if curvature <= 0:
                continue
            aim = new[j] - slope[j] / curvature
            if j:
                aim = math.copysign(max(abs(aim) - penalty / curvature, 0.0), aim)
            change = aim - new[j]
            if change:
                slope += hessian[:, j] * change
                new[j] = aim
                largest = max(largest, abs(change) * math.sqrt(curvature))
        if largest < 1e-11:
            break
    return new


def _fit_all(
    cells: DataFrame, scalings: list[_Scaling], sizes: np.ndarray, events: np.ndarray,
    owner: np.ndarray, penalties: np.ndarray, weights: OutsideFold,
) -> tuple[np.ndarray, np.ndarray]:
    """Standardized coefficients (models x terms+1) and convergence of every model."""
    models = len(owner)
    p = len(scalings[0].mean) + 1
    rate = np.clip(events / sizes, 1e-4, 1 - 1e-4)
    beta = np.zeros((models, p))
    beta[:, 0] = np.log(rate / (1 - rate))[owner]
    previous, best = beta.copy(), np.full(models, np.inf)
    converged = np.zeros(models, dtype=bool)
    active = np.arange(models)
    maps = [s.matrix for s in scalings]
    for _ in range(_OUTER_STEPS):
        raw = np.stack([maps[owner[m]].T @ beta[m] for m in active])
        sums = newton_sums(cells, raw, active, weights)
        still = []
        for i, m in enumerate(active):
            t, n = maps[owner[m]], sizes[owner[m]]
            objective = -sums.loglik[i] / n + penalties[m] * np.abs(beta[m, 1:]).sum()
            if objective > best[m] + 1e-12:
                # Overshot: go half-way back and look again.
                beta[m] = (beta[m] + previous[m]) / 2
                if np.max(np.abs(beta[m] - previous[m])) >= _TOLERANCE:
                    still.append(m)
                else:
                    converged[m] = True
                continue
            best[m], previous[m] = objective, beta[m].copy()
            new = _descend(t @ sums.gradient[i] / n, t @ sums.hessian[i] @ t.T / n, beta[m], penalties[m])
            moved = np.max(np.abs(new - beta[m]))
            beta[m] = new
            if moved < _TOLERANCE:
                converged[m] = True
            else:
                still.append(m)
        active = np.array(still, dtype=int)
        if not len(active):
            break
    return beta, converged


def penalty_path(largest: float) -> np.ndarray:
    if not np.isfinite(largest) or largest <= 1e-8:
        return np.array([0.0])
    lowest = max(largest * fv.LASSO_MIN_RATIO, fv.LASSO_MIN_PENALTY)
    return np.geomspace(largest, lowest, fv.LASSO_PENALTIES)


def fit_lasso(frame: ModelFrame, row_keys: list[str]) -> LassoResult:
    folds = fold_count(frame)
    if folds:
        cells = folded_cells(frame, row_keys, folds).persist()
    else:
        cells = frame.cells().withColumn("fold", F.lit(0)).persist()
    terms = len(frame.terms)
    scalings, sizes, events = _scalings(cells, terms, folds)
    whole = len(scalings) - 1

    # Largest useful penalty: the steepest standardized slope at the null model.
    null = np.zeros((1, terms + 1))
    null[0, 0] = math.log(events[whole] / (sizes[whole] - events[whole]))
    at_null = newton_sums(cells, null, np.array([0]), OutsideFold((-1,)), second_order=False)
    slopes = (scalings[whole].matrix @ at_null.gradient[0])[1:] / sizes[whole]
    path = penalty_path(float(np.max(np.abs(slopes))))

    owner = np.repeat(np.arange(folds + 1), len(path))
    left_out = tuple(int(f) for f in np.repeat([*range(folds), -1], len(path)))
    beta, converged = _fit_all(
        cells, scalings, sizes, events, owner, np.tile(path, folds + 1), OutsideFold(left_out)
    )
    raw = np.stack([scalings[owner[m]].matrix.T @ beta[m] for m in range(len(owner))])
    full = slice(folds * len(path), None)

    fit_sums = newton_sums(cells, raw[full], np.arange(len(path)), OutsideFold((-1,) * len(path)), False)
    nonzero = (np.abs(beta[full][:, 1:]) > fv.LASSO_SELECTED).sum(axis=1)
    bic = -2 * fit_sums.loglik + (nonzero + 1) * math.log(frame.n)
    bic_index = int(np.argmin(bic))

    mean = se = None
    reason = None
    chosen, lowest = bic_index, None
    if folds:
        models = np.arange(folds * len(path))
        held = newton_sums(cells, raw[: folds * len(path)], models, InsideFold(left_out), False)
        losses = (-held.loglik / held.weight).reshape(folds, len(path)).T
        mean = losses.mean(axis=1)
        se = losses.std(axis=1, ddof=1) / math.sqrt(folds)
        lowest = int(np.argmin(mean))
        chosen = int(np.nonzero(mean <= mean[lowest] + se[lowest])[0][0])
    else:
        reason = "an outcome class has fewer than 3 complete rows"
    at = full.start + chosen
    return LassoResult(
        frame=frame, cells=cells,
        beta=raw[at, 1:], intercept=float(raw[at, 0]), standardized=beta[at, 1:],
        penalty=float(path[chosen]), converged=bool(converged[at]),
        selection_method="cross_validation" if folds else "bic_fallback",
        selection_rule="lambda_1se" if folds else "bic",
        folds=folds, fallback_reason=reason, penalties=path, mean_loss=mean, se_loss=se,
        lambda_min=float(path[lowest]) if folds else None,
        lambda_1se=float(path[chosen]) if folds else None,
        bic=bic, path_coefficients=beta[full], scaling=scalings[whole],
    )


def optimality_gaps(result: LassoResult) -> np.ndarray:
    """How far each penalty's coefficients are from the optimality conditions, in one scan.

    The mean slope of the likelihood along a standardized term has to be the penalty, with the
    coefficient's sign, where that is not zero; at most the penalty where it is; and zero along
    the intercept. The objective is convex, so the conditions hold at its minimum alone.
    """
    beta, t = result.path_coefficients, result.scaling.matrix
    raw, models = beta @ t, np.arange(len(beta))
    sums = newton_sums(result.cells, raw, models, OutsideFold((-1,) * len(beta)), second_order=False)
    slope = (sums.gradient @ t.T) / sums.weight[:, None]
    penalty = result.penalties[:, None]
    inner = np.where(beta[:, 1:] != 0, np.abs(slope[:, 1:] - penalty * np.sign(beta[:, 1:])), np.maximum(np.abs(slope[:, 1:]) - penalty, 0.0))
    return np.maximum(np.abs(slope[:, 0]), inner.max(axis=1))


LASSO_SCHEMA = (
    "term string, predictor string, kind string, reference_level string, coefficient double, "
    "standardized_coefficient double, abs_standardized_coefficient double, odds_ratio double, "
    "selected boolean, selected_rank int"
)


def lasso_rows(result: LassoResult) -> list[tuple]:
    """Selected terms first, largest standardized effect first, then by name."""
    rows = []
    for i, term in enumerate(result.frame.terms):
        z, b = float(result.standardized[i]), float(result.beta[i])
        rows.append((abs(z) > fv.LASSO_SELECTED, z, b, term))
    rows.sort(key=lambda r: (not r[0], -abs(round(r[1], 4)), r[3].name))
    out, rank = [], 0
    for selected, z, b, term in rows:
        rank += selected
        out.append(
            (
                term.name, term.predictor, term.kind, term.reference, round(b, 4), round(z, 4),
                round(abs(z), 4), round(clipped_exp(b), 3), bool(selected), rank if selected else None,
            )
        )
    return out


def penalty_rows(result: LassoResult) -> list[tuple]:
    if result.mean_loss is None:
        return []
    return [
        (round(float(p), 6), round(float(m), 4), round(float(s), 4))
        for p, m, s in zip(result.penalties, result.mean_loss, result.se_loss, strict=True)
    ]
