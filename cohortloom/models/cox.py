"""Cox regression with Breslow ties on whole-day durations.

A Newton step is one grouped scan: sums per duration, then a running total from
the longest duration down over at most a few tens of thousands of days, whatever
the number of rows. Only the step's p + p*p totals reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .frame import Term, _with_terms, build_design, fold, survival_rows
from .logistic import TERM_SCHEMA, term_rows
from .newton import solved, wald_errors


@dataclass
class CoxModel:
    terms: list[Term]
    skipped: list[dict[str, str]]
    beta: np.ndarray
    errors: np.ndarray | None
    converged: bool
    log_likelihood: float
    frame: DataFrame
    n: int
    events: int
    survival_count: int
    checked: DataFrame
    warnings: list[str] = field(default_factory=list)


def _step_sums(cells: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and Hessian at ``beta``."""
    p = len(beta)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = [
        "s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in pairs],
        "d", "de", *[f"dx_{i}" for i in range(p)],
    ]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per duration of each Arrow batch; Spark adds them up."""
        for batch in batches:
            if not batch.num_rows:
                continue
            days, event, flat, n = (batch.column(i) for i in range(4))
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n = n.to_numpy(zero_copy_only=False).astype(float)
            hits = n * event.to_numpy(zero_copy_only=False)
            eta = np.clip(x @ beta, -fv.COX_ETA_CLIP, fv.COX_ETA_CLIP)
            w = np.exp(eta) * n
            at, place = np.unique(days.to_numpy(zero_copy_only=False), return_inverse=True)
            columns = [
                w, *[w * x[:, i] for i in range(p)], *[w * x[:, i] * x[:, j] for i, j in pairs],
                hits, hits * eta, *[hits * x[:, i] for i in range(p)],
            ]
            sums = [np.bincount(place, c, len(at)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), *[pa.array(s) for s in sums]], names=["duration_days", *names]
            )

    # Coefficients travel with the task, not in the plan: every step runs the same compiled code.
    schema = "duration_days int, " + ", ".join(f"{c} double" for c in names)
    parts = cells.select("duration_days", "event", "x", "n").mapInArrow(scan, schema)
    by_day = parts.groupBy("duration_days").agg(*[F.sum(c).alias(c) for c in names])
    # One row per whole day of follow-up: bounded by the calendar, not the data.
    at_risk = Window.orderBy(F.col("duration_days").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in pairs]]
    risk = by_day.withColumns({c: F.sum(c).over(at_risk) for c in summed}).filter("d > 0")
    mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
    d = F.col("d")
    total = risk.agg(
        F.sum(F.col("de") - d * F.log("s0")).alias("ll"),
        *[F.sum(F.col(f"dx_{i}") - d * mean[i]).alias(f"g{i}") for i in range(p)],
        *[
            F.sum(-d * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"h{i}_{j}")
            for i, j in pairs
        ],
    ).first()
    gradient = np.array([total[f"g{i}"] for i in range(p)])
    hessian = np.zeros((p, p))
    for i, j in pairs:
        hessian[i, j] = hessian[j, i] = total[f"h{i}_{j}"]
    return total["ll"], gradient, hessian


@dataclass
class PartialFit:
    """Coefficients that maximize the partial likelihood, and how the search went."""

    beta: np.ndarray
    likelihood: float = math.nan
    settled: bool = False
    singular: bool = False
    errors: np.ndarray | None = None


def fit_cells(cells: DataFrame, p: int) -> PartialFit:
    """Ridge-stabilized ascent on the same Newton pieces as the logistic models."""
    fit = PartialFit(np.zeros(p))
    steps = 0
    while not fit.settled and steps < fv.NEWTON_STEPS:
        fit.likelihood, gradient, hessian = _step_sums(cells, fit.beta)
        move, singular = solved(fv.RIDGE * np.eye(p) - hessian, gradient)
        fit.beta, fit.singular = fit.beta + move, fit.singular or singular
        fit.settled, steps = bool(np.abs(move).max() < fv.NEWTON_TOLERANCE), steps + 1
    fit.errors = wald_errors(-_step_sums(cells, fit.beta)[2])
    return fit


def _some(value, otherwise: str):
    if not value:
        raise ValueError(otherwise)
    return value


def fit_cox(df: DataFrame, start: str, event: str, predictors: list[str], censor: str | None = None) -> CoxModel:
    """Hazard ratios on whole days. Rows without follow-up time are left out first, then rows
    that lack a predictor; what remains at each stage is counted in one scan."""
    _some(predictors, "A Cox model needs a predictor.")
    survival = survival_rows(df, start, event, censor or None)
    known = [F.col(f"`{c}`") for c in dict.fromkeys(predictors) if c in df.columns]
    timed = survival.df.select("duration_days", "event", *known).persist()
    cells = None
    try:
        before = timed.agg(F.count("*").alias("n"), F.sum("event").alias("events")).first()
        _some(before["n"], "The chosen dates give no row with follow-up time.")
        _some(before["events"], "None of the rows has the event.")
        design = build_design(timed, predictors)
        terms = _some(design.terms, "No predictor can be turned into a term.")
        frame = _with_terms(timed, terms, [F.col("duration_days"), F.col("event")])
        after = frame.agg(F.count("*").alias("n"), F.sum("event").alias("events")).first()
        _some(after["n"], "Every row lacks some predictor.")
        events = int(_some(after["events"], "No row with all predictors has the event."))
        cells = fold(frame, ["duration_days", "event", "x"]).persist()
        fit = fit_cells(cells, len(terms))
    finally:
        for held in (cells, timed):
            if held is not None:
                held.unpersist()
    notes = {
        "A step used the pseudo-inverse of a singular matrix.": fit.singular,
        "Model did not fully converge.": not fit.settled,
        "Few events per model term; estimates may vary widely.": events <= max(len(terms) * 5, 5),
    }
    return CoxModel(
        terms, design.skipped, fit.beta, fit.errors, fit.settled, fit.likelihood, frame, after["n"], events,
        before["n"], survival.checked, [note for note, applies in notes.items() if applies],
    )


def cox_table(model: CoxModel) -> DataFrame:
    rows = term_rows(model.terms, model.beta, model.errors)
    return model.frame.sparkSession.createDataFrame(rows, TERM_SCHEMA.format(effect="hazard_ratio"))


def survival_summary(frame: DataFrame) -> DataFrame:
    """Range and median of follow-up, events and censored rows.

    The median walks the day counts (bounded by the calendar), not the rows.
    """
    days = frame.groupBy("duration_days").agg(
        F.count("*").alias("n"), F.sum("event").alias("events")
    )
    through = Window.orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = days.select(
        "duration_days", "n", "events",
        F.sum("n").over(through).alias("upto"), F.sum("n").over(whole).alias("total"),
    )
    before = F.col("upto") - F.col("n")

    def at(rank):
        return F.max(F.when((before < rank) & (rank <= F.col("upto")), F.col("duration_days")))

    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor(F.col("total") / 2) + 1
    return ranked.agg(
        F.min("duration_days").cast("bigint").alias("duration_min_days"),
        F.floor((at(low) + at(high)) / 2).cast("bigint").alias("duration_median_days"),
        F.max("duration_days").cast("bigint").alias("duration_max_days"),
        F.sum("events").cast("bigint").alias("events"),
        (F.sum("n") - F.sum("events")).cast("bigint").alias("censored"),
    )
