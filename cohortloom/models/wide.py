"""Logistic models whose predictors have very many levels.

The dense models keep a number per pair of terms on the driver. Here a term per level is a
row of a level table, and the driver holds only the few other terms ("dense": intercept,
numbers, columns of few levels), however many levels there are.

A Newton step is one scan of the folded cells, joined to the levels' coefficients: each level
gets the sum of its weights, of its weighted dense values and of its residuals. With one wide
predictor the levels exclude each other, so the equations are diagonal but for the dense
border, and eliminating the levels solves them exactly. With several, conjugate gradients
solve them: a product with the information matrix is a scan of the cells that joins the
direction and adds it up by level, and the elimination over the widest predictor is the
preconditioner. Vectors over levels stay tables all the way.

The input is read once: its distinct rows, with counts, give the kinds of the predictors and
the cells. With one wide predictor the cells are laid out by level once, so that a step moves
the levels' coefficients and no cells, adds up each level where it lies and writes one table.

Defined results: rows that lack the outcome or a predictor are left out. The reference of a
wide predictor is the first of its levels in text order among the rows used. A level whose
rows all have one outcome has a coefficient that grows until the step limit or the floor of
probabilities ends it. Standard errors come with one wide predictor only; else they are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.scalars import text_form
from ..functions.stats import two_sided_normal_p
from ..session import discard, stored
from .frame import Term, build_design, encode_outcome, predictor_kinds
from .logistic import term_rows
from .newton import solved

# Conjugate gradients end when the preconditioned residual has shrunk so far: a Newton step
# need not be solved more closely than it moves.
_SHARE = 0.1
_MOST_PRODUCTS = 200
DENSE = -1  # `which` of the rows of a level table that belong to the dense terms


@dataclass
class WideModel:
    dense_terms: list[Term]
    dense: np.ndarray  # intercept first
    dense_errors: np.ndarray | None
    wide: list[str]
    references: list[str]
    levels: DataFrame  # which, level, b, error
    skipped: list[dict[str, str]]
    n: int
    events: int
    steps: int
    converged: bool
    warnings: list[str] = field(default_factory=list)

    def terms(self) -> DataFrame:
        """A row per term, in the form of the dense models' term table."""
        spark = self.levels.sparkSession
        errors = self.dense_errors[1:] if self.dense_errors is not None else None
        own = spark.createDataFrame(term_rows(self.dense_terms, self.dense[1:], errors), _TERMS)
        names, first = F.array(*map(F.lit, self.wide)), F.array(*map(F.lit, self.references))
        b, se = F.col("b"), F.col("error")
        reach = fv.CONFIDENCE_Z * se
        name = F.get(names, F.col("which"))
        rows = self.levels.select(
            F.concat(name, F.lit(": "), F.col("level")).alias("term"), name.alias("predictor"), F.lit("indicator").alias("kind"),
            F.get(first, F.col("which")).alias("reference_level"), F.round(b, 4).alias("coefficient"), _ratio(b).alias("odds_ratio"),
            _ratio(b - reach).alias("ci_low"), _ratio(b + reach).alias("ci_high"), F.round(se, 4).alias("standard_error"),
            F.round(b / se, 3).alias("z"), F.round(_normal_p(b / se), 4).alias("p_value"),
        )
        return own.unionByName(rows) if self.dense_terms else rows


_TERMS = (
    "term string, predictor string, kind string, reference_level string, coefficient double, odds_ratio double, "
    "ci_low double, ci_high double, standard_error double, z double, p_value double"
)


def _ratio(value: Column) -> Column:
    return F.round(F.exp(F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0))), 3)


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else two_sided_normal_p(v))


def _folded(df: DataFrame, names: list[str]) -> tuple[DataFrame, str]:
    """(distinct rows of the named columns with counts, the count's name)."""
    names = [n for n in dict.fromkeys(names) if n in df.columns]
    count = "n"
    while count in (n.lower() for n in names):
        count = f"_{count}"
    return df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias(count)), count


def _cells(df: DataFrame, count: str, label: Column, dense: list[Term], wide: list[str]) -> DataFrame:
    """(label, x, l0, l1, ..., n): distinct complete rows with counts."""
    x = F.array(*[t.value.cast("double") for t in dense]) if dense else F.array().cast("array<double>")
    levels = [text_form(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"l{i}") for i, c in enumerate(wide)]
    rows = df.select(label.cast("double").alias("label"), x.alias("x"), *levels, F.col(count).alias("n"))
    complete = F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    for i in range(len(wide)):
        complete &= F.col(f"l{i}").isNotNull()
    return rows.where(complete).groupBy("label", "x", *[f"l{i}" for i in range(len(wide))]).agg(F.sum("n").cast("double").alias("n"))


def _with_levels(cells: DataFrame, table: DataFrame | None, value: str, m: int) -> DataFrame:
    """Cells with `b0`, `b1`, ...: the value of each cell's level, zero for a reference."""
    for k in range(m):
        if table is None:
            cells = cells.withColumn(f"b{k}", F.lit(0.0))
            continue
        own = table.where(F.col("which") == k).select(F.col("level").alias(f"l{k}"), F.col(value).alias(f"b{k}"))
        cells = cells.join(own, f"l{k}", "left").withColumn(f"b{k}", F.coalesce(f"b{k}", F.lit(0.0)))
    return cells


def _along(dense: np.ndarray, m: int) -> Column:
    """The dense vector's and the levels' share of each cell, added up."""
    total = F.lit(float(dense[0]))
    for i, v in enumerate(dense[1:]):
        total = total + F.get("x", F.lit(i)) * F.lit(float(v))
    for k in range(m):
        total = total + F.col(f"b{k}")
    return total


def _scored(cells: DataFrame, levels: DataFrame | None, dense: np.ndarray, m: int) -> DataFrame:
    """Cells with their weight and residual at the given coefficients."""
    clip, floor = F.lit(fv.SIGMOID_CLIP), F.lit(fv.PROBABILITY_FLOOR)
    eta = F.greatest(F.least(_along(dense, m), clip), -clip)
    p = F.greatest(F.least(1 / (1 + F.exp(-eta)), 1 - floor), floor)
    rows = _with_levels(cells, levels, "b", m).withColumn("p", p)
    keep = [f"{c}{k}" for k in range(m) for c in "lb"]
    return rows.select("x", *keep, (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("w"), (F.col("n") * (F.col("label") - F.col("p"))).alias("r"))


def _row(which: int, level: Column, **values: Column) -> Column:
    return F.struct(F.lit(which).alias("which"), level.alias("level"), *[v.alias(k) for k, v in values.items()])


def _dense_parts(q: int) -> list[Column]:
    """A row for each row of the dense block."""
    parts = []
    for i in range(q):
        x = F.get("xi", F.lit(i))
        parts.append(_row(DENSE, F.lit(str(i)), w=F.col("w") * x, wx=_times(F.col("w") * x), r=F.col("r") * x, b=F.lit(0.0)))
    return parts


def _times(c: Column) -> Column:
    return F.transform("xi", lambda v: v * c)


def _added(rows: DataFrame, keys: list[str], q: int) -> DataFrame:
    added = [F.sum(F.get("wx", F.lit(j))).alias(f"wx{j}") for j in range(q)]
    found = rows.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("r").alias("r"), F.max("b").alias("b"), *added)
    return found.select(*keys, "w", F.array(*[f"wx{j}" for j in range(q)]).alias("wx"), "r", "b")


def _sums(scored: DataFrame, m: int, q: int) -> DataFrame:
    """(which, level, w, wx, r, b) per level; with several wide predictors also the dense block
    by row, as DENSE rows."""
    rows = scored.withColumn("xi", F.concat(F.array(F.lit(1.0)), "x"))
    if m == 1:
        # Grouped by the column by which the cells are laid out, so nothing moves.
        found = _added(rows.select(F.col("l0").alias("level"), "w", _times(F.col("w")).alias("wx"), "r", F.col("b0").alias("b")), ["level"], q)
        return found.select(F.lit(0).alias("which"), *found.columns)
    parts = [_row(k, F.col(f"l{k}"), w=F.col("w"), wx=_times(F.col("w")), r=F.col("r"), b=F.col(f"b{k}")) for k in range(m)]
    return _added(rows.select(F.inline(F.array(*parts, *_dense_parts(q)))), ["which", "level"], q)


def _dense_block(sums: DataFrame, scored: DataFrame, m: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(information, gradient) of the dense terms."""
    matrix, gradient = np.zeros((q, q)), np.zeros(q)
    if m == 1 and q == 1:
        row = sums.agg(F.sum("w").alias("w"), F.sum("r").alias("r")).first()
        matrix[0, 0], gradient[0] = row["w"], row["r"]
        return matrix, gradient
    if m == 1:
        rows = scored.withColumn("xi", F.concat(F.array(F.lit(1.0)), "x"))
        sums = _added(rows.select(F.inline(F.array(*_dense_parts(q)))), ["which", "level"], q)
    for row in sums.where(F.col("which") == DENSE).collect():
        matrix[int(row["level"])], gradient[int(row["level"])] = row["wx"], row["r"]
    return matrix, gradient


def _dot(values: np.ndarray) -> Column:
    """wx times a dense vector."""
    total = F.lit(0.0)
    for j, v in enumerate(values):
        total = total + F.get("wx", F.lit(j)) * F.lit(float(v))
    return total


class _Elimination:
    """Solves the dense terms and the levels of one predictor exactly; the other levels by their
    own weight alone."""

    def __init__(self, levels: DataFrame, matrix: np.ndarray, ridge: float, value: str | None = None):
        """The shares that `dense` needs of the column `value` are taken on the way."""
        q = len(matrix)
        self.first, self.own = F.col("which") == 0, F.col("w") + F.lit(ridge)
        cross = [F.sum(F.when(self.first, F.get("wx", F.lit(i)) * F.get("wx", F.lit(j)) / self.own)).alias(f"c{i}_{j}") for i in range(q) for j in range(i, q)]
        sums = levels.agg(*cross, *(self._shares(value, q) if value else [])).first()
        self.known = {value: sums} if value else {}
        taken = np.zeros((q, q))
        for i in range(q):
            for j in range(i, q):
                taken[i, j] = taken[j, i] = sums[f"c{i}_{j}"] or 0.0
        self.left = matrix + ridge * np.diag([0.0] + [1.0] * (q - 1)) - taken
        self.singular = False

    def _shares(self, value: str, q: int) -> list[Column]:
        return [F.sum(F.when(self.first, F.get("wx", F.lit(j)) * F.col(value) / self.own)).alias(f"s{j}") for j in range(q)]

    def dense(self, levels: DataFrame, value: str, dense: np.ndarray) -> np.ndarray:
        sums = self.known[value] if value in self.known else levels.agg(*self._shares(value, len(dense))).first()
        move, singular = solved(self.left, dense - np.array([sums[f"s{j}"] or 0.0 for j in range(len(dense))]))
        self.singular |= singular
        return move

    def level(self, value: str, dense: np.ndarray) -> Column:
        return (F.col(value) - F.when(self.first, _dot(dense)).otherwise(0.0)) / self.own


def _product(scored: DataFrame, levels: DataFrame, dense: np.ndarray, m: int) -> DataFrame:
    """The information matrix times a direction: (which, level, h)."""
    rows = _with_levels(scored.drop(*[f"b{k}" for k in range(m)]), levels, "d", m).withColumn("t", F.col("w") * _along(dense, m))
    parts = [_row(k, F.col(f"l{k}"), h=F.col("t")) for k in range(m)]
    parts += [_row(DENSE, F.lit(str(i)), h=F.col("t") * (F.get("x", F.lit(i - 1)) if i else F.lit(1.0))) for i in range(len(dense))]
    return rows.select(F.inline(F.array(*parts))).groupBy("which", "level").agg(F.sum("h").alias("h"))


def _conjugate(scored: DataFrame, levels: DataFrame, matrix: np.ndarray, gradient: np.ndarray, m: int) -> tuple[np.ndarray, DataFrame]:
    """(dense move, levels with a column `move`) by preconditioned conjugate gradients."""
    ridge = fv.RIDGE
    own_ridge = ridge * np.array([0.0] + [1.0] * (len(gradient) - 1))
    solver = _Elimination(levels, matrix, ridge)
    u, r = np.zeros_like(gradient), gradient.copy()
    table = stored(levels.select("which", "level", "w", "wx", "b", F.lit(0.0).alias("u"), "r", F.lit(0.0).alias("old")), "wide")
    beta, d, first, size = 0.0, np.zeros_like(gradient), None, math.inf
    for _ in range(_MOST_PRODUCTS):
        z = solver.dense(table, "r", r)
        here = solver.level("r", z)
        found = float(table.agg(F.sum(F.col("r") * here)).first()[0] or 0.0) + float(r @ z)
        first = found if first is None else first
        beta = 0.0 if math.isinf(size) else found / size
        size = found
        if found <= 0 or math.sqrt(found) <= _SHARE * math.sqrt(first) and beta:
            break
        d = z + beta * d
        ahead = table.select("which", "level", "w", "wx", "b", "u", "r", (here + beta * F.col("old")).alias("d"))
        product = stored(_product(scored, ahead, d, m), "wide")
        h = np.zeros_like(gradient)
        for row in product.where(F.col("which") == DENSE).collect():
            h[int(row["level"])] = row["h"]
        h += own_ridge * d
        both = ahead.join(product, ["which", "level"]).withColumn("h", F.col("h") + ridge * F.col("d"))
        length = float(both.agg(F.sum(F.col("d") * F.col("h"))).first()[0] or 0.0) + float(d @ h)
        step = size / length
        u, r = u + step * d, r - step * h
        new = both.select(
            "which", "level", "w", "wx", "b", (F.col("u") + step * F.col("d")).alias("u"), (F.col("r") - step * F.col("h")).alias("r"), F.col("d").alias("old")
        )
        after = stored(new, "wide")
        discard(product)
        discard(table)
        table = after
    return u, table.withColumn("move", F.col("u"))


def fit_wide(df: DataFrame, outcome: str, predictors: list[str]) -> WideModel:
    """Fit by Newton steps; every categorical predictor with more than a few levels is wide."""
    df, count = _folded(df, [outcome, *predictors])
    df, cells = df.persist(), None
    try:
        label = encode_outcome(df, outcome)
        kinds = predictor_kinds(df, predictors, outcome)
        wide = [n for n, kind in kinds.kinds.items() if kind == "categorical" and n not in kinds.values]
        if not wide:
            raise ValueError("No predictor has many levels; use a dense model.")
        narrow = [n for n in kinds.kinds if n not in wide]
        dense_terms = build_design(df, narrow, outcome).terms if narrow else []
        m, q = len(wide), len(dense_terms) + 1
        cells = _cells(df, count, label.label, dense_terms, wide)
        if m == 1:
            # A given number keeps the layout of the cells known to each step's join.
            cells = cells.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l0").sortWithinPartitions("l0")
        cells = cells.persist()
        levels, dense, steps, converged, singular, held, sums = None, np.zeros(q), 0, False, False, None, None
        head = cells.agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("events"), *[F.min(f"l{k}").alias(f"l{k}") for k in range(m)],
            *[F.approx_count_distinct(f"l{k}").alias(f"c{k}") for k in range(m)],
        ).first()
        df.unpersist()
        if not head["n"] or head["events"] in (0, head["n"]):
            raise ValueError("The complete rows hold one outcome class only.")
        # The predictor that is eliminated exactly is the one with most levels.
        order = sorted(range(m), key=lambda k: -head[f"c{k}"])
        wide, references = [wide[k] for k in order], [head[f"l{k}"] for k in order]
        cells = cells.withColumnsRenamed({f"l{k}": f"_{i}" for i, k in enumerate(order)}).withColumnsRenamed({f"_{i}": f"l{i}" for i in range(m)})
        reference = F.lit(False)
        for k, name in enumerate(references):
            reference |= (F.col("which") == k) & (F.col("level") == name)
        while steps < fv.NEWTON_STEPS and not converged:
            scored = _scored(cells, levels, dense, m)
            scored = scored.persist() if m > 1 or q > 1 else scored
            before, sums = sums, stored(_sums(scored, m, q), "wide")
            matrix, gradient = _dense_block(sums, scored, m, q)
            own = sums.where((F.col("which") != DENSE) & ~reference)
            if m == 1:
                solver = _Elimination(own, matrix, fv.RIDGE, "r")
                move = solver.dense(own, "r", gradient)
                moved, singular = own.withColumn("move", solver.level("r", move)), singular or solver.singular
            else:
                move, moved = _conjugate(scored, own, matrix, gradient, m)
            scored.unpersist()
            dense, steps = dense + move, steps + 1
            largest = moved.agg(F.max(F.abs("move"))).first()[0] or 0.0
            converged = max(float(np.abs(move).max()), largest) < fv.NEWTON_TOLERANCE
            after = moved.select("which", "level", (F.col("b") + F.col("move")).alias("b"))
            if m == 1:  # read off the sums, which stay until the next ones are there
                used = [before]
            else:
                after, used = stored(after, "wide"), [sums, levels, moved]
            for table in {id(f): f for f in used if f is not None}.values():
                discard(table)
            levels = after
        scored = _scored(cells, levels, dense, m)
        scored = scored.persist() if m == 1 and q > 1 else scored
        held = stored(_sums(scored, m, q), "wide")
        matrix, _ = _dense_block(held, scored, m, q)
        scored.unpersist()
        if m == 1 and sums is not None:
            discard(sums)
    finally:
        for used in (df, cells):
            if used is not None:
                used.unpersist()
    own = held.where((F.col("which") != DENSE) & ~reference)
    errors, error = None, F.lit(None).cast("double")
    if m == 1:
        solver = _Elimination(own, matrix, 0.0)
        inverse = np.linalg.pinv(solver.left)
        diagonal = np.diag(inverse)
        errors = np.sqrt(diagonal) if (diagonal >= 0).all() else None
        # Block inverse: a level's variance is 1/w plus what it shares with the dense terms.
        share = sum((_dot(inverse[i]) * F.get("wx", F.lit(i)) for i in range(q)), F.lit(0.0)) / (F.col("w") * F.col("w"))
        error = F.sqrt(1 / F.col("w") + share)
    notes = {"A step used the pseudo-inverse of a singular matrix.": singular, "Model did not fully converge.": not converged}
    return WideModel(
        dense_terms, dense, errors, wide, references, own.select("which", "level", "b", error.alias("error")), kinds.skipped,
        int(head["n"]), int(head["events"]), steps, converged, [note for note, applies in notes.items() if applies],
    )
