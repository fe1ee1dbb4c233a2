"""Evaluation of scored rows: AUC, ROC, calibration, decision curves.

Every function takes a frame with a 0/1 ``label`` and a ``score`` column. Rows
are first folded to distinct scores (combined on the map side), so repeated
scores cost nothing downstream.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.stats import chi_square_tail
from ..operators.ordered import equal_count_groups, running_sums
from ..session import materialize


def score_table(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., score, pos, neg): weighted class counts per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return scored.groupBy(*(by or []), "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("label") == 0, w).otherwise(0)).cast("bigint").alias("neg"),
    )


def auc_from_table(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., auc, n, events): exact AUC with ties counted one half.

    One lazy plan: inside each score range the wins are counted locally, and a
    range adds (its positives) x (negatives in lower ranges). Only one row per
    range and group reaches the last window.
    """
    by = by or []
    ranged = table.repartitionByRange(*[F.col(c) for c in by], F.col("score")).withColumn(
        "_pid", F.spark_partition_id()
    )
    below = Window.partitionBy(*by, "_pid").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    # Doubles: products of counts leave the bigint range on large tables.
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    parts = local.groupBy(*by, "_pid").agg(
        F.sum(pos * (F.col("_below") + neg / 2)).alias("_wins"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)))
    wins = F.sum(F.col("_wins") + F.col("_pos").cast("double") * F.col("_before"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return placed.groupBy(*by).agg(
        F.try_divide(wins, pairs).alias("auc"),
        (F.sum("_pos") + F.sum("_neg")).alias("n"),
        F.sum("_pos").alias("events"),
    )


def auc(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return auc_from_table(score_table(scored, by, weight), by)


def roc_from_table(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., fpr, tpr): the staircase from (0, 0), rounded, repeats removed.

    Both rates only rise along the curve, so dropping consecutive repeats equals
    ``distinct`` and at most about 20,000 points per group remain.
    """
    by = by or []
    totals = table.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    steps = running_sums(table, by, "score", {"_tp": "pos", "_fp": "neg"}, descending=True)
    if by:
        steps = steps.join(totals, by)
    else:
        first = totals.first()
        steps = steps.withColumns({"_p": F.lit(first["_p"]), "_n": F.lit(first["_n"])})
    points = steps.select(
        *by,
        F.round(F.col("_fp") / F.greatest(F.col("_n"), F.lit(1)), 4).alias("fpr"),
        F.round(F.col("_tp") / F.greatest(F.col("_p"), F.lit(1)), 4).alias("tpr"),
    )
    origin = totals.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin).distinct()


def roc_points(scored: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return roc_from_table(score_table(scored, by, weight), by)


# ---------------------------------------------------------------- calibration


@dataclass
class Calibration:
    """Risk-group table and the goodness-of-fit test over it."""

    status: str
    reason: str | None
    groups: DataFrame | None
    group_count: int = 0
    degrees_of_freedom: int = 0
    statistic: float | None = None
    p_value: float | None = None
    low_expected_count: bool = False


def risk_groups(scored: DataFrame, tie_keys: list[str], total: int, groups: int) -> DataFrame:
    """Observed and expected events per equal-count risk group.

    Rows of equal score are split by ``tie_keys``, which must make rows unique.
    """
    order = [F.col("score"), *[F.col(k) for k in tie_keys]]
    grouped = equal_count_groups(scored.select("label", "score", *tie_keys), order, total, groups)
    sums = grouped.groupBy("group").agg(
        F.count("*").alias("n"),
        F.min("score").alias("risk_min"),
        F.max("score").alias("risk_max"),
        F.sum(F.col("label").cast("double")).alias("observed_events"),
        F.sum("score").alias("expected_events"),
    )
    observed, expected, n = F.col("observed_events"), F.col("expected_events"), F.col("n")
    gap = F.pow(observed - expected, F.lit(2.0))
    floor = F.lit(1e-12)
    return sums.withColumns(
        {
            "observed_non_events": n - observed,
            "expected_non_events": n - expected,
            "contribution": gap / F.greatest(expected, floor) + gap / F.greatest(n - expected, floor),
        }
    )


def rounded_risk_groups(groups: DataFrame) -> DataFrame:
    """The published form of the risk-group table."""
    n = F.col("n")
    return groups.select(
        "group",
        n.cast("bigint").alias("n"),
        F.round("risk_min", 4).alias("risk_min"),
        F.round("risk_max", 4).alias("risk_max"),
        F.round("observed_events", 3).alias("observed_events"),
        F.round("expected_events", 3).alias("expected_events"),
        F.round("observed_non_events", 3).alias("observed_non_events"),
        F.round("expected_non_events", 3).alias("expected_non_events"),
        F.round(F.col("observed_events") / n, 4).alias("observed_event_rate"),
        F.round(F.col("expected_events") / n, 4).alias("expected_event_rate"),
        F.round("contribution", 4).alias("contribution"),
    )


def hosmer_lemeshow(
    scored: DataFrame, tie_keys: list[str], total: int | None = None, groups: int = fv.RISK_GROUPS
) -> Calibration:
    total = scored.count() if total is None else total
    if total < 3:
        return Calibration("fallback", "fewer than 3 complete cases", None)
    actual = min(groups, total)
    if actual < 3:
        return Calibration("fallback", "fewer than 3 risk groups can be formed", None)
    # At most `groups` rows: kept as a written result so the test and the table agree.
    table = materialize(risk_groups(scored, tie_keys, total, actual))
    head = table.agg(
        F.count("*").alias("g"),
        F.sum("contribution").alias("s"),
        F.min(F.least("expected_events", "expected_non_events")).alias("low"),
    ).first()
    df = head["g"] - 2
    return Calibration(
        "fit", None, rounded_risk_groups(table), head["g"], df, head["s"],
        chi_square_tail(head["s"], df), head["low"] < 5,
    )


# --------------------------------------------------------------------- LOESS

_COARSE_BINS = 20_000
_FINE_BINS = 200


class _ScoreBins:
    """Counts of scores in disjoint intervals, refined only where it matters.

    The driver holds interval counts (a bounded number), never scores. For a
    target the k-th distance is bracketed from interval ends; intervals that
    still straddle the bracket are split further in the next pass, until the
    bracket closes on one exact distance.
    """

    def __init__(self, table: DataFrame, low: float, high: float):
        bins = float(_COARSE_BINS)
        self.frame = table.select(
            F.col("score").alias("x"),
            (F.col("pos") + F.col("neg")).alias("n"),
            F.lit(0).alias("parent"),
            F.lit(low).alias("lo"),
            F.lit(bins / (high - low)).alias("scale"),
            F.lit(_COARSE_BINS - 1).alias("last"),
        )
        self.next_id = 1
        self.known: dict[tuple[int, int], tuple[int, float, float]] = {}

    def split(self) -> None:
        place = F.least(F.floor((F.col("x") - F.col("lo")) * F.col("scale")), F.col("last"))
        self.frame = self.frame.withColumn("bin", place.cast("int"))
        found = self.frame.groupBy("parent", "bin").agg(
            F.sum("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")
        )
        for row in found.collect():
            self.known[row["parent"], row["bin"]] = (row["n"], row["a"], row["b"])

    def brackets(self, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        keys = list(self.known)
        n, a, b = (np.array([self.known[key][i] for key in keys], dtype=float) for i in range(3))
        lower, upper, open_bins = np.empty(len(targets)), np.empty(len(targets)), set()
        for i, t in enumerate(targets):
            near = np.maximum(0.0, np.maximum(a - t, t - b))
            far = np.maximum(np.abs(a - t), np.abs(b - t))
            lower[i] = _weighted_kth(near, n, k)
            upper[i] = _weighted_kth(far, n, k)
            if lower[i] < upper[i]:
                wide = (near <= upper[i]) & (far >= lower[i]) & (a < b)
                open_bins.update(np.nonzero(wide)[0].tolist())
        return lower, upper, [keys[i] for i in sorted(open_bins)]

    def refine(self, open_bins: list[tuple[int, int]]) -> None:
        spark = self.frame.sparkSession
        rows = []
        for parent, index in open_bins:
            _, a, b = self.known.pop((parent, index))
            rows.append((parent, index, self.next_id, a, _FINE_BINS / (b - a), _FINE_BINS - 1))
            self.next_id += 1
        schema = "parent int, bin int, child int, lo double, scale double, last int"
        # A few intervals per grid point: bounded by the grid, not the data.
        table = F.broadcast(spark.createDataFrame(rows, schema))
        self.frame = (
            self.frame.select("x", "n", "parent", "bin")
            .join(table, ["parent", "bin"])
            .select("x", "n", F.col("child").alias("parent"), "lo", "scale", "last")
        )
        self.split()


def _weighted_kth(values: np.ndarray, weights: np.ndarray, k: int) -> float:
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(weights[order]), k)])


def kth_distances(table: DataFrame, targets: np.ndarray, k: int, low: float, high: float) -> np.ndarray:
    """Exact distance from each target to its k-th nearest score (with repeats)."""
    bins = _ScoreBins(table, low, high)
    bins.split()
    while True:
        lower, upper, open_bins = bins.brackets(targets, k)
        if not open_bins:
            return upper
        bins.refine(open_bins)


def loess_curve(
    scored: DataFrame, span: float = fv.LOESS_SPAN, points: int = fv.LOESS_POINTS
) -> tuple[DataFrame | None, str | None]:
    """(predicted_risk, observed_rate) by local linear tri-cube smoothing.

    Returns (curve, None) or (None, reason). Passes over the distinct scores:
    one or a few for the bandwidths, one for the weighted sums of all targets.
    """
    table = materialize(score_table(scored))
    head = table.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("pos"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    n = head["n"] or 0
    if n < 3:
        return None, "fewer than 3 complete cases"
    if head["high"] - head["low"] <= 1e-12:
        return None, "predicted risks have no variation"
    targets = np.linspace(0.0, 1.0, points)
    k = max(3, min(n, math.ceil(span * n)))
    bandwidth = kth_distances(table, targets, k, head["low"], head["high"])
    grid = ", ".join(
        f"named_struct('i', {i}, 't', {float(t)!r}D, 'h', {float(h)!r}D)"
        for i, (t, h) in enumerate(zip(targets, bandwidth, strict=True))
    )
    rows = table.select("score", "pos", (F.col("pos") + F.col("neg")).alias("n"), F.expr(f"inline(array({grid}))"))
    dx, h = F.col("score") - F.col("t"), F.col("h")
    narrow = h <= 1e-12
    # Rows at or beyond the bandwidth weigh nothing; dropping them first saves the cubes.
    near = rows.select("i", "t", "h", "n", "pos", dx.alias("dx")).filter(
        (F.abs("dx") < h) | (narrow & (F.abs("dx") <= 1e-12))
    )
    u = F.abs("dx") / h
    rest = 1 - u * u * u
    w = F.when(narrow, 1.0).otherwise(rest * rest * rest)
    weighted = near.withColumn("w", w)
    sums = weighted.groupBy("i", "t", "h").agg(
        F.sum(F.col("w") * F.col("n")).alias("s0"),
        F.sum(F.col("w") * F.col("n") * F.col("dx")).alias("s1"),
        F.sum(F.col("w") * F.col("n") * F.col("dx") * F.col("dx")).alias("s2"),
        F.sum(F.col("w") * F.col("pos")).alias("y0"),
        F.sum(F.col("w") * F.col("pos") * F.col("dx")).alias("y1"),
    )
    spark = scored.sparkSession
    schema = "i int, t double, h double"
    all_targets = spark.createDataFrame(
        [(i, float(t), float(h)) for i, (t, h) in enumerate(zip(targets, bandwidth, strict=True))], schema
    )
    smoothed = _local_linear(head["pos"] / n)
    return (
        all_targets.join(F.broadcast(sums.drop("t", "h")), "i", "left")
        .select(
            F.round("t", 4).alias("predicted_risk"),
            F.round(F.least(F.greatest(smoothed, F.lit(0.0)), F.lit(1.0)), 4).alias("observed_rate"),
        ),
        None,
    )


def _local_linear(mean: float) -> Column:
    s0, s1, s2, y0, y1 = (F.col(c) for c in ("s0", "s1", "s2", "y0", "y1"))
    det = s0 * s2 - s1 * s1
    # One distinct score in reach leaves no slope to fit: use the weighted mean.
    flat = (F.col("h") <= 1e-12) | (det <= 1e-12 * s0 * s2)
    return (
        F.when(s0.isNull() | (s0 <= 1e-12), F.lit(mean))
        .when(flat, y0 / s0)
        .otherwise((s2 * y0 - s1 * y1) / det)
    )


# ------------------------------------------------------------ decision curve

_THRESHOLDS = [round(i * 0.01, 4) for i in range(100)]


def _threshold_bucket(score: Column) -> Column:
    """How many thresholds are <= score, minus one; exact at the edges."""
    edges = F.array(*[F.lit(t) for t in [*_THRESHOLDS, math.inf]])
    guess = F.least(F.greatest(F.floor(score * 100), F.lit(0)), F.lit(99)).cast("int")
    up = score >= F.get(edges, guess + 1)
    down = score < F.get(edges, guess)
    return guess + up.cast("int") - down.cast("int")


def decision_curve(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """Net benefit at 100 thresholds from one bucketed pass (at most 101 groups)."""
    w = F.col(weight) if weight else F.lit(1)
    counts = (
        scored.select(_threshold_bucket(F.col("score")).alias("bucket"), "label", w.alias("w"))
        .groupBy("bucket")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0)).alias("neg"),
        )
    )
    spark = scored.sparkSession
    grid = spark.createDataFrame(list(enumerate(_THRESHOLDS)), "bucket int, threshold double")
    # Full join: a score below zero would sit in bucket -1 and still counts in n.
    table = grid.join(counts, "bucket", "full").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("q"),
    ).filter(F.col("threshold").isNotNull())
    n = F.col("p") + F.col("q")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    model = F.col("tp") / n - F.col("fp") / n * odds
    treat_all = F.col("p") / n - F.col("q") / n * odds
    return table.select(
        "threshold",
        F.round(model, 4).alias("model_net_benefit"),
        F.round(treat_all, 4).alias("treat_all_net_benefit"),
        F.lit(0.0).alias("treat_none_net_benefit"),
        F.col("tp").cast("bigint").alias("true_positives"),
        F.col("fp").cast("bigint").alias("false_positives"),
        (F.col("tp") + F.col("fp")).cast("bigint").alias("classified_positive"),
        F.round((F.col("tp") + F.col("fp")) / n, 4).alias("classification_rate"),
        F.round(F.try_divide(model - treat_all, odds) * 100, 2).alias("interventions_avoided_per_100"),
    )


def superior_range(curve: DataFrame) -> DataFrame:
    """First and last threshold where the model beats both fixed strategies."""
    better = (F.col("model_net_benefit") > F.col("treat_all_net_benefit")) & (
        F.col("model_net_benefit") > F.col("treat_none_net_benefit")
    )
    t = F.when(better, F.col("threshold"))
    return curve.agg(F.min(t).alias("threshold_min"), F.max(t).alias("threshold_max"))
