"""Survival curves and the log-rank test, on counts per whole day.

Rows fold to one count per group and day before anything is ordered, so a group's window
walks the calendar and never the rows.

Defined results: rows without follow-up time or without a group are left out. Without rows a
curve is empty; the log-rank test asks for two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import text_form
from ..functions.stats import chi_square_tail
from .frame import survival_rows

_Z = 1.96
_HALF = 0.5 + 1e-12  # a product of fractions may miss one half by its last digits
MOST_GROUPS = 500  # the test's covariance is groups x groups


def day_counts(df: DataFrame, start: str, event: str, censor: str | None = None, by: str | None = None) -> DataFrame:
    """(group, duration_days, n, events): rows that end on each day of follow-up."""
    rows = survival_rows(df, start, event, censor).df
    group = text_form(F.col(f"`{by}`"), df.schema[by].dataType) if by else F.lit("all")
    return (
        rows.select(group.alias("group"), "duration_days", "event")
        .where("group is not null")
        .groupBy("group", "duration_days")
        .agg(F.count("*").alias("n"), F.sum("event").cast("bigint").alias("events"))
    )


def _log_log(survival: Column, variance: Column, sign: float) -> Column:
    """Bound of the survival on the log(-log) scale, which stays between zero and one."""
    spread = F.lit(sign * _Z) * F.sqrt(variance) / F.log(survival)
    return F.when((survival > 0) & (survival < 1), F.pow(survival, F.exp(spread)))


def kaplan_meier(counts: DataFrame) -> DataFrame:
    """A row per group and day: at risk, events, censored, survival, Greenwood error, 95 % band.

    The survival of a day is the running product of 1 - events / at risk up to it. Its error
    is the survival times the root of the running sum of events / (at risk x survivors); both
    error and band are null once nobody survives.
    """
    onward = Window.partitionBy("group").orderBy(F.desc("duration_days")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("group").orderBy("duration_days").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("at_risk") - F.col("events")
    risk = counts.withColumn("at_risk", F.sum("n").over(onward))
    curve = risk.withColumns(
        {
            "survival": F.product(left / F.col("at_risk")).over(upto),
            "_variance": F.sum(F.try_divide(F.col("events"), F.col("at_risk") * left)).over(upto),
        }
    )
    alive = F.col("survival") > 0
    return curve.select(
        "group",
        F.col("duration_days").cast("bigint").alias("day"),
        "at_risk",
        "events",
        (F.col("n") - F.col("events")).alias("censored"),
        "survival",
        F.when(alive, F.col("survival") * F.sqrt("_variance")).alias("std_error"),
        _log_log(F.col("survival"), F.col("_variance"), -1.0).alias("ci_low"),
        _log_log(F.col("survival"), F.col("_variance"), 1.0).alias("ci_high"),
    )


def median_survival(curve: DataFrame) -> DataFrame:
    """Per group: rows, events, and the first day on which at most half survive (null: never)."""
    return curve.groupBy("group").agg(
        F.max("at_risk").alias("n"),
        F.sum("events").alias("events"),
        F.min(F.when(F.col("survival") <= _HALF, F.col("day"))).alias("median_days"),
        F.min("survival").alias("last_survival"),
    )


@dataclass
class LogRank:
    groups: list[str]
    n: np.ndarray
    observed: np.ndarray
    expected: np.ndarray
    statistic: float
    degrees_of_freedom: int
    p_value: float | None


def log_rank(counts: DataFrame) -> LogRank:
    """Equal hazards in all groups? On each event day a group expects its share of those at
    risk; the covariance of the observed counts is hypergeometric."""
    sizes = counts.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").limit(MOST_GROUPS + 1).collect()
    if not 2 <= len(sizes) <= MOST_GROUPS:
        raise ValueError(f"A log-rank test compares 2 to {MOST_GROUPS} groups.")
    groups = [r["group"] for r in sizes]
    k = len(groups)
    # A row per day with an array over groups: its length is the calendar, whatever the rows.
    each = [F.col("group") == g for g in groups]
    days = counts.groupBy("duration_days").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(each)],
        *[F.sum(F.when(c, F.col("events")).otherwise(0)).alias(f"d{i}") for i, c in enumerate(each)],
    )
    onward = Window.orderBy(F.desc("duration_days")).rowsBetween(Window.unboundedPreceding, 0)
    risk = days.select(
        F.array(*[F.sum(f"n{i}").over(onward).cast("double") for i in range(k)]).alias("n"),
        F.array(*[F.col(f"d{i}").cast("double") for i in range(k)]).alias("d"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k + k * k)
        for batch in batches:
            n, d = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for i in (0, 1))
            deaths, at_risk = d.sum(1), n.sum(1)
            some = deaths > 0
            n, d, deaths, at_risk = n[some], d[some], deaths[some], at_risk[some]
            share = n / at_risk[:, None]
            weight = deaths * (at_risk - deaths) / np.maximum(at_risk - 1, 1)
            covariance = np.diag(weight @ share) - (share * weight[:, None]).T @ share
            total += np.concatenate([d.sum(0), deaths @ share, covariance.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    found = dict(risk.mapInArrow(scan, "place long, value double").groupBy("place").agg(F.sum("value")).collect())
    total = np.array([found.get(i, 0.0) for i in range(2 * k + k * k)])
    observed, expected, covariance = total[:k], total[k : 2 * k], total[2 * k :].reshape(k, k)
    # The groups' differences sum to zero, so one of them adds nothing.
    inner, gap = covariance[:-1, :-1], (observed - expected)[:-1]
    degrees = int(np.linalg.matrix_rank(inner, hermitian=True))
    statistic = float(gap @ np.linalg.pinv(inner, hermitian=True) @ gap)
    return LogRank(groups, np.array([r["n"] for r in sizes]), observed, expected, statistic, degrees, chi_square_tail(statistic, degrees))


LOG_RANK_SCHEMA = "group string, n bigint, observed double, expected double, statistic double, degrees_of_freedom bigint, p_value double"


def log_rank_rows(test: LogRank) -> list[tuple]:
    """A row per group, each with the test's result."""
    result = (round(test.statistic, 4), test.degrees_of_freedom, None if test.p_value is None else round(test.p_value, 4))
    columns = zip(test.groups, test.n.tolist(), test.observed.tolist(), test.expected.tolist(), strict=True)
    return [(g, n, round(o, 4), round(e, 4), *result) for g, n, o, e in columns]


def regression_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least squares of y on x over rows that have both, per group: the line of a scatter plot.
    A group whose x does not vary has no slope."""
    group = F.col(f"`{by}`").cast("string") if by else F.lit("all")
    pair = df.select(group.alias("group"), F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    return (
        pair.where("group is not null and x is not null and y is not null")
        .groupBy("group")
        .agg(
            F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
            F.regr_r2("y", "x").alias("r_squared"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        )
    )
