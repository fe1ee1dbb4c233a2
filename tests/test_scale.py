"""Survival curves, rank boundaries and profiles against direct calculations and plan shapes."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.models import evaluate, survival
from cohortloom.operators import ordered, profile

from test_plans import plan


@pytest.fixture(scope="module")
def follow_up(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        group = [None, "a", "b", "c"][min(3, int(rng.integers(0, 40)) % 13 % 4)]
        days, hit = int(rng.integers(1, 60 if group != "c" else 90)), bool(rng.random() < (0.3 if group == "a" else 0.7))
        rows.append((i, group, days, hit))
    df = spark.createDataFrame(rows, "id int, arm string, days int, hit boolean").select(
        "id", "arm", F.to_date(F.lit("2020-01-01")).alias("start"),
        F.expr("case when hit then date_add(date '2020-01-01', days) end").alias("died"),
        F.expr("case when not hit then date_add(date '2020-01-01', days) end").alias("last_date"),
    )
    return df, [r for r in rows if r[1] is not None]


def test_kaplan_meier_matches_row_by_row(follow_up):
    df, rows = follow_up
    curve = survival.kaplan_meier(survival.day_counts(df, "start", "died", "last_date", "arm")).collect()
    found = {(r["group"], r["day"]): r for r in curve}
    assert len(found) == len({(r[1], r[2]) for r in rows})
    for group in "abc":
        mine, alive, spread, median = [r for r in rows if r[1] == group], 1.0, 0.0, None
        for day in sorted({r[2] for r in mine}):
            at_risk, hits = sum(r[2] >= day for r in mine), sum(r[2] == day and r[3] for r in mine)
            alive *= (at_risk - hits) / at_risk
            spread += hits / (at_risk * (at_risk - hits)) if at_risk > hits else 0.0
            row = found[group, day]
            assert (row["at_risk"], row["events"]) == (at_risk, hits) and row["survival"] == pytest.approx(alive)
            if 0 < alive < 1:
                assert row["std_error"] == pytest.approx(alive * math.sqrt(spread))
                assert row["ci_low"] == pytest.approx(alive ** math.exp(-1.96 * math.sqrt(spread) / math.log(alive)))
                assert 0 <= row["ci_low"] <= alive <= row["ci_high"] <= 1
            median = day if median is None and alive <= 0.5 else median
        summary = survival.median_survival(survival.kaplan_meier(survival.day_counts(df, "start", "died", "last_date", "arm")))
        assert summary.where(F.col("group") == group).first()["median_days"] == median


def test_log_rank_matches_row_by_row(follow_up):
    df, rows = follow_up
    for groups in ("ab", "abc"):
        own = [r for r in rows if r[1] in groups]
        gap, covariance = np.zeros(len(groups)), np.zeros((len(groups), len(groups)))
        for day in sorted({r[2] for r in own if r[3]}):
            n = np.array([sum(r[1] == g and r[2] >= day for r in own) for g in groups], float)
            d = np.array([sum(r[1] == g and r[2] == day and r[3] for r in own) for g in groups], float)
            share, weight = n / n.sum(), d.sum() * (n.sum() - d.sum()) / max(n.sum() - 1, 1)
            gap += d - d.sum() * share
            covariance += weight * (np.diag(share) - np.outer(share, share))
        statistic = gap[:-1] @ np.linalg.inv(covariance[:-1, :-1]) @ gap[:-1]
        test = survival.log_rank(survival.day_counts(df.where(F.col("arm").isin(*groups)), "start", "died", "last_date", "arm"))
        assert test.statistic == pytest.approx(statistic) and test.degrees_of_freedom == len(groups) - 1
        assert test.observed - test.expected == pytest.approx(gap) and 0 <= test.p_value <= 1
    with pytest.raises(ValueError):
        survival.log_rank(survival.day_counts(df.where("arm = 'a'"), "start", "died", "last_date", "arm"))
    assert survival.kaplan_meier(survival.day_counts(df.where("false"), "start", "died", "last_date", "arm")).count() == 0


def test_nobody_left_ends_the_band(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "d int").selectExpr("date '2020-01-01' as start", "date_add(date '2020-01-01', d) as died")
    last = survival.kaplan_meier(survival.day_counts(df, "start", "died")).orderBy("day").collect()[-1]
    assert (last["survival"], last["std_error"], last["ci_low"], last["ci_high"]) == (0.0, None, None, None)


def test_regression_line_by_group(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 4.0, 7.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), (None, 3.0, 3.0)], "g string, x double, y double")
    found = {r["group"]: r for r in survival.regression_line(df, "x", "y", "g").collect()}
    slope, intercept = np.polyfit([1, 2, 4], [2, 4.5, 7], 1)
    assert found["a"]["slope"] == pytest.approx(slope) and found["a"]["intercept"] == pytest.approx(intercept) and found["a"]["n"] == 3
    assert found["b"]["slope"] is None and set(found) == {"a", "b"}


def test_groups_by_boundaries_equal_a_full_ranking(spark):
    rng = np.random.default_rng(1)
    for kind, n in enumerate((517, 640, 333)):
        score = [rng.random(n), np.round(rng.random(n), 1), np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n) * 1e6)][kind]
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(score)], "id int, score double")
        order = sorted(range(n), key=lambda i: (score[i], i))
        small, larger = divmod(n, 10)
        sizes = [small + (g < larger) for g in range(10)]
        wanted = dict(zip(order, np.repeat(np.arange(1, 11), sizes).tolist(), strict=True))
        found = ordered.equal_count_groups(df, [F.col("score"), F.col("id")], n, 10)
        assert {r["id"]: r["group"] for r in found.collect()} == wanted
        cuts = ordered.values_at_ranks(df, F.col("score"), [0, 5, n - 1])
        assert [c.value for c in cuts] == [np.sort(score)[r] for r in (0, 5, n - 1)]


def test_risk_groups_move_no_rows(spark):
    rows = spark.range(5000).selectExpr("id", "id / 7.0 as score", "cast(id % 3 = 0 as int) as label")
    text = plan(evaluate.risk_groups(rows, ["id"], 5000, 10))
    moved = [line for line in text.splitlines() if "Exchange" in line]
    # The one exchange carries a partial sum per group; no row is sorted.
    assert len(moved) == 1 and "hashpartitioning(group" in moved[0] and "Sort" not in text


def test_profile_shuffles_no_texts(spark):
    long = [(i, f"{'same start ' * 60}{i % 900:03d}", f"{i % 5}") for i in range(1800)]
    df = spark.createDataFrame(long, "id int, note string, few string").repartition(4)
    counts = profile.fingerprint_counts(df)
    for line in re.findall(r"Exchange hashpartitioning\(.*?\)", plan(counts)):
        assert "value" not in line and "note" not in line
    found = profile.profile(df, columns=["note", "few"])
    listed = {(r["column"], r["rank"]): (r["value"], r["count"]) for r in found.top(3).collect()}
    notes = sorted({t for _, t, _ in long})
    assert [listed["note", i] for i in (1, 2, 3)] == [(t, 2) for t in notes[:3]]
    assert [listed["few", i] for i in (1, 2, 3)] == [(str(i), 360) for i in range(3)] and len(listed) == 6
    facts = {r["column"]: r for r in found.columns.collect()}
    assert facts["note"]["unique_count"] == 900 and facts["few"]["unique_count"] == 5 and not facts["few"]["is_binary"]
    direct = profile.top_values(profile.value_counts(df, ["note", "few"]), 7)
    assert sorted(map(tuple, found.top(7).collect())) == sorted(map(tuple, direct.collect()))
    assert profile.profile(df.where("false")).top().count() == 0
