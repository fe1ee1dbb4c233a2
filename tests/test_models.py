"""Models on small frames with known answers, and laws that hold on any frame."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.stats import chi_square_tail, two_sided_normal_p
from cohortloom.models import cox, evaluate, lasso, logistic, screen
from cohortloom.models import frame as frames
from cohortloom.plans import templates
from cohortloom.sources.store import RunContext

RUN = RunContext("20260510_120000", "2026-05-10T12:00:00-04:00")
NLR20 = [1.1, 1.4, 1.6, 1.9, 2.1, 2.4, 2.7, 3.0, 3.3, 3.7, 4.1, 4.4, 4.8, 5.2, 5.6, 5.9, 6.3, 6.8, 7.1, 7.5]
AGE20 = [42, 44, 47, 49, 52, 54, 55, 56, 58, 59, 60, 61, 62, 63, 65, 66, 68, 70, 72, 74]
Y20 = [0, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1]
NLR12 = [1.1, 1.4, 1.6, 1.9, 2.1, 2.4, 5.2, 5.6, 6.0, 6.3, 6.8, 7.1]
AGE12 = [42, 44, 47, 49, 52, 54, 60, 63, 65, 68, 70, 72]


@pytest.fixture(scope="module")
def twenty(spark):
    rows = [(i, bool(y), n, a, "FM"[i % 2]) for i, (y, n, a) in enumerate(zip(Y20, NLR20, AGE20))]
    return spark.createDataFrame(rows, "id int, recurrence boolean, nlr double, age int, sex string").coalesce(2).cache()


@pytest.fixture(scope="module")
def twelve(spark):
    rows = [(i, i >= 6, n, a, "FM"[i % 2]) for i, (n, a) in enumerate(zip(NLR12, AGE12))]
    return spark.createDataFrame(rows, "id int, recurrence boolean, nlr double, age int, sex string").coalesce(1).cache()


def newton(x, y, ridge=1e-6):
    beta = np.zeros(x.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.0] + [ridge] * (x.shape[1] - 1))
        move = np.linalg.solve(h, x.T @ (y - p))
        beta += move
        if np.abs(move).max() < 1e-6:
            break
    return beta


def test_logistic_coefficients_errors_and_score_equations(twenty):
    frame = frames.build_model_frame(twenty, "recurrence", ["nlr", "age", "sex"], ["id"])
    model = logistic.fit(frame)
    assert model.beta == pytest.approx([-11.557476, -0.242702, 0.223969, -0.809067], abs=1e-5)
    assert model.errors == pytest.approx([16.221213, 1.599874, 0.379027, 1.115713], abs=1e-4)
    assert [t.name for t in frame.terms] == ["nlr", "age", "sex: m"]
    assert evaluate.auc(model.scored_cells(), weight="n").first()["auc"] == pytest.approx(0.828283, abs=1e-6)
    gap = model.scored("x").agg(*[F.sum((F.col("label") - F.col("score")) * F.get("x", F.lit(i))) for i in range(3)]).first()
    assert max(abs(v) for v in gap) < 1e-3
    test = evaluate.hosmer_lemeshow(model.scored("id"), ["id"])
    assert (test.group_count, test.degrees_of_freedom) == (10, 8)
    assert test.statistic == pytest.approx(9.237046, abs=1e-5) and test.p_value == pytest.approx(0.322696, abs=1e-6)
    assert {r["n"] for r in test.groups.collect()} == {2}
    logistic.release(model)


def test_lasso_path_optimality_and_selection(twenty):
    frame = frames.build_model_frame(twenty, "recurrence", ["nlr", "age", "sex"], ["id"])
    fit = lasso.fit_lasso(frame, ["id"])
    gaps = lasso.optimality_gaps(fit)
    fit.path_coefficients[10] += 1e-3
    assert gaps.max() < 1e-6 and lasso.optimality_gaps(fit)[10] > 1e-5
    fit.path_coefficients[10] -= 1e-3
    fit.cells.unpersist()
    assert fit.penalties[0] == pytest.approx(0.269029, abs=1e-6) and len(fit.penalties) == 30
    assert fit.penalties[-1] == pytest.approx(0.02 * fit.penalties[0])
    x = np.column_stack([NLR20, AGE20, [i % 2 for i in range(20)]]).astype(float)
    z, y = (x - x.mean(0)) / x.std(0), np.array(Y20, float)
    for penalty, beta in zip(fit.penalties, fit.path_coefficients):
        # Subgradient conditions of the penalized optimum.
        p = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:])))
        slope = z.T @ (y - p) / 20
        assert abs((y - p).mean()) < 1e-6
        for b, s in zip(beta[1:], slope):
            assert (s == pytest.approx(penalty * np.sign(b), abs=1e-5)) if b else abs(s) <= penalty + 1e-6
    at = int(np.argmin(np.abs(fit.penalties - 0.2 * fit.penalties[0])))
    assert fit.path_coefficients[at][2] == pytest.approx(1.0175, abs=0.05)
    assert fit.selection_rule == "lambda_1se" and fit.folds == 5
    assert fit.penalty >= fit.lambda_min


def test_separable_frame_through_templates(twelve):
    artifact, _ = templates.run_template(
        "multivariable_logistic_regression", {"outcome": "recurrence", "predictors": ["nlr", "age", "sex"]}, twelve, RUN, "m1")
    assert artifact["metadata"]["n"] == 12 and artifact["metadata"]["auc"] >= 0.9
    assert artifact["metadata"]["cv_folds"] == 5 and artifact["metadata"]["cv_auc"] is not None
    assert artifact["cohort"]["excluded_rows"] == 0
    assert artifact["cohort"]["required_fields"] == ["recurrence", "nlr", "age", "sex"]
    assert "Model did not fully converge." in artifact["data"]["warnings"]
    curve, _ = templates.run_template(
        "decision_curve_analysis", {"outcome": "recurrence", "predictors": ["nlr"]}, twelve, RUN, "m1")
    rows = {r["threshold"]: r for r in curve["data"]["rows"]}
    assert len(rows) == 100 and rows[0.0]["model_net_benefit"] == rows[0.0]["treat_all_net_benefit"] == 0.5
    assert (rows[0.5]["true_positives"], rows[0.5]["false_positives"]) == (6, 0)


def test_small_classes_fall_back(spark):
    rows = [(False, 1.1, 42), (False, 1.4, 44), (True, 5.2, 60), (True, 5.6, 63)]
    df = spark.createDataFrame(rows, "recurrence boolean, nlr double, age int").coalesce(1)
    frame = frames.build_model_frame(df.withColumn("id", F.col("age")), "recurrence", ["nlr", "age"], ["id"])
    assert logistic.cross_validated_auc(frame, ["id"]).status == "fallback"
    artifact, _ = templates.run_template("lasso_logistic_regression", {"outcome": "recurrence", "predictors": ["nlr", "age"]}, df, RUN, "m")
    assert artifact["metadata"]["selection_method"] == "bic_fallback" and artifact["metadata"]["cv_folds"] == 0
    assert "used BIC-selected penalty" in " ".join(artifact["data"]["warnings"])
    row = artifact["data"]["rows"][0]
    assert row["odds_ratio"] == pytest.approx(math.exp(row["coefficient"]), rel=1e-2)


def test_yes_no_variants_are_one_term(spark):
    words = ["No", "no", "No - none seen", "No", "Yes", "yes", "Yes - inferolateral margin", "Yes"]
    df = spark.createDataFrame([(i >= 4, w) for i, w in enumerate(words)], "recurrence boolean, residual string")
    design = frames.build_design(df, ["residual", "recurrence", "absent"], "recurrence")
    assert [t.name for t in design.terms] == ["residual: yes"]
    assert [s["reason"] for s in design.skipped] == ["It is the outcome itself.", "The clean table has no such column."]
    assert frames.choose_levels(["a", "b"]) == ("a", "b") and frames.choose_levels(["death", "none"]) == ("none", "death")


def test_bootstrap_draws_whole_samples(twenty):
    frame = frames.build_model_frame(twenty, "recurrence", ["nlr"], ["id"])
    boot = logistic.bootstrap_validation(frame, 0.8, 60)
    again = logistic.bootstrap_validation(frame, 0.8, 60)
    assert boot.completed + boot.skipped == 60 and boot.completed > 50
    assert boot.optimism == pytest.approx(again.optimism, abs=1e-9)
    assert boot.corrected_auc == pytest.approx(min(1, max(0, 0.8 - boot.optimism)))
    row = boot.intervals.first()
    assert row["bootstrap_ci_low"] <= row["bootstrap_odds_ratio_median"] <= row["bootstrap_ci_high"]


def test_resample_counts_are_multinomial():
    draw = logistic.Resample(7, 400, {0: 30, 2: 70})
    counts = []
    for bucket, n in ((0, [10.0, 20.0]), (2, [70.0])):
        draw.enter(np.array(n), np.full(len(n), bucket << 40))
        counts.append(draw(np.array(n), None, None, np.arange(400)))
    whole = np.vstack(counts)
    assert (whole.sum(axis=0) == 100).all()
    assert whole.mean(axis=1) == pytest.approx([10, 20, 70], abs=1.0)
    assert whole.var(axis=1) == pytest.approx([9, 16, 21], rel=0.3)
    alone = logistic.Resample(7, 400, {0: 30, 2: 70})
    alone.enter(np.array([70.0]), np.array([2 << 40]))
    assert (alone(np.array([70.0]), None, None, np.array([5, 9])) == whole[2:, [5, 9]]).all()


def test_bootstrap_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    rows = [(i, bool(rng.random() < 1 / (1 + np.exp(-v))), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y boolean, x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts, batch in ((1, 10_000), (4, 700), (7, 64)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            frame = frames.build_model_frame(df.repartition(parts), "y", ["x"], ["id"])
            boot = logistic.bootstrap_validation(frame, 0.7, 30)
            found.append([tuple(r) for r in boot.intervals.collect()] + [round(boot.optimism, 9)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert found[0] == found[1] == found[2]


def test_many_levels_keep_their_predictor(spark):
    rows = [(i % 2 == 0, f"site {i % 1500}", float(i % 11)) for i in range(6000)]
    df = spark.createDataFrame(rows, "y boolean, site string, x double")
    board = {r["predictor"]: r for r in screen.univariate_auc_screen(df, "y", ["site", "x"]).leaderboard.collect()}
    assert board["site"]["term_count"] == 1499 and board["site"]["auc"] == 1.0 and board["site"]["reference_level"] == "site 0"
    design = frames.build_design(df, ["site"])
    assert len(design.terms) == 1499 and not design.skipped



def test_cox_matches_direct_newton(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=120), 2)
    days = np.maximum(1, np.round(rng.exponential(40 * np.exp(-0.5 * x)))).astype(int)
    event = rng.random(120) < 0.7
    rows = [(f"2020-01-01", str(np.datetime64("2020-01-01") + int(d)) if e else None, str(np.datetime64("2020-01-01") + int(d)), float(v))
            for d, e, v in zip(days, event, x)]
    df = spark.createDataFrame(rows, "start_on string, ended string, seen_date string, x double").coalesce(2)
    model = cox.fit_cox(df, "start_on", "ended", ["x"])
    beta = 0.0
    for _ in range(30):
        w, g, h = np.exp(beta * x), 0.0, 0.0
        for t in np.unique(days[event]):
            risk, d = days >= t, (days == t) & event
            m = (w * x)[risk].sum() / w[risk].sum()
            g += x[d].sum() - d.sum() * m
            h += d.sum() * ((w * x * x)[risk].sum() / w[risk].sum() - m * m)
        beta += g / (h + 1e-6)
    assert model.beta[0] == pytest.approx(beta, abs=1e-6) and model.errors[0] == pytest.approx(h ** -0.5, abs=1e-6)
    assert (model.n, model.events) == (120, int(event.sum()))
    summary = cox.survival_summary(model.frame).first()
    assert summary["duration_median_days"] == int(np.median(days)) and summary["duration_max_days"] == days.max()


def test_survival_rows_rules(spark):
    rows = [
        ("2020-01-01", "2020-02-01", None, None), (None, "2020-02-01", None, None), ("2020-01-01", None, None, "2020-03-01"),
        ("2020-01-01", None, "2020-01-15", "2020-03-01"), ("2020-01-01", "2019-01-01", None, None), ("2020-01-01", None, None, None),
    ]
    df = spark.createDataFrame(rows, "resection_date string, recurrence_date string, seen string, dod string")
    found = frames.survival_rows(df, "resection_date", "recurrence_date", "seen")
    assert sorted((r["duration_days"], r["event"]) for r in found.df.collect()) == [(14, 0), (31, 1), (60, 0)]
    reasons = {r["reason"]: r["rows"] for r in frames.exclusion_counts(found.checked).collect()}
    assert reasons == {"Missing index date.": 1, "Non-positive follow-up time.": 2}


def test_auc_laws_and_brute_force(spark):
    rng = np.random.default_rng(5)
    score, label = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "label int, score double")
    p, n = score[label == 1], score[label == 0]
    direct = ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))
    up = evaluate.auc(df).first()["auc"]
    down = evaluate.auc(df.withColumn("score", -F.col("score"))).first()["auc"]
    assert up == pytest.approx(direct, abs=1e-12) and up + down == pytest.approx(1.0)
    points = evaluate.roc_points(df)
    assert {(0.0, 0.0), (1.0, 1.0)} <= {(r["fpr"], r["tpr"]) for r in points.collect()}
    assert points.count() == points.distinct().count()


def test_loess_bandwidth_is_exact(spark):
    rng = np.random.default_rng(9)
    score = np.concatenate([rng.random(300), np.full(200, 0.25), 0.4 + 1e-9 * rng.random(150)])
    df = spark.createDataFrame([(int(v > 0.5), float(v)) for v in score], "label int, score double")
    table = evaluate.score_table(df).cache()
    targets = np.linspace(0, 1, 101)
    k = 487
    found = evaluate.kth_distances(table, targets, k, score.min(), score.max())
    direct = np.array([np.sort(np.abs(score - t))[k - 1] for t in targets])
    assert found == pytest.approx(direct, abs=0)


def test_screen_ranks_and_separation(spark):
    rows = [(True, 5.0, "Frontal", 1.0), (True, 4.0, "Frontal", 2.0), (False, 1.2, "Temporal", 1.0), (False, 1.5, "Temporal", 2.5)]
    df = spark.createDataFrame(rows, "recurrence boolean, nlr double, lobe string, weak double")
    found = screen.univariate_auc_screen(df, "recurrence", ["nlr", "lobe", "weak"])
    board = {r["predictor"]: r for r in screen.ranked(found.leaderboard).collect()}
    assert board["lobe"]["auc"] == board["nlr"]["auc"] == 1.0 and board["weak"]["rank"] == 3
    assert "did not fully converge" in board["nlr"]["warnings"]
    artifact, _ = templates.run_template("univariate_auc_screen", {"outcome": "recurrence", "predictors": ["nlr", "lobe"]}, df, RUN, "m")
    assert artifact["metadata"]["fit_count"] == 2 and artifact["data"]["roc_curves"] and artifact["cohort_display"] == "none"


def test_template_registry_and_errors(twelve):
    assert len(templates.TEMPLATES) == 8
    assert [p.name for p in templates.TEMPLATES["cox_regression"].parameters] == ["start_date", "event_date", "censor_date", "predictors"]
    with pytest.raises(ValueError, match="Unknown analysis template"):
        templates.run_template("nope", {}, twelve, RUN, "m")
    with pytest.raises(ValueError, match="no outcome column"):
        templates.run_template("decision_curve_analysis", {"outcome": "x", "predictors": ["nlr"]}, twelve, RUN, "m")
    with pytest.raises(ValueError, match="exactly two"):
        templates.run_template("decision_curve_analysis", {"outcome": "age", "predictors": ["nlr"]}, twelve, RUN, "m")


def test_tail_probabilities():
    assert two_sided_normal_p(1.96) == pytest.approx(0.0499958, abs=1e-6)
    assert chi_square_tail(9.237046, 8) == pytest.approx(0.322696, abs=1e-6)
    assert chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_tail(11.070498, 5) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_tail(0, 3) == 1.0 and chi_square_tail(1, 0) is None
