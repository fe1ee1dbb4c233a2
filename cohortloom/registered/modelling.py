"""Models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..models import cox, evaluate, lasso, logistic, screen
from ..models import frame as frames
from .base import query, sql_round, table

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_SCORED = (
    "(select cast(l_returnflag = 'R' as integer) as label, {score} as score, " + ", ".join(_KEYS) + " from lineitem)"
)
_COARSE = "1.0 / (1.0 + exp(0.5 - 0.02 * l_quantity))"
_FINE = "1.0 / (1.0 + exp(0.5 - 0.02 * l_quantity - 0.00001 * l_extendedprice))"


def _scored(spark, sf, score):
    return table(spark, sf, "lineitem").select(
        F.expr("cast(l_returnflag = 'R' as int)").alias("label"), F.expr(score).alias("score"), *_KEYS
    )


def _auc_sql(source: str) -> str:
    return (
        f"with s as (select score, sum(label) as pos, sum(1 - label) as neg from {source} group by score), "
        "c as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s) "
        "select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc, "
        "cast(sum(pos) + sum(neg) as bigint) as n, cast(sum(pos) as bigint) as events from c"
    )


for _name, _score in (("auc_coarse_score", _COARSE), ("auc_fine_score", _FINE)):
    query(_name, _auc_sql(_SCORED.format(score=_score)))(
        lambda spark, sf, score=_score: evaluate.auc(_scored(spark, sf, score)).select(
            F.round("auc", 6).alias("auc"), "n", "events"
        )
    )


def _roc_sql(source: str) -> str:
    return (
        f"with s as (select score, sum(label) as pos, sum(1 - label) as neg from {source} group by score), "
        "c as (select sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from s "
        "window w as (order by score desc)) "
        f"select 0.0 as fpr, 0.0 as tpr union select {sql_round('fp / n', 4)}, {sql_round('tp / p', 4)} from c"
    )


# Plain arithmetic: both engines give the same doubles, so exact ties agree.
_LINEAR = "0.02 * l_quantity + 0.00001 * l_extendedprice"

for _name, _score in (("roc_points", _COARSE), ("roc_points_fine_score", _LINEAR)):
    query(_name, _roc_sql(_SCORED.format(score=_score)))(
        lambda spark, sf, score=_score: evaluate.roc_points(_scored(spark, sf, score))
    )


def _groups_sql(source: str) -> str:
    keys = ", ".join(_KEYS)
    return (
        f"(select g, count(*) as n, min(score) as lo, max(score) as hi, sum(label) as o, sum(score) as e from "
        f"(select *, ntile(10) over (order by score, {keys}) as g from {source}) group by g)"
    )


_CONTRIBUTION = "(o - e) * (o - e) / greatest(e, 1e-12) + (o - e) * (o - e) / greatest(n - e, 1e-12)"


@query(
    "hosmer_lemeshow_groups",
    f"select cast(g as bigint) as \"group\", n, round(lo, 4) as risk_min, round(hi, 4) as risk_max, round(o, 3) as observed_events, round(e, 3) as expected_events, "
    "round(n - o, 3) as observed_non_events, round(n - e, 3) as expected_non_events, round(o / n, 4) as observed_event_rate, "
    f"round(e / n, 4) as expected_event_rate, round({_CONTRIBUTION}, 4) as contribution from {_groups_sql(_SCORED.format(score=_COARSE))}",
)
def _(spark, sf):
    return evaluate.hosmer_lemeshow(_scored(spark, sf, _COARSE), _KEYS).groups


@query(
    "hosmer_lemeshow_test",
    f"with t as (select sum({_CONTRIBUTION}) as s, count(*) as g, min(least(e, n - e)) < 5 as low from {_groups_sql(_SCORED.format(score=_FINE))}) "
    "select cast(g as bigint) as group_count, cast(g - 2 as bigint) as degrees_of_freedom, round(s, 4) as statistic, "
    "round(exp(-s / 2) * (1 + s / 2 + pow(s / 2, 2) / 2 + pow(s / 2, 3) / 6), 4) as p_value, low as low_expected_count from t",
)
def _(spark, sf):
    c = evaluate.hosmer_lemeshow(_scored(spark, sf, _FINE), _KEYS)
    return spark.createDataFrame(
        [(c.group_count, c.degrees_of_freedom, round(c.statistic, 4), round(c.p_value, 4), c.low_expected_count)],
        "group_count bigint, degrees_of_freedom bigint, statistic double, p_value double, low_expected_count boolean",
    )


def _loess_sql(source: str) -> str:
    return (
        f"with s as materialized (select score, count(*) as n, sum(label) as pos from {source} group by score), "
        "k as (select greatest(3, least(sum(n), ceil(0.75 * sum(n)))) as k, sum(pos) / sum(n) as mean from s), "
        "g as (select i / 100.0 as t from range(0, 101) r(i)), "
        "d as (select t, score, n, pos, score - t as dx, sum(n) over (partition by t order by abs(score - t) range between unbounded preceding and current row) as upto from g, s), "
        "h as (select t, min(abs(dx)) as h from d, k where upto >= k group by t), "
        "w as (select d.*, h, case when abs(dx) <= h then pow(1 - pow(abs(dx) / h, 3), 3) else 0 end as w from d join h using (t)), "
        "m as (select t, sum(w * n) as s0, sum(w * n * dx) as s1, sum(w * n * dx * dx) as s2, sum(w * pos) as y0, sum(w * pos * dx) as y1 from w group by t) "
        "select round(t, 4) as predicted_risk, round(greatest(0, least(1, case when s0 <= 1e-12 then mean "
        "when s0 * s2 - s1 * s1 <= 1e-12 * s0 * s2 then y0 / s0 else (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) end)), 4) as observed_rate from m, k"
    )


for _name, _score in (("loess_curve", _COARSE), ("loess_curve_fine_score", _FINE)):
    query(_name, _loess_sql(_SCORED.format(score=_score)))(
        lambda spark, sf, score=_score: evaluate.loess_curve(_scored(spark, sf, score))[0]
    )


def _curve_sql(source: str) -> str:
    return (
        f"with s as (select score, count(*) as n, sum(label) as pos from {source} group by score), "
        "a as (select sum(pos) as p, sum(n - pos) as q, sum(n) as n from s), g as (select round(i * 0.01, 4) as t from range(0, 100) r(i)), "
        "c as (select t, coalesce(sum(case when score >= t then pos end), 0) as tp, coalesce(sum(case when score >= t then s.n - pos end), 0) as fp from g, s group by t), "
        "b as (select *, t / (1 - t) as odds, tp / n - fp / n * (t / (1 - t)) as model, p / n - q / n * (t / (1 - t)) as every from c, a) "
        f"select t as threshold, {sql_round('model', 4)} as model_net_benefit, {sql_round('every', 4)} as treat_all_net_benefit, 0.0 as treat_none_net_benefit, "
        "cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives, cast(tp + fp as bigint) as classified_positive, "
        f"{sql_round('(tp + fp) / n', 4)} as classification_rate, "
        f"case when odds > 0 then {sql_round('(model - every) / odds * 100', 2)} end as interventions_avoided_per_100 from b"
    )


@query("decision_curve", _curve_sql(_SCORED.format(score=_FINE)))
def _(spark, sf):
    return evaluate.decision_curve(_scored(spark, sf, _FINE))


@query(
    "decision_curve_superior_range",
    f"select min(threshold) as threshold_min, max(threshold) as threshold_max from ({_curve_sql(_SCORED.format(score=_FINE))}) "
    "where model_net_benefit > treat_all_net_benefit and model_net_benefit > treat_none_net_benefit",
)
def _(spark, sf):
    return evaluate.superior_range(evaluate.decision_curve(_scored(spark, sf, _FINE)))


# ------------------------------------------------------------------- screen


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


_DOCS = "(select doc_id, lang, n_chars, toxic, quality from documents join labels using (doc_id))"


def _screen_auc(counts: str) -> str:
    return (
        f"(select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 3) as auc, sum(pos) + sum(neg) as n, sum(pos) as events "
        f"from (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from {counts}))"
    )


def _screen_sql() -> str:
    sign = f"(select case when avg(case when quality = 1 then n_chars end) < avg(case when quality = 0 then n_chars end) then -1 else 1 end as s from {_DOCS})"
    numeric = f"(select n_chars * s as score, sum(quality) as pos, sum(1 - quality) as neg from {_DOCS}, {sign} group by all)"

    def level(c):
        return (
            f"(select score, sum(pos) as pos, sum(neg) as neg from (select {c}, sum(quality) as pos, sum(1 - quality) as neg, avg(quality) as score "
            f"from {_DOCS} group by {c}) group by score)"
        )

    parts = [("n_chars", numeric, "1"), ("lang", level("lang"), "3"), ("toxic", level("toxic"), "1")]
    return " union all ".join(
        f"select '{n}' as predictor, auc, cast(n as bigint) as n, cast(events as bigint) as events, cast(n - events as bigint) as non_events, "
        f"cast(0 as bigint) as missing, {terms} as term_count from {_screen_auc(source)}"
        for n, source, terms in parts
    )


@query("univariate_auc_screen", f"select *, row_number() over (order by auc desc, predictor) as rank from ({_screen_sql()})")
def _(spark, sf):
    found = screen.univariate_auc_screen(_labelled(spark, sf), "quality", ["n_chars", "lang", "toxic", "quality", "absent"])
    return screen.ranked(found.leaderboard).drop("reference_level", "warnings")


def _screen_roc_sql() -> str:
    sign = f"(select case when avg(case when quality = 1 then n_chars end) < avg(case when quality = 0 then n_chars end) then -1 else 1 end as s from {_DOCS})"
    sources = {
        "n_chars": f"(select n_chars * s as score, quality as label from {_DOCS}, {sign})",
        "lang": f"(select avg(quality) over (partition by lang) as score, quality as label from {_DOCS})",
        "toxic": f"(select avg(quality) over (partition by toxic) as score, quality as label from {_DOCS})",
    }
    return " union all ".join(f"select '{n}' as predictor, * from ({_roc_sql(source)})" for n, source in sources.items())


@query("univariate_auc_screen_roc", _screen_roc_sql())
def _(spark, sf):
    found = screen.univariate_auc_screen(_labelled(spark, sf), "quality", ["n_chars", "lang", "toxic"])
    return found.roc_curves()


# A predictor with a level per part: more levels than any driver list should hold.
_BY_PART = "(select l_partkey, sum(cast(l_returnflag = 'R' as integer)) as pos, sum(cast(l_returnflag <> 'R' as integer)) as neg from lineitem group by l_partkey)"


@query(
    "univariate_auc_screen_many_levels",
    f"with v as (select *, pos / (pos + neg) as score from {_BY_PART}), s as (select score, sum(pos) as pos, sum(neg) as neg from v group by score), "
    "c as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s) "
    "select 'part' as predictor, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 3) as auc, cast(sum(pos) + sum(neg) as bigint) as n, "
    "(select count(*) - 1 from v) as term_count, (select min('part ' || l_partkey) from v) as reference_level from c",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.expr("l_returnflag = 'R'").alias("returned"), F.concat(F.lit("part "), F.col("l_partkey")).alias("part")
    )
    board = screen.univariate_auc_screen(rows, "returned", ["part"]).leaderboard
    return board.select("predictor", "auc", "n", F.col("term_count").cast("bigint").alias("term_count"), "reference_level")


# ----------------------------------------------------------------- logistic


def _two_sided(z: str) -> str:
    """Two-sided normal tail by Simpson's rule on 2,000 steps."""
    step = f"(least(abs({z}), 9) / 2000)"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(i * {step}, 2) / 2)))"
    return f"round(greatest(0, 1 - 2 / sqrt(2 * pi()) * {step} / 3 * {area}), 4)"


def _line_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.expr("l_returnflag = 'R'").alias("returned"),
        F.expr("case when l_linenumber <> 7 then l_quantity end").alias("quantity"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        *_KEYS,
    )


# Newton steps as a recursive query over distinct covariate rows: 3 x 3 systems
# solved by cofactors, ridge on the slopes only.
_CELLS = (
    "cells as materialized (select case when l_returnflag = 'R' then 1.0 else 0.0 end as y, l_quantity as x1, l_discount * 100 as x2, "
    "cast(count(*) as double) as n from lineitem where l_linenumber <> 7 group by all)"
)
_P = "least(greatest(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 1e-8), 1 - 1e-8)"


def _sums(p: str, ridge: str) -> str:
    w = f"n * {p} * (1 - {p})"
    return (
        f"sum(n * (y - {p})) as g0, sum(n * (y - {p}) * x1) as g1, sum(n * (y - {p}) * x2) as g2, "
        f"sum({w}) as a, sum({w} * x1) as b, sum({w} * x2) as c, sum({w} * x1 * x1){ridge} as d, sum({w} * x1 * x2) as e, sum({w} * x2 * x2){ridge} as f"
    )


_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
_NEWTON = (
    f"with recursive {_CELLS}, step(i, b0, b1, b2) as (select 0, 0.0::double, 0.0::double, 0.0::double union all "
    f"select i + 1, b0 + (g0 * (d * f - e * e) + g1 * (c * e - b * f) + g2 * (b * e - c * d)) / {_DET}, "
    f"b1 + (g0 * (c * e - b * f) + g1 * (a * f - c * c) + g2 * (b * c - a * e)) / {_DET}, "
    f"b2 + (g0 * (b * e - c * d) + g1 * (b * c - a * e) + g2 * (a * d - b * b)) / {_DET} "
    f"from (select i, b0, b1, b2, {_sums(_P, ' + 1e-6')} from step, cells where i < 12 group by i, b0, b1, b2)), "
    f"last as (select * from step where i = 12), info as (select b0, b1, b2, {_sums(_P, '')} from last, cells group by b0, b1, b2) "
)


@query(
    "logistic_terms",
    _NEWTON
    + "select term, round(coef, 4) as coefficient, round(exp(coef), 3) as odds_ratio, round(exp(coef - 1.96 * se), 3) as ci_low, "
    "round(exp(coef + 1.96 * se), 3) as ci_high, round(se, 4) as standard_error, round(coef / se, 3) as z, "
    + _two_sided("coef / se")
    + " as p_value from ("
    f"select 'quantity' as term, b1 as coef, sqrt((a * f - c * c) / {_DET}) as se from info union all "
    f"select 'discount_pct', b2, sqrt((a * d - b * b) / {_DET}) from info)",
)
def _(spark, sf):
    model = logistic.fit(frames.build_model_frame(_line_rows(spark, sf), "returned", ["quantity", "discount_pct"], _KEYS))
    try:
        return logistic.term_table(model).drop("predictor", "kind", "reference_level")
    finally:
        logistic.release(model)


@query(
    "logistic_apparent_auc",
    _NEWTON
    + ", scored as (select b0 + b1 * x1 + b2 * x2 as score, sum(y * n) as pos, sum((1 - y) * n) as neg from last, cells group by all), "
    "c as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from scored) "
    "select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 4) as auc, cast(sum(pos) + sum(neg) as bigint) as n, cast(sum(pos) as bigint) as events from c",
)
def _(spark, sf):
    model = logistic.fit(frames.build_model_frame(_line_rows(spark, sf), "returned", ["quantity", "discount_pct"], _KEYS))
    found = evaluate.auc(model.scored_cells(), weight="n").select(F.round("auc", 4).alias("auc"), "n", "events").collect()
    logistic.release(model)
    return spark.createDataFrame(found, "auc double, n bigint, events bigint")


@query(
    "complete_case_cohort",
    "select count(*) as input_rows, count_if(l_linenumber <> 7) as included_rows, count_if(l_linenumber = 7) as excluded_rows, "
    "count_if(l_linenumber <> 7 and l_returnflag = 'R') as events from lineitem",
)
def _(spark, sf):
    f = frames.build_model_frame(_line_rows(spark, sf), "returned", ["quantity", "discount_pct"], _KEYS)
    return spark.createDataFrame(
        [(f.input_rows, f.n, f.input_rows - f.n, f.events)],
        "input_rows bigint, included_rows bigint, excluded_rows bigint, events bigint",
    )


_SEED = fv.FOLD_SEED
_FOLDS = (
    f"(select o_orderkey, label, x, cast((row_number() over (partition by label order by md5('{_SEED}|' || o_orderkey), o_orderkey) - 1) % 5 as integer) as fold "
    "from (select o_orderkey, o_totalprice as x, case o_orderstatus when 'F' then 1 when 'O' then 0 end as label from orders) where label is not null)"
)


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("case o_orderstatus when 'F' then 'yes' when 'O' then 'no' end").alias("filled"),
        F.col("o_totalprice").alias("price"),
    )


@query("stratified_folds", f"select o_orderkey, label, fold from {_FOLDS}")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("case o_orderstatus when 'F' then 1 when 'O' then 0 end").alias("label")
    )
    return frames.stratified_folds(rows.filter("label is not null"), ["o_orderkey"], 5)


@query(
    "cross_validated_auc",
    f"with f as materialized (select * from {_FOLDS}), s as (select t.fold, sign(avg(case when f.label = 1 then f.x end) - avg(case when f.label = 0 then f.x end)) as s "
    "from (select distinct fold from f) t join f on f.fold <> t.fold group by t.fold), "
    "g as (select f.fold, x * s as score, sum(label) as pos, sum(1 - label) as neg from f join s using (fold) group by all), "
    "c as (select *, coalesce(sum(neg) over (partition by fold order by score rows between unbounded preceding and 1 preceding), 0) as below from g) "
    "select fold, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc from c group by fold",
)
def _(spark, sf):
    frame = frames.build_model_frame(_order_rows(spark, sf), "filled", ["price"], ["o_orderkey"])
    result = logistic.cross_validated_auc(frame, ["o_orderkey"])
    return spark.createDataFrame(
        [(i, round(v, 6)) for i, v in enumerate(result.fold_aucs)], "fold int, auc double"
    )


@query("bootstrap_intervals")
def _(spark, sf):
    frame = frames.build_model_frame(_line_rows(spark, sf), "returned", ["quantity", "discount_pct"], _KEYS)
    model = logistic.fit(frame)
    apparent = evaluate.auc(model.scored_cells(), weight="n").first()["auc"]
    logistic.release(model)
    return logistic.bootstrap_validation(frame, apparent).intervals


# -------------------------------------------------------------------- LASSO


def _lasso_frame(spark, sf):
    return frames.build_model_frame(
        table(spark, sf, "orders").select(
            "o_orderkey",
            F.expr("case o_orderstatus when 'F' then 1 when 'O' then 0 end").alias("filled"),
            F.expr("o_totalprice / 1000").alias("price"),
            F.expr("cast(month(o_orderdate) as double)").alias("month"),
            "o_orderpriority",
        ),
        "filled", ["price", "month", "o_orderpriority"], ["o_orderkey"],
    )


_LEVELS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


_PENALTIES = (
    "with r as (select case o_orderstatus when 'F' then 1.0 else 0.0 end as y, o_totalprice / 1000 as x1, cast(month(o_orderdate) as double) as x2, "
    + ", ".join(f"cast(o_orderpriority = '{v}' as integer) as x{i + 3}" for i, v in enumerate(_LEVELS))
    + " from orders where o_orderstatus in ('F', 'O')), m as (select greatest("
    + ", ".join(f"abs(covar_pop(x{i}, y)) / stddev_pop(x{i})" for i in range(1, 7))
    + ") as top from r) select i as position, round(top * pow(greatest(0.02, 1e-5 / top), i / 29.0), 8) as penalty from m, range(0, 30) t(i)"
)


@query("lasso_penalties", _PENALTIES)
def _(spark, sf):
    result = lasso.fit_lasso(_lasso_frame(spark, sf), ["o_orderkey"])
    result.cells.unpersist()
    return spark.createDataFrame(
        [(i, round(float(p), 8)) for i, p in enumerate(result.penalties)], "position bigint, penalty double"
    )


@query("lasso_optimality", f"select *, true as optimal from ({_PENALTIES})")
def _(spark, sf):
    """Whether the coefficients of each penalty meet the conditions of the one minimum."""
    result = lasso.fit_lasso(_lasso_frame(spark, sf), ["o_orderkey"])
    gaps = lasso.optimality_gaps(result)
    result.cells.unpersist()
    return spark.createDataFrame(
        [(i, round(float(p), 8), bool(g < 1e-6)) for i, (p, g) in enumerate(zip(result.penalties, gaps, strict=True))], "position bigint, penalty double, optimal boolean"
    )


@query("lasso_terms")
def _(spark, sf):
    result = lasso.fit_lasso(_lasso_frame(spark, sf), ["o_orderkey"])
    result.cells.unpersist()
    return spark.createDataFrame(lasso.lasso_rows(result), lasso.LASSO_SCHEMA)


# ----------------------------------------------------------------- survival


def _survival_input(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *_KEYS,
        F.to_date("o_orderdate").alias("start_date"),
        F.expr("case when l_linestatus = 'F' then to_date(l_shipdate) end").alias("event_date"),
        F.expr("case when l_linenumber <> 4 then date_add(to_date(l_shipdate), 3) end").alias("censor_date"),
        (F.col("l_quantity") / 10).alias("quantity"),
    )


_SURVIVAL = (
    "(select *, case when start_date is null then 'Missing index date.' when days is null then 'Missing event or censor date.' "
    "when days <= 0 then 'Non-positive follow-up time.' end as reason from (select *, date_diff('day', start_date, "
    "coalesce(event_date, censor_date, greatest(start_date, event_date, censor_date, cast(l_shipdate as date)))) as days, cast(event_date is not null as integer) as event from "
    "(select l_quantity / 10 as quantity, cast(o_orderdate as date) as start_date, case when l_linestatus = 'F' then cast(l_shipdate as date) end as event_date, "
    "case when l_linenumber <> 4 then cast(l_shipdate as date) + 3 end as censor_date, " + ", ".join(_KEYS)
    + " from lineitem join orders on l_orderkey = o_orderkey)))"
)


@query("survival_rows", f"select {', '.join(_KEYS)}, days as duration_days, event from {_SURVIVAL} where reason is null")
def _(spark, sf):
    rows = frames.survival_rows(_survival_input(spark, sf), "start_date", "event_date", "censor_date")
    return rows.df.select(*_KEYS, "duration_days", "event")


@query("survival_exclusions", f"select reason, count(*) as rows from {_SURVIVAL} where reason is not null group by reason")
def _(spark, sf):
    rows = frames.survival_rows(_survival_input(spark, sf), "start_date", "event_date", "censor_date")
    return frames.exclusion_counts(rows.checked)


@query(
    "survival_summary",
    "select cast(min(days) as bigint) as duration_min_days, cast(floor(median(days)) as bigint) as duration_median_days, "
    "cast(max(days) as bigint) as duration_max_days, cast(sum(event) as bigint) as events, cast(count(*) - sum(event) as bigint) as censored "
    f"from {_SURVIVAL} where reason is null",
)
def _(spark, sf):
    rows = frames.survival_rows(_survival_input(spark, sf), "start_date", "event_date", "censor_date")
    return cox.survival_summary(rows.df)


@query(
    "cox_terms",
    f"with recursive cells as materialized (select days, quantity as x, sum(event) as d, cast(count(*) as double) as n from {_SURVIVAL} where reason is null group by all), "
    "step(i, b) as (select 0, 0.0::double union all select i + 1, b + g / (h + 1e-6) from (select i, b, sum(dx - d * s1 / s0) as g, sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) as h from "
    "(select i, b, days, d, dx, sum(s0) over w as s0, sum(s1) over w as s1, sum(s2) over w as s2 from (select i, b, days, sum(d) as d, sum(d * x) as dx, "
    "sum(n * exp(b * x)) as s0, sum(n * exp(b * x) * x) as s1, sum(n * exp(b * x) * x * x) as s2 from step, cells where i < 10 group by i, b, days) "
    "window w as (partition by i order by days desc)) where d > 0 group by i, b)), "
    "fin as (select b, sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) as h from (select b, d, sum(s0) over w as s0, sum(s1) over w as s1, sum(s2) over w as s2 from "
    "(select b, days, sum(d) as d, sum(n * exp(b * x)) as s0, sum(n * exp(b * x) * x) as s1, sum(n * exp(b * x) * x * x) as s2 from step, cells where i = 10 group by b, days) "
    "window w as (order by days desc)) where d > 0 group by b) "
    "select 'quantity' as term, round(b, 4) as coefficient, round(exp(b), 3) as hazard_ratio, round(exp(b - 1.96 / sqrt(h)), 3) as ci_low, "
    "round(exp(b + 1.96 / sqrt(h)), 3) as ci_high, round(1 / sqrt(h), 4) as standard_error, round(b * sqrt(h), 3) as z, "
    + _two_sided("b * sqrt(h)")
    + " as p_value from fin",
)
def _(spark, sf):
    model = cox.fit_cox(_survival_input(spark, sf), "start_date", "event_date", ["quantity"], "censor_date")
    return cox.cox_table(model).drop("predictor", "kind", "reference_level")
