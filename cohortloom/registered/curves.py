"""Survival curves, the log-rank test, fitted lines and wide logistic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import survival, wide
from .base import query, table
from .modelling import _survival_input, _two_sided

_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
_BANDS = "case when quantity < 1 then 'small' when quantity < 3 then 'medium' else 'large' end"
_HALVES = "case when quantity < 2.5 then 'low' else 'high' end"
_COUNTS = (
    'c as materialized (select {group} as "group", days, count(*) as n, sum(event) as d from (select *, date_diff(\'day\', start_date, '
    "coalesce(event_date, censor_date, greatest(start_date, event_date, censor_date))) as days, cast(event_date is not null as integer) as event from "
    "(select l_quantity / 10 as quantity, cast(o_orderdate as date) as start_date, case when l_linestatus = 'F' then cast(l_shipdate as date) end as event_date, "
    "case when l_linenumber <> 4 then cast(l_shipdate as date) + 3 end as censor_date, cast(l_shipdate as date) as shipped "
    "from lineitem join orders on l_orderkey = o_orderkey)) where days > 0 and start_date is not null group by all)"
)


def _counts(spark, sf, group: str):
    rows = _survival_input(spark, sf).withColumn("stratum", F.expr(group)).drop("l_shipdate")
    return survival.day_counts(rows, "start_date", "event_date", "censor_date", "stratum")


def _curve_sql(group: str) -> str:
    return (
        f"with {_COUNTS.format(group=group)}, r as (select *, sum(n) over (partition by \"group\" order by days desc) as at_risk from c), "
        "k as (select *, product((at_risk - d) / at_risk) over w as survival, "
        "sum(case when at_risk > d then d / (at_risk * (at_risk - d)) end) over w as v from r window w as (partition by \"group\" order by days)), "
        "curve as materialized (select \"group\", cast(days as bigint) as day, cast(at_risk as bigint) as at_risk, cast(d as bigint) as events, "
        "cast(n - d as bigint) as censored, survival, v from k) "
    )


_LOGS = "case when survival > 0 and survival < 1 then round(pow(survival, exp({sign} * 1.96 * sqrt(v) / ln(survival))), 6) end"


@query(
    "kaplan_meier_curve",
    _curve_sql(_BANDS)
    + 'select "group", day, at_risk, events, censored, round(survival, 6) as survival, '
    "case when survival > 0 then round(survival * sqrt(v), 6) end as std_error, "
    f"{_LOGS.format(sign='-1')} as ci_low, {_LOGS.format(sign='1')} as ci_high from curve",
)
def _(spark, sf):
    curve = survival.kaplan_meier(_counts(spark, sf, _BANDS))
    return curve.withColumns({c: F.round(c, 6) for c in ("survival", "std_error", "ci_low", "ci_high")})


@query(
    "kaplan_meier_medians",
    _curve_sql(_BANDS)
    + 'select "group", max(at_risk) as n, cast(sum(events) as bigint) as events, min(case when survival <= 0.5 + 1e-12 then day end) as median_days, '
    'round(min(survival), 6) as last_survival from curve group by "group"',
)
def _(spark, sf):
    found = survival.median_survival(survival.kaplan_meier(_counts(spark, sf, _BANDS)))
    return found.withColumn("last_survival", F.round("last_survival", 6))


def _log_rank_sql(group: str, names: list[str], statistic: str, p_value: str) -> str:
    """Sums over event days; `statistic` combines gaps u0.. and covariances v00, v01, v11."""
    return (
        f"with {_COUNTS.format(group=group)}, t as (select days, sum(d) as d from c group by days having sum(d) > 0), "
        'm as (select t.days, t.d as deaths, c."group" as g, sum(case when c.days >= t.days then c.n else 0 end) as n, '
        "sum(case when c.days = t.days then c.d else 0 end) as d from t, c group by all), "
        "j as (select *, sum(n) over (partition by days) as at_risk from m), "
        "h as (select *, n / at_risk as share, deaths * (at_risk - deaths) / greatest(at_risk - 1, 1) as weight from j), "
        "o as (select g, sum(d) as observed, sum(deaths * share) as expected from h group by g), "
        "s as (select a.g as g, b.g as f, sum(a.weight * (case when a.g = b.g then a.share else 0 end - a.share * b.share)) as v "
        "from h a join h b using (days) group by all), "
        f"u as (select {', '.join(f'max(observed - expected) filter (g = {n!r}) as u{i}' for i, n in enumerate(names))} from o), "
        f"w as (select {', '.join(f'max(v) filter (g = {a!r} and f = {b!r}) as v{i}{k}' for i, a in enumerate(names) for k, b in enumerate(names) if i <= k)} from s), "
        f"x as (select {statistic} as x from u, w) "
        'select o.g as "group", (select cast(sum(n) as bigint) from c where c."group" = o.g) as n, round(cast(observed as double), 4) as observed, round(expected, 4) as expected, '
        f"round(x, 4) as statistic, cast({len(names)} as bigint) as degrees_of_freedom, {p_value} as p_value from o, x"
    )


@query("log_rank_two_groups", _log_rank_sql(_HALVES, ["high"], "u0 * u0 / v00", _two_sided("sqrt(x)")))
def _(spark, sf):
    return spark.createDataFrame(survival.log_rank_rows(survival.log_rank(_counts(spark, sf, _HALVES))), survival.LOG_RANK_SCHEMA)


@query(
    "log_rank_three_groups",
    _log_rank_sql(_BANDS, ["large", "medium"], "(u0 * u0 * v11 - 2 * u0 * u1 * v01 + u1 * u1 * v00) / (v00 * v11 - v01 * v01)", "round(exp(-x / 2), 4)"),
)
def _(spark, sf):
    return spark.createDataFrame(survival.log_rank_rows(survival.log_rank(_counts(spark, sf, _BANDS))), survival.LOG_RANK_SCHEMA)


@query(
    "regression_line",
    'select l_returnflag as "group", count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, '
    "round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r_squared, "
    "min(l_quantity) as x_min, max(l_quantity) as x_max from lineitem group by l_returnflag",
)
def _(spark, sf):
    line = survival.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return line.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2), "r_squared": F.round("r_squared", 6)})


# Every part a level: one coefficient each, the log odds of a part less those of the first one.
_PARTS = (
    "(select 'part ' || l_partkey as part, sum(cast(l_returnflag = 'R' as integer)) as e, sum(cast(l_returnflag <> 'R' as integer)) as o "
    "from lineitem group by l_partkey having e > 0 and o > 0)"
)


@query(
    "wide_logistic_terms",
    f"with p as materialized (select *, ln(e / o) as b, 1.0 / e + 1.0 / o as v from {_PARTS}), f as (select part, b, v from p order by part limit 1) "
    "select 'part: ' || p.part as term, f.part as reference_level, round(p.b - f.b, 3) as coefficient, round(sqrt(p.v + f.v), 3) as standard_error "
    "from p, f where p.part <> f.part",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("part "), "l_partkey").alias("part"), F.expr("l_returnflag = 'R'").alias("returned"))
    mixed = lines.groupBy("part").agg(F.min("returned").alias("low"), F.max("returned").alias("high")).where("low <> high")
    model = wide.fit_wide(lines.join(mixed.select("part"), "part"), "returned", ["part"])
    rows = model.levels.select(
        F.concat(F.lit("part: "), "level").alias("term"), F.lit(model.references[0]).alias("reference_level"),
        F.round("b", 3).alias("coefficient"), F.round("error", 3).alias("standard_error"),
    )
    return rows
