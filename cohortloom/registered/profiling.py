"""Profiles and cohort summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import summaries
from .base import MESSY_BOOLEAN, MESSY_TEXT, query, sql_missing, table

_LONG = (
    "(select * from (select {cols} from {source}) unpivot include nulls (value for column_name in ({names})))"
)


def _profile_sql(source: str, columns: dict[str, str], numeric: list[str], types: str) -> str:
    cols = ", ".join(f"cast({e} as varchar) as {n}" for n, e in columns.items())
    long = _LONG.format(cols=cols, source=source, names=", ".join(columns))
    in_numeric = ", ".join(f"'{n}'" for n in numeric) or "''"
    word = "trim(split_part(lower(trim(value)), ' ', 1), ':-;,.')"
    label = (
        f"case when {word} in ('true','false','yes','no','y','n','0','1','m','f') then {word} else value end"
    )
    return (
        f"with l as (select column_name, case when {sql_missing('value')} then null else value end as value from {long}), "
        "f as (select column_name, count(*) as row_count, count(value) as non_null, count(distinct value) as unique_count, "
        f"count(distinct {label}) as labels, "
        f"min(case when column_name in ({in_numeric}) then try_cast(value as double) end) as lo, "
        f"median(case when column_name in ({in_numeric}) then try_cast(value as double) end) as med, "
        f"max(case when column_name in ({in_numeric}) then try_cast(value as double) end) as hi from l group by column_name) "
        f"select column_name, {types} as type, non_null, row_count - non_null as missing, "
        "round((row_count - non_null) * 100.0 / row_count, 1) as missing_pct, unique_count, labels = 2 as is_binary, "
        "round(lo, 3) as min_value, round(med, 3) as median_value, round(hi, 3) as max_value, "
        "unique_count > 100 as value_counts_truncated from f"
    )


def _as_rows(p: prof.Profile):
    return p.columns.drop("position").withColumnRenamed("column", "column_name")


_CUSTOMER_SQL = {
    "customer_id": "c_custkey", "nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment",
    "active": "case c_custkey % 4 when 0 then 'Yes - often' when 1 then 'no' when 2 then 'N/A' else 'YES' end",
    "start_date": "case when c_custkey % 9 <> 0 then concat('2020-01-', 10 + c_custkey % 15) end",
}


def _customers(spark, sf):
    df = table(spark, sf, "customer")
    return df.select(*[F.expr(e).alias(n) for n, e in _CUSTOMER_SQL.items()])


_ANALYSIS_TYPES = (
    "case when column_name like '%!_id' escape '!' then case when unique_count > greatest(row_count * 0.5, 1) then 'identifier' else 'text' end "
    "when labels = 2 then 'binary' when column_name in ('nation', 'balance') then 'numeric' "
    "when contains(column_name, 'date') then 'date' when unique_count <= 20 then 'categorical' else 'text' end"
)
_WORKBENCH_TYPES = (
    "case when contains(column_name, 'date') then 'date' when column_name in ('customer_id', 'nation', 'balance') then 'numeric' "
    "when unique_count between 1 and 2 then 'binary-like' when unique_count <= 20 then 'categorical' else 'text' end"
)
_NUMERIC = ["customer_id", "nation", "balance"]


@query("profile_columns", _profile_sql("customer", _CUSTOMER_SQL, _NUMERIC, _ANALYSIS_TYPES))
def _(spark, sf):
    return _as_rows(prof.profile(_customers(spark, sf)))


@query("profile_workbench", _profile_sql("customer", _CUSTOMER_SQL, _NUMERIC, _WORKBENCH_TYPES))
def _(spark, sf):
    return _as_rows(prof.profile(_customers(spark, sf), mode="workbench"))


_ORDER_COLUMNS = {"status": "o_orderstatus", "priority": "o_orderpriority", "cell": MESSY_TEXT, "buyer": "o_custkey"}


@query(
    "profile_top_values",
    "with l as (select column_name, value from "
    + _LONG.format(
        cols=", ".join(f"cast({e} as varchar) as {n}" for n, e in _ORDER_COLUMNS.items()),
        source="orders", names=", ".join(_ORDER_COLUMNS),
    )
    + f" where not {sql_missing('value')}), c as (select column_name, value, count(*) as count from l group by all) "
    "select column_name, value, count, rank from (select *, row_number() over (partition by column_name order by count desc, value) as rank from c) "
    "where rank <= 100",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _ORDER_COLUMNS.items()])
    return prof.top_values(prof.value_counts(df)).withColumnRenamed("column", "column_name")


@query(
    "profile_sample_values",
    " union all ".join(
        f"(select '{n}' as column_name, cast({e} as varchar) as value, row_number() over (order by o_orderkey) as rank "
        f"from orders where not {sql_missing(f'cast({e} as varchar)')} order by o_orderkey limit 4)"
        for n, e in _ORDER_COLUMNS.items()
    ),
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _ORDER_COLUMNS.items()])
    return prof.first_present(df, "o_orderkey", list(_ORDER_COLUMNS)).withColumnRenamed("column", "column_name")


_PRESENCE = {"t": MESSY_TEXT, "b": MESSY_BOOLEAN, "p": "o_orderpriority"}


@query(
    "profile_presence_pairs",
    " union all ".join(
        f"select '{a}' as left_name, '{b}' as right_name, count_if(not {sql_missing(ea)} and not {sql_missing(eb)}) as rows from orders"
        for i, (a, ea) in enumerate(_PRESENCE.items())
        for b, eb in list(_PRESENCE.items())[i:]
    ),
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _PRESENCE.items()])
    return prof.presence_pairs(df, list(_PRESENCE)).withColumnsRenamed({"left": "left_name", "right": "right_name"})


@query(
    "profile_documents",
    _profile_sql(
        "documents",
        {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"},
        ["doc_id", "n_chars"],
        "case when column_name = 'doc_id' then case when unique_count > greatest(row_count * 0.5, 1) then 'identifier' else 'text' end "
        "when labels = 2 then 'binary' when column_name = 'n_chars' then 'numeric' when unique_count <= 20 then 'categorical' else 'text' end",
    ),
)
def _(spark, sf):
    return _as_rows(prof.profile(table(spark, sf, "documents")))


_TEXTS = ("text", "lang", "source")


@query(
    "profile_documents_top_values",
    "with c as ("
    + " union all ".join(f"select '{n}' as column_name, {n} as value, count(*) as count from documents where not {sql_missing(n)} group by {n}" for n in _TEXTS)
    + ") select column_name, value, count, rank from "
    "(select *, row_number() over (partition by column_name order by count desc, value) as rank from c) where rank <= 100",
)
def _(spark, sf):
    return prof.profile(table(spark, sf, "documents"), columns=list(_TEXTS)).top().withColumnRenamed("column", "column_name")


# ---------------------------------------------------------------- summaries

_COHORT = (
    "(select c_custkey, case when c_custkey % 11 <> 0 then c_custkey % 90 end as age_at_presentation, "
    "case c_custkey % 3 when 0 then 'M' when 1 then 'F' end as sex, "
    "case when c_mktsegment <> 'BUILDING' then c_mktsegment end as contributor from customer)"
)


def _cohort(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.expr("cast(case when c_custkey % 11 <> 0 then c_custkey % 90 end as int)").alias("age_at_presentation"),
        F.expr("case c_custkey % 3 when 0 then 'M' when 1 then 'F' end").alias("sex"),
        F.expr("case when c_mktsegment <> 'BUILDING' then c_mktsegment end").alias("contributor"),
    )


@query(
    "cohort_summary",
    "select count(*) as total_patients, round(median(age_at_presentation), 1) as median_age, "
    f"round(avg(case when lower(sex) = 'm' then 100.0 when sex is not null then 0.0 end), 1) as pct_male from {_COHORT}",
)
def _(spark, sf):
    return summaries.cohort_summary(_cohort(spark, sf))


@query(
    "cohort_contributors",
    f"select coalesce(contributor, 'Unknown') as contributor, count(*) as count from {_COHORT} group by all",
)
def _(spark, sf):
    return summaries.counts_by(_cohort(spark, sf), "contributor")


@query("sex_breakdown", f"select coalesce(sex, 'Unknown') as sex, count(*) as count from {_COHORT} group by all")
def _(spark, sf):
    return summaries.counts_by(_cohort(spark, sf), "sex")


@query(
    "age_distribution",
    f"with v as (select age_at_presentation as v from {_COHORT} where age_at_presentation is not null), "
    "h as (select min(v) as lo, max(v) as hi from v), b as (select i, lo + (i - 1) * (hi - lo) / 12.0 as lower, lo + i * (hi - lo) / 12.0 as upper "
    "from h, range(1, 13) t(i)), c as (select least(12, floor((v - lo) * 12.0 / (hi - lo)) + 1) as i, count(*) as n from v, h group by all) "
    "select cast(b.i as bigint) as bin, round(lower, 6) as lower, round(upper, 6) as upper, coalesce(n, 0) as count from b left join c on b.i = c.i",
)
def _(spark, sf):
    out = summaries.age_distribution(_cohort(spark, sf))
    return out.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query(
    "age_exclusions",
    f"select count(age_at_presentation) as n, count(*) - count(age_at_presentation) as excluded from {_COHORT}",
)
def _(spark, sf):
    return summaries.age_exclusions(_cohort(spark, sf))


@query("exact_median", "select round(median(o_totalprice), 4) as median from orders")
def _(spark, sf):
    return summaries.exact_median(table(spark, sf, "orders"), "o_totalprice").select(F.round("median", 4).alias("median"))
