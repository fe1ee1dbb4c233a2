"""Cleaning: normalizers, filters, derived fields, joins, spec runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, joins, normalize, structure, summaries
from ..operators.let import let
from ..plans import spec as specs
from ..plans.registry_functions import default_registry
from .base import (
    MESSY_BOOLEAN,
    MESSY_DATE,
    MESSY_NUMBER,
    MESSY_TEXT,
    query,
    sql_boolean,
    sql_date,
    sql_day,
    sql_missing,
    sql_number,
    sql_present,
    sql_round,
    sql_title,
    table,
)


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(MESSY_TEXT).alias("t"),
        F.expr(MESSY_BOOLEAN).alias("b"),
        F.expr(MESSY_DATE).alias("d"),
        F.expr(MESSY_NUMBER).alias("n"),
    )


_MESSY_SQL = (
    f"(select o_orderkey, {MESSY_TEXT} as t, {MESSY_BOOLEAN} as b, {MESSY_DATE} as d, {MESSY_NUMBER} as n from orders)"
)


def _iso(name: str):
    return F.date_format(name, "yyyy-MM-dd")


# ------------------------------------------------------------- normalizers


@query("normalize_text", f"select o_orderkey, {sql_present('t')} as value from {_MESSY_SQL}")
def _(spark, sf):
    out = normalize.normalize_fields(_messy(spark, sf), mappings=[{"source": "t", "output": "value"}], type="text")
    return out.select("o_orderkey", "value")


@query("normalize_category", f"select o_orderkey, {sql_title('t')} as value from {_MESSY_SQL}")
def _(spark, sf):
    out = normalize.normalize_fields(_messy(spark, sf), mappings=[{"source": "t", "output": "value"}], type="category")
    return out.select("o_orderkey", "value")


@query("normalize_boolean", f"select o_orderkey, {sql_boolean('b')} as value from {_MESSY_SQL}")
def _(spark, sf):
    out = normalize.normalize_fields(_messy(spark, sf), mappings=[{"source": "b", "output": "value"}], type="boolean")
    return out.select("o_orderkey", "value")


@query("normalize_date", f"select o_orderkey, {sql_day(sql_date('d'))} as value from {_MESSY_SQL}")
def _(spark, sf):
    out = normalize.normalize_fields(_messy(spark, sf), mappings=[{"source": "d", "output": "value"}], type="date")
    return out.select("o_orderkey", _iso("value").alias("value"))


@query("normalize_number", f"select o_orderkey, {sql_number('n')} as value from {_MESSY_SQL}")
def _(spark, sf):
    out = normalize.normalize_fields(_messy(spark, sf), mappings=[{"source": "n", "output": "value"}], type="number")
    return out.select("o_orderkey", "value")


@query(
    "normalize_keep_original",
    f"select o_orderkey, coalesce(cast(cast({sql_boolean('b')} as boolean) as varchar), {sql_present('b')}) as value "
    f"from (select o_orderkey, trim(b) as b from {_MESSY_SQL})",
)
def _(spark, sf):
    rows = _messy(spark, sf).withColumn("b", F.trim("b"))
    out = normalize.normalize_fields(
        rows, mappings=[{"source": "b", "output": "value"}], type="boolean", on_invalid="keep_original"
    )
    return out.select("o_orderkey", "value")


# ----------------------------------------------------------------- filters

_FILTERS = {
    "filter_is_missing": ({"conditions": [{"field": "t", "operator": "is_missing"}]}, sql_missing("t")),
    "filter_is_not_missing": ({"conditions": [{"field": "t", "operator": "is_not_missing"}]}, f"not {sql_missing('t')}"),
    "filter_equals": (
        {"conditions": [{"field": "t", "operator": "equals", "value": "1-URGENT"}]},
        f"{sql_present('t')} is not distinct from '1-URGENT'",
    ),
    "filter_equals_missing": (
        {"conditions": [{"field": "t", "operator": "equals", "value": "n/a"}]}, f"{sql_present('t')} is null",
    ),
    "filter_not_equals": (
        {"conditions": [{"field": "t", "operator": "not_equals", "value": "F"}]},
        f"{sql_present('t')} is distinct from 'F'",
    ),
    "filter_contains": (
        {"conditions": [{"field": "t", "operator": "contains", "value": "URGENT"}]},
        f"contains(coalesce(lower({sql_present('t')}), ''), 'urgent')",
    ),
    "filter_not_contains": (
        {"conditions": [{"field": "t", "operator": "not_contains", "value": "mill"}]},
        f"not contains(coalesce(lower({sql_present('t')}), ''), 'mill')",
    ),
    "filter_greater": (
        {"conditions": [{"field": "n", "operator": "gt", "value": "100"}]}, f"coalesce({sql_number('n')} > 100, false)",
    ),
    "filter_at_least_drop": (
        {"action": "drop", "conditions": [{"field": "n", "operator": "gte", "value": 100.5}]},
        f"not coalesce({sql_number('n')} >= 100.5, false)",
    ),
    "filter_less_any_in": (
        {
            "match": "any",
            "conditions": [
                {"field": "n", "operator": "lt", "value": 0},
                {"field": "t", "operator": "in", "value": "F, O ,"},
                {"field": "unknown", "operator": "equals", "value": "x"},
            ],
        },
        f"coalesce({sql_number('n')} < 0, false) or coalesce({sql_present('t')} in ('F', 'O'), false) or {sql_present('t')} is null",
    ),
    "filter_at_most_not_in": (
        {
            "conditions": [
                {"field": "n", "operator": "lte", "value": 500},
                {"field": "t", "operator": "not_in", "value": ["F", "P"]},
            ],
        },
        f"coalesce({sql_number('n')} <= 500, false) and not coalesce({sql_present('t')} in ('F', 'P'), false)",
    ),
    "filter_sparse_rows": (
        {"action": "drop", "minimum_populated_fields": 4, "ignored_fields": ["o_orderkey"]},
        "not ("
        + " + ".join(f"cast(not {sql_missing(c)} as integer)" for c in ("t", "b", "d", "n"))
        + " < 4)",
    ),
    "filter_required_field": ({"action": "drop", "required_field": "b"}, f"not {sql_missing('b')}"),
    "filter_nothing_to_test": ({"action": "drop", "conditions": [{"field": "unknown", "operator": "equals"}]}, "false"),
}


def _filter_query(params):
    return lambda spark, sf: filters.filter_rows(_messy(spark, sf), **params).select("o_orderkey", "t", "n")


for _name, (_params, _where) in _FILTERS.items():
    query(_name, f"select o_orderkey, t, n from {_MESSY_SQL} where {_where}")(_filter_query(_params))


@query(
    "filter_equals_double",
    "select o_orderkey, v, w from (select o_orderkey, o_orderkey * 1000.0::double as v, (o_orderkey % 7) / 10000.0::double as w from orders) "
    "where v = 12345000.0 or v = 2.0e6 or w = 0.0001 or w = 0.0",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("o_orderkey * 1000D").alias("v"), F.expr("(o_orderkey % 7) / 10000D").alias("w")
    )
    conditions = [
        {"field": "v", "operator": "equals", "value": "12345000.0"},
        {"field": "v", "operator": "equals", "value": 2000000.0},
        {"field": "v", "operator": "equals", "value": "3000000"},  # no double reads so
        {"field": "w", "operator": "in", "value": ["0.0001", "0.0", "x"]},
    ]
    return filters.filter_rows(rows, match="any", conditions=conditions)


_UNREADABLE = f"({sql_present('n')} is not null and {sql_number('n')} is null)"


@query(
    "normalize_stop_run",
    f"with r as (select count(*) as n, count_if({_UNREADABLE}) as bad from {_MESSY_SQL}) "
    "select * from (select 'rows_raw' as metric, n as value from r union all select 'filtered_rows', bad from r "
    "union all select 'remaining_rows', n - bad from r union all select 'rows_ingested', n - bad from r)",
)
def _(spark, sf):
    """A value that may not occur, in rows that an earlier filter removed."""
    drop = {"action": "drop", "conditions": [{"field": "n", "operator": "in", "value": ["4.2d", "1,000"]}]}
    stop = {"fields": ["n"], "type": "number", "on_invalid": "stop_run"}
    steps = [{"operation": "filter_rows", "params": drop}, {"operation": "normalize_fields", "params": stop}]
    env = specs.Environment("orders", default_registry())
    compiled = specs.compile_spec({"spec_id": "stop", "version": 1, "steps": steps}, _messy(spark, sf), env, row_id=F.col("o_orderkey"))
    counts = compiled.step_metrics().where("metric in ('rows_raw', 'filtered_rows', 'remaining_rows', 'rows_ingested')")
    return counts.groupBy("metric").agg(F.sum("value").alias("value"))


@query(
    "remove_stub_rows",
    "select o_orderkey, i, t from (select o_orderkey, case when o_orderkey % 5 <> 0 then o_custkey end as i, "
    "case when o_orderkey % 3 = 0 then '  ' when o_orderkey % 3 = 1 then 'n/a' end as t from orders) "
    "where i is not null and trim(coalesce(t, '')) <> ''",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.expr("case when o_orderkey % 5 <> 0 then o_custkey end").alias("i"),
        F.expr("case when o_orderkey % 3 = 0 then '  ' when o_orderkey % 3 = 1 then 'n/a' end").alias("t"),
        F.col("o_orderkey").alias("_row_id"),
    )
    return filters.remove_stub_rows(rows, "i").select(F.col("_row_id").alias("o_orderkey"), "i", "t")


# ---------------------------------------------------------- derived values


@query(
    "math_operations",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "round(l_extendedprice + l_quantity, 2) as added, round(l_extendedprice - 10, 2) as reduced, "
    "round(l_extendedprice * l_discount, 4) as scaled, "
    f"case when l_discount <> 0 then {sql_round('l_quantity / l_discount', 3)} end as divided from lineitem",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    plan = {
        "added": {"operator": "add", "left_field": "l_extendedprice", "right_field": "l_quantity", "precision": 2},
        "reduced": {"operator": "subtract", "left_field": "l_extendedprice", "right_value": 10, "precision": 2},
        "scaled": {"operator": "multiply", "left_field": "l_extendedprice", "right_field": "l_discount", "precision": 4},
        "divided": {"left_field": "l_quantity", "right_field": "l_discount", "precision": 3},
    }
    out = df.withColumns({name: normalize.math_value(df, p) for name, p in plan.items()})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *plan)


@query(
    "compute_ratio",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    f"case when l_tax <> 0 then {sql_round('l_discount / l_tax', 3)} end as ratio from lineitem",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = df.withColumn("ratio", normalize.ratio_value(df, "l_discount", "l_tax"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ratio")


_AGE_SQL = (
    "select o_orderkey, coalesce("
    "try_cast(trunc(case when o_orderkey % 4 = 0 then (o_custkey % 90) + 0.7 end) as integer), "
    "cast(floor(date_diff('day', date '1950-03-01' + cast(o_custkey % 9000 as integer), cast(o_orderdate as date)) / 365.25) as integer)"
    ") as age from orders"
)


@query("derive_age", _AGE_SQL)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 4 = 0 then concat(o_custkey % 90, '.7') else 'n/a' end").alias("given"),
        F.expr("date_add(date '1950-03-01', cast(o_custkey % 9000 as int))").alias("dob"),
        F.col("o_orderdate").alias("seen"),
    )
    return df.select("o_orderkey", normalize.derived_age(df, "given", "dob", "seen").alias("age"))


@query(
    "remap_values",
    "select c_custkey, case lower(c_mktsegment) when 'building' then 'Construction' when 'machinery' then null "
    "else c_mktsegment end as segment from customer",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    out, _hit = normalize.remap_values(
        df, field="segment",
        value_mappings=[{"key": " Building ", "value": "Construction"}, {"from": "MACHINERY", "to": ""}],
    )
    return out.select("c_custkey", "segment")


@query(
    "remap_values_many_pairs",
    "select p_partkey, case when p_size between 1 and 40 then 'size ' || (p_size * 2) else cast(p_size as varchar) end as size "
    "from part",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    pairs = {str(i): f"size {2 * i}" for i in range(1, 41)} | {f"other {i}": "x" for i in range(100)}
    out, _hit = normalize.remap_values(df, field="size", value_mappings=pairs)
    return out.select("p_partkey", "size")


@query(
    "lookup_mapping",
    "select s_suppkey, coalesce(r_name, s) as place from (select s_suppkey, case when s_suppkey % 3 = 0 then 'nowhere' "
    "else upper(n_name) end as s, case when s_suppkey % 3 <> 0 then n_regionkey end as rk from supplier join nation on s_nationkey = n_nationkey) "
    "left join region on rk = r_regionkey",
)
def _(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    mapping = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("key"), F.col("r_name").alias("value")
    )
    names = nation.select("n_nationkey", "n_name")
    df = table(spark, sf, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.expr("case when s_suppkey % 3 = 0 then 'nowhere' else upper(n_name) end").alias("place")
    )
    return normalize.lookup_mapping(df, ["place"], mapping)


@query(
    "registry_functions",
    f"select o_orderkey, case when {sql_missing('d')} then 'Biopsy/None' else 'Resection' end as resection_type, "
    f"case when e is null then null when lower(e) in ('residual', 'progression') then upper(e[1]) || lower(e[2:]) "
    f"when {sql_date('e')} is not null then 'Date' else {sql_title('e')} end as recurrence_type, "
    f"case when trim(t) = '?' then 'Unknown' else {sql_present('t')} end as histo_report, "
    "case when lower(q) in ('yes', 'qmc', 'local') then true when lower(q) in ('no', 'non-local') then false "
    "when q is not null then contains(lower(q), 'qmc') end as qmc_local, "
    "case when lower(q) in ('yes', 'qmc', 'local') then 'QMC' when lower(q) in ('no', 'non-local') then null else q end as referring_centre "
    f"from (select o_orderkey, t, d, case o_orderkey % 6 when 0 then 'residual' when 1 then 'PROGRESSION' when 2 then d "
    "when 3 then 'local spread' when 4 then null else 'nd' end as e0, "
    "case o_orderkey % 6 when 0 then 'Yes' when 1 then 'non-local' when 2 then 'Leeds (QMC)' when 3 then 'Derby' when 4 then 'QMC' end as q, "
    f"{sql_present('e0')} as e from {_MESSY_SQL})",
)
def _(spark, sf):
    df = _messy(spark, sf).withColumns(
        {
            "e": F.expr(
                "case o_orderkey % 6 when 0 then 'residual' when 1 then 'PROGRESSION' when 2 then d "
                "when 3 then 'local spread' when 4 then null else 'nd' end"
            ),
            "q": F.expr(
                "case o_orderkey % 6 when 0 then 'Yes' when 1 then 'non-local' when 2 then 'Leeds (QMC)' "
                "when 3 then 'Derby' when 4 then 'QMC' end"
            ),
        }
    )
    calls = [
        ("derive_resection_type", ["d"], ["resection_type"]),
        ("derive_recurrence_type", ["e"], ["recurrence_type"]),
        ("normalize_histo_report", ["t"], ["histo_report"]),
        ("split_qmc_local", ["q"], ["qmc_local", "referring_centre"]),
    ]
    registry = default_registry()
    for name, inputs, outputs in calls:
        function = registry.resolve("gbm_registry", f"gbm_registry.{name}")
        df = df.transform(function, {"inputs": inputs, "outputs": outputs})
    return df.select("o_orderkey", "resection_type", "recurrence_type", "histo_report", "qmc_local", "referring_centre")


# -------------------------------------------------------------------- joins

_LEFT = "(select o_orderkey, case when o_custkey % 50 <> 0 then o_custkey end as k, o_orderstatus as name from orders)"
_RIGHT = (
    "(select case when c_custkey % 3 <> 0 then c_custkey when c_custkey <> 9 then -c_custkey end as k, c_name as name, c_mktsegment as seg from customer)"
)


def _join_sides(spark, sf):
    left = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("case when o_custkey % 50 <> 0 then o_custkey end").alias("k"),
        F.col("o_orderstatus").alias("name"),
    )
    # All customers; a third has keys no order has, one has none.
    right = table(spark, sf, "customer").select(
        F.expr("case when c_custkey % 3 <> 0 then c_custkey when c_custkey <> 9 then -c_custkey end").alias("k"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"),
    )
    return left, right


def _join_sql(how: str) -> str:
    return (
        f"select l.o_orderkey, coalesce(l.k, r.k) as k, l.name as name_x, r.name as name_y, r.seg "
        f"from {_LEFT} l {how} join {_RIGHT} r on l.k is not distinct from r.k"
    )


for _how, _word in (("left", "left"), ("inner", "inner"), ("outer", "full outer")):
    query(f"join_{_how}", _join_sql(_word))(
        lambda spark, sf, how=_how: joins.join_data(*_join_sides(spark, sf), "k", "k", how)
    )


@query(
    "join_prefix_and_columns",
    "select o_orderkey, o_custkey, c_custkey, c_mktsegment as customer__c_mktsegment from orders left join customer on o_custkey = c_custkey",
)
def _(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.join_data(
        left, table(spark, sf, "customer"), "o_custkey", "c_custkey", "left", ["c_mktsegment", "unknown"], "customer__"
    )


@query(
    "join_pivot",
    "with f as (select l_orderkey, l_returnflag, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) as v "
    "from lineitem where l_linenumber <> 3 group by all) "
    "select o_orderkey, o_custkey, "
    + ", ".join(f"max(case when l_returnflag = '{c}' then v end) as flag__{c}" for c in "ANR")
    + ", max(l_orderkey) as l_orderkey from orders left join f on o_orderkey = l_orderkey group by o_orderkey, o_custkey",
)
def _(spark, sf):
    right = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag",
        F.expr("case when l_linenumber <> 3 then l_extendedprice end").alias("price"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("place"),
    )
    wide = joins.pivot_long(right, "l_orderkey", "l_returnflag", "price", "flag__", order_by="place")
    return joins.join_data(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), wide, "o_orderkey", "l_orderkey", "left"
    )


@query(
    "union_by_name",
    "select o_orderkey, o_totalprice, null as o_orderpriority from orders where o_orderstatus = 'F' "
    "union all select o_orderkey, null, o_orderpriority from orders where o_orderstatus <> 'F'",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return structure.union_by_name(
        [
            orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"),
            orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority"),
        ]
    )


@query(
    "rename_and_set_value",
    "select o_orderkey as patient_id, o_orderstatus, o_totalprice, 'fixed' as origin from orders",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    df, _n = structure.rename_columns(
        df,
        {"o_orderkey": "patient_id", "o_totalprice": "patient_id", "absent": "x", "o_orderstatus": "o_totalprice"},
    )
    return structure.set_value(df, "origin", "fixed")


@query(
    "publish_null_tokens",
    f"select o_orderkey, case when {sql_missing('t')} then null else t end as t, case when {sql_missing('b')} then null else b end as b "
    f"from {_MESSY_SQL}",
)
def _(spark, sf):
    return structure.publishable(_messy(spark, sf).select("o_orderkey", "t", "b"))


# ---------------------------------------------------------------- spec runs

ORDER_SPEC = {
    "spec_id": "orders_example",
    "adapter_id": "orders",
    "version": "1",
    "steps": [
        {"operation": "rename_columns", "params": {"columns": {"o_orderkey": "patient_id", "o_orderstatus": "contributor"}}},
        {
            "id": "sparse", "operation": "filter_rows", "label": "Filter sparse rows",
            "params": {
                "action": "drop", "match": "any", "conditions": [{"field": "t", "operator": "equals", "value": "P"}],
                "minimum_populated_fields": 6, "ignored_fields": [], "counts_as": "stub_rows",
            },
        },
        {"operation": "normalize_fields", "params": {"fields": ["d"], "type": "date", "on_invalid": "flag"}},
        {"operation": "normalize_fields", "params": {"fields": ["b"], "type": "boolean", "on_invalid": "flag"}},
        {"operation": "normalize_fields", "params": {"fields": ["n"], "type": "number"}},
        {"operation": "normalize_fields", "params": {"fields": ["t"], "type": "category"}},
        {"operation": "remap_values", "params": {"field": "t", "value_mappings": {"1-urgent": "Urgent", "f": ""}}},
        {"operation": "math", "params": {"operator": "divide", "left_field": "o_totalprice", "right_field": "n", "output": "unit", "precision": 6}},
        {"operation": "derive_age", "params": {"source": "n", "output": "age", "dob": "absent", "missing_flag": "missing_age"}},
        {
            "operation": "filter_rows", "label": "Filter cheap rows",
            "params": {"action": "keep", "conditions": [{"field": "o_totalprice", "operator": "gte", "value": 1000}]},
        },
        {"operation": "finalize_output", "params": {"drop_fields": ["o_custkey"], "canonical_fields_first": False, "add_missing_canonical_fields": False}},
    ],
}


def compiled_orders(spark: SparkSession, sf: str) -> specs.CompiledSpec:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"
    )
    # The messy cells stand for columns of a raw file, so they are computed once.
    cells = {"t": MESSY_TEXT, "b": MESSY_BOOLEAN, "d": MESSY_DATE, "n": MESSY_NUMBER}
    raw = let(orders, {name: F.expr(cell) for name, cell in cells.items()}).drop("o_orderdate")
    env = specs.Environment("orders", default_registry())
    return specs.compile_spec(
        ORDER_SPEC, raw, env,
        source_file=F.concat(F.lit("orders_"), F.col("o_orderpriority"), F.lit(".csv")), row_id=F.col("o_orderkey"),
    )


_RAW_SQL = (
    f"(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {MESSY_TEXT} as t, {MESSY_BOOLEAN} as b, "
    f"{MESSY_DATE} as d, {MESSY_NUMBER} as n from orders)"
)
_POPULATED = "5 + " + " + ".join(f"cast(not {sql_missing(c)} as integer)" for c in ("t", "b", "d", "n"))
_STEPS_SQL = (
    f"(select *, ({sql_present('t')} is not distinct from 'P') or ({_POPULATED}) < 6 as stub, "
    f"{sql_present('d')} is not null and {sql_date('d')} is null as bad_d, "
    f"{sql_present('b')} is not null and ({sql_boolean('b')}) is null as bad_b, "
    f"try_cast(trunc({sql_number('n')}) as integer) is null as no_age, {sql_number('n')} as num, "
    f"lower(coalesce({sql_title('t')}, '')) in ('1-urgent', 'f') as mapped, {sql_title('t')} as title from {_RAW_SQL})"
)
_FLAG_LIST = (
    "concat_ws(',', case when bad_d then 'invalid_date_d' end, case when bad_b then 'invalid_boolean_b' end, "
    "case when no_age then 'missing_age' end)"
)
_KEPT_SQL = f"(select * from {_STEPS_SQL} where not stub and o_totalprice >= 1000)"


@query(
    "spec_clean_rows",
    f"select o_orderkey as patient_id, o_orderstatus as contributor, {sql_day(sql_date('d'))} as d, {sql_boolean('b')} as b, num as n, "
    "case when lower(title) = '1-urgent' then 'Urgent' when lower(title) = 'f' then null else title end as t, "
    f"case when num <> 0 then {sql_round('o_totalprice / num', 6)} end as unit, "
    f"try_cast(trunc(num) as integer) as age, {_FLAG_LIST} as flags, 'orders' as source from {_KEPT_SQL}",
)
def _(spark, sf):
    clean = compiled_orders(spark, sf).clean()
    return clean.select(
        "patient_id", "contributor", _iso("d").alias("d"), "b", "n", "t", "unit", "age",
        F.array_join("data_quality_flags", ",").alias("flags"), "source",
    )


@query(
    "spec_orders_summary",
    f"select o_orderstatus as contributor, coalesce(title, 'none') as kind, count(*) as rows, "
    f"sum(cast(bad_d as integer)) as bad_dates, round(sum(o_totalprice), 2) as total, max({sql_day(sql_date('d'))}) as latest "
    f"from (select * exclude (title), case when lower(title) = '1-urgent' then 'Urgent' when lower(title) = 'f' then null else title end as title "
    f"from {_KEPT_SQL}) group by all",
)
def orders_summary(spark, sf):
    return (
        compiled_orders(spark, sf)
        .clean()
        .groupBy("contributor", F.coalesce("t", F.lit("none")).alias("kind"))
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.array_contains("data_quality_flags", "invalid_date_d").cast("int")).alias("bad_dates"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.max(_iso("d")).alias("latest"),
        )
    )


@query(
    "spec_quality_report",
    f"select cast(o_orderkey as varchar) as patient_id, 'orders_' || o_orderpriority || '.csv' as source_file, {_FLAG_LIST} as flags, "
    "concat_ws(',', case when bad_d then 'orders_' || o_orderpriority || ':3:normalize_fields|3|d|' || d end, "
    "case when bad_b then 'orders_' || o_orderpriority || ':4:normalize_fields|4|b|' || b end, "
    "case when no_age then 'orders_' || o_orderpriority || ':9:derive_age|9|age|' || coalesce(cast(num as varchar), '-') end) as details "
    f"from {_KEPT_SQL}",
)
def _(spark, sf):
    def line(d):
        return F.concat_ws(
            "|", d["step_id"], d["step_position"].cast("string"), d["field"], F.coalesce(d["raw_value"], F.lit("-"))
        )

    return compiled_orders(spark, sf).quality_report().select(
        "patient_id", "source_file", F.array_join("flags", ",").alias("flags"),
        F.array_join(F.transform("flag_details", line), ",").alias("details"),
    )


_METRICS = {
    (0, "rows_raw"): "count(*)",
    (2, "filtered_rows"): "count_if(stub)",
    (2, "remaining_rows"): "count_if(not stub)",
    (3, "invalid_values"): "count_if(not stub and bad_d)",
    (4, "invalid_values"): "count_if(not stub and bad_b)",
    (5, "invalid_values"): "0",
    (6, "invalid_values"): "0",
    (7, "remapped_values"): "count_if(not stub and mapped)",
    (9, "missing_age_records"): "count_if(not stub and no_age)",
    (10, "filtered_rows"): "count_if(not stub and o_totalprice < 1000)",
    (10, "remaining_rows"): "count_if(not stub and o_totalprice >= 1000)",
    (-1, "rows_ingested"): "count_if(not stub and o_totalprice >= 1000)",
}


@query(
    "spec_step_metrics",
    " union all ".join(
        f"select 'orders_' || o_orderpriority || '.csv' as source_file, {p} as step_position, '{m}' as metric, "
        f"cast({e} as bigint) as value from {_STEPS_SQL} group by o_orderpriority"
        for (p, m), e in _METRICS.items()
    ),
)
def _(spark, sf):
    return compiled_orders(spark, sf).step_metrics()


@query(
    "spec_source_summary",
    "select 'orders' as adapter, 'orders_' || o_orderpriority || '.csv' as file, count(*) as rows_raw, count_if(stub) as rows_stub, "
    f"count_if(not stub and o_totalprice >= 1000) as rows_ingested, 'orders_example' as spec_id, '1' as spec_version from {_STEPS_SQL} group by o_orderpriority",
)
def _(spark, sf):
    return compiled_orders(spark, sf).source_summary()


@query(
    "run_summary",
    "select count(distinct o_orderpriority) as source_files, count(*) as raw_rows, count_if(stub) as stub_rows, "
    "count_if(not stub and o_totalprice >= 1000) as ingested_rows, 'orders' as adapters, "
    "count_if(not stub and o_totalprice >= 1000 and (bad_d or bad_b or no_age)) as flagged_records, "
    "cast(sum(case when not stub and o_totalprice >= 1000 then cast(bad_d as integer) + cast(bad_b as integer) + cast(no_age as integer) else 0 end) as bigint) as quality_flags "
    f"from {_STEPS_SQL}",
)
def _(spark, sf):
    compiled = compiled_orders(spark, sf)
    return summaries.run_summary(compiled.source_summary(), compiled.quality_report())


@query(
    "finalize_canonical_types",
    f"select cast(o_orderkey as varchar) as patient_id, 'orders' as source, {sql_day(sql_date('d'))} as dob, "
    f"try_cast({sql_present('n')} as integer) as age_at_presentation, o_totalprice as neutrophils, cast(null as varchar) as sex, "
    f"case when {sql_present('n')} is not null and try_cast({sql_present('n')} as integer) is null then 'type_mismatch_age_at_presentation' else '' end as flags "
    f"from (select o_orderkey, o_totalprice, d, case when o_orderkey % 7 in (0, 2, 5) then n end as n from {_RAW_SQL})",
)
def _(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("patient_id"), F.expr(MESSY_DATE).alias("dob"),
        F.expr(f"case when o_orderkey % 7 in (0, 2, 5) then {MESSY_NUMBER} end").alias("age_at_presentation"),
        F.col("o_totalprice").alias("neutrophils"),
    )
    spec = {
        "steps": [
            {"operation": "normalize_fields", "params": {"fields": ["dob"], "type": "date"}},
            {"operation": "select_canonical_fields"},
        ]
    }
    clean = specs.compile_spec(spec, raw, specs.Environment("orders", default_registry())).clean()
    return clean.select(
        "patient_id", "source", _iso("dob").alias("dob"), "age_at_presentation", "neutrophils", "sex",
        F.array_join("data_quality_flags", ",").alias("flags"),
    )
