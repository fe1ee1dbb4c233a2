"""Run catalogue, data files and marker replies, on tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fixed_values import MARKER_ORDER
from ..functions.scalars import entity_key
from ..plans import catalog
from ..sources.readers import data_file_catalogue, parse_marker_replies
from .base import MESSY_TEXT, query, sql_missing, table

# A run per order month, a source file per month and priority, an artifact per
# ship month and return flag: late ship months have no run and become orphans.


def _month(c):
    return F.date_format(c, "yyyyMM")


def _sources(spark, sf):
    return table(spark, sf, "orders").groupBy(
        _month("o_orderdate").alias("run_id"), F.concat("o_orderpriority", F.lit(".csv")).alias("file")
    ).agg(
        F.count("*").alias("rows_raw"),
        F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("rows_stub"),
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("rows_filtered"),
    )


def _runs(spark, sf):
    return table(spark, sf, "orders").groupBy(_month("o_orderdate").alias("run_id")).agg(
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("run_datetime"),
        F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("total_rows"),
    )


def _run_totals(spark, sf):
    totals = _sources(spark, sf).groupBy("run_id").agg(
        F.sum("rows_raw").alias("raw_rows"), F.sum("rows_stub").alias("stub_rows")
    )
    return _runs(spark, sf).join(totals, "run_id")


def _artifacts(spark, sf):
    flag = F.col("l_returnflag")
    grouped = table(spark, sf, "lineitem").groupBy(_month("l_shipdate").alias("run_id"), "l_returnflag").agg(
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("run_datetime"),
        F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("kept"),
    )
    return grouped.select(
        F.concat(F.lit("script_"), F.lower(flag), F.lit("_"), "run_id", F.lit("_000000.json")).alias("file_name"),
        F.when(flag != "R", F.concat(F.lit("script_"), F.lower(flag))).alias("script_id"),
        "run_id", F.col("run_id").alias("manifest_run_id"), "run_datetime",
        F.when(flag == "A", "Alpha").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("category"), F.when(flag == "N", 5).alias("priority"),
        F.to_json(F.struct("n")).alias("metadata"),
        F.when(flag == "A", "shared_model_frame").alias("cohort_display"),
        F.when(flag == "A", F.to_json(F.struct(F.col("n").alias("input_rows"), F.col("kept").alias("included_rows")))).alias("cohort"),
        F.when(flag != "N", F.lit('{"type":"table"}')).alias("visualization"),
    )


_RUNS = (
    "(select strftime(o_orderdate, '%Y%m') as run_id, strftime(max(o_orderdate), '%Y-%m-%d') as run_datetime, count_if(o_orderstatus = 'O') as total_rows, "
    "count(*) as raw_rows, count_if(o_orderstatus = 'P') as stub_rows, count(distinct o_orderpriority) as source_count from orders group by 1)"
)
_ARTIFACTS = (
    "(select strftime(l_shipdate, '%Y%m') as run_id, l_returnflag as f, strftime(max(l_shipdate), '%Y-%m-%d') as run_datetime, count(*) as n, "
    "count_if(l_linestatus = 'F') as kept, 'script_' || lower(l_returnflag) as script_id from lineitem group by all)"
)


@query(
    "catalog_runs",
    f"select run_id, run_datetime, total_rows, source_count, raw_rows, stub_rows, run_datetime = (select max(run_datetime) from {_RUNS}) as is_latest from {_RUNS}",
)
def _(spark, sf):
    return catalog.ingestion_runs(_runs(spark, sf), _sources(spark, sf))


@query(
    "catalog_artifacts",
    "select 'script_' || lower(f) || '_' || run_id || '_000000.json' as file_name, script_id, case when f = 'A' then 'Alpha' else 'Script ' || f end as title, "
    "'' as description, 'Uncategorized' as category, case when f = 'N' then 5 else 99 end as priority, case when f = 'A' then 'shared_model_frame' "
    "when f = 'R' then 'policy' else 'none' end as cohort_display, case when f <> 'N' then 'table' end as visualization_type, "
    f"(run_datetime, run_id) = max((run_datetime, run_id)) over (partition by f) as is_latest from {_ARTIFACTS}",
)
def _(spark, sf):
    out = catalog.artifact_list(_artifacts(spark, sf), {"script_r": "policy"})
    return out.select(
        "file_name", "script_id", "title", "description", "category", "priority", "cohort_display",
        "visualization_type", "is_latest",
    )


@query(
    "catalog_pipeline",
    f"with a as (select * from {_ARTIFACTS}), r as (select * from {_RUNS}) "
    "select r.run_id as manifest_run_id, total_rows, count(a.f) as analyses, count(case when a.f <> 'N' then 1 end) as visualizations, "
    "coalesce(string_agg(case when a.f <> 'R' then a.script_id end, ', ' order by a.script_id), '') as scripts from r left join a using (run_id) group by r.run_id, total_rows "
    "union all select null, null, count(*), count(case when f <> 'N' then 1 end), string_agg(distinct case when f <> 'R' then script_id end, ', ' order by case when f <> 'R' then script_id end) "
    "from a where run_id not in (select run_id from r) having count(*) > 0",
)
def _(spark, sf):
    return catalog.pipeline(_runs(spark, sf), _artifacts(spark, sf))


@query(
    "catalog_orphans",
    f"select 'script_' || lower(f) || '_' || run_id || '_000000.json' as file_name from {_ARTIFACTS} where run_id not in (select run_id from {_RUNS})",
)
def _(spark, sf):
    return catalog.orphans(_runs(spark, sf), _artifacts(spark, sf)).select("file_name")


@query(
    "catalog_latest_analysis",
    f"select run_id, f as flag from {_ARTIFACTS} where run_id = (select arg_max(run_id, (run_datetime, run_id)) from {_ARTIFACTS})",
)
def _(spark, sf):
    out = catalog.latest_analysis_run(_artifacts(spark, sf))
    return out.select("run_id", F.upper(F.regexp_extract("file_name", "script_([a-z])", 1)).alias("flag"))


@query(
    "catalog_stage_status",
    "select 1 as position, 'ingestion' as stage, case when count(*) > 0 then 'completed' else 'pending' end as status from orders "
    "union all select 2, 'analysis', case when count(*) > 0 then 'completed' else 'failed' end from lineitem "
    "union all select 3, 'visualization', case when count_if(l_returnflag <> 'N') > 0 then 'completed' else 'failed' end from lineitem",
)
def _(spark, sf):
    return catalog.stage_status(_runs(spark, sf), _artifacts(spark, sf))


@query(
    "catalog_analysis_history",
    f"select run_id as run, run_id, max(run_datetime) as run_datetime, count(*) as artifacts, count(case when f <> 'R' then 1 end) as scripts, "
    f"'Analysis outputs' as title from {_ARTIFACTS} group by run_id",
)
def _(spark, sf):
    return catalog.analysis_history(_artifacts(spark, sf))


def _steps(spark, sf):
    files = _sources(spark, sf)
    number = (F.dense_rank().over(_by_run()) - 1) * 2
    rows = files.withColumn("_base", number)

    def step(offset, step_id, label, operation, metrics):
        return F.struct(
            (F.col("_base") + offset).cast("int").alias("ordinal"),
            F.concat(F.regexp_replace("file", r"\.csv$", ""), F.lit(f":{step_id}")).alias("step_id"),
            F.lit(label).alias("label"), F.lit("Removed rows.").alias("summary"), F.lit("completed").alias("status"),
            F.lit("static_code").alias("execution_mode"), F.col("file").alias("source_file"),
            F.lit(operation).alias("operation"), metrics.alias("metrics"),
        )

    sparse = F.to_json(F.struct(F.col("rows_stub").alias("filtered_rows"), (F.col("rows_raw") - F.col("rows_stub")).alias("remaining_rows")))
    cheap = F.to_json(
        F.struct(
            F.col("rows_filtered").alias("filtered_rows"), F.lit("status").alias("filter_label"),
            F.concat(F.lit("Drop "), F.col("rows_filtered").cast("string"), F.lit(" rows.")).alias("filter_description"),
        )
    )
    return rows.select(
        "run_id",
        F.inline(
            F.array(
                step(0, "sparse", "Filter sparse rows", "filter_rows", sparse),
                step(1, "cheap", "Filter finished", "filter_rows", cheap),
            )
        ),
    )


def _by_run():
    return Window.partitionBy("run_id").orderBy("file")


_SPEC = (
    '{"steps": [{"id": "sparse", "operation": "filter_rows", "label": "Filter sparse rows", "params": {"action": "drop", "match": "any", '
    '"conditions": [{"field": "patient_id", "operator": "is_missing"}], "minimum_populated_fields": 2}}, '
    '{"id": "x", "operation": "math"}, {"id": "cheap", "operation": "filter_rows", "params": {"conditions": [{"field": "o_orderstatus", "operator": "equals", "value": "F"}]}}]}'
)
_FILES = (
    "(select *, (dense_rank() over (partition by run_id order by file) - 1) * 2 as base from (select strftime(o_orderdate, '%Y%m') as run_id, o_orderpriority || '.csv' as file, count(*) as raw, "
    "count_if(o_orderstatus = 'P') as stub, count_if(o_orderstatus = 'F') as cheap from orders group by all))"
)


@query(
    "catalog_step_rollup",
    f"with f as (select * from {_FILES}), d as (select run_id, count(*) as k, string_agg(file, ', ' order by file) as files, min(base) as b, "
    "string_agg(file || ': Drop ' || cheap || ' rows.', '; ' order by file) as each_file, count(distinct cheap) as kinds, min(cheap) as one from f group by run_id) "
    "select run_id, b as ordinal, 'sparse' as step_id, 'Filter sparse rows' as label, case when k = 1 then files || ': Removed rows.' "
    "else 'Ran ' || k || 'x, once per input file: ' || files || '. Removed rows.' end as detail, k as run_count, files as source_files from d "
    "union all select run_id, b + 1, 'cheap', 'Filter finished (status)', case when k = 1 then files || ': Drop ' || one || ' rows.' "
    "when kinds = 1 then 'Ran ' || k || 'x, once per input file: ' || files || '. Drop ' || one || ' rows.' else 'Ran ' || k || 'x, once per input file. ' || each_file end, k, files from d",
)
def _(spark, sf):
    return catalog.step_rollup(_steps(spark, sf)).drop("status", "execution_mode")


@query(
    "catalog_filter_rules",
    f"with f as (select * from {_FILES}) select run_id, base + 1 as position, 'sparse_rows' as rule, 'Filter sparse rows (sparse rows)' as label, stub as count, raw - stub as remaining_rows, "
    "'Drop rows where any of: patient_id is missing; fewer than 2 populated field(s).' as description, 'patient_id is missing|fewer than 2 populated field(s)' as conditions from f where stub > 0 "
    "union all select run_id, base + 2, 'filter_rows', 'Filter finished (status)', cheap, null, 'Drop ' || cheap || ' rows.', 'o_orderstatus equals F' from f where cheap > 0 "
    f"union all select run_id, 0, 'sparse_rows', 'Sparse row filter', stub_rows, null, 'Rows with no patient identifier or too few populated fields were removed.', '' "
    f"from {_RUNS} where stub_rows > 0 and run_id not in (select run_id from f where stub > 0)",
)
def _(spark, sf):
    sources = _sources(spark, sf)
    specs = sources.select("run_id", F.col("file").alias("source_file"), F.lit(_SPEC).alias("spec"))
    out = catalog.filter_rules(_steps(spark, sf), specs, _run_totals(spark, sf))
    return out.withColumn("conditions", F.array_join("conditions", "|"))


@query(
    "catalog_cohort_trace",
    f"select 'script_a_' || a.run_id || '_000000.json' as file_name, a.run_id as manifest_run_id, r.raw_rows, r.stub_rows, r.total_rows as clean_rows, "
    f"a.n as input_rows, a.kept as included_rows, a.n - a.kept as excluded_rows from {_ARTIFACTS} a left join {_RUNS} r using (run_id) where f = 'A'",
)
def _(spark, sf):
    artifacts = catalog.artifact_list(_artifacts(spark, sf))
    return catalog.cohort_trace(_run_totals(spark, sf), artifacts).drop("script_id", "cohort_display", "basis", "rules")


# ------------------------------------------------------- data files, markers


@query(
    "data_file_catalogue",
    "with b as (select o_orderpriority as file, o_orderstatus as status, cast(o_custkey as varchar) as buyer, " + MESSY_TEXT + " as cell from orders), "
    "l as (select * from b unpivot (value for column_name in (status, buyer, cell))), "
    f"d as (select distinct file, column_name, value from l where not {sql_missing('value')}), "
    "c as (select *, row_number() over (partition by file, column_name order by value) as r, count(*) over (partition by file, column_name) as n from d) "
    "select file, column_name, any_value(n) as distinct_values, string_agg(value, '|' order by value) as values, (select count(*) from b where b.file = c.file) as rows "
    "from c where r <= 200 group by file, column_name",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("buyer"), F.expr(MESSY_TEXT).alias("cell"),
    )
    return data_file_catalogue(df, "file").withColumn("values", F.array_join("values", "|"))


@query(
    "marker_replies",
    "select 'K' || c_custkey as k_number, i as position, m as marker, case when i = 4 then c_mktsegment else 'v' || i end as value, "
    "case when i = 2 then 'unclear, see text' else '' end as notes from customer, (values "
    + ", ".join(f"({i}, '{m}')" for i, m in enumerate(MARKER_ORDER))
    + ") t(i, m) where c_custkey % 5 not in (2, 3)",
)
def _(spark, sf):
    return parse_marker_replies(_replies(spark, sf), "k", "reply")[0]


@query(
    "marker_reply_rejects",
    "select 'K' || c_custkey as k_number, case when c_custkey % 5 = 2 then 'The reply is empty.' else 'The reply does not hold the required markers in order.' end as reason "
    "from customer where c_custkey % 5 in (2, 3)",
)
def _(spark, sf):
    return parse_marker_replies(_replies(spark, sf), "k", "reply")[1]


def _replies(spark, sf):
    lines = [
        F.concat(
            F.lit(f"{m}, "), F.col("c_mktsegment") if i == 4 else F.lit(f"v{i}"),
            F.lit(',"unclear, see text"' if i == 2 else ","),
        )
        for i, m in enumerate(MARKER_ORDER)
    ]
    body = F.concat_ws("\n", *lines)
    short = F.concat_ws("\n", *lines[:4])
    header = F.lit("marker,value,notes\n")
    kind = F.col("c_custkey") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("Here it is:\n```csv\n"), header, body, F.lit("\n```\nDone.")))
        .when(kind == 1, body)
        .when(kind == 2, F.lit("  "))
        .when(kind == 3, F.concat(header, short))
        .otherwise(F.concat(header, body, F.lit("\n\n")))
    )
    return table(spark, sf, "customer").select(F.concat(F.lit("K"), "c_custkey").alias("k"), reply.alias("reply"))


@query(
    "entity_keys",
    "select c_custkey, case when c_custkey % 3 <> 0 then 'K' || c_custkey end as k_number from customer",
)
def _(spark, sf):
    name = F.expr("case when c_custkey % 3 <> 0 then concat('report k', c_custkey, ' (2 years later).txt') else 'no-key.K.txt' end")
    return table(spark, sf, "customer").select("c_custkey", entity_key(name).alias("k_number"))
