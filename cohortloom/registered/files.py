"""Sources, sinks and runs: the given tables are written as raw files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..models import frame as frames
from ..operators import contracts
from ..plans import histology, ingest
from ..plans import spec as specs
from ..plans.registry_functions import default_registry
from ..session import ensure_checkpoint_dir
from ..sources import hashes, readers, store
from .base import MESSY_BOOLEAN, MESSY_DATE, MESSY_NUMBER, MESSY_TEXT, query, sql_boolean, sql_date, sql_day, sql_number, sql_present, sql_title, table


def _folder(spark: SparkSession) -> str:
    """A folder of this call alone, where driver and tasks can reach it."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


_CUSTOMERS = (
    "(select cast(c_custkey as varchar) as \"K-number\", c_name || ', \"' || c_mktsegment || '\"' as Notes, "
    "case when c_custkey % 4 = 0 then null else cast(c_acctbal as varchar) end as Score from customer)"
)


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("K-number"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("Notes"),
        F.expr("case when c_custkey % 4 <> 0 then cast(c_acctbal as string) end").alias("Score"),
    )


def _raw_csv(df: DataFrame, path: str, sep: str = ",") -> list[str]:
    df.write.options(header=True, sep=sep, escape='"', quoteAll=False).csv(path)
    return readers.list_files(df.sparkSession, [f"{path}/*.csv"])


@query("source_registry_csv", f"select * from {_CUSTOMERS}")
def _(spark, sf):
    files = _raw_csv(_customers(spark, sf).repartition(3), _folder(spark))
    return readers.read_registry_csv(spark, files).drop(readers.FILE_NAME)


@query("source_generic_csv", f"select \"K-number\", Notes, coalesce(Score, '') as Score from {_CUSTOMERS}")
def _(spark, sf):
    files = _raw_csv(_customers(spark, sf).repartition(2), _folder(spark), ";")
    return readers.read_generic_csv(spark, files).drop(readers.FILE_NAME)


@query("source_lookup_json", "select lower(c_name) as key, n_name as value from customer join nation on c_nationkey = n_nationkey")
def _(spark, sf):
    """A lookup of one object a line, as many lines as there are customers."""
    path = _folder(spark)
    pairs = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    pairs.select(F.to_json(F.create_map(F.lower("c_name"), "n_name")).alias("value")).write.text(path)
    return readers.read_mapping(spark, path)


@query("source_published_table", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(spark, sf):
    root = _folder(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(f"{root}/published")
    return readers.read_data_file(spark, root, "published").drop("_row_order")


@query("marker_dataset_sink", "select 'K' || c_custkey as k_number, c_mktsegment as marker, c_name as value, c_custkey as position from customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("K"), "c_custkey").alias("k_number"), F.col("c_mktsegment").alias("marker"), F.col("c_name").alias("value"),
        F.col("c_custkey").alias("position"),
    )
    path = f"{_folder(spark)}.json"
    store.write_marker_dataset(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "json_export",
    "select '{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\",\"note\":' || case when c_custkey % 2 = 0 then 'null' else '\"kept\"' end || '}' as value from customer",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.expr("case when c_custkey % 2 = 0 then 'N/A' else 'kept' end").alias("note")
    )
    return store.to_json_rows(rows)


# --------------------------------------------------------------------- runs


def _run(spark: SparkSession, sf: str) -> tuple[ingest.Workspace, str]:
    """A run of the generic adapter over customers as raw files, one of them without rows."""
    ws = ingest.Workspace.at(spark, _folder(spark))
    rows = _customers(spark, sf).withColumn("Score", F.coalesce("Score", F.lit("Not Documented")))
    _raw_csv(rows.repartition(2), f"{ws.root}/data/raw/imports")
    rows.where("false").coalesce(1).write.options(header=True).mode("append").csv(f"{ws.root}/data/raw/imports")
    return ws, ingest.run_ingestion(ws, "generic_csv").run_id


@query("ingest_clean_rows", f"select \"K-number\", Notes, Score, 'generic_csv' as source from {_CUSTOMERS}")
def _(spark, sf):
    ws, _ = _run(spark, sf)
    return ws.store.clean().select("K-number", "Notes", "Score", "source")


@query("ingest_run_sources", "select 'generic_csv' as adapter, count(*) as rows_raw, 0 as rows_stub, count(*) as rows_ingested, 'generic_csv_default' as spec_id from customer")
def _(spark, sf):
    ws, run_id = _run(spark, sf)
    found = ws.store.table("run_sources").where(F.col("run_id") == run_id)
    sums = [F.sum(c).alias(c) for c in ("rows_raw", "rows_stub", "rows_ingested")]
    return found.groupBy("adapter", "spec_id").agg(*sums)


_PARITY = "case c_custkey % 3 when 0 then 'a.csv' when 1 then 'b.csv' else 'c.csv' end"


@query(
    "ingest_run_files",
    f"select {_PARITY} as file, count(*) as rows_raw, count(*) as rows_ingested from customer group by all union all select 'empty.csv', 0, 0",
)
def _(spark, sf):
    """Files of known names and sizes, one of them without rows."""
    ws = ingest.Workspace.at(spark, _folder(spark))
    target = f"{ws.root}/data/raw/imports"
    rows = table(spark, sf, "customer").select(F.expr(_PARITY).alias("file"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    for file in ("a.csv", "b.csv", "c.csv", "empty.csv"):
        _named_file(rows.where(F.col("file") == file).drop("file"), target, file)
    run_id = ingest.run_ingestion(ws, "generic_csv").run_id
    found = ws.store.committed("run_sources").where(F.col("run_id") == run_id)
    return found.select("file", F.col("rows_raw").cast("bigint").alias("rows_raw"), F.col("rows_ingested").cast("bigint").alias("rows_ingested"))


def _named_file(df: DataFrame, folder: str, name: str, header: bool = True) -> None:
    """One CSV file of that name; Spark names its own parts."""
    spark, part = df.sparkSession, f"{folder}-part-{uuid.uuid4().hex}"
    df.coalesce(1).write.options(header=header, escape='"').csv(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    written = hadoop.Path(readers.list_files(spark, [f"{part}/*.csv"])[0])
    system = written.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(folder))
    system.rename(written, hadoop.Path(f"{folder}/{name}"))


@query("ingest_preview", "select count(*) as source_rows, count(*) as clean_rows, least(count(*), 10) as shown, count(*) as rows_raw, 0 as rows_stub from customer")
def _(spark, sf):
    """A spec applied without writing: whole counts, and the first rows."""
    ws = ingest.Workspace.at(spark, _folder(spark))
    _named_file(_customers(spark, sf), f"{ws.root}/data/raw/imports", "a.csv")
    found = ingest.preview(ws, "generic_csv")
    counts = spark.createDataFrame([(found.source_profile.rows, found.transformed_profile.rows, found.rows.count())], "source_rows bigint, clean_rows bigint, shown bigint")
    own = found.summary.select(*[F.col(c).cast("bigint").alias(c) for c in ("rows_raw", "rows_stub")]).collect()
    return counts.withColumns({"rows_raw": F.lit(own[0]["rows_raw"]), "rows_stub": F.lit(own[0]["rows_stub"])})


@query(
    "artifacts_by_latest",
    "select 'script_' || n_regionkey as script_id, lpad(cast(max(n_nationkey) as varchar), 3, '0') as run_id, "
    "'script_' || n_regionkey || '_' || lpad(cast(max(n_nationkey) as varchar), 3, '0') || '.json' as file_name, max(n_nationkey) as value from nation group by n_regionkey",
)
def _(spark, sf):
    """An artifact per nation, of one script per region: the newest run of each script counts."""
    kept = ingest.Workspace.at(spark, _folder(spark)).store
    for row in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows at every scale
        run = f"{row['n_nationkey']:03d}"
        kept.save_artifact(
            {
                "script_id": f"script_{row['n_regionkey']}", "run_id": run, "manifest_run_id": run, "run_datetime": f"2024-01-01T00:00:{int(run):02d}",
                "title": row["n_name"], "description": "", "category": "test", "priority": 1, "data": {"value": row["n_nationkey"]},
            }
        )
    value = F.get_json_object("data", "$.value").cast("int").alias("value")
    return kept.latest_artifacts().select("script_id", "run_id", "file_name", value)


@query("saved_specs", "select 'generic_csv' as adapter_id, max(r_regionkey) as version, count(*) as saved from region")
def _(spark, sf):
    """The newest saved spec is the adapter's default; the earlier ones stay in the table."""
    ws = ingest.Workspace.at(spark, _folder(spark))
    for row in table(spark, sf, "region").orderBy("r_regionkey").collect():  # 5 rows at every scale
        ws.store.save_spec("generic_csv", {"spec_id": "s", "version": row["r_regionkey"], "steps": []})
    spec, origin = ingest.default_spec(ws, "generic_csv")
    saved = ws.store.table("saved_specs").count() if origin == "saved" else 0
    return spark.createDataFrame([(spec["adapter_id"], spec["version"], saved)], "adapter_id string, version int, saved bigint")


# ---------------------------------------------------------------- histology

_NATIONS = "(select n_nationkey as k, n_name, n_regionkey from nation)"


def _histology(spark: SparkSession, sf: str) -> ingest.Workspace:
    """A report per nation; most have a marker file, some a reply that is good or bad, some nothing."""
    ws = ingest.Workspace.at(spark, _folder(spark))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    nations = nations.cache()
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("marker"), F.col("c_name").alias("value"))
    for k in range(25):  # the nation table has 25 rows at every scale
        _named_file(nations.where(F.col("k") == k).select("name"), f"{ws.root}/data/raw/histology/reports", f"K{100 + k} report.txt", header=False)
        if k % 5 < 3:
            _named_file(customers.where(F.col("k") == k).select("marker", "value"), f"{ws.root}/data/raw/histology/markers", f"K{100 + k} report.csv")
    replies = nations.where("k % 5 = 3").select(
        F.concat(F.lit("K"), F.col("k") + 100, F.lit(" report.txt")).alias("file_name"),
        F.when(F.col("k") % 2 == 0, F.concat(*[F.concat(F.lit(f"{m},"), "name", F.lit("\n")) for m in fv.MARKER_ORDER])).otherwise("no markers").alias("text"),
    )
    nations.unpersist()
    histology.run_histology(ws, replies)
    return ws


_MARKED = "select 'K' || (100 + c_nationkey) as k_number, c_mktsegment as marker, c_name as value from customer where c_nationkey % 5 < 3"


@query(
    "histology_dataset",
    f"{_MARKED} union all select 'K' || (100 + k), m.marker, n_name from {_NATIONS}, (values "
    + ", ".join("('" + m.replace("'", "''") + "')" for m in fv.MARKER_ORDER)
    + ") m(marker) where k % 5 = 3 and k % 2 = 0",
)
def _(spark, sf):
    return histology.histology_dataset(_histology(spark, sf).store).select("k_number", "marker", "value")


@query(
    "histology_files",
    "select 'K' || (100 + k) || ' report.txt' as file_name, case when k % 5 < 3 then 'csv' when k % 5 = 4 then 'missing' when k % 2 = 0 then 'reply' else 'rejected' end as origin, "
    f"case when k % 5 < 3 then (select count(*) from customer where c_nationkey = k) when k % 5 = 3 and k % 2 = 0 then {len(fv.MARKER_ORDER)} else 0 end as rows from {_NATIONS}",
)
def _(spark, sf):
    ws = _histology(spark, sf)
    run = histology.latest_histology(ws.store).first()["run_id"]
    return ws.store.run_table("histology_files", run).select("file_name", "origin", F.col("rows").cast("bigint").alias("rows"))


@query(
    "histology_latest_run",
    "select 25 as text_reports, 15 as source_csvs, count_if(k % 5 = 3 and k % 2 = 0) as source_replies, count_if(k % 5 = 4 or k % 5 = 3 and k % 2 = 1) as missing_reports, "
    f"(select count(*) from customer where c_nationkey % 5 < 3) + {len(fv.MARKER_ORDER)} * count_if(k % 5 = 3 and k % 2 = 0) as total_rows from {_NATIONS}",
)
def _(spark, sf):
    return histology.latest_histology(_histology(spark, sf).store).drop("run_id", "run_datetime")


# ------------------------------------------------------- folders and contracts


def _region_files(spark: SparkSession, sf: str, folder: str, changed: bool) -> None:
    regions = table(spark, sf, "region").join(table(spark, sf, "nation"), F.expr("r_regionkey = n_regionkey"))
    for k in range(5):  # the region table has 5 rows at every scale
        if k == (4 if changed else 3):
            continue
        value = F.when(F.lit(changed) & (F.col("n_regionkey") == 1), F.lower("n_name")).otherwise(F.col("n_name"))
        _named_file(regions.where(F.col("r_regionkey") == k).select(value.alias("name"), F.col("n_nationkey").alias("key")).orderBy("key"), folder, f"region{k}.csv")


@query(
    "file_changes",
    "select 'region' || r_regionkey || '.csv' as name, case r_regionkey when 1 then 'changed' when 3 then 'new' when 4 then 'removed' end as status "
    "from region where r_regionkey in (1, 3, 4)",
)
def _(spark, sf):
    first, second = _folder(spark), _folder(spark)
    _region_files(spark, sf, first, False)
    _region_files(spark, sf, second, True)
    seen, now = (hashes.hash_files(spark, readers.list_files(spark, [f"{f}/*.csv"])).withColumn("path", F.substring_index("path", "/", -1)) for f in (first, second))
    return hashes.changes(now, seen).select(F.col("path").alias("name"), "status")


@query(
    "folder_catalogue",
    "select 'reference' as kind, 'region' || n_regionkey || '.csv' as name, count(*) as rows, c.column_name, count(*) as distinct_values, "
    "array_to_string(list_sort(list(case when c.column_name = 'key' then cast(n_nationkey as varchar) else n_name end)), ',') as listed, n_regionkey = 0 as is_latest "
    "from nation, (values ('name'), ('key')) c(column_name) where n_regionkey <> 3 group by n_regionkey, c.column_name",
)
def _(spark, sf):
    folder = _folder(spark)
    _region_files(spark, sf, folder, False)
    found = hashes.catalogue(spark, {"reference": [f"{folder}/*.csv"]}, latest=readers.list_files(spark, [f"{folder}/region0.csv"]))
    return found.where("length(sha256) = 64").select("kind", "name", "rows", "column_name", "distinct_values", F.array_join("values", ",").alias("listed"), "is_latest")


_CONTRACT = (
    {"name": "o_orderkey", "type": "bigint", "nullable": False},
    {"name": "priority", "type": "string", "allowed": ("1-URGENT", "2-HIGH", "3-MEDIUM")},
    {"name": "cell", "type": "double"},
    {"name": "note", "type": "string", "nullable": False},
    {"name": "o_orderdate", "type": "date"},
    {"name": "absent", "type": "int"},
)
_PLANTED = (
    "(select o_orderkey, o_orderpriority as priority, case o_orderkey % 5 when 0 then 'x' || o_orderkey when 1 then null else cast(o_custkey as varchar) end as cell, "
    "case when o_orderkey % 7 = 0 then ' n/a ' else 'ok' end as note from orders)"
)


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"),
        F.expr("case o_orderkey % 5 when 0 then concat('x', o_orderkey) when 1 then null else cast(o_custkey as string) end").alias("cell"),
        F.expr("case when o_orderkey % 7 = 0 then ' n/a ' else 'ok' end").alias("note"), F.to_date("o_orderdate").alias("o_orderdate"), F.lit(1).alias("surplus"),
    )


_ALLOWED = "('1-URGENT', '2-HIGH', '3-MEDIUM')"


@query(
    "contract_violations",
    f"select o_orderkey, 'priority' as field, 'not_allowed' as problem, priority as value from {_PLANTED} where priority not in {_ALLOWED} "
    f"union all select o_orderkey, 'cell', 'type', cell from {_PLANTED} where cell like 'x%' "
    f"union all select o_orderkey, 'note', 'null', null from {_PLANTED} where note <> 'ok'",
)
def _(spark, sf):
    found = contracts.violations(_planted(spark, sf), _CONTRACT, ["o_orderkey"])
    return found.withColumn("value", F.when(F.col("problem") != "null", F.col("value")))


@query(
    "contract_report",
    "select * from (values ('cell', 'type', 'double', 'string', cast(null as bigint)), ('absent', 'missing', 'int', null, null), ('surplus', 'extra', null, 'int', null)) "
    "v(field, problem, expected, found, rows) "
    f"union all select 'priority', 'row_not_allowed', '1-URGENT, 2-HIGH, 3-MEDIUM', null, count(*) from {_PLANTED} where priority not in {_ALLOWED} "
    f"union all select 'cell', 'row_type', 'double', null, count(*) from {_PLANTED} where cell like 'x%' "
    f"union all select 'note', 'row_null', 'not null', null, count(*) from {_PLANTED} where note <> 'ok'",
)
def _(spark, sf):
    return contracts.validate(_planted(spark, sf), _CONTRACT)


# ---------------------------------------------------------------- operations


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = {"t": MESSY_TEXT, "b": MESSY_BOOLEAN, "d": MESSY_DATE, "n": MESSY_NUMBER}
    return table(spark, sf, "orders").select("o_orderkey", *[F.expr(c).alias(n) for n, c in cells.items()])


_CELLS = f"(select o_orderkey, {MESSY_TEXT} as t, {MESSY_TEXT} as c, {MESSY_BOOLEAN} as b, {MESSY_DATE} as d, {MESSY_NUMBER} as n from orders)"


@query(
    "single_type_operations",
    f"select o_orderkey, {sql_present('t')} as t, {sql_title('c')} as c, {sql_boolean('b')} as b, {sql_day(sql_date('d'))} as d, {sql_number('n')} as n from {_CELLS}",
)
def _(spark, sf):
    kinds = {"normalize_text": "t", "normalize_category": "c", "normalize_boolean": "b", "parse_date": "d", "to_float": "n"}
    steps = [{"operation": o, "params": {"fields": [f]}} for o, f in kinds.items()]
    raw = _cells(spark, sf).withColumn("c", F.col("t"))
    env = specs.Environment("orders", default_registry())
    clean = specs.compile_spec({"spec_id": "single", "version": 1, "steps": steps}, raw, env, row_id=F.col("o_orderkey")).clean()
    return clean.select("o_orderkey", "t", "c", "b", F.date_format("d", "yyyy-MM-dd").alias("d"), "n")


@query(
    "attached_flags",
    f"select o_orderkey, case when {sql_present('d')} is not null and {sql_date('d')} is null then 'invalid_date_d' else '' end as flags from {_CELLS}",
)
def _(spark, sf):
    steps = [
        {"operation": "validate_required_columns", "params": {"columns": ["o_orderkey", "d"], "strict": True}},
        {"operation": "normalize_fields", "params": {"fields": ["d"], "type": "date", "on_invalid": "flag"}},
        {"operation": "attach_quality_flags", "params": {}},
    ]
    env = specs.Environment("orders", default_registry())
    clean = specs.compile_spec({"spec_id": "flags", "version": 1, "steps": steps}, _cells(spark, sf), env, row_id=F.col("o_orderkey")).clean()
    return clean.select("o_orderkey", F.array_join("data_quality_flags", ",").alias("flags"))


@query(
    "time_to_event_cohort",
    "select cast(count(*) as bigint) as n, cast(sum(event) as bigint) as events, cast(sum(days) as bigint) as days from (select cast(event_date is not null as integer) as event, "
    "date_diff('day', s, coalesce(event_date, c)) as days from (select cast(o_orderdate as date) as s, "
    "case when l_linestatus = 'F' then cast(l_shipdate as date) end as event_date, cast(l_shipdate as date) as c from lineitem join orders on l_orderkey = o_orderkey)) where days > 0",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).select(
        F.to_date("o_orderdate").alias("start_date"), F.expr("case when l_linestatus = 'F' then to_date(l_shipdate) end").alias("event_date"),
        F.to_date("l_shipdate").alias("censor_date"),
    )
    found = frames.survival_rows(rows, "start_date", "event_date", "censor_date").df
    return found.agg(F.count("*").alias("n"), F.sum("event").cast("bigint").alias("events"), F.sum("duration_days").cast("bigint").alias("days"))
