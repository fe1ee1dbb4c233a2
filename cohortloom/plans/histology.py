"""Compile marker rows of text reports into one published dataset.

A run is one batch job: report files, the marker CSVs beside them and, if given, free-text
replies about reports meet on the report's name. A report takes its CSV; without one (or
with ``prefer_replies``) it takes its reply; what is left over is listed with a reason.

Rows and file list are written under the run's own folder; the run's row in
``histology_runs`` comes last and commits them. Readers start from committed runs, so a run
that broke off, or one still going on, is never seen.

Defined results: no report at all is an error, as is a report without an entity key in its
name; so is a run in which no report has markers. CSVs without a report are left out. A
marker CSV without rows counts as compiled with zero rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.summaries import latest_per_key
from ..sources.readers import entity_key, list_files, parse_marker_replies, read_marker_rows
from ..sources.store import RunContext, Store
from .ingest import Workspace

# Where reports and their marker files lie, relative to the workspace.
REPORT_GLOB = "data/raw/histology/reports/*.txt"
MARKER_GLOB = "data/raw/histology/markers/*.csv"

RUN_SCHEMA = (
    "run_id string, run_datetime string, text_reports bigint, source_csvs bigint, source_replies bigint, "
    "missing_reports bigint, total_rows bigint"
)
STEP_SCHEMA = "run_id string, ordinal int, step_id string, label string, summary string, status string, execution_mode string, metrics string"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _file_names(ws: Workspace, glob: str) -> tuple[list[str], DataFrame]:
    """(paths, their names as a table); names only, so files are not opened."""
    paths = list_files(ws.spark, [f"{ws.root}/{glob}"])
    names = ws.spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "file_name string")
    return paths, names.withColumn("stem", _stem(F.col("file_name")))


@dataclass(frozen=True)
class Compiled:
    """(k_number, marker, value, notes, file_name) and (file_name, k_number, origin, rows, reason)."""

    rows: DataFrame
    files: DataFrame


def compile_reports(ws: Workspace, replies: DataFrame | None = None, prefer_replies: bool = False) -> Compiled:
    """Markers of all reports. ``replies`` has ``file_name`` (of the report) and ``text``."""
    paths, reports = _file_names(ws, REPORT_GLOB)
    if not paths:
        raise FileNotFoundError(f"No report files match {REPORT_GLOB}.")
    reports = reports.withColumn("k_number", entity_key(F.col("file_name")))
    unnamed = [r["file_name"] for r in reports.where("k_number is null").limit(5).collect()]
    if unnamed:
        raise ValueError(f"Report names without an entity key: {', '.join(unnamed)}")
    report = reports.select("stem", "k_number", F.col("file_name").alias("report"))

    marker_paths, marker_files = _file_names(ws, MARKER_GLOB)
    with_csv = report.join(marker_files.select("stem"), "stem", "left_semi")
    found = [ws.spark.createDataFrame([], "k_number string, marker string, value string, notes string, report string, origin string")]
    rejects = ws.spark.createDataFrame([], "report string, reason string")
    answered = ws.spark.createDataFrame([], "report string")
    if replies is not None:
        asked = replies.select(_stem(F.col("file_name")).alias("stem"), F.col("text").alias("reply")).join(report, "stem")
        if not prefer_replies:
            asked = asked.join(with_csv.select("stem"), "stem", "left_anti")
        good, bad = parse_marker_replies(asked, "report", "reply")
        answered = good.select(F.col("k_number").alias("report")).distinct()
        rejects = bad.select(F.col("k_number").alias("report"), "reason")
        markers = good.withColumnRenamed("k_number", "report").join(report.select("report", "k_number"), "report")
        found.append(markers.select("k_number", "marker", "value", "notes", "report", F.lit("reply").alias("origin")))
    if marker_paths:
        csv = read_marker_rows(ws.spark, marker_paths).withColumn("stem", _stem(F.col("file_name"))).drop("file_name", "k_number")
        own = report.join(answered, "report", "left_anti") if prefer_replies else report
        found.append(csv.join(own, "stem").select("k_number", "marker", "value", "notes", "report", F.lit("csv").alias("origin")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)

    counts = rows.groupBy("report").agg(F.count("*").alias("rows"))
    origin = (
        F.when(F.col("answered"), "reply").when(F.col("has_csv"), "csv").when(F.col("reason").isNotNull(), "rejected").otherwise("missing")
    )
    files = (
        report.join(with_csv.select("report", F.lit(True).alias("has_csv")), "report", "left")
        .join(answered.withColumn("answered", F.lit(True)), "report", "left")
        .join(rejects, "report", "left")
        .join(counts, "report", "left")
        .select(
            F.col("report").alias("file_name"), "k_number", origin.alias("origin"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.when(origin == "missing", F.lit("No marker file and no reply.")).when(origin == "rejected", F.col("reason")).alias("reason"),
        )
    )
    return Compiled(rows.withColumnRenamed("report", "file_name"), files)


def run_histology(ws: Workspace, replies: DataFrame | None = None, prefer_replies: bool = False) -> RunContext:
    """Compile, write and commit one run."""
    run, store = RunContext.now(), ws.store
    compiled = compile_reports(ws, replies, prefer_replies)
    store.append_run("histology_files", compiled.files, run.run_id)
    files = store.run_table("histology_files", run.run_id)
    counts = {r["origin"]: (r["files"], r["rows"]) for r in files.groupBy("origin").agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).collect()}
    number = {o: counts.get(o, (0, 0))[0] for o in ("csv", "reply", "missing", "rejected")}
    if not number["csv"] + number["reply"]:
        raise FileNotFoundError("No report has a marker file or a reply.")
    store.append_run("histology_markers", compiled.rows.drop("origin"), run.run_id)
    total = sum(rows for _, rows in counts.values())
    missing = number["missing"] + number["rejected"]
    store.append_rows("histology_steps", _steps(run.run_id, number, missing, total), STEP_SCHEMA)
    # The commit: nothing reads the run before this row is there.
    row = (run.run_id, run.run_datetime, sum(number.values()), number["csv"], number["reply"], missing, total)
    store.append_rows("histology_runs", [row], RUN_SCHEMA)
    return run


def _steps(run_id: str, number: dict[str, int], missing: int, total: int) -> list[tuple]:
    mode = "llm_powered" if number["reply"] else "static_code"
    texts = sum(number.values())
    return [
        (run_id, 0, "read_text_reports", "Read report files", f"{texts} report(s) found", "completed", "static_code", f'{{"text_reports": {texts}}}'),
        (
            run_id, 1, "extract_marker_csvs", "Collect markers", f"{number['csv']} file(s), {number['reply']} repl(ies), {missing} without markers", "completed",
            mode, f'{{"source_csvs": {number["csv"]}, "source_replies": {number["reply"]}, "missing_reports": {missing}}}',
        ),
        (run_id, 2, "compile_histology_dataset", "Compile markers", f"{total} marker row(s)", "completed", "static_code", f'{{"total_rows": {total}}}'),
    ]


def latest_histology(store: Store) -> DataFrame:
    """The newest committed run: one row, or none."""
    runs = store.table("histology_runs", RUN_SCHEMA).withColumn("all", F.lit(1))
    return latest_per_key(runs, "all", ["run_datetime", "run_id"]).drop("all")


def histology_dataset(store: Store, run_id: str | None = None) -> DataFrame:
    """Marker rows of a committed run, the newest by default."""
    runs = latest_histology(store) if run_id is None else store.table("histology_runs", RUN_SCHEMA).where(F.col("run_id") == run_id)
    chosen = runs.first()
    if chosen is None:
        raise FileNotFoundError("No committed histology run.")
    return store.run_table("histology_markers", chosen["run_id"])
