"""Ingestion runs: read sources, apply their specs, publish, keep the manifest."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import profile as prof
from ..operators.flags import DETAILS, SOURCE_FILE, WORK_COLUMNS, unique_details
from ..operators.structure import union_by_name
from ..operators.summaries import run_summary
from ..sources import adapters
from ..sources.readers import FILE_NAME, inside, list_files, read_data_file, read_mapping
from ..sources.store import RUN_SCHEMA, SPEC_SCHEMA, STEP_SCHEMA, RunContext, Store, quality_report_of
from .registry_functions import FunctionRegistry, default_registry
from .spec import DROPPED, CompiledSpec, Environment, compile_spec, quality_report


@dataclass(frozen=True)
class Workspace:
    """Where sources lie, where results go, and which functions specs may call."""

    spark: SparkSession
    root: str
    functions: FunctionRegistry
    output: str

    @classmethod
    def at(cls, spark: SparkSession, root: str, functions: FunctionRegistry | None = None) -> Workspace:
        return cls(spark, root.rstrip("/"), functions or default_registry(), f"{root.rstrip('/')}/outputs")

    @property
    def store(self) -> Store:
        return Store(self.spark, self.output)


def default_spec(ws: Workspace, adapter_id: str) -> tuple[dict[str, Any], str]:
    """(spec, "saved" or "packaged") of an adapter."""
    saved = ws.store.saved_spec(adapter_id)
    if saved is not None:
        return {**saved, "adapter_id": adapter_id}, "saved"
    return adapters.get_source(adapter_id).default_spec(), "packaged"


def active_spec(ws: Workspace, adapter_id: str, spec: dict[str, Any] | None) -> dict[str, Any]:
    active = copy.deepcopy(spec) if spec is not None else default_spec(ws, adapter_id)[0]
    if not isinstance(active, dict):
        raise ValueError("Ingestion spec must be a JSON object.")
    owner = active.get("adapter_id")
    if owner and owner != adapter_id:
        raise ValueError(f"Spec adapter_id {owner} does not match adapter {adapter_id}.")
    return {**active, "adapter_id": adapter_id}


def _files(ws: Workspace, adapter_id: str, source_file: str | None) -> list[str]:
    if source_file is None:
        return adapters.get_source(adapter_id).match_files(ws.spark, ws.root)
    found = list_files(ws.spark, [inside(ws.root, source_file)])
    if not found:
        raise FileNotFoundError(f"Source file does not exist: {source_file}")
    return found


def compile_source(
    ws: Workspace, adapter_id: str, files: list[str], spec: dict[str, Any]
) -> tuple[DataFrame, CompiledSpec]:
    """All files of one adapter as one plan; the file name rides on each row."""
    raw = adapters.get_source(adapter_id).read(ws.spark, files)
    env = Environment(
        adapter_id,
        ws.functions,
        load_file=lambda name: read_data_file(ws.spark, ws.root, name),
        load_mapping=lambda name: read_mapping(ws.spark, inside(ws.root, name)),
    )
    # The reader's file name moves to the bookkeeping column before step one.
    compiled = compile_spec(
        spec, raw, env, source_file=F.col(FILE_NAME), drop_source_column=FILE_NAME
    )
    return raw.drop(FILE_NAME), compiled


@dataclass(frozen=True)
class Preview:
    source_profile: prof.Profile
    transformed_profile: prof.Profile
    summary: DataFrame
    steps: list[dict[str, Any]]
    step_metrics: DataFrame
    quality_report: DataFrame
    rows: DataFrame


def preview(
    ws: Workspace, adapter_id: str, source_file: str | None = None,
    spec: dict[str, Any] | None = None, row_limit: int = fv.PREVIEW_ROWS,
) -> Preview:
    """Apply a spec without writing: profiles before and after, counts, first rows."""
    files = _files(ws, adapter_id, source_file)
    if not files:
        raise FileNotFoundError(f"No source files found for adapter {adapter_id}.")
    if source_file is None:
        files = files[:1]
    raw, compiled = compile_source(ws, adapter_id, files, active_spec(ws, adapter_id, spec))
    clean = compiled.clean()
    return Preview(
        prof.profile(raw, "workbench"),
        prof.profile(clean, "workbench"),
        compiled.source_summary(),
        _step_facts(compiled),
        compiled.step_metrics(),
        compiled.quality_report().limit(row_limit),
        clean.limit(row_limit),
    )


def _step_facts(compiled: CompiledSpec) -> list[dict[str, Any]]:
    return [
        {
            "position": s.position, "step_id": s.step_id, "label": s.label, "description": s.description,
            "inputs": s.inputs, "outputs": s.outputs, "metrics": compiled.facts[s.position],
        }
        for s in compiled.steps
    ]


def row_table(compiled: CompiledSpec) -> DataFrame:
    """Every row as it is stored: published columns, report columns, drop mark."""
    traced = compiled.traced
    details = unique_details().alias(DETAILS)
    keep = [c for c in traced.columns if c not in WORK_COLUMNS]
    return traced.select(
        *[F.col(f"`{c}`") for c in keep], F.col(SOURCE_FILE), details,
        F.col(DROPPED).isNull().alias("kept"),
    )


def run_ingestion(
    ws: Workspace, adapter_id: str | None = None, source_file: str | None = None, spec: dict[str, Any] | None = None,
) -> RunContext:
    """Ingest one adapter or all of them and append the run to the store.

    The raw files are scanned once: kept and dropped rows land together in one
    write, split by the partition column ``kept``. The report and every count
    are then pruned reads of what was written, so a lost executor can neither
    double nor miss a count.
    """
    run = RunContext.now()
    store = ws.store
    compiled_by_adapter: dict[str, tuple[list[str], CompiledSpec]] = {}
    for name in [adapter_id] if adapter_id else sorted(adapters.SOURCES):
        chosen = active_spec(ws, name, spec)
        files = _files(ws, name, source_file)
        if files:
            compiled_by_adapter[name] = (files, compile_source(ws, name, files, chosen)[1])
    if not compiled_by_adapter:
        raise FileNotFoundError("No source files were found for the selected ingestion adapters")

    tables = [
        row_table(c).withColumn("_adapter", F.lit(name)) for name, (_, c) in compiled_by_adapter.items()
    ]
    store.append_run("rows", union_by_name(tables), run.run_id, "kept")

    written = ws.spark.read.parquet(f"{store.path('rows')}/run_id={run.run_id}")
    sources, metrics = [], []
    for name, (_, compiled) in compiled_by_adapter.items():
        mine = written.filter(F.col("_adapter") == name)
        sources.append(compiled.source_summary(mine))
        metrics.append(compiled.step_metrics(mine).withColumn("adapter", F.lit(name)))
    source_table = _every_source(ws, compiled_by_adapter, union_by_name(sources))
    store.append("run_sources", source_table.withColumn("run_id", F.lit(run.run_id)))
    stored_sources = store.table("run_sources").filter(F.col("run_id") == run.run_id)
    totals = run_summary(stored_sources, store.quality_report(run.run_id)).first().asDict()

    counts: dict[tuple[str, str, int], dict[str, int]] = {}
    for row in union_by_name(metrics).collect():
        # One row per file, step and counter: manifest-sized.
        key = (row["adapter"], row["source_file"], row["step_position"])
        counts.setdefault(key, {})[row["metric"]] = row["value"]
    steps = _manifest_steps(run, totals, [r.asDict() for r in stored_sources.collect()], compiled_by_adapter, counts)
    store.append_rows("run_steps", steps, STEP_SCHEMA)
    store.append_rows("run_specs", _spec_rows(run, compiled_by_adapter), SPEC_SCHEMA)
    store.append_rows(
        "runs",
        [(run.run_id, run.run_datetime, fv.PIPELINE_VERSION, fv.CANONICAL_VERSION, totals["ingested_rows"], "")],
        RUN_SCHEMA,
    )
    return run


def _every_source(ws: Workspace, compiled: dict[str, tuple[list[str], CompiledSpec]], found: DataFrame) -> DataFrame:
    """A row for every file that was read; a file without rows has zero counts."""
    listed = [
        (name, _file_name(path), c.spec.get("spec_id"), str(c.spec["version"]) if c.spec.get("version") is not None else None)
        for name, (paths, c) in compiled.items()
        for path in paths
    ]
    files = ws.spark.createDataFrame(listed, "adapter string, file string, spec_id string, spec_version string")
    counts = found.drop("spec_id", "spec_version")
    return files.join(counts, ["adapter", "file"], "left").na.fill(0, ["rows_raw", "rows_stub", "rows_ingested"]).select(found.columns)


def run_and_save(ws: Workspace, adapter_id: str, source_file: str | None, spec: dict[str, Any]) -> RunContext:
    """Run a spec and keep it as the adapter's default."""
    chosen = {**active_spec(ws, adapter_id, spec), "transient": True}
    run = run_ingestion(ws, adapter_id, source_file, chosen)
    ws.store.save_spec(adapter_id, chosen)
    return run


def _file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _spec_rows(run: RunContext, compiled: dict[str, tuple[list[str], CompiledSpec]]) -> list[tuple]:
    rows = []
    for name, (files, c) in compiled.items():
        for path in files:
            s = c.spec
            rows.append(
                (
                    run.run_id, run.run_datetime, name, _file_name(path), s.get("spec_id"), s.get("version"),
                    s.get("label"), bool(s.get("transient", False)), json.dumps(s),
                )
            )
    return rows


def _manifest_steps(run, totals, sources, compiled, counts) -> list[tuple]:
    """Run steps in order: read, normalize, each spec step per file, validate, write."""
    rows: list[tuple] = []

    def add(step_id, label, summary, operation=None, source_file=None, inputs=(), outputs=(), metrics=None):
        rows.append(
            (
                run.run_id, len(rows), step_id, label, summary, "completed", "static_code", source_file,
                operation, list(inputs), list(outputs), json.dumps(metrics or {}),
            )
        )

    files = [s["file"] for s in sources]
    add(
        "read_sources", "Read source files", f"{totals['source_files']} file(s), {totals['raw_rows']} raw row(s)",
        inputs=files, outputs=["raw rows"], metrics={k: totals[k] for k in ("source_files", "raw_rows")},
    )
    add(
        "normalize", "Normalize to canonical schema",
        f"Adapter: {totals['adapters'] or 'unknown'} | schema {fv.CANONICAL_VERSION}",
        inputs=["raw rows"], outputs=["canonical records"], metrics={"canonical_schema_version": fv.CANONICAL_VERSION},
    )
    for name, (paths, c) in compiled.items():
        for path in paths:
            file = _file_name(path)
            stem = file.rsplit(".", 1)[0]
            for s in c.steps:
                found = counts.get((name, file, s.position), {})
                metrics = {**c.facts[s.position], **found}
                summary = s.description or step_summary(s.operation, metrics)
                add(f"{stem}:{s.step_id}", s.label, summary, s.operation, file, s.inputs, s.outputs, metrics)
    add(
        "validate_quality", "Validate and flag rows",
        f"{totals['stub_rows']} stub row(s) skipped | {totals['flagged_records']} flagged record(s)",
        inputs=["canonical records"], outputs=["quality report"],
        metrics={k: totals[k] for k in ("stub_rows", "flagged_records", "quality_flags")},
    )
    add(
        "write_outputs", "Write result files", f"{totals['ingested_rows']} canonical row(s)",
        inputs=["canonical records", "quality report"], outputs=["clean dataset", "quality report"],
        metrics={"ingested_rows": totals["ingested_rows"]},
    )
    return rows


def step_summary(operation: str, metrics: dict[str, Any]) -> str:
    if operation == "filter_rows":
        kept = metrics.get("remaining_rows", 0)
        return f"{metrics['filter_description']} Retained {kept} of {kept + metrics.get('filtered_rows', 0)} row(s)."
    if operation == "remove_stub_rows":
        gone = metrics.get("filtered_rows", 0)
        return f"Removed {gone} stub row(s) from {gone + metrics.get('remaining_rows', 0)} row(s)."
    if operation in ("static_code", "custom_python"):
        return f"Ran allow-listed function {metrics.get('function')}."
    return f"Applied {operation.replace('_', ' ')}."


__all__ = [
    "Preview", "Workspace", "active_spec", "compile_source", "default_spec", "preview", "quality_report", "quality_report_of",
    "row_table", "run_and_save", "run_ingestion",
]
