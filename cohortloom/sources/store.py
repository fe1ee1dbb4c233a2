"""Append-only run store: clean rows, reports, manifests, artifacts, specs.

Each kind is a Parquet table partitioned by run. A table "latest pointer" is the
newest row per key, found by query, so two runs never overwrite each other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.structure import publishable
from ..operators.summaries import latest_per_key
from .readers import list_files


@dataclass(frozen=True)
class RunContext:
    run_id: str
    run_datetime: str

    @classmethod
    def now(cls) -> RunContext:
        """Second-resolution time plus a suffix, so two quick runs stay apart."""
        current = datetime.now(ZoneInfo(fv.RUN_TIMEZONE))
        suffix = uuid.uuid4().hex[:6]
        return cls(f"{current:%Y%m%d_%H%M%S}_{suffix}", current.isoformat(timespec="seconds"))


_WRITE = "write_id"  # partition column of the folders that single writes made

RUN_SCHEMA = (
    "run_id string, run_datetime string, pipeline_version string, canonical_schema_version string, "
    "total_rows bigint, notes string"
)
STEP_SCHEMA = (
    "run_id string, ordinal int, step_id string, label string, summary string, status string, execution_mode string, "
    "source_file string, operation string, inputs array<string>, outputs array<string>, metrics string"
)
SPEC_SCHEMA = (
    "run_id string, run_datetime string, adapter_id string, source_file string, spec_id string, version string, "
    "label string, transient boolean, spec string"
)
SAVED_SPEC_SCHEMA = "adapter_id string, saved_at string, spec string"
ARTIFACT_SCHEMA = (
    "file_name string, script_id string, run_id string, manifest_run_id string, run_datetime string, title string, "
    "description string, category string, priority int, metadata string, cohort_display string, cohort string, "
    "visualization string, data string"
)


def quality_report_of(rows: DataFrame) -> DataFrame:
    """(patient_id, source_file, flags, flag_details) of stored kept rows."""
    patient = F.col("patient_id") if "patient_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        patient.cast("string").alias("patient_id"),
        F.col("_source_file").alias("source_file"),
        F.col("data_quality_flags").alias("flags"),
        F.col("_flag_details").alias("flag_details"),
    )


@dataclass(frozen=True)
class Store:
    """Tables of one workspace under a root folder on any shared file system."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return bool(
            list_files(self.spark, [f"{self.path(name)}/*.parquet", f"{self.path(name)}/*/*.parquet",
                                    f"{self.path(name)}/*/*/*.parquet"])
        )

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        if not self.exists(name):
            if schema is None:
                raise FileNotFoundError(f"No {name} table has been written.")
            return self.spark.createDataFrame([], schema)
        # Runs may differ in extra columns; the union of them is the table.
        return self.spark.read.option("mergeSchema", True).parquet(self.path(name)).drop(_WRITE)

    def committed(self, name: str) -> DataFrame:
        """Rows of finished runs. A run's row in `runs` is written last; without it the run broke
        off or is still going on."""
        return self.table(name).join(self.table("runs", RUN_SCHEMA).select("run_id").distinct(), "run_id", "left_semi")

    def append(self, name: str, df: DataFrame, *partitions: str) -> None:
        """Add rows in a folder of this write alone: a commit cleans its folder's unfinished files,
        which must not be those of another writer."""
        writer = df.write.mode("errorifexists")
        path = f"{self.path(name)}/{_WRITE}={uuid.uuid4().hex}"
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)

    def append_run(self, name: str, df: DataFrame, run_id: str, *partitions: str) -> None:
        """Rows of one run in a folder of its own, so writers at the same time never share one."""
        writer = df.drop("run_id").write.mode("errorifexists")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.path(name)}/run_id={run_id}")

    def run_table(self, name: str, run_id: str) -> DataFrame:
        """Rows that one run wrote."""
        return self.spark.read.parquet(f"{self.path(name)}/run_id={run_id}")

    def append_rows(self, name: str, rows: list[tuple], schema: str) -> None:
        """Manifest-sized rows (steps, specs, artifacts) from the driver."""
        if rows:
            self.append(name, self.spark.createDataFrame(rows, schema).coalesce(1))

    # ------------------------------------------------------------- clean rows

    def latest_run(self) -> dict[str, Any] | None:
        if not self.exists("runs"):
            return None
        row = self.table("runs").orderBy(F.col("run_datetime").desc(), F.col("run_id").desc()).first()
        return row.asDict() if row else None

    def clean(self, run_id: str | None = None) -> DataFrame:
        """Clean rows of one run (newest by default); the run filter prunes folders."""
        if run_id is None:
            latest = self.latest_run()
            if latest is None:
                raise FileNotFoundError("No clean dataset found. Run ingestion first.")
            run_id = latest["run_id"]
        elif not self.exists("runs") or not self.table("runs").where(F.col("run_id") == run_id).take(1):
            raise FileNotFoundError(f"Run {run_id} has not been committed.")
        folder = f"{self.path('rows')}/run_id={run_id}/kept=true"
        rows = self.spark.read.parquet(folder)
        extra = [c for c in rows.columns if c in ROW_EXTRAS or c.startswith("_m_")]
        return publishable(rows.drop(*extra))

    def quality_report(self, run_id: str) -> DataFrame:
        folder = f"{self.path('rows')}/run_id={run_id}/kept=true"
        rows = self.spark.read.option("mergeSchema", True).parquet(folder)
        return quality_report_of(rows)

    # ------------------------------------------------------------------ specs

    def save_spec(self, adapter_id: str, spec: dict[str, Any]) -> None:
        saved = {**{k: v for k, v in spec.items() if k != "transient"}, "adapter_id": adapter_id}
        now = datetime.now(ZoneInfo(fv.RUN_TIMEZONE)).isoformat()
        self.append_rows("saved_specs", [(adapter_id, now, json.dumps(saved))], SAVED_SPEC_SCHEMA)

    def saved_spec(self, adapter_id: str) -> dict[str, Any] | None:
        """Newest saved spec of an adapter; unreadable or foreign ones do not count."""
        rows = self.table("saved_specs", SAVED_SPEC_SCHEMA).filter(F.col("adapter_id") == adapter_id)
        row = latest_per_key(rows, "adapter_id", ["saved_at"]).first()
        if row is None:
            return None
        try:
            spec = json.loads(row["spec"])
        except ValueError:
            return None
        if not isinstance(spec, dict) or spec.get("adapter_id") not in (None, "", adapter_id):
            return None
        return spec

    # -------------------------------------------------------------- artifacts

    def save_artifact(self, artifact: dict[str, Any]) -> None:
        def text(key: str) -> str | None:
            return json.dumps(artifact[key], default=str) if artifact.get(key) is not None else None

        a = artifact
        self.append_rows(
            "artifacts",
            [
                (
                    f"{a['script_id']}_{a['run_id']}.json", a["script_id"], a["run_id"], a["manifest_run_id"],
                    a["run_datetime"], a["title"], a["description"], a["category"], a["priority"], text("metadata"),
                    a.get("cohort_display"), text("cohort"), text("visualization"), text("data"),
                )
            ],
            ARTIFACT_SCHEMA,
        )

    def latest_artifacts(self) -> DataFrame:
        return latest_per_key(self.table("artifacts", ARTIFACT_SCHEMA), "script_id", ["run_datetime", "run_id"])


# Bookkeeping columns stored with the rows but not part of the clean table.
ROW_EXTRAS = ("_source_file", "_flag_details", "_dropped_at", "_adapter")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row: null tokens as null, dates ISO, nested cells kept."""
    return publishable(df).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}).alias("value")
    )


def write_marker_dataset(df: DataFrame, path: str) -> None:
    """Long marker table as CSV when the name says so, else as JSON lines."""
    writer = df.write.mode("errorifexists")
    if path.lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
