"""Sources a run can ingest: where files lie, how they are read, their spec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.packaged_specs import packaged_spec
from .readers import list_files, read_generic_csv, read_registry_csv

# Where source files are looked for, relative to the workspace.
REGISTRY_GLOBS = ("data/raw/registry/main_sheet/*.csv",)
GENERIC_GLOBS = ("data/raw/imports/*.csv", "data/raw/uploads/*.csv", "data/raw/*.csv")


@dataclass(frozen=True)
class Source:
    """A registered input kind. Add one to ``SOURCES`` to extend the engine."""

    adapter_id: str
    globs: tuple[str, ...]
    read: Callable[[SparkSession, list[str]], DataFrame]
    default_spec: Callable[[], dict[str, Any]]
    publish_without_matches: bool = False

    def match_files(self, spark: SparkSession, root: str) -> list[str]:
        return list_files(spark, [f"{root}/{g}" for g in self.globs])


SOURCES: dict[str, Source] = {
    "gbm_registry": Source(
        "gbm_registry", REGISTRY_GLOBS, read_registry_csv, lambda: packaged_spec("gbm_registry")
    ),
    "generic_csv": Source(
        "generic_csv", GENERIC_GLOBS, read_generic_csv, lambda: packaged_spec("generic_csv"), True
    ),
}


def register_source(source: Source) -> None:
    SOURCES[source.adapter_id] = source


def get_source(adapter_id: str) -> Source:
    if adapter_id not in SOURCES:
        raise ValueError(f"Unknown ingestion adapter: {adapter_id}")
    return SOURCES[adapter_id]
