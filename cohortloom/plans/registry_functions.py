"""Named table functions that specs may call, allow-listed per adapter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.normalize import staged

TableFunction = Callable[[DataFrame, dict[str, Any]], DataFrame]


def _names(params: dict[str, Any], inputs: list[str], outputs: list[str]) -> tuple[str, list[str]]:
    source = str((params.get("inputs") or inputs)[0])
    return source, [str(o) for o in (params.get("outputs") or outputs or [source])]


def _single(build, default_in: str, default_out: str) -> TableFunction:
    def run(df: DataFrame, params: dict[str, Any]) -> DataFrame:
        source, outputs = _names(params, [default_in], [default_out])
        if source not in df.columns:
            return df
        return df.withColumn(outputs[0], build(F.col(f"`{source}`"), df.schema[source].dataType))

    return run


def flag_presence(yes: str, no: str, default_in: str, default_out: str) -> TableFunction:
    return _single(lambda c, t: S.presence_label(c, t, yes, no), default_in, default_out)


def split_local(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    source, outputs = _names(params, ["qmc_local_raw"], ["qmc_local", "referring_centre"])
    if source not in df.columns:
        return df
    is_local, centre = S.local_centre(F.col(f"`{source}`"), df.schema[source].dataType)
    return df.withColumns({outputs[0]: is_local, outputs[1]: centre})


def recurrence_type(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    source, outputs = _names(params, ["first_recurrence_evidence"], ["recurrence_type"])
    if source not in df.columns:
        return df
    df, (date,), (text,), helpers = staged(df, [(source, "date")])
    return df.withColumn(outputs[0], S.recurrence_kind(text, date)).drop(*helpers)


BUILTIN: dict[str, TableFunction] = {
    "normalize_histo_report": _single(S.report_status, "histo_report", "histo_report"),
    "split_qmc_local": split_local,
    "derive_resection_type": flag_presence("Resection", "Biopsy/None", "resection_date", "resection_type"),
    "derive_recurrence_type": recurrence_type,
}


@dataclass
class FunctionRegistry:
    """Explicit allow-list: adapter id -> function id -> table function."""

    allowed: dict[str, dict[str, TableFunction]] = field(default_factory=dict)

    def register(self, adapter_id: str, function_id: str, function: TableFunction) -> None:
        self.allowed.setdefault(adapter_id, {})[function_id] = function

    def resolve(self, adapter_id: str, function_id: str) -> TableFunction:
        function = self.allowed.get(adapter_id, {}).get(function_id)
        if function is None:
            raise ValueError(f"Adapter {adapter_id} does not allow custom operation {function_id}.")
        return function

    def builtin(self, name: str) -> TableFunction:
        return BUILTIN[name]


def default_registry() -> FunctionRegistry:
    registry = FunctionRegistry()
    for name, function in BUILTIN.items():
        registry.register("gbm_registry", f"gbm_registry.{name}", function)
    return registry
