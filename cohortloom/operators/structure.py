"""Column structure: rename, constants, final layout, required columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import is_nested, missing_to_null
from .flags import FLAGS, WORK_COLUMNS, Flag, unique_flags

CANONICAL = tuple(name for name, _ in fv.CANONICAL_FIELDS)


def data_columns(df: DataFrame) -> list[str]:
    """User columns, without the bookkeeping columns of a spec run."""
    return [c for c in df.columns if c not in WORK_COLUMNS and not c.startswith("_m_") and c != "_dropped_at"]


def rename_columns(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, int]:
    """Rename present columns; a target that is already taken keeps its owner.

    When two present sources claim one target the first in mapping order wins,
    so the result never has two columns of one name.
    """
    present, taken, accepted = set(df.columns), set(), {}
    for source, target in columns.items():
        target = str(target or "")
        if source not in present or not target or target in taken:
            continue
        if target in present and target != source:
            continue
        accepted[source] = target
        taken.add(target)
    return df.withColumnsRenamed(accepted), len(accepted)


def set_value(df: DataFrame, field: str, value: object) -> DataFrame:
    return df.withColumn(field, F.lit(value)) if field else df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def validate_required_columns(df: DataFrame, required: Iterable[str], strict: bool = False) -> DataFrame:
    missing = missing_columns(df, required)
    if missing and strict:
        raise KeyError(f"Missing required columns: {', '.join(missing)}")
    return df


def type_mismatches(df: DataFrame) -> tuple[dict[str, Column], list[Flag]]:
    """Casts of present canonical columns to contract types, with failure flags."""
    casts, flags = {}, []
    for name, wanted in fv.CANONICAL_FIELDS:
        if name not in df.columns or name == "data_quality_flags":
            continue
        dtype = df.schema[name].dataType
        if dtype.simpleString() == wanted:
            continue
        current = F.col(f"`{name}`")
        value = missing_to_null(current, dtype)
        if is_nested(dtype):
            cast = F.to_json(value) if wanted == "string" else F.lit(None).cast(wanted)
        elif (dtype.simpleString(), wanted) in {("boolean", "date"), ("double", "date"), ("int", "date"), ("bigint", "date")}:
            cast = F.lit(None).cast(wanted)
        else:
            cast = value.try_cast(wanted)
        casts[name] = cast
        flags.append(
            Flag(
                condition=value.isNotNull() & cast.isNull(),
                name=f"type_mismatch_{name}",
                source=name,
                output=name,
                raw=current,
                raw_type=dtype,
                message=f"{name} does not fit the published type {wanted}.",
                hint="Add a normalization step for this field.",
            )
        )
    return casts, flags


def finalize_output(
    df: DataFrame,
    drop_fields: Iterable[str] = (),
    canonical_fields_first: bool = True,
    add_missing_canonical_fields: bool = True,
    canonical_only: bool = False,
) -> DataFrame:
    """Lay out the published columns; bookkeeping columns ride along at the end."""
    if FLAGS in df.columns:
        df = df.withColumn("data_quality_flags", unique_flags())
    if add_missing_canonical_fields:
        absent = {n: F.lit(None).cast(t) for n, t in fv.CANONICAL_FIELDS if n not in df.columns}
        if absent:
            df = df.withColumns(absent)
    dropped = set(drop_fields)
    keep = [c for c in data_columns(df) if c not in dropped]
    if canonical_only:
        keep = [c for c in CANONICAL if c in keep]
    elif canonical_fields_first:
        keep = [c for c in CANONICAL if c in keep] + [c for c in keep if c not in CANONICAL]
    work = [c for c in df.columns if c not in set(data_columns(df))]
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *work]])


def publishable(df: DataFrame) -> DataFrame:
    """Null every null token in every column, nested cells included."""
    return df.select(
        *[
            missing_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union by column name, absent cells null.

    A column whose type differs between frames takes its contract type, or text
    when it has none.
    """
    contract = dict(fv.CANONICAL_FIELDS)
    types: dict[str, set[str]] = {}
    for frame in frames:
        for f in frame.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {n: contract.get(n, "string") for n, t in types.items() if len(t) > 1}

    def aligned(frame: DataFrame) -> DataFrame:
        casts = {
            n: F.col(f"`{n}`").try_cast(t)
            for n, t in mixed.items()
            if n in frame.columns and frame.schema[n].dataType.simpleString() != t
        }
        return frame.withColumns(casts) if casts else frame

    frames = [aligned(f) for f in frames]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
