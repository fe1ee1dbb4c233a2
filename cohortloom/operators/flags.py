"""Quality flags carried on the row itself.

Flags live in array columns, so they follow the row through every filter, join
and shuffle and never need a side table keyed by row number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import STRING, text_form

FLAGS = "_flags"
DETAILS = "_flag_details"
ROW_ID = "_row_id"
SOURCE_FILE = "_source_file"
SOURCE_STEM = "_source_stem"
WORK_COLUMNS = (FLAGS, DETAILS, ROW_ID, SOURCE_FILE, SOURCE_STEM)

DETAIL_TYPE = (
    "struct<flag:string,step_id:string,step_label:string,step_position:int,"
    "operation:string,field:string,source:string,output:string,raw_value:string,"
    "row_index:string,message:string,hint:string,"
    "context:array<struct<name:string,value:string>>>"
)


@dataclass(frozen=True)
class StepInfo:
    """Where a flag comes from."""

    step_id: str
    label: str
    position: int
    operation: str


@dataclass(frozen=True)
class Flag:
    condition: Column
    name: str
    source: str
    output: str
    raw: Column
    message: str
    hint: str
    raw_type: T.DataType = STRING
    context: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)


def start(df: DataFrame, source_file: Column, row_id: Column) -> DataFrame:
    return df.withColumns(
        {
            FLAGS: F.array().cast("array<string>"),
            DETAILS: F.array().cast(f"array<{DETAIL_TYPE}>"),
            ROW_ID: row_id.cast("string"),
            SOURCE_FILE: source_file,
            SOURCE_STEM: F.regexp_replace(F.coalesce(source_file, F.lit("")), r"\.[^.]*$", ""),
        }
    )


def _detail(flag: Flag, step: StepInfo) -> Column:
    context = (
        F.array(
            *[
                F.struct(F.lit(k).alias("name"), text_form(c, t).alias("value"))
                for k, (c, t) in flag.context.items()
            ]
        )
        if flag.context
        else F.lit(None).cast("array<struct<name:string,value:string>>")
    )
    return F.struct(
        F.lit(flag.name).alias("flag"),
        F.concat(F.col(SOURCE_STEM), F.lit(":" + step.step_id)).alias("step_id"),
        F.lit(step.label).alias("step_label"),
        F.lit(step.position).alias("step_position"),
        F.lit(step.operation).alias("operation"),
        F.lit(flag.output).alias("field"),
        F.lit(flag.source).alias("source"),
        F.lit(flag.output).alias("output"),
        text_form(flag.raw, flag.raw_type).alias("raw_value"),
        F.col(ROW_ID).alias("row_index"),
        F.lit(flag.message).alias("message"),
        F.lit(flag.hint).alias("hint"),
        context.alias("context"),
    )


def appended(flags: list[Flag], step: StepInfo) -> dict[str, Column]:
    """Column updates that append every flag whose condition holds."""
    names = F.array(*[F.when(f.condition, F.lit(f.name)) for f in flags])
    details = F.array(*[F.when(f.condition, _detail(f, step)) for f in flags])
    return {
        FLAGS: F.concat(F.col(FLAGS), F.array_compact(names)),
        DETAILS: F.concat(F.col(DETAILS), F.array_compact(details)),
    }


def unique_flags() -> Column:
    return F.filter(F.array_distinct(F.col(FLAGS)), lambda f: f != "")


def unique_details() -> Column:
    return F.array_distinct(F.col(DETAILS))
