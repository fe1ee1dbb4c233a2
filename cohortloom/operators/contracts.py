"""Contract checks: a table against a list of fields with types and nullability.

Differences of the schema are a small table; violations of rows are counted in one scan and
listed from another, each row once per broken field.

Defined results: an empty table has schema differences but no row violations. A field that is
missing breaks no row. A value breaks its type when it has text that does not cast to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_missing, text_form


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # a Spark type name, such as "double" or "array<string>"
    nullable: bool = True
    allowed: tuple[str, ...] = ()

    @classmethod
    def of(cls, spec: Any) -> Field:
        """A field from a mapping as in contract files, or a field as it is."""
        if isinstance(spec, cls):
            return spec
        return cls(spec["name"], spec.get("type", "string"), bool(spec.get("nullable", True)), tuple(spec.get("allowed", ())))


DIFFERENCES = "field string, problem string, expected string, found string"


def _type(text: str) -> T.DataType:
    return T._parse_datatype_string(text)


def schema_differences(df: DataFrame, contract: Sequence[Any]) -> DataFrame:
    """(field, problem, expected, found): missing and extra fields, and other types."""
    fields = [Field.of(f) for f in contract]
    have = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for f in fields:
        if f.name not in have:
            rows.append((f.name, "missing", _type(f.type).simpleString(), None))
        elif have[f.name].simpleString() != _type(f.type).simpleString():
            rows.append((f.name, "type", _type(f.type).simpleString(), have[f.name].simpleString()))
    known = {f.name for f in fields}
    rows += [(name, "extra", None, kind.simpleString()) for name, kind in have.items() if name not in known]
    return df.sparkSession.createDataFrame(rows, DIFFERENCES)


def _problem(df: DataFrame, f: Field) -> Column:
    """The first rule of a field that a row breaks, or null."""
    cell, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
    wanted = _type(f.type)
    problem = F.lit(None).cast("string")
    if f.allowed:
        # A missing value is the business of `nullable`.
        problem = F.when(~is_missing(cell, kind) & ~text_form(cell, kind).isin(*f.allowed), "not_allowed")
    if kind != wanted and isinstance(wanted, T.AtomicType) and isinstance(kind, T.AtomicType):
        text = text_form(cell, kind)
        problem = F.when(text.isNotNull() & text.try_cast(wanted).isNull(), "type").otherwise(problem)
    if not f.nullable:
        problem = F.when(is_missing(cell, kind), "null").otherwise(problem)
    return problem


def _broken(df: DataFrame, contract: Sequence[Any]) -> list[tuple[Field, Column]]:
    return [(f, _problem(df, f)) for f in map(Field.of, contract) if f.name in df.columns]


def violations(df: DataFrame, contract: Sequence[Any], keys: Sequence[str]) -> DataFrame:
    """(keys..., field, problem, value): a row per broken cell, from one scan without a shuffle."""
    cells = [
        F.struct(F.lit(f.name).alias("field"), problem.alias("problem"), text_form(F.col(f"`{f.name}`"), df.schema[f.name].dataType).alias("value"))
        for f, problem in _broken(df, contract)
    ]
    named = [F.col(f"`{k}`") for k in keys]
    if not cells:
        return df.select(*named, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("value")).where("false")
    return df.select(*named, F.inline(F.array(*cells))).where("problem is not null")


def validate(df: DataFrame, contract: Sequence[Any]) -> DataFrame:
    """(field, problem, expected, found, rows): schema differences (rows null) and, for each
    broken rule, how many rows break it, counted in one scan."""
    spark = df.sparkSession
    checked = _broken(df, contract)
    counts = [F.count_if(problem == kind).alias(f"{kind}:{i}") for i, (_, problem) in enumerate(checked) for kind in ("null", "type", "not_allowed")]
    found = df.agg(*counts).first().asDict() if counts else {}
    rows = []
    for i, (f, _) in enumerate(checked):
        wanted = {"null": "not null", "type": _type(f.type).simpleString(), "not_allowed": ", ".join(f.allowed)}
        rows += [(f.name, f"row_{k}", wanted[k], None, found[f"{k}:{i}"]) for k in wanted if found[f"{k}:{i}"]]
    schema = schema_differences(df, contract).withColumn("rows", F.lit(None).cast("bigint"))
    return schema.unionByName(spark.createDataFrame(rows, f"{DIFFERENCES}, rows bigint"))
