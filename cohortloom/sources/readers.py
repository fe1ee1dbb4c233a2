"""Readers for registry inputs: CSV sets, JSON documents, marker files, text reports."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.scalars import entity_key, is_missing, strip, text_form
from ..operators.structure import union_by_name

FILE_NAME = "_file_name"
_DELIMITERS = ",;\t|"
_HEAD_LINES = 5


def list_files(spark: SparkSession, patterns: list[str], suffix: str = "") -> list[str]:
    """Sorted, distinct paths matching glob patterns on any Hadoop file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for pattern in patterns:
        path = hadoop.Path(pattern)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            name = status.getPath().toString()
            if status.isFile() and name.endswith(suffix):
                found.add(name)
    return sorted(found)


def sniff_delimiter(lines: list[str]) -> str:
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=_DELIMITERS).delimiter
    except csv.Error:
        return ","


def _columns(header: str, delimiter: str) -> tuple[str, ...]:
    """Header names; a repeated or empty name gets a suffix so columns stay distinct."""
    names, seen = [], set()
    for i, raw in enumerate(next(csv.reader([header.lstrip("﻿")], delimiter=delimiter), [])):
        name = raw or f"Unnamed: {i}"
        base, n = name, 1
        while name in seen:
            name, n = f"{base}.{n}", n + 1
        seen.add(name)
        names.append(name)
    return tuple(names)


@dataclass(frozen=True)
class FileFacts:
    """What a file's layout depends on: its first lines as bytes, and two facts of all lines."""

    head: tuple[bytes, ...] = ()
    utf8: bool = True
    broken_lines: bool = False


def _plain_path(path: str) -> str:
    """One spelling of a path: Spark's metadata and Hadoop write schemes and blanks apart."""
    return re.sub(r"^(\w+:)/+", r"\1/", unquote(path))


def file_facts(spark: SparkSession, paths: list[str]) -> dict[str, FileFacts]:
    """Facts of all files from two jobs, however many there are; a few lines a file come back."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken")
    )
    order = Window.partitionBy("path").orderBy("at")
    heads = (
        lines.where("block = 0")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("line", F.row_number().over(order))
        .where(F.col("line") <= _HEAD_LINES)
        .select("path", "line", F.col("value").cast("binary").alias("value"))
    )
    first: dict[str, dict[int, bytes]] = {}
    for row in heads.collect():
        first.setdefault(row["path"], {})[row["line"]] = bytes(row["value"])
    found: dict[str, FileFacts] = {}
    for r in facts.collect():
        own = FileFacts(tuple(v for _, v in sorted(first.get(r["path"], {}).items())), r["utf8"], r["broken"])
        # A path without a scheme lies on the default file system.
        found.setdefault(unquote(urlparse(r["path"]).path), own)
        found[_plain_path(r["path"])] = own
    return {path: found.get(_plain_path(path), FileFacts()) for path in paths}


def read_csv_set(
    spark: SparkSession, paths: list[str], delimiter: str | None = ",", encoding: str | None = "UTF-8",
    trim_names: bool = False, with_path: str | None = None,
) -> DataFrame:
    """Union of CSV files by column name, every cell as text, plus the file name (and path).

    Files that share a layout are one scan, which Spark may split unless some cell holds a
    line break. ``delimiter=None`` sniffs it from the first lines; ``encoding=None`` tries
    UTF-8 and falls back to Latin-1.
    """
    groups: dict[tuple, list[str]] = {}
    for path, facts in file_facts(spark, paths).items():
        coding = encoding or ("UTF-8" if facts.utf8 else "ISO-8859-1")
        lines = [line.decode(coding, "replace") for line in facts.head]
        sep = delimiter or sniff_delimiter(lines)
        names = _columns(lines[0] if lines else "", sep)
        names = tuple(n.strip() for n in names) if trim_names else names
        groups.setdefault((names, sep, coding, facts.broken_lines), []).append(path)
    frames = []
    for (columns, sep, coding, broken), members in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        frame = (
            spark.read.schema(schema)
            .options(header=True, sep=sep, encoding=coding, multiLine=broken, escape='"', enforceSchema=True)
            .csv(members)
        )
        path = [F.col("_metadata.file_path").alias(with_path)] if with_path else []
        frames.append(frame.select("*", F.url_decode(F.col("_metadata.file_name")).alias(FILE_NAME), *path))
    return union_by_name(frames)


def read_registry_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_csv_set(spark, paths)


def read_generic_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Unknown delimiter and encoding; blank cells stay empty text."""
    frame = read_csv_set(spark, paths, delimiter=None, encoding=None)
    blanks = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in frame.columns if c != FILE_NAME}
    return frame.withColumns(blanks)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) rows of a JSON mapping: one object per line, or one object over many lines.

    Lines are parsed where they are split to; only a file whose first line is no whole object
    is read as one text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    pairs = F.from_json("value", "map<string,string>")
    first = lines.select(pairs.isNotNull().alias("whole")).first()
    text = lines if first is None or first["whole"] else spark.read.text(path, wholetext=True)
    return text.select(F.explode(pairs).alias("key", "value"))


def inside(root: str, path: str) -> str:
    """Resolve ``path`` under the workspace ``root``; anything outside is an error."""
    joined = PurePosixPath(path) if path.startswith("/") or "://" in path else PurePosixPath(root) / path
    parts: list[str] = []
    for part in joined.parts:
        if part == "..":
            if not parts:
                break
            parts.pop()
        elif part != ".":
            parts.append(part)
    resolved = str(PurePosixPath(*parts)) if parts else ""
    base = str(PurePosixPath(root))
    if resolved != base and not resolved.startswith(base + "/"):
        raise ValueError("Join data file must be inside the workspace.")
    return resolved


def read_data_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """A join input: CSV, JSON (records, array or one object), or a published table."""
    full = inside(root, path)
    suffix = PurePosixPath(full).suffix.lower()
    if not list_files(spark, [full]) and not list_files(spark, [full + "/*"]):
        raise FileNotFoundError(f"Join data file does not exist: {path}")
    if suffix == ".csv":
        df = spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"').csv(full)
    elif suffix == ".json":
        df = spark.read.json(full, multiLine=True)
        field = df.schema["records"].dataType if "records" in df.columns else None
        if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.StructType):
            df = df.select(F.posexplode("records").alias("_row_order", "r")).select("r.*", "_row_order")
            return df
    elif suffix in (".parquet", ""):
        # The place of a row in its file, which every read finds again.
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return spark.read.parquet(full).select("*", place.alias("_row_order"))
    else:
        raise ValueError(f"Unsupported join data file type: {suffix}")
    return df.withColumn("_row_order", F.monotonically_increasing_id())


MARKER_COLUMNS = ("k_number", "marker", "value", "notes")


def read_marker_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(marker rows, rejected files): one CSV per report, entity key in its name."""
    keyed = read_marker_rows(spark, paths)
    rejects = keyed.filter("k_number is null").select("file_name").distinct()
    rows = keyed.filter("k_number is not null").select(*MARKER_COLUMNS)
    return rows, rejects.withColumn("reason", F.lit("No entity key in the file name."))


def read_marker_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(k_number, marker, value, notes, file_name) of marker CSVs; no key in the name is null."""
    frame = read_csv_set(spark, paths, trim_names=True)
    if "notes" not in frame.columns:
        frame = frame.withColumn("notes", F.lit(""))
    missing = sorted({"marker", "value"} - set(frame.columns))
    if missing:
        raise ValueError(f"Marker files are missing required columns: {', '.join(missing)}")
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in MARKER_COLUMNS[1:]]
    return frame.select(entity_key(F.col(FILE_NAME)).alias("k_number"), *cells, F.col(FILE_NAME).alias("file_name"))


def read_text_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, k_number, text): one row per report, whole text."""
    reports = spark.read.text(paths, wholetext=True).select(
        F.url_decode(F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("text")
    )
    return reports.withColumn("k_number", entity_key(F.col("file_name")))


# One reply line per CSV record: a line break inside quotes is content.
_RECORD_BREAK = r'\r?\n(?=(?:[^"]*"[^"]*")*[^"]*$)'
# A field after its comma: quoted with doubled quotes inside, or plain.
_FIELD = r',("(?:[^"]|"")*"|[^,]*)'


def parse_marker_replies(replies: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(marker rows, rejects) from free-text replies that should hold a marker CSV.

    A code fence is cut away, a missing header is supplied, and the five markers
    must appear once each in order. Failures land in the rejects with a reason.
    """
    fenced = F.regexp_extract(F.col(text), r"(?is)```(?:csv)?\s*(.*?)```", 1)
    has_fence = F.col(text).rlike(r"(?is)```(?:csv)?\s*(.*?)```")
    body = strip(F.when(has_fence, fenced).otherwise(F.col(text)))
    first = F.lower(strip(F.substring_index(body, "\n", 1)))
    headed = F.when(F.startswith(first, F.lit("marker,value")), body).otherwise(
        F.concat(F.lit("marker,value,notes\n"), body)
    )
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col("line")), F.lit(_FIELD), F.lit(1))
    record = F.transform(
        found,
        lambda f: F.when(
            F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(f),
    )
    lines = replies.select(F.col(key).alias("key"), body.alias("body"), headed.alias("headed")).select(
        "key", "body", F.split("headed", _RECORD_BREAK).alias("lines")
    )
    header = (
        lines.select("key", "body", "lines", F.get("lines", F.lit(0)).alias("line"))
        .withColumn("h", record)
    )
    cells = F.filter(F.expr("slice(lines, 2, size(lines))"), lambda v: strip(v) != "")
    rows = header.select("key", "body", "h", F.posexplode_outer(cells).alias("position", "line")).withColumn("r", record)
    at_notes = F.array_position("h", "notes")
    values = F.col("r")

    def cell(c):
        return F.coalesce(strip(c), F.lit(""))

    parsed = rows.select(
        "key", "body", "h", "position",
        cell(F.get(values, F.lit(0))).alias("marker"),
        cell(F.get(values, F.lit(1))).alias("value"),
        F.when(at_notes > 0, cell(F.get(values, at_notes.cast("int") - 1))).otherwise("").alias("notes"),
    )
    item = F.struct("position", "marker", "value", "notes")
    # One reply is one record: its few marker rows meet here, never several replies.
    whole = parsed.groupBy("key").agg(
        F.first("body").alias("body"), F.first("h").alias("h"), F.array_sort(F.collect_list(item)).alias("items")
    )
    expected = F.array(*[F.lit(m) for m in fv.MARKER_ORDER])
    head_ok = (strip(F.get("h", F.lit(0))) == "marker") & (strip(F.get("h", F.lit(1))) == "value")
    reason = (
        F.when(F.coalesce(F.col("body"), F.lit("")) == "", "The reply is empty.")
        .when(~F.coalesce(head_ok, F.lit(False)), "The reply is missing required columns: marker, value.")
        .when(
            ~F.coalesce(F.transform("items", lambda r: r["marker"]) == expected, F.lit(False)),
            "The reply does not hold the required markers in order.",
        )
    )
    checked = whole.withColumn("reason", reason)
    good = checked.filter("reason is null").select(F.col("key").alias("k_number"), F.inline("items"))
    return (
        good.select("k_number", "position", "marker", "value", "notes"),
        checked.filter("reason is not null").select(F.col("key").alias("k_number"), "reason"),
    )


def data_file_catalogue(df: DataFrame, file_column: str, limit: int = fv.DATA_FILE_VALUE_LIMIT) -> DataFrame:
    """(file, rows, column_name, distinct_values, values): per file and column, the
    first ``limit`` distinct values in text order.

    The rank limit is applied before the shuffle, so a file or column with
    millions of values sends at most ``limit`` of them per task.
    """
    names = [c for c in df.columns if c != file_column]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.when(
                    ~is_missing(F.col(f"`{c}`"), df.schema[c].dataType),
                    text_form(F.col(f"`{c}`"), df.schema[c].dataType),
                ).alias("value"),
            )
            for c in names
        ]
    )
    rows = df.groupBy(F.col(file_column).alias("file")).agg(F.count("*").alias("rows"))
    distinct = (
        df.select(F.col(file_column).alias("file"), F.inline(cells)).filter("value is not null").distinct()
    )
    counts = distinct.groupBy("file", "column_name").agg(F.count("*").alias("distinct_values"))
    order = Window.partitionBy("file", "column_name").orderBy("value")
    listed = (
        distinct.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= limit)
        .groupBy("file", "column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )
    # A file without a present cell keeps its row count, with no column.
    return rows.join(counts.join(listed, ["file", "column_name"]), "file", "left").select(
        "file", "column_name", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "values", "rows"
    )
