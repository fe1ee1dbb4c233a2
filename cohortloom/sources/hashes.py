"""File hashes, what changed since an earlier look, and the catalogue of a folder's data files.

Defined results: a folder without matching files gives empty tables. A file without rows is
listed with zero rows and no column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import FILE_NAME, data_file_catalogue, list_files, read_csv_set

HASHES = "path string, bytes bigint, modified timestamp, sha256 string"


def hash_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, bytes, modified, sha256) of each file, hashed where it is read."""
    if not paths:
        return spark.createDataFrame([], HASHES)
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status, sha256, previous_sha256) of files that are new, changed or removed. Files
    are told apart by content; a new date alone is no change."""
    old = previous.groupBy("path").agg(F.max_by("sha256", "modified").alias("previous_sha256"))
    both = current.select("path", "sha256").join(old, "path", "full")
    status = F.when(F.col("previous_sha256").isNull(), "new").when(F.col("sha256").isNull(), "removed").when(F.col("sha256") != F.col("previous_sha256"), "changed")
    return both.select("path", status.alias("status"), "sha256", "previous_sha256").where("status is not null")


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The files that an earlier look saw with the same content."""
    return current.join(previous.select("path", "sha256").distinct(), ["path", "sha256"], "left_semi")


def catalogue(spark: SparkSession, globs: Mapping[str, Sequence[str]], latest: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """(kind, name, path, sha256, rows, column_name, distinct_values, values, is_latest): a row
    per file and column of all CSV files that match a kind's globs.

    Every file is hashed and read once; a file that matches two kinds belongs to the first.
    Columns without a present value are left out, as is a file's column name if it has none.
    """
    kind_of: dict[str, str] = {}
    for kind, patterns in globs.items():
        for path in list_files(spark, list(patterns)):
            kind_of.setdefault(path, kind)
    schema = "path string, kind string, name string"
    paths = sorted(kind_of)
    listed = spark.createDataFrame([(p, kind_of[p], p.rsplit("/", 1)[-1]) for p in paths], schema)
    hashes = hash_files(spark, paths).select(_same_spelling("path").alias("_at"), "sha256")
    files = listed.withColumn("_at", _same_spelling("path")).join(hashes, "_at", "left").withColumn("is_latest", F.col("path").isin(*latest) if latest else F.lit(False))
    if not paths:
        kinds = {"column_name": "string", "distinct_values": "bigint", "values": "array<string>", "rows": "bigint"}
        return files.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()}).select(*_CATALOGUE)
    frame = read_csv_set(spark, paths, delimiter=None, encoding=None, with_path="_path")
    frame = frame.withColumn("_path", _same_spelling("_path")).drop(FILE_NAME)
    found = data_file_catalogue(frame, "_path", *([limit] if limit else []))
    return files.join(found.withColumnRenamed("file", "_at"), "_at", "left").select(
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) if c in ("rows", "distinct_values") else F.col(c) for c in _CATALOGUE]
    )


_CATALOGUE = ("kind", "name", "path", "sha256", "rows", "column_name", "distinct_values", "values", "is_latest")


def _same_spelling(column: str):
    """Paths without scheme slashes and escapes: readers and listings spell them apart."""
    return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), r"^(\w+:)/+", r"$1/")
