"""Run-scoped tables in the shared folder; they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the rows under `spark.checkpoint.dir` and read them back with the same schema.
    The shuffle files of the write go when it ends; nothing reads them again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that `store` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_column(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever other columns the table has."""
    return docs.select(docs["doc_id"].cast(T.LongType()).alias("doc_id"), docs["text"].cast(T.StringType()).alias("text"))
