"""Session helpers shared by operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where driver and tasks share a disk."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
            current = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
        context.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written under the checkpoint folder and read back; `discard` deletes them."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that `stored` returned, or of one made from it alone."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
