"""Incremental ingestion: only files that arrived since the last run.

A batch run lists and reads the whole source folder. On a folder that only grows,
a file stream remembers what it has read, and each micro-batch goes through the
same compiled spec and the same append-only write as a batch run.

With a manifest folder every micro-batch also leaves its rows, quality report, file counts
and step counts, each in a folder of the batch's number, and last a row in ``batches`` that
commits them. A batch that runs again after a failure replaces all of them, so the union of
committed batches is what one batch run over all the files would publish (a flag's row number
counts the rows of its own batch).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import Workspace, active_spec, quality_report_of, row_table
from ..plans.spec import CompiledSpec, Environment, compile_spec
from ..sources.readers import FILE_NAME, inside, list_files, read_data_file, read_mapping

BATCHES = "raw_rows bigint, kept_rows bigint, flagged_rows bigint"
MANIFEST = ("report", "sources", "steps", "batches")


def _publish_batch(compiled: CompiledSpec, folder: str, batch_id: int) -> None:
    """Everything of one micro-batch; its commit comes last. The batch is read once."""
    spark = compiled.traced.sparkSession

    def put(name: str, df: DataFrame, *partitions: str) -> DataFrame:
        path = f"{folder}/{name}/batch={batch_id}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = put("rows", row_table(compiled), "kept")
    report = put("report", quality_report_of(rows.where("kept")))
    sources = put("sources", compiled.source_summary(rows))
    put("steps", compiled.step_metrics(rows))
    raw = sources.agg(F.sum("rows_raw")).first()[0] or 0
    kept = report.agg(F.count("*").alias("rows"), F.count_if(F.size("flags") > 0).alias("flagged")).first()
    put("batches", spark.createDataFrame([(raw, kept["rows"], kept["flagged"])], BATCHES))


def read_manifest(ws: Workspace, folder: str, name: str) -> DataFrame:
    """One of the manifest's tables, of committed batches only."""
    if name not in MANIFEST:
        raise ValueError(f"A manifest has {', '.join(MANIFEST)}.")
    done = {int(p.split("batch=")[1].split("/")[0]) for p in list_files(ws.spark, [f"{folder}/batches/*/_SUCCESS"])}
    if not done:
        raise FileNotFoundError("No batch has been committed.")
    table = ws.spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")
    return table.where(F.col("batch").isin(*sorted(done)))


def ingest_arrivals(
    ws: Workspace, adapter_id: str, folder: str, columns: list[str], table: str, checkpoint: str,
    spec: dict[str, Any] | None = None, max_files: int = 1000, manifest: str | None = None,
) -> StreamingQuery:
    """Process all files waiting in ``folder`` and stop; clean rows land in ``table``.

    Each micro-batch owns one ``batch`` partition and replaces it whole, so a
    batch that runs again after a failure leaves no duplicates.
    """
    chosen = active_spec(ws, adapter_id, spec)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    arriving = (
        ws.spark.readStream.schema(schema)
        .options(header=True, maxFilesPerTrigger=max_files)
        .csv(folder)
        .select("*", F.url_decode(F.col("_metadata.file_name")).alias(FILE_NAME))
    )
    env = Environment(
        adapter_id, ws.functions,
        load_file=lambda name: read_data_file(ws.spark, ws.root, name),
        load_mapping=lambda name: read_mapping(ws.spark, inside(ws.root, name)),
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        compiled = compile_spec(chosen, batch, env, F.col(FILE_NAME), drop_source_column=FILE_NAME)
        compiled.clean().write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if manifest:
            _publish_batch(compiled, manifest, batch_id)

    return (
        arriving.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
