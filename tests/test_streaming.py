"""Newly arrived files go through the same spec once."""

import json

from pyspark.sql import functions as F

from cohortloom.plans import ingest
from cohortloom.streaming.arrivals import _publish_batch, ingest_arrivals, read_manifest


def test_only_new_files_are_ingested(spark, tmp_path):
    folder = tmp_path / "data/raw/imports"
    folder.mkdir(parents=True)
    ws = ingest.Workspace.at(spark, str(tmp_path))
    spec = {"adapter_id": "generic_csv", "steps": [
        {"operation": "filter_rows", "params": {"action": "drop", "conditions": [{"field": "score", "operator": "is_missing"}]}},
        {"operation": "normalize_fields", "params": {"fields": ["score"], "type": "number", "on_invalid": "flag"}}]}

    def arrive(name, text):
        (folder / name).write_text(text)
        query = ingest_arrivals(ws, "generic_csv", str(folder), ["id", "score"], str(tmp_path / "clean"), str(tmp_path / "state"), spec)
        query.awaitTermination(90)
        assert query.exception() is None
        return sorted((r["id"], r["score"], json.dumps(r["data_quality_flags"])) for r in spark.read.parquet(str(tmp_path / "clean")).collect())

    first = arrive("a.csv", "id,score\nA,1.5\nB,n/a\n")
    assert first == [("A", 1.5, "[]")]
    second = arrive("b.csv", "id,score\nC,2\n")
    assert second == [("A", 1.5, "[]"), ("C", 2.0, "[]")]


def test_batches_add_up_to_one_run(spark, tmp_path):
    folder = tmp_path / "data/raw/imports"
    folder.mkdir(parents=True)
    ws = ingest.Workspace.at(spark, str(tmp_path))
    spec = {"adapter_id": "generic_csv", "spec_id": "s", "version": 1, "steps": [
        {"operation": "filter_rows", "params": {"action": "drop", "conditions": [{"field": "score", "operator": "is_missing"}]}},
        {"operation": "normalize_fields", "params": {"fields": ["score"], "type": "number", "on_invalid": "flag"}}]}
    manifest = str(tmp_path / "manifest")

    def arrive(name, text):
        (folder / name).write_text(text)
        query = ingest_arrivals(ws, "generic_csv", str(folder), ["id", "score"], str(tmp_path / "clean"), str(tmp_path / "state"), spec, manifest=manifest)
        query.awaitTermination(90)
        assert query.exception() is None

    arrive("a.csv", "id,score\nA,1.5\nB,n/a\nC,odd\n")
    arrive("b.csv", "id,score\nD,2\nE,strange\n")
    # A batch that broke off: rows and report, but no commit.
    broken = spark.read.parquet(f"{manifest}/report/batch=0")
    broken.write.parquet(f"{manifest}/report/batch=7")
    run = ingest.run_ingestion(ws, "generic_csv", spec=spec)
    rows = lambda df, *names: sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    report = ("source_file", "flags", F.expr("transform(flag_details, d -> struct(d.flag, d.step_id, d.field, d.raw_value, d.message, d.hint))"))
    assert rows(read_manifest(ws, manifest, "report"), *report) == rows(ws.store.quality_report(run.run_id), *report)
    files = ("adapter", "file", "rows_raw", "rows_stub", "rows_ingested")
    assert rows(read_manifest(ws, manifest, "sources"), *files) == rows(ws.store.table("run_sources"), *files)
    assert rows(spark.read.parquet(str(tmp_path / "clean")), "id", "score", "data_quality_flags") == rows(ws.store.clean(), "id", "score", "data_quality_flags")
    assert rows(read_manifest(ws, manifest, "batches"), "raw_rows", "kept_rows", "flagged_rows") == ["(2, 2, 1)", "(3, 2, 1)"]
    # Running a batch again replaces what it left.
    before = rows(read_manifest(ws, manifest, "steps"), "metric", "value")
    raw, compiled = ingest.compile_source(ws, "generic_csv", [str(folder / "b.csv")], {**spec, "adapter_id": "generic_csv"})
    _publish_batch(compiled, manifest, 1)
    assert rows(read_manifest(ws, manifest, "steps"), "metric", "value") == before
    assert rows(read_manifest(ws, manifest, "batches"), "raw_rows", "kept_rows", "flagged_rows") == ["(2, 2, 1)", "(3, 2, 1)"]
