"""Ingestion runs end to end in a temporary workspace."""

import json

import pytest
from pyspark.sql import functions as F

from cohortloom.plans import catalog, ingest, templates
from cohortloom.plans.packaged_specs import packaged_spec
from cohortloom.sources import readers

BASE = "K-number,DOB,Presentation Date"


@pytest.fixture
def ws(spark, tmp_path):
    (tmp_path / "data/raw/registry/main_sheet").mkdir(parents=True)
    (tmp_path / "data/raw/imports").mkdir(parents=True)
    (tmp_path / "data/reference").mkdir(parents=True)
    (tmp_path / "data/reference/lobe_mapping.json").write_text('{"frontal": "Frontal Lobe"}')
    return ingest.Workspace.at(spark, str(tmp_path))


def put(ws, text, name="main.csv", folder="data/raw/registry/main_sheet"):
    with open(f"{ws.root}/{folder}/{name}", "w", encoding="utf-8") as handle:
        handle.write(text)


def with_step(spec, step):
    at = next(i for i, s in enumerate(spec["steps"]) if s["operation"] == "finalize_output")
    spec["steps"].insert(at, step)
    return spec


def test_booleans_read_leading_words(ws):
    put(ws, f"{BASE},Residual contrast enhancement\n" + "".join(
        f"K{i},01/01/1960,01/01/2020,{v}\n" for i, v in enumerate(["Yes", "yes", "Yes - inferolateral margin", "No", "no"])
    ))
    rows = ingest.preview(ws, "gbm_registry").rows.orderBy("patient_id").collect()
    assert [r["residual_enhancement"] for r in rows] == [True, True, True, False, False]


def test_missing_age_is_flagged(ws):
    put(ws, f"{BASE},Age at presentation,Sex\nK1,,,,M\n")
    row = ingest.preview(ws, "gbm_registry").rows.first()
    assert row["age_at_presentation"] is None
    assert row["data_quality_flags"] == ["missing_age_at_presentation"]


def test_row_values_and_canonical_layout(ws):
    put(ws, f"{BASE},Age at presentation,Neutrophils (presentation),Lymphocytes (presentation),QMC Local,Contributor,Lobe\n"
            "K0000001,01/01/1960,01/01/2020,,4,2,QMC,QMC,FRONTAL\n")
    row = ingest.preview(ws, "gbm_registry").rows.first().asDict()
    assert list(row)[:3] == ["patient_id", "source", "contributor"]
    assert (row["nlr"], row["qmc_local"], row["referring_centre"]) == (2.0, True, "QMC")
    assert (row["age_at_presentation"], row["tumour_lobe"], row["source"]) == (60, "Frontal Lobe", "gbm_registry")
    assert row["data_quality_flags"] == [] and "qmc_local_raw" not in row


def test_flag_details_name_step_and_value(ws):
    put(ws, f"{BASE},Age at presentation\nK0000001,not-a-date,01/01/2020,60\n", "example.csv")
    report = ingest.preview(ws, "gbm_registry").quality_report.first()
    detail = next(d for d in report["flag_details"] if d["flag"] == "invalid_date_dob")
    assert detail["step_label"] == "Normalize required dates" and detail["step_position"] == 4
    assert detail["step_id"] == "example:normalize_core_dates"
    assert (detail["operation"], detail["field"], detail["raw_value"]) == ("normalize_fields", "dob", "not-a-date")
    assert "date" in detail["hint"]


def test_pivot_join_of_marker_dataset(ws):
    put(ws, f"{BASE}\nK1,01/01/1960,01/01/2020\nK2,01/01/1961,01/01/2020\n")
    markers = {"run_id": "x", "records": [
        {"k_number": "K1", "marker": "IDH1 or IDH2 mutated", "value": "no", "notes": ""},
        {"k_number": "K1", "marker": "IDH1 or IDH2 mutated", "value": "later", "notes": ""},
        {"k_number": None, "marker": "Subtype", "value": "neural", "notes": ""},
    ]}
    put(ws, json.dumps(markers), "markers.json", "data/reference")
    spec = with_step(packaged_spec("gbm_registry"), {
        "id": "join", "operation": "join_data_file",
        "params": {"file": "data/reference/markers.json", "left_key": "patient_id", "right_key": "k_number",
                   "pivot": {"index": "k_number", "columns": "marker", "values": "value", "prefix": "histology__"}},
    })
    shown = ingest.preview(ws, "gbm_registry", spec=spec)
    rows = {r["patient_id"]: r for r in shown.rows.collect()}
    assert rows["K1"]["histology__IDH1 or IDH2 mutated"] == "no"
    assert rows["K2"]["histology__IDH1 or IDH2 mutated"] is None
    counts = {(r["step_position"], r["metric"]): r["value"] for r in shown.step_metrics.filter("metric = 'output_rows'").collect()}
    assert list(counts.values()) == [2]
    assert shown.summary.first()["rows_raw"] == 2


@pytest.mark.parametrize("key, value, expected", [("QMC", "", None), ("qmc", "Leeds", "Leeds")])
def test_remap_counts_and_blanks(ws, key, value, expected):
    put(ws, f"{BASE},Contributor\nK1,01/01/1960,01/01/2020,QMC\n")
    spec = with_step(packaged_spec("gbm_registry"), {
        "operation": "remap_values", "params": {"field": "contributor", "value_mappings": [{"key": key, "value": value}]}})
    shown = ingest.preview(ws, "gbm_registry", spec=spec)
    # Title case runs first, so the mapped value is compared as "Qmc".
    assert shown.rows.first()["contributor"] == expected
    assert shown.step_metrics.filter("metric = 'remapped_values'").first()["value"] == 1


def test_generic_csv_keeps_text_and_maps_null_tokens(ws):
    put(ws, "Subject ID;Study Arm;Score\nS001;Not Documented;42\n", "g.csv", "data/raw/imports")
    spec = with_step(packaged_spec("generic_csv"), {
        "operation": "remap_values",
        "params": {"field": "Study Arm", "value_mappings": [{"key": "not documented", "value": "Unknown"}]}})
    row = ingest.preview(ws, "generic_csv", spec=spec).rows.first().asDict()
    assert row["Study Arm"] == "Unknown" and row["Score"] == "42" and "patient_id" not in row


def test_latin1_and_quoted_breaks(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('name,note\nJos\xe9,"two\nlines"\n'.encode("latin-1"))
    row = readers.read_generic_csv(spark, [str(path)]).first()
    assert (row["name"], row["note"]) == ("José", "two\nlines")


def test_run_publishes_counts_lineage_and_saved_spec(ws):
    put(ws, f"{BASE},Age at presentation,Sex\nK1,bad,01/01/2020,60,M\nK2,01/01/1950,01/01/2020,,F\n,,,,\n", "a.csv")
    put(ws, f"K-number,Sex,DOB\nK3,M,01/01/1950\n", "b.csv")
    spec = packaged_spec("gbm_registry")
    spec["steps"][0]["label"] = "Saved map"
    run = ingest.run_and_save(ws, "gbm_registry", None, spec)
    store = ws.store
    assert store.clean().count() == 3 and set(store.clean().columns).isdisjoint({"_flags", "_source_file", "kept"})
    sources = {r["file"]: r.asDict() for r in store.table("run_sources").collect()}
    assert (sources["a.csv"]["rows_raw"], sources["a.csv"]["rows_stub"], sources["a.csv"]["rows_ingested"]) == (3, 1, 2)
    assert sources["b.csv"]["rows_raw"] == 1
    report = {r["patient_id"]: r["flags"] for r in store.quality_report(run.run_id).collect()}
    assert report == {"K1": ["invalid_date_dob"], "K2": [], "K3": ["missing_age_at_presentation"]}
    assert ingest.default_spec(ws, "gbm_registry")[1] == "saved"
    assert "transient" not in ingest.default_spec(ws, "gbm_registry")[0]

    runs = catalog.ingestion_runs(
        store.table("runs"), store.table("run_sources"),
        catalog.flag_totals(store.quality_report(run.run_id).withColumn("run_id", F.lit(run.run_id))),
    ).collect()
    assert (runs[0]["raw_rows"], runs[0]["stub_rows"], runs[0]["flagged_records"], runs[0]["is_latest"]) == (4, 1, 2, True)
    rolled = catalog.step_rollup(store.table("run_steps")).filter("run_count > 1")
    assert rolled.count() == len(spec["steps"])
    rules = catalog.filter_rules(
        store.table("run_steps"), store.table("run_specs"), catalog.ingestion_runs(store.table("runs"), store.table("run_sources"))
    ).collect()
    assert [(r["rule"], r["count"]) for r in rules] == [("sparse_rows", 1)]

    written = templates.run_scripts(store)
    assert {a["script_id"] for a in written} == {"cohort_summary", "age_distribution", "sex_breakdown"}
    summary = next(a for a in written if a["script_id"] == "cohort_summary")
    assert summary["data"]["total_patients"] == 3 and summary["data"]["pct_male"] == 66.7
    assert catalog.stage_status(store.table("runs"), store.table("artifacts")).filter("status = 'completed'").count() == 3
    assert catalog.orphans(store.table("runs"), store.table("artifacts")).count() == 0
    assert store.latest_artifacts().count() == 3

    second = ingest.run_ingestion(ws, "gbm_registry")
    assert store.latest_run()["run_id"] == second.run_id and store.table("runs").count() == 2


def test_plan_time_errors(ws):
    put(ws, f"{BASE}\nK1,01/01/1960,01/01/2020\n")
    cases = [
        ({"operation": "no_such"}, "Unsupported ingestion operation"),
        ({"operation": "filter_rows", "params": {"conditions": [{"field": "sex", "operator": "like"}]}}, None),
        ({"operation": "filter_rows", "params": {"conditions": [{"field": "dob", "operator": "like"}]}}, "Unsupported filter operator"),
        ({"operation": "join_data_file", "params": {"file": "x.csv", "left_key": "dob", "join_type": "cross"}}, "Unsupported join type"),
        ({"operation": "join_data_file", "params": {"file": "../x.csv", "left_key": "dob", "right_key": "a"}}, "inside the workspace"),
        ({"operation": "static_code", "params": {"function": "os.system"}}, "does not allow"),
        ({"operation": "normalize_fields", "params": {"fields": ["patient_id"], "type": "number", "on_invalid": "stop_run"}}, "1 value"),
    ]
    for step, message in cases:
        spec = with_step(packaged_spec("gbm_registry"), step)
        if message is None:
            ingest.preview(ws, "gbm_registry", spec=spec)
            continue
        with pytest.raises(ValueError, match=message):
            ingest.preview(ws, "gbm_registry", spec=spec)
    with pytest.raises(ValueError, match="does not match"):
        ingest.active_spec(ws, "generic_csv", packaged_spec("gbm_registry"))


def test_marker_files_and_rejects(spark, tmp_path):
    (tmp_path / "K1463292 (2 years later).csv").write_text(" marker , value \nSubtype,neural\nATRX mutation,\n")
    (tmp_path / "no key.csv").write_text("marker,value,notes\nSubtype,other,x\n")
    rows, rejects = readers.read_marker_files(spark, readers.list_files(spark, [f"{tmp_path}/*.csv"]))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("K1463292", "ATRX mutation", "", ""), ("K1463292", "Subtype", "neural", "")]
    assert [r["file_name"] for r in rejects.collect()] == ["no key.csv"]
