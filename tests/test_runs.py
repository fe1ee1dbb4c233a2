"""Published runs: histology, interrupted and simultaneous writers, file hashes, contracts."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import fixed_values as fv
from cohortloom.models import frame, logistic, wide
from cohortloom.operators import contracts
from cohortloom.plans import histology, ingest
from cohortloom.sources import hashes, readers


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


REPLY = "```csv\nmarker,value,notes\n" + "".join(f'{m},yes,"seen, twice"\n' for m in fv.MARKER_ORDER) + "```"


@pytest.fixture
def reports(spark, tmp_path):
    for name in ("K1234567", "K2 (2 years later)", "K3", "K4", "K5"):
        write(tmp_path, f"data/raw/histology/reports/{name}.txt", "report text")
    write(tmp_path, "data/raw/histology/markers/K1234567.csv", "marker,value,notes\nIDH1 or IDH2 mutated,no,\n")
    write(tmp_path, "data/raw/histology/markers/K2 (2 years later).csv", "marker, value\nMGMT,yes\nEGFR,\n")
    write(tmp_path, "data/raw/histology/markers/K99.csv", "marker,value\nno report,x\n")
    write(tmp_path, "data/raw/histology/markers/K5.csv", "marker,value,notes\n")
    return ingest.Workspace.at(spark, str(tmp_path))


def test_histology_run_joins_reports_files_and_replies(spark, reports):
    replies = spark.createDataFrame([("K3.txt", REPLY), ("K4.txt", "nothing"), ("K1234567.txt", REPLY), ("K77.txt", REPLY)], "file_name string, text string")
    run = histology.run_histology(reports, replies)
    rows = histology.histology_dataset(reports.store)
    found = {(r["k_number"], r["marker"], r["value"], r["notes"]) for r in rows.collect()}
    wanted = {("K1234567", "IDH1 or IDH2 mutated", "no", ""), ("K2", "MGMT", "yes", ""), ("K2", "EGFR", "", "")}
    assert found == wanted | {("K3", m, "yes", "seen, twice") for m in fv.MARKER_ORDER}
    files = {r["file_name"]: (r["origin"], r["rows"], r["reason"]) for r in reports.store.run_table("histology_files", run.run_id).collect()}
    assert files["K3.txt"] == ("reply", 5, None) and files["K5.txt"] == ("csv", 0, None) and files["K4.txt"][0] == "rejected" and files["K4.txt"][2]
    assert files["K2 (2 years later).txt"][:2] == ("csv", 2) and len(files) == 5
    second = histology.run_histology(reports, replies, prefer_replies=True)
    assert histology.latest_histology(reports.store).first()["run_id"] == second.run_id
    assert histology.histology_dataset(reports.store).where("k_number = 'K1234567'").count() == 5
    assert histology.histology_dataset(reports.store, run.run_id).count() == 8
    assert histology.latest_histology(reports.store).first().asDict().items() >= {"text_reports": 5, "source_csvs": 2, "source_replies": 2, "missing_reports": 1}.items()
    # A run that broke off before its last row is not there.
    reports.store.append_run("histology_markers", rows, "99999999_broken")
    assert histology.latest_histology(reports.store).first()["run_id"] == second.run_id
    with pytest.raises(FileNotFoundError):
        histology.histology_dataset(reports.store, "99999999_broken")


def test_histology_errors(spark, tmp_path):
    ws = ingest.Workspace.at(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        histology.run_histology(ws)
    write(tmp_path, "data/raw/histology/reports/K1.txt", "x")
    with pytest.raises(FileNotFoundError):
        histology.run_histology(ws)
    write(tmp_path, "data/raw/histology/reports/unnamed.txt", "x")
    with pytest.raises(ValueError, match="unnamed"):
        histology.run_histology(ws)


def test_interrupted_and_simultaneous_runs(spark, tmp_path, monkeypatch):
    write(tmp_path, "data/raw/imports/a.csv", "Subject ID,Score\n1,2\n2,3\n")
    ws = ingest.Workspace.at(spark, str(tmp_path))
    with ThreadPoolExecutor(3) as pool:
        runs = {r.run_id for r in pool.map(lambda _: ingest.run_ingestion(ws, "generic_csv"), range(3))}
    assert len(runs) == 3 and {r["run_id"] for r in ws.store.table("runs").collect()} == runs
    for run_id in runs:
        assert ws.store.clean(run_id).count() == 2
        assert ws.store.table("run_sources").where(F.col("run_id") == run_id).count() == 1
        assert ws.store.table("run_steps").where(F.col("run_id") == run_id).count() > 2

    def stop(*_):
        raise RuntimeError("lost")

    latest = ws.store.latest_run()["run_id"]
    monkeypatch.setattr(ingest, "_spec_rows", stop)
    with pytest.raises(RuntimeError):
        ingest.run_ingestion(ws, "generic_csv")
    broken = {r["run_id"] for r in ws.store.table("run_sources").select("run_id").distinct().collect()} - runs
    assert len(broken) == 1 and ws.store.committed("run_sources").select("run_id").distinct().count() == 3
    assert ws.store.latest_run()["run_id"] == latest and ws.store.clean().count() == 2
    with pytest.raises(FileNotFoundError):
        ws.store.clean(broken.pop())


def test_hashes_and_changes(spark, tmp_path):
    write(tmp_path, "in/a b.csv", "x,y\n1,\n2,z\n")
    write(tmp_path, "in/empty.csv", "x\n")
    look = lambda: hashes.hash_files(spark, readers.list_files(spark, [f"{tmp_path}/in/*.csv"]))
    seen = spark.createDataFrame(look().collect(), hashes.HASHES)
    assert hashes.changes(look(), seen).count() == 0 and hashes.unchanged(look(), seen).count() == 2
    write(tmp_path, "in/a b.csv", "x,y\n1,\n2,w\n")
    write(tmp_path, "in/c.csv", "x\n")
    (tmp_path / "in/empty.csv").unlink()
    assert {r["path"].rsplit("/", 1)[-1].replace("%20", " "): r["status"] for r in hashes.changes(look(), seen).collect()} == {"a b.csv": "changed", "c.csv": "new", "empty.csv": "removed"}
    listed = {(r["kind"], r["name"], r["column_name"]): r for r in hashes.catalogue(spark, {"one": [f"{tmp_path}/in/a*.csv"], "two": [f"{tmp_path}/in/*.csv"]}).collect()}
    assert set(listed) == {("one", "a b.csv", "x"), ("one", "a b.csv", "y"), ("two", "c.csv", None)}
    assert listed["one", "a b.csv", "y"]["values"] == ["w"] and listed["one", "a b.csv", "x"]["rows"] == 2 and listed["two", "c.csv", None]["rows"] == 0
    assert hashes.catalogue(spark, {"none": [f"{tmp_path}/nowhere/*.csv"]}).count() == 0 and hashes.hash_files(spark, []).count() == 0


def test_contract_edges(spark):
    df = spark.createDataFrame([(1, "1.5", None), (2, "many", "x"), (None, None, "ND")], "id int, amount string, word string")
    contract = [{"name": "id", "type": "int", "nullable": False}, {"name": "amount", "type": "double"}, {"name": "word", "nullable": False, "allowed": ["y"]}]
    found = {(r["id"], r["field"], r["problem"]) for r in contracts.violations(df, contract, ["id"]).collect()}
    assert found == {(None, "id", "null"), (2, "amount", "type"), (1, "word", "null"), (2, "word", "not_allowed"), (None, "word", "null")}
    assert {r["field"]: r["problem"] for r in contracts.schema_differences(df, contract).collect()} == {"amount": "type"}
    none = df.where("false")
    assert contracts.violations(none, contract, ["id"]).count() == 0 and contracts.validate(none, contract).where("rows is not null").count() == 0
    assert contracts.violations(df, [{"name": "absent"}], ["id"]).count() == 0


def test_wide_fit_equals_the_dense_one(spark):
    rng = np.random.default_rng(3)
    n = 1500
    a, b, x = rng.integers(0, 22, n), rng.integers(0, 18, n), rng.normal(size=n).round(1)
    eta = 0.3 * x + rng.normal(size=22)[a] * 0.7 + rng.normal(size=18)[b] * 0.5
    rows = [(bool(u < 1 / (1 + np.exp(-e))), float(v), f"a{i:02d}", f"b{j:02d}") for u, e, v, i, j in zip(rng.random(n), eta, x, a, b, strict=True)]
    rows += [(None, 1.0, "a01", "b01"), (True, None, "a01", "b01"), (True, 1.0, None, "b01")]
    df = spark.createDataFrame(rows, "y boolean, x double, a string, b string").repartition(2)
    for predictors in (["x", "a"], ["x", "a", "b"]):
        own = df.where("a is not null") if "b" not in predictors else df
        model = wide.fit_wide(own, "y", predictors)
        dense = logistic.fit(frame.build_model_frame(own, "y", predictors))
        wanted = {r["term"]: r for r in logistic.term_table(dense).collect()}
        logistic.release(dense)
        found = {r["term"]: r for r in model.terms().collect()}
        assert model.converged and set(found) == set(wanted) and model.n == dense.frame.n and model.events == dense.frame.events
        for term, r in wanted.items():
            assert found[term]["coefficient"] == pytest.approx(r["coefficient"], abs=2e-4) and found[term]["reference_level"] == r["reference_level"]
            if len(model.wide) == 1:
                assert found[term]["standard_error"] == pytest.approx(r["standard_error"], abs=2e-4)
                assert found[term]["p_value"] == pytest.approx(r["p_value"], abs=2e-3)
    with pytest.raises(ValueError):
        wide.fit_wide(df, "y", ["x"])


def test_a_wide_step_writes_one_table(spark, monkeypatch):
    """With one wide predictor; and equal rows count as often as they occur."""
    rows = [(i % 3 == 0 or i % 7 == 1, f"level {i % 25}") for i in range(1000)]
    df = spark.createDataFrame(rows, "n boolean, a string")
    written = []
    monkeypatch.setattr(wide, "stored", lambda df, name, stored=wide.stored: written.append(name) or stored(df, name))
    model = wide.fit_wide(df, "n", ["a", "a"])
    assert model.converged and len(written) == model.steps + 1
    counts = {}
    for event, level in rows:
        counts.setdefault(level, [0, 0])[event] += 1
    odds = {level: np.log(e / o) for level, (o, e) in counts.items()}
    found = {r["level"]: r["b"] for r in model.levels.collect()}
    assert model.n == 1000 and model.references == ["level 0"]
    assert found == {level: pytest.approx(v - odds["level 0"], abs=1e-4) for level, v in odds.items() if level != "level 0"}
