"""Cell rules, profiles and operators on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import scalars as S
from cohortloom.operators import filters, normalize, profile, structure
from cohortloom.plans import spec as specs
from cohortloom.plans.registry_functions import default_registry
from cohortloom.sources.store import to_json_rows


def values(spark, cells, build):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").coalesce(1)
    return [r["v"] for r in rows.select("i", build(F.col("c")).alias("v")).orderBy("i").collect()]


def test_null_tokens_and_text(spark):
    cells = ["", " ? ", "NA", "n/a", "Nd", "Not Documented", "none", "NULL", "nan", "　x ", "none left", None]
    assert values(spark, cells, S.present_text) == [None] * 9 + ["x", "none left", None]


def test_title_case_follows_text_convention(spark):
    cells = ["king's mill POST-op", "o'neil", "a1b c2D", "élan vital"]
    assert values(spark, cells, S.title_case) == [c.title() for c in cells]


def test_booleans(spark):
    cells = ["Yes", " y ", "TRUE", "1", "No - none", "no:", "F", "n", "0", "-yes", "maybe", "concurrent", "Yes — left", "1.0"]
    want = [True, True, True, True, False, False, None, False, False, True, None, None, True, None]
    assert values(spark, cells, S.to_boolean) == want


@pytest.mark.parametrize("text, want", [
    ("1/2/2020", (2020, 2, 1)), ("31/12/1999", (1999, 12, 31)), ("12/31/1999", (1999, 12, 31)), ("1/2/69", (1969, 2, 1)),
    ("1/2/68", (2068, 2, 1)), ("31/02/2020", None), ("2020-1-5", (2020, 1, 5)), ("2020/3/4", (2020, 3, 4)),
    ("13-05-2020", (2020, 5, 13)), ("05-06-2020", (2020, 5, 6)), ("20200131", (2020, 1, 31)), ("2020", (2020, 1, 1)),
    ("2020-05-06 10:11", (2020, 5, 6)), ("2020-05-06T10:11:12Z", (2020, 5, 6)), ("12345", None), ("5 Mar 2020", (2020, 3, 5)),
    ("March 5, 2020", (2020, 3, 5)), ("december 25 2020", (2020, 12, 25)), ("2020-13-01", None), ("2020-01-01 foo", None),
])
def test_dates(spark, text, want):
    assert values(spark, [text], S.to_date) == [dt.date(*want) if want else None]


def test_numbers(spark):
    cells = ["4.2", " -3 ", "1e3", "4.2d", "1,000", "n/a", ".5", "5.", "0x10"]
    assert values(spark, cells, S.to_number) == [4.2, -3.0, 1000.0, None, None, None, 0.5, 5.0, None]


def test_model_and_profile_labels(spark):
    assert values(spark, ["Yes - a", "No", "TRUE", "Other X"], S.model_label) == ["yes", "no", "yes", "other x"]
    assert values(spark, ["Yes - a", "M", "Other X", "nd"], S.profile_label) == ["yes", "m", "Other X", None]


def test_filter_edges(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("?", None)], "t string, n double")

    def kept(**params):
        return filters.filter_rows(df, **params).count()

    assert kept(conditions=[{"field": "t", "operator": "equals", "value": None}]) == 2
    assert kept(conditions=[{"field": "t", "operator": "not_equals", "value": "a"}]) == 2
    assert kept(conditions=[{"field": "n", "operator": "gt", "value": "x"}]) == 0
    assert kept(conditions=[{"field": "t", "operator": "contains", "value": ""}]) == 3
    assert kept(conditions=[{"field": "t", "operator": "in", "value": "a,"}]) == 3
    assert kept(action="drop") == 0 and kept() == 3
    assert filters.rule_description({"action": "drop", "match": "any", "conditions": [{"field": "t", "operator": "is_missing"}],
                                     "minimum_populated_fields": 2}) == "Drop rows where any of: t is missing; fewer than 2 populated field(s)."


def test_rename_keeps_targets_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out, n = structure.rename_columns(df, {"a": "x", "b": "x", "c": "b", "z": "q"})
    assert out.columns == ["x", "b", "c"] and n == 1


def test_flags_keep_order_and_repeat_once(spark):
    df = spark.createDataFrame([("K1", "bad", "bad")], "patient_id string, d string, e string")
    step = {"operation": "normalize_fields", "params": {"fields": ["d", "e"], "type": "date", "on_invalid": "flag", "invalid_flag": "bad_date"}}
    run = specs.compile_spec({"steps": [step]}, df, specs.Environment("x", default_registry()), source_file=F.lit("f.csv"))
    report = run.quality_report().first()
    assert report["flags"] == ["bad_date"] and [d["field"] for d in report["flag_details"]] == ["d", "e"]
    counts = {r["metric"]: r["value"] for r in run.step_metrics().collect()}
    assert counts == {"rows_raw": 1, "invalid_values": 2, "rows_ingested": 1}


def test_legacy_operations_and_disabled_steps(spark):
    df = spark.createDataFrame([(" a b ", "yes", "1.5", "1/2/2020", "x")], "t string, b string, n string, d string, c string")
    steps = [
        {"operation": "normalize_text", "params": {"fields": "t"}}, {"operation": "normalize_boolean", "params": {"fields": ["b"]}},
        {"operation": "to_float", "params": {"fields": ["n"]}}, {"operation": "normalize_category", "params": {"fields": ["c"]}},
        {"operation": "parse_date", "params": {"mappings": [{"source": "d", "target": "day", "invalid_flag": "bad"}]}},
        {"operation": "compute_ratio", "params": {"numerator": "n", "denominator": "n", "output": "r"}},
        {"operation": "set_value", "params": {"field": "s", "value": "v"}}, {"operation": "set_value", "enabled": False, "params": {"field": "t", "value": "no"}},
        {"operation": "validate_required_columns", "params": {"columns": ["zz"]}}, {"operation": "attach_quality_flags"},
    ]
    run = specs.compile_spec({"steps": steps}, df, specs.Environment("x", default_registry()))
    row = run.clean().first()
    assert (row["t"], row["b"], row["n"], row["c"], row["day"], row["r"], row["s"]) == ("a b", True, 1.5, "X", dt.date(2020, 2, 1), 1.0, "v")
    assert run.facts[9]["missing_columns"] == 1
    with pytest.raises(KeyError, match="zz"):
        structure.validate_required_columns(df, ["zz"], strict=True)


def test_json_rows(spark):
    df = spark.createDataFrame([("n/a", dt.date(2020, 1, 2), ["a", "none"])], "t string, d date, l array<string>")
    assert to_json_rows(df).first()["value"] == '{"t":null,"d":"2020-01-02","l":["a",null]}'


def test_profile_blanks_and_types(spark):
    rows = [("A", "Yes - inferolateral margin", 1, None), ("B", "", 2, "2020-01-01"), ("C", "   ", 3, None), ("D", "No", None, None), ("E", "Not Documented", 5, None)]
    df = spark.createDataFrame(rows, "patient_id string, residual string, age int, seen_date string")
    got = {r["column"]: r for r in profile.profile(df).columns.collect()}
    assert (got["residual"]["type"], got["residual"]["missing"], got["residual"]["non_null"]) == ("binary", 3, 2)
    assert (got["age"]["type"], got["age"]["median_value"]) == ("numeric", 2.5)
    assert got["patient_id"]["type"] == "identifier" and got["seen_date"]["type"] == "date"


def test_large_mapping_equals_small(spark):
    df = spark.createDataFrame([(str(i),) for i in range(200)], "v string")
    small, _ = normalize.remap_values(df, field="v", value_mappings={"7": "seven"})
    large, hit = normalize.remap_values(df, field="v", value_mappings={"7": "seven", **{f"x{i}": "y" for i in range(100)}})
    assert sorted(r["v"] for r in small.collect()) == sorted(r["v"] for r in large.collect())
    assert large.filter(hit).count() == 1


def test_typed_columns_compare_like_their_text(spark):
    df = spark.createDataFrame([(5, 1.5, True), (50, float("nan"), False), (None, None, None)], "n int, d double, b boolean")

    def kept(field, operator, value=None):
        return filters.filter_rows(df, conditions=[{"field": field, "operator": operator, "value": value}]).count()

    assert [kept("n", "equals", v) for v in ("5", " 5 ", 5, "05", "x", None)] == [1, 1, 1, 0, 0, 1]
    assert kept("n", "not_equals", "05") == 3 and kept("n", "in", "5,50,") == 3 and kept("n", "not_in", [5]) == 2
    assert kept("d", "gt", 0) == 1 and kept("d", "is_missing") == 2 and kept("d", "equals", "1.5") == 1
    assert kept("b", "equals", "True") == 1 and kept("b", "equals", "true") == 0
