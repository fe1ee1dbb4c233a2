"""Plan shapes and scale behaviour that results alone do not show."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortloom.models import evaluate
from cohortloom.models import frame as frames
from cohortloom.operators import joins, ordered, profile, summaries
from cohortloom.plans import spec as specs
from cohortloom.plans.registry_functions import default_registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    raw = spark.read.parquet(f"{SF}/orders.parquet")
    steps = [
        {"operation": "filter_rows", "params": {"conditions": [{"field": "o_totalprice", "operator": "gt", "value": 1000}]}},
        {"operation": "normalize_fields", "params": {"fields": ["o_orderstatus"], "type": "category"}},
    ]
    run = specs.compile_spec({"steps": steps}, raw, specs.Environment("x", default_registry()), row_id=F.col("o_orderkey"))
    text = plan(run.clean().select("o_orderkey", "o_orderstatus"))
    assert "GreaterThan(o_totalprice,1000.0)" in text, text[text.index("PushedFilters"):]
    scan = text[text.index("ReadSchema"):]
    assert "o_orderdate" not in scan and "o_custkey" not in scan


@needs_data
def test_no_cross_joins(spark):
    names = ["join_outer", "join_pivot", "catalog_filter_rules", "catalog_stage_status", "catalog_latest_analysis",
             "catalog_cohort_trace", "decision_curve", "auc_fine_score", "data_file_catalogue", "stratified_folds"]
    for name in names:
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@needs_data
def test_top_values_limit_before_the_shuffle(spark):
    counts = profile.value_counts(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_returnflag"))
    assert "WindowGroupLimit" in plan(profile.top_values(counts))


@pytest.fixture
def many_ranges(spark):
    """Keep small range partitions apart, as large ones are on a cluster."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


def test_ordered_work_across_many_ranges(many_ranges):
    # A third of the rows share one score; ranks must still be 1..n and cut by row key.
    spark = many_ranges
    rng = np.random.default_rng(2)
    score = np.where(np.arange(3000) % 3 == 0, 0.5, np.round(rng.random(3000), 3))
    label = rng.integers(0, 2, 3000)
    rows = spark.createDataFrame(
        [(i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))], "id int, score double, label int")
    key = [F.col("score"), F.col("id")]
    assert ordered.placed(rows, key).select("_pid").distinct().count() > 2
    got = ordered.global_rank(rows, key).orderBy("score", "id").select("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert {r["n"] for r in evaluate.hosmer_lemeshow(rows, ["id"]).groups.collect()} == {300}

    p, n = score[label == 1], score[label == 0]
    direct = ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))
    by_half = rows.withColumn("half", F.col("id") % 2)
    assert evaluate.auc(rows).first()["auc"] == pytest.approx(direct, abs=1e-12)
    for r in evaluate.auc(by_half, ["half"]).collect():
        mine = np.arange(3000) % 2 == r["half"]
        a, b = score[mine & (label == 1)], score[mine & (label == 0)]
        want = ((a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()) / (len(a) * len(b))
        assert r["auc"] == pytest.approx(want, abs=1e-12)

    cuts = np.unique(score)[::-1]
    curve = {(0.0, 0.0)} | {(round((n >= t).sum() / len(n), 4), round((p >= t).sum() / len(p), 4)) for t in cuts}
    assert {(r["fpr"], r["tpr"]) for r in evaluate.roc_points(rows).collect()} == curve
    assert summaries.exact_median(rows, "score").first()["median"] == pytest.approx(float(np.median(score)))
    medians = {r["column"]: r["median"] for r in profile.medians(profile.value_counts(rows)).collect()}
    assert medians == {"id": 1499.5, "score": float(np.median(score)), "label": float(np.median(label))}


def test_folds_are_even_and_layout_free(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    one = frames.stratified_folds(rows.repartition(1), ["id"], 5)
    many = frames.stratified_folds(rows.repartition(7), ["id"], 5)
    sizes = [r["count"] for r in one.groupBy("label", "fold").count().filter("label = 0").collect()]
    assert max(sizes) - min(sizes) <= 1
    assert one.exceptAll(many).count() == 0


def test_outer_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a")] * 5 + [(None, "n"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (9, "w")], "k int, r string")
    got = sorted(map(tuple, joins.join_data(left, right, "k", "k", "outer").collect()), key=repr)
    want = [(1, "a", "x")] * 5 + [(None, "n", "y"), (None, "n", "z"), (3, "c", None), (9, None, "w")]
    assert got == sorted(want, key=repr)
