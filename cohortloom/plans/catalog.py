"""Run catalogue: lineage, stage status and cohort traces over the run tables.

Every function takes and returns frames, so it works on the store's tables or on
any tables of the same shape, and grows with the number of runs, not with memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import WORDING

def _mark_latest(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Mark the newest row, overall or per key."""
    key = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(f"k{i}") for i, c in enumerate(order)])
    if not by:
        top = df.agg(F.max(key).alias("m")).first()["m"]
        same = [F.coalesce(F.col(c), F.lit("")) == v for c, v in zip(order, top or [], strict=False)]
        return df.withColumn("is_latest", reduce(lambda a, b: a & b, same, F.lit(top is not None)))
    newest = df.groupBy(*by).agg(F.max(key).alias("_newest"))
    joined = df.join(newest, by, "left")
    return joined.withColumn("is_latest", F.coalesce(key == F.col("_newest"), F.lit(False))).drop("_newest")


def ingestion_runs(runs: DataFrame, sources: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One row per run: totals over its files, flag totals, latest mark; newest first."""
    totals = sources.groupBy("run_id").agg(
        F.count("*").alias("source_count"),
        F.sum("rows_raw").alias("raw_rows"),
        F.sum("rows_stub").alias("stub_rows"),
    )
    out = runs.join(totals, "run_id", "left").na.fill(0, ["source_count", "raw_rows", "stub_rows"])
    if flags is not None:
        out = out.join(flags, "run_id", "left").na.fill(0, ["flagged_records", "quality_flags"])
    return _mark_latest(out, ["run_datetime", "run_id"]).orderBy(
        F.col("run_datetime").desc(), F.col("run_id").desc()
    )


def flag_totals(report: DataFrame) -> DataFrame:
    """(run_id, flagged_records, quality_flags) from report rows of many runs."""
    size = F.size("flags")
    return report.groupBy("run_id").agg(
        F.count(F.when(size > 0, 1)).alias("flagged_records"),
        F.sum(F.greatest(size, F.lit(0))).cast("bigint").alias("quality_flags"),
    )


def artifact_list(artifacts: DataFrame, policies: dict[str, str] | None = None) -> DataFrame:
    """Artifacts with defaults filled in, the latest of each script marked, in display order."""
    from_file = F.regexp_replace(F.regexp_replace("file_name", r"\.[^.]*$", ""), r"_\d+_\d+$", "")
    script = F.coalesce("script_id", from_file)
    known = F.lit("none")
    for name, policy in (policies or {}).items():
        known = F.when(script == name, policy).otherwise(known)
    filled = artifacts.withColumns(
        {
            "script_id": script,
            "title": F.coalesce("title", F.initcap(F.replace(script, F.lit("_"), F.lit(" ")))),
            "description": F.coalesce("description", F.lit("")),
            "category": F.coalesce("category", F.lit("Uncategorized")),
            "priority": F.coalesce("priority", F.lit(99)),
            "cohort_display": F.coalesce("cohort_display", known),
            "visualization_type": F.get_json_object("visualization", "$.type"),
        }
    )
    marked = _mark_latest(filled, ["run_datetime", "run_id"], ["script_id"])
    return marked.orderBy(
        F.coalesce("run_datetime", "run_id").desc(), F.col("is_latest").desc(), "priority", "title"
    )


def pipeline(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(manifest_run_id, total_rows, analyses, visualizations, scripts) per run, plus
    one row under a null id for artifacts whose run is unknown."""
    per_run = artifacts.groupBy("manifest_run_id").agg(
        F.count("*").alias("analyses"),
        F.count("visualization").alias("visualizations"),
        F.array_join(F.array_sort(F.collect_set("script_id")), ", ").alias("scripts"),
    )
    known = runs.select(F.col("run_id").alias("manifest_run_id"), "total_rows")
    lanes = known.join(per_run, "manifest_run_id", "left").na.fill(0, ["analyses", "visualizations"])
    lost = orphans(runs, artifacts)
    lost_lane = lost.groupBy(F.lit(None).cast("string").alias("manifest_run_id")).agg(
        F.lit(None).cast("bigint").alias("total_rows"),
        F.count("*").alias("analyses"),
        F.count("visualization").alias("visualizations"),
        F.array_join(F.array_sort(F.collect_set("script_id")), ", ").alias("scripts"),
    )
    return lanes.withColumn("scripts", F.coalesce("scripts", F.lit(""))).unionByName(lost_lane)


def orphans(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts whose ingestion run is not in the catalogue."""
    known = runs.select(F.col("run_id").alias("_known"))
    return artifacts.join(known, F.col("manifest_run_id") == F.col("_known"), "left_anti")


def latest_analysis_run(artifacts: DataFrame) -> DataFrame:
    """All artifacts of the newest analysis run."""
    per_run = artifacts.groupBy(F.coalesce("run_id", F.lit("")).alias("_run")).agg(
        F.max(F.coalesce("run_datetime", "run_id", F.lit(""))).alias("_at")
    )
    # One struct survives the aggregate, whatever the number of runs.
    newest = per_run.agg(F.max(F.struct("_at", "_run")).alias("m")).select(F.col("m._run").alias("_run"))
    return artifacts.withColumn("_run", F.coalesce("run_id", F.lit(""))).join(newest, "_run").drop("_run")


def stage_status(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(position, stage, status): ingestion, analysis and visualization."""
    zero = F.lit(0).cast("bigint")
    one = F.count("*")
    counts = (
        runs.agg(one.alias("r"))
        .select("r", zero.alias("a"), zero.alias("v"))
        .unionByName(artifacts.agg(one.alias("a"), F.count("visualization").alias("v")).withColumn("r", zero))
        .agg(*[F.max(c).alias(c) for c in "rav"])
    )
    done = {k: F.col(k) > 0 for k in "rav"}

    def status(mine: Column, before: Column | None) -> Column:
        out = F.when(mine, "completed")
        return out.otherwise("pending") if before is None else out.when(before, "failed").otherwise("pending")

    stages = [
        ("ingestion", status(done["r"], None)),
        ("analysis", status(done["a"], done["r"])),
        ("visualization", status(done["v"], done["a"])),
    ]
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("stage"), s.alias("status"))
                    for i, (n, s) in enumerate(stages)
                ]
            )
        )
    )


def analysis_history(artifacts: DataFrame, label: str = "Analysis") -> DataFrame:
    """One row per analysis run: size, scripts, newest time; newest first."""
    run = F.coalesce("run_id", "run_datetime", "file_name")
    return (
        artifacts.groupBy(run.alias("run"))
        .agg(
            F.max("run_id").alias("run_id"),
            F.max("run_datetime").alias("run_datetime"),
            F.count("*").alias("artifacts"),
            F.count_distinct("script_id").alias("scripts"),
        )
        .withColumn("title", F.lit(f"{label} outputs"))
        .orderBy(F.coalesce("run_datetime", "run_id").desc())
    )


def step_flow(steps: DataFrame) -> DataFrame:
    """Step rows with display label and detail."""
    filter_label = F.get_json_object("metrics", "$.filter_label")
    is_filter = (F.col("operation") == "filter_rows") & filter_label.isNotNull()
    label = F.coalesce("label", "step_id", F.lit("Pipeline step"))
    return steps.withColumns(
        {
            "label": F.when(is_filter, F.concat(label, F.lit(" ("), filter_label, F.lit(")"))).otherwise(label),
            "detail": F.coalesce(F.get_json_object("metrics", "$.filter_description"), "summary", F.lit("")),
        }
    )


def step_rollup(steps: DataFrame) -> DataFrame:
    """Steps that ran once per input file become one row; others stay as they are."""
    flow = step_flow(steps)
    operation = F.when(
        F.contains("step_id", F.lit(":")), F.expr("substring(step_id, instr(step_id, ':') + 1)")
    ).otherwise(F.col("step_id"))
    keyed = flow.withColumn(
        "_key", F.when(F.col("source_file").isNotNull(), operation).otherwise(
            F.concat_ws("#", "step_id", F.col("ordinal").cast("string"))
        )
    )
    item = F.struct("ordinal", "source_file", "detail")
    grouped = keyed.groupBy("run_id", "_key", "label", "execution_mode").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by("step_id", "ordinal").alias("_step"),
        F.min_by("status", "ordinal").alias("status"),
        F.count("source_file").alias("run_count"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    files = F.array_join(F.transform("items", lambda i: i["source_file"]), ", ")
    details = F.array_distinct(F.filter(F.transform("items", lambda i: i["detail"]), lambda d: d != ""))
    first = F.get("items", F.lit(0))
    with_detail = F.filter("items", lambda i: i["detail"] != "")
    per_file = F.array_join(
        F.transform(with_detail, lambda i: F.concat(i["source_file"], F.lit(": "), i["detail"])), "; "
    )
    ran = F.concat(F.lit("Ran "), F.col("run_count").cast("string"), F.lit("x, once per input file"))
    detail = (
        F.when(F.col("run_count") == 0, first["detail"])
        .when((F.col("run_count") == 1) & (first["detail"] == ""), F.lit(""))
        .when(F.col("run_count") == 1, F.concat(first["source_file"], F.lit(": "), first["detail"]))
        .when(F.size(details) == 1, F.concat(ran, F.lit(": "), files, F.lit(". "), F.get(details, F.lit(0))))
        .otherwise(F.concat(ran, F.lit(". "), per_file))
    )
    return grouped.select(
        "run_id", "ordinal",
        F.when(F.col("run_count") > 0, F.col("_key")).otherwise(F.col("_step")).alias("step_id"),
        "label", detail.alias("detail"), "status", "execution_mode", "run_count",
        F.when(F.col("run_count") > 0, files).alias("source_files"),
    )


_SPEC_STEPS = (
    "struct<steps:array<struct<id:string,operation:string,label:string,params:struct<"
    "action:string,match:string,minimum_populated_fields:string,required_field:string,"
    "conditions:array<struct<field:string,operator:string,value:string>>>>>>"
)


def spec_filters(specs: DataFrame) -> DataFrame:
    """(run_id, filter_index, label, filter_label, filter_description, conditions) of
    every filter step in the stored spec snapshots, in snapshot and step order."""
    parsed = specs.withColumn("s", F.from_json("spec", _SPEC_STEPS)).select(
        "run_id", "source_file", F.posexplode("s.steps").alias("position", "step")
    )
    p = F.col("step.params")
    conditions = F.coalesce(p["conditions"], F.array())

    def sentence(c: Column) -> Column:
        operator = F.coalesce(c["operator"], F.lit("equals"))
        text = F.concat(F.lit(" "), operator)
        for name, words in WORDING.items():
            lead, valued, _ = f" {words}".partition("{}")
            value = F.concat(F.lit(lead), F.coalesce(c["value"], F.lit("None"))) if valued else F.lit(lead)
            text = F.when(operator == name, value).otherwise(text)
        return F.concat(F.coalesce(c["field"], F.lit("field")), text)

    minimum = p["minimum_populated_fields"]
    sparse = F.when(
        minimum.isNotNull() & (minimum != ""),
        F.array(F.concat(F.lit("fewer than "), minimum, F.lit(" populated field(s)"))),
    ).otherwise(F.array().cast("array<string>"))
    rules = F.concat(F.transform(conditions, sentence), sparse)
    fields = F.array_distinct(F.filter(F.transform(conditions, lambda c: c["field"]), lambda f: f.isNotNull()))
    label = (
        F.when(minimum.isNotNull() & (minimum != ""), "sparse rows")
        .when(F.size(fields) > 0, F.array_join(fields, ", "))
        .otherwise(F.coalesce(p["required_field"], F.lit("")))
    )
    action = F.initcap(F.coalesce(p["action"], F.lit("keep")))
    description = F.when(F.size(rules) == 0, F.concat(action, F.lit(" rows matching this filter."))).otherwise(
        F.concat(
            action, F.lit(" rows where "), F.coalesce(p["match"], F.lit("all")), F.lit(" of: "),
            F.array_join(rules, "; "), F.lit("."),
        )
    )
    order = Window.partitionBy("run_id").orderBy("source_file", "position")
    return (
        parsed.filter(F.col("step.operation") == "filter_rows")
        .withColumns({"_rules": rules, "_label": label, "_description": description})
        .select(
            "run_id",
            (F.row_number().over(order) - 1).alias("filter_index"),
            F.coalesce("step.label", F.lit("Filter Rows")).alias("spec_label"),
            F.col("_label").alias("spec_filter_label"),
            F.col("_description").alias("spec_filter_description"),
            F.col("_rules").alias("spec_conditions"),
        )
    )


def filter_rules(steps: DataFrame, specs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, position, rule, label, count, remaining_rows, description, conditions).

    The n-th filter step of a run pairs with the n-th filter of its specs; filters
    that removed nothing are left out; a run whose stub rows no rule explains gets
    a stub rule in front. ``runs`` needs (run_id, stub_rows).
    """
    order = Window.partitionBy("run_id").orderBy("ordinal")
    numbered = steps.filter(F.col("operation") == "filter_rows").withColumn(
        "filter_index", F.row_number().over(order) - 1
    )
    joined = numbered.join(spec_filters(specs), ["run_id", "filter_index"], "left")

    def metric(name: str, kind: str = "string") -> Column:
        value = F.get_json_object("metrics", f"$.{name}")
        return value if kind == "string" else value.try_cast(kind)

    count = metric("filtered_rows", "bigint")
    label = F.coalesce("label", "spec_label", F.lit("Filter rows"))
    tag = F.coalesce(metric("filter_label"), F.nullif(F.col("spec_filter_label"), F.lit("")))
    stated = F.from_json(metric("filter_conditions"), "array<string>")
    rules = joined.filter(count > 0).select(
        "run_id",
        (F.col("filter_index") + 1).cast("int").alias("position"),
        F.when(F.contains(F.lower(label), F.lit("sparse")), "sparse_rows").otherwise("filter_rows").alias("rule"),
        F.when(tag.isNotNull(), F.concat(label, F.lit(" ("), tag, F.lit(")"))).otherwise(label).alias("label"),
        count.alias("count"),
        metric("remaining_rows", "bigint").alias("remaining_rows"),
        F.coalesce(metric("filter_description"), "spec_filter_description", "summary", F.lit("")).alias("description"),
        F.coalesce(F.when(F.size(stated) > 0, stated), "spec_conditions", F.array().cast("array<string>")).alias("conditions"),
    )
    explained = rules.filter(F.col("rule") == "sparse_rows").select("run_id").distinct()
    stub = (
        runs.filter(F.col("stub_rows") > 0)
        .join(explained, "run_id", "left_anti")
        .select(
            "run_id",
            F.lit(0).alias("position"),
            F.lit("sparse_rows").alias("rule"),
            F.lit("Sparse row filter").alias("label"),
            F.col("stub_rows").cast("bigint").alias("count"),
            F.lit(None).cast("bigint").alias("remaining_rows"),
            F.lit("Rows with no patient identifier or too few populated fields were removed.").alias("description"),
            F.array().cast("array<string>").alias("conditions"),
        )
    )
    return rules.unionByName(stub)


def cohort_trace(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Raw -> clean -> included rows of every artifact that shows its cohort.

    ``runs`` needs (run_id, raw_rows, stub_rows, total_rows). A stated zero stays
    zero; only an absent count falls back.
    """

    def number(column: str, name: str) -> Column:
        return F.get_json_object(column, f"$.{name}").try_cast("bigint")

    shown = artifacts.filter(F.col("cohort_display") != "none")
    known = runs.select(
        F.col("run_id").alias("manifest_run_id"), "raw_rows", "stub_rows",
        F.col("total_rows").alias("clean_rows"),
    )
    included = F.coalesce(number("cohort", "included_rows"), number("metadata", "n"))
    entering = F.coalesce(number("cohort", "input_rows"), F.col("clean_rows"))
    excluded = F.coalesce(
        number("cohort", "excluded_rows"), F.greatest(entering - included, F.lit(0))
    )
    return shown.join(known, "manifest_run_id", "left").filter(included.isNotNull()).select(
        "file_name", "script_id", "manifest_run_id", "cohort_display", "raw_rows", "stub_rows", "clean_rows",
        entering.alias("input_rows"), included.alias("included_rows"), excluded.alias("excluded_rows"),
        F.get_json_object("cohort", "$.basis").alias("basis"),
        F.coalesce(F.get_json_object("cohort", "$.rules"), F.lit("[]")).alias("rules"),
    )
