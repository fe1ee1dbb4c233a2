"""Cohort summaries: headline numbers, age histogram, sex counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ordered import running_sums


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row (median) of a numeric column, from distinct values and counts."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.lit(0).alias("all"), F.col(column).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
    )
    ranked = running_sums(counts, ["all"], "v", {"upto": "c"})
    total = ranked.agg(F.sum("c").alias("n")).first()["n"] or 0
    before = F.col("upto") - F.col("c")

    def at(rank: int) -> Column:
        return F.max(F.when((before < rank) & (F.col("upto") >= rank), F.col("v")))

    return ranked.agg(((at((total + 1) // 2) + at(total // 2 + 1)) / 2).alias("median"))


def cohort_summary(df: DataFrame, age: str = "age_at_presentation", sex: str = "sex") -> DataFrame:
    """(total_patients, median_age, pct_male): one row."""
    median = exact_median(df, age).first()["median"]
    male = F.avg((F.lower(F.col(sex)) == "m").cast("double")) * 100
    return df.agg(F.count("*").alias("total_patients"), F.round(male, 1).alias("pct_male")).select(
        "total_patients",
        F.round(F.lit(median).cast("double"), 1).alias("median_age"),
        "pct_male",
    )


def counts_by(df: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    """(column, count): nulls under ``unknown``, most frequent first."""
    return (
        df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias(column))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), column)
    )


def age_distribution(
    df: DataFrame, age: str = "age_at_presentation", bins: int = fv.HISTOGRAM_BINS
) -> DataFrame:
    """(bin, lower, upper, count): equal-width bins from minimum to maximum.

    A second pass over one pruned column replaces shipping the values.
    """
    ages = df.select(F.col(age).cast("int").cast("double").alias("v")).filter("v is not null")
    head = ages.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spark = df.sparkSession
    if head["lo"] is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    low, high = head["lo"], head["hi"]
    width = (high - low) / bins
    place = F.least(F.floor((F.col("v") - low) * bins / F.lit(high - low)) + 1, F.lit(bins)) if width else F.lit(1)
    counts = ages.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    frame = spark.createDataFrame(
        [(i + 1, low + i * width, low + (i + 1) * width) for i in range(bins)],
        "bin int, lower double, upper double",
    )
    return frame.join(counts, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("c", F.lit(0)).cast("bigint").alias("count")
    )


def age_exclusions(df: DataFrame, age: str = "age_at_presentation") -> DataFrame:
    """(n, excluded): rows with and without an age."""
    return df.agg(
        F.count(F.col(age)).alias("n"), F.count(F.when(F.col(age).isNull(), 1)).alias("excluded")
    )


def quality_summary(report: DataFrame) -> DataFrame:
    """(flagged_records, quality_flags) of a quality report."""
    size = F.size("flags")
    return report.agg(
        F.count(F.when(size > 0, 1)).alias("flagged_records"),
        F.coalesce(F.sum(F.when(size > 0, size)), F.lit(0)).cast("bigint").alias("quality_flags"),
    )


def run_summary(sources: DataFrame, report: DataFrame) -> DataFrame:
    """One row of run totals from the per-file summary and the quality report."""
    totals = sources.agg(
        F.count("*").alias("source_files"),
        F.coalesce(F.sum("rows_raw"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("rows_stub"), F.lit(0)).alias("stub_rows"),
        F.coalesce(F.sum("rows_ingested"), F.lit(0)).alias("ingested_rows"),
        F.array_join(F.array_sort(F.collect_set("adapter")), ", ").alias("adapters"),
    )
    flags = quality_summary(report).first()
    return totals.withColumns({k: F.lit(flags[k]).cast("bigint") for k in ("flagged_records", "quality_flags")})


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key (the table form of a latest pointer)."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
