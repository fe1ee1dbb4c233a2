"""Column profiles: counts, types, top values, samples, numeric summaries.

One long (column, fingerprint) aggregate feeds every statistic, so the table is
scanned once whatever its width, repeated values combine before the shuffle,
and no statistic needs a whole column in one task. A fingerprint is the length
and a 128-bit hash of a value; whole texts are read again only for the values
that a profile lists, however long the cells are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.scalars import is_missing, profile_label, text_form
from ..session import materialize
from .ordered import running_sums


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, label, number, count) of every present value."""
    cells = _cells(df, columns or df.columns)
    return cells.groupBy("column", "value", "label", "number").agg(F.count("*").alias("count"))


HEAD = 64  # leading characters that order values of equal count, before whole texts do


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, label, number) of every present cell, as structs unrolled by the scan."""
    cells = []
    for name in columns:
        dtype, cell = df.schema[name].dataType, F.col(f"`{name}`")
        number = cell.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else (
            cell.cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
        )
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                text_form(cell, dtype).alias("value"),
                profile_label(cell, dtype).alias("label"),
                number.alias("number"),
                is_missing(cell, dtype).alias("gone"),
            )
        )
    return df.select(F.inline(F.array(*cells))).filter(~F.col("gone")).drop("gone")


def _fingerprint(text: str) -> Column:
    return F.struct(F.length(text).alias("length"), F.unhex(F.md5(text)).alias("hash"))


def fingerprint_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, key, label_key, number, head, count) of every present value. Rows have a bounded
    width: the value itself stays behind, but for its first HEAD characters."""
    cells = _cells(df, columns or df.columns)
    key = _fingerprint("value")
    label_key = F.when(F.col("label") == F.col("value"), key).when(F.col("label").isNotNull(), _fingerprint("label"))
    return (
        cells.select("column", key.alias("key"), label_key.alias("label_key"), "number", F.substring("value", 1, HEAD).alias("head"))
        .groupBy("column", "key", "label_key", "number", "head")
        .agg(F.count("*").alias("count"))
    )


def listed_values(df: DataFrame, counts: DataFrame, columns: list[str] | None = None, limit: int = fv.VALUE_COUNT_LIMIT) -> DataFrame:
    """(column, value, count, rank) like `top_values`, with texts only for values that may be
    listed. Values of equal count follow the text; where more of them share their head than
    the list holds, longer heads are compared first, so a task never orders whole columns."""
    columns = columns or df.columns
    keyed = _cells(df, columns).select("column", _fingerprint("value").alias("key"), "value")
    width, keys = HEAD, ["column", "key"]
    maybe = counts.groupBy(*keys, "head").agg(F.sum("count").alias("count"))
    while True:
        maybe = materialize(_first_heads(maybe, limit))
        crowd = maybe.groupBy("column").agg(F.count("*").alias("n"), F.max(F.length("head")).alias("w")).agg(F.max("n"), F.max("w")).first()
        # At most a few times the listed values are left, or all of them are known to their ends.
        if not crowd[0] or crowd[0] <= 4 * limit or crowd[1] < width:
            break
        width *= 8
        longer = keyed.select(*keys, F.substring("value", 1, width).alias("head")).join(maybe.select(*keys), keys, "left_semi").distinct()
        maybe = maybe.drop("head").join(longer, keys)
    few = maybe.select("column", "key", "count")
    if (crowd[0] or 0) <= 4 * limit:
        few = F.broadcast(few)  # columns x 4 x limit rows at most
    return top_values(keyed.join(few, keys).groupBy(*keys, "value", "count").agg(F.lit(0)), limit)


def _first_heads(maybe: DataFrame, limit: int) -> DataFrame:
    """Values whose count and head put them among the first `limit` of their column, and those
    that tie with the last of them. Only one row per count and head is ordered."""
    heads = maybe.groupBy("column", "count", "head").agg(F.count("*").alias("values"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "head")
    first = heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("earlier", F.coalesce(F.sum("values").over(before), F.lit(0))).filter(F.col("earlier") < limit)
    # At most `limit` rows a column.
    return maybe.join(F.broadcast(first.select("column", "count", "head")), ["column", "count", "head"])


def top_values(counts: DataFrame, limit: int = fv.VALUE_COUNT_LIMIT) -> DataFrame:
    """(column, value, count, rank): most frequent first, ties by value.

    The rank limit is applied inside partitions before the shuffle, so a column
    of all-distinct values sends at most ``limit`` rows per task.
    """
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("column", "value", F.col("count").cast("bigint").alias("count"), "rank")
    )


def first_present(df: DataFrame, row_id: str, columns: list[str], limit: int = fv.SAMPLE_VALUES) -> DataFrame:
    """The first ``limit`` present cells of each column by row order, repeats kept."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            text_form(F.col(f"`{c}`"), df.schema[c].dataType).alias("value"),
            is_missing(F.col(f"`{c}`"), df.schema[c].dataType).alias("gone"),
        )
        for c in columns
    ]
    long = df.select(F.col(row_id).alias("_row"), F.inline(F.array(*cells))).filter(~F.col("gone"))
    order = Window.partitionBy("column").orderBy("_row")
    return (
        long.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("column", "value", "rank")
    )


def medians(counts: DataFrame) -> DataFrame:
    """Exact (column, median) of numeric values from their counts."""
    numbers = counts.filter("number is not null").groupBy("column", "number").agg(F.sum("count").alias("c"))
    ranked = running_sums(numbers, ["column"], "number", {"upto": "c"})
    totals = ranked.groupBy("column").agg(F.sum("c").alias("n"))
    before = F.col("upto") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((before < rank) & (rank <= F.col("upto")), F.col("number")))

    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    # One total per profiled column.
    return (
        ranked.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(((at(low) + at(high)) / 2).alias("median"))
    )


@dataclass(frozen=True)
class Profile:
    """Lazy profile tables of one frame."""

    rows: int
    columns: DataFrame
    counts: DataFrame
    frame: DataFrame
    names: list[str]

    def top(self, limit: int = fv.VALUE_COUNT_LIMIT) -> DataFrame:
        return listed_values(self.frame, self.counts, self.names, limit)


def _type_rule(schema: T.StructType, mode: str) -> Column:
    """Type label per column name; counts decide where the name does not."""
    name, unique, labels = F.lower("column"), F.col("unique_count"), F.col("label_count")
    numeric_names = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    boolean_names = [f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)]
    some = F.col("non_null") > 0
    numeric = F.col("column").isin(*numeric_names) & some if numeric_names else F.lit(False)
    boolean = F.col("column").isin(*boolean_names) if boolean_names else F.lit(False)
    date = name.contains("date") | name.isin(*fv.DATE_NAMES)
    few = unique <= fv.CATEGORICAL_MAX_LEVELS
    if mode == "workbench":
        return (
            F.when(date, "date")
            .when(numeric | boolean, "numeric")
            .when((unique > 0) & (unique <= 2), "binary-like")
            .when(few, "categorical")
            .otherwise("text")
        )
    identifier = name.endswith("_id") | name.isin(*fv.IDENTIFIER_NAMES)
    mostly_unique = unique > F.greatest(F.col("row_count") * 0.5, F.lit(1.0))
    return (
        F.when(identifier, F.when(mostly_unique, "identifier").otherwise("text"))
        .when((labels == 2) | boolean, "binary")
        .when(numeric, "numeric")
        .when(date, "date")
        .when(few, "categorical")
        .otherwise("text")
    )


def profile(df: DataFrame, mode: str = "analysis", columns: list[str] | None = None) -> Profile:
    """Profile every column (``mode``: analysis or workbench type rules)."""
    columns = columns or df.columns
    rows = df.count()
    # Stored once: totals, top values, samples and medians all read it.
    counts = materialize(fingerprint_counts(df, columns))
    # Labels are counted without holding a column's label set in one task.
    by_label = counts.groupBy("column", "label_key").agg(
        F.sum("count").alias("n"), F.count("*").alias("values"),
        F.min("number").alias("low"), F.max("number").alias("high"),
    )
    facts = by_label.groupBy("column").agg(
        F.sum("n").alias("non_null"),
        F.sum("values").alias("unique_count"),
        F.count("label_key").alias("label_count"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column string")
    joined = names.join(facts, "column", "left").join(medians(counts), "column", "left").withColumn(
        "row_count", F.lit(rows).cast("bigint")
    ).na.fill(0, ["non_null", "unique_count", "label_count"])
    missing = F.col("row_count") - F.col("non_null")
    schema = T.StructType([df.schema[c] for c in columns])
    table = joined.select(
        "position",
        "column",
        _type_rule(schema, mode).alias("type"),
        F.col("non_null").cast("bigint").alias("non_null"),
        missing.cast("bigint").alias("missing"),
        F.coalesce(F.round(F.try_divide(missing * 100, F.col("row_count")), 1), F.lit(0.0)).alias("missing_pct"),
        F.col("unique_count").cast("bigint").alias("unique_count"),
        (F.col("label_count") == 2).alias("is_binary"),
        F.round("low", 3).alias("min_value"),
        F.round("median", 3).alias("median_value"),
        F.round("high", 3).alias("max_value"),
        (F.col("unique_count") > fv.VALUE_COUNT_LIMIT).alias("value_counts_truncated"),
    )
    return Profile(rows, table, counts, df, columns)


def presence_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, rows): how many rows have both cells present, in one pass."""
    present = {c: ~is_missing(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.count(F.when(present[a] & present[b], 1)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{i}").alias("rows"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return df.agg(*sums).select(F.inline(cells))
