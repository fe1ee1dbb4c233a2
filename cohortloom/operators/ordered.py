"""Distributed order: ranks and running sums without a one-task window.

Rows are range-partitioned by the full order key, sorted inside partitions and
written once, so their partition and position are facts that later stages can
join on. A global rank is then "rows in earlier partitions + position here".
Only per-partition totals (a row per partition and group) meet in one task. Where only a
few ranks matter, as for equal-count groups, counts per interval find them and rows stay put.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_POSITION_BITS = 33


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``_pid`` (range partition) and ``_pos`` (0-based place inside it)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id of a row is its partition number followed by its place in it.
    stored = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    place = F.col("_mid").bitwiseAND((1 << _POSITION_BITS) - 1)
    return stored.withColumns(
        {"_pid": F.shiftright("_mid", _POSITION_BITS), "_pos": place}
    ).drop("_mid")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank of every row by a unique order key."""
    rows = placed(df, order)
    starts = _running_before(
        rows.groupBy("_pid").agg(F.count("*").alias("_n")), [], {"_start": F.col("_n")}
    ).select("_pid", "_start")
    # One row per range partition: bounded by the partition count, not the data.
    return (
        rows.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + F.col("_pos") + 1)
        .drop("_pid", "_pos", "_start")
    )


def _running_before(totals: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns(
        {name: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for name, c in sums.items()}
    )


def running_sums(
    df: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums ``{new name: column}`` per group along ``order``.

    ``(by, order)`` must be unique (pre-aggregate ties first). The window and the
    offset join share one partitioning, so the rows move once more, not twice.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    rows = placed(df, [*[F.col(c) for c in by], key])
    group = [*by, "_pid"]
    totals = rows.groupBy(*group).agg(*[F.sum(c).alias(f"_{n}_t") for n, c in sums.items()])
    offsets = _running_before(totals, by, {f"_{n}_o": F.col(f"_{n}_t") for n in sums}).select(
        *group, *[f"_{n}_o" for n in sums]
    )
    here = Window.partitionBy(*group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_{n}_l": F.sum(c).over(here) for n, c in sums.items()})
    joined = local.join(offsets, group)
    return joined.withColumns({n: F.col(f"_{n}_l") + F.col(f"_{n}_o") for n in sums}).drop(
        "_pid", "_pos", *[f"_{n}_{s}" for n in sums for s in "lo"]
    )


_BINS = 4096
_FINE_BINS = 1024


@dataclass(frozen=True)
class Cut:
    """The value at a zero-based rank, how many rows are smaller, and how many equal it."""

    rank: int
    value: float
    below: int
    ties: int


def values_at_ranks(df: DataFrame, value: Column, ranks: list[int]) -> list[Cut]:
    """Exact values at some ranks, without ordering rows.

    A pass counts rows per interval and keeps each interval's ends; the interval that holds a
    wanted rank is split further in the next pass until it is a single value. Only interval
    counts leave a task: at most one row per interval, whatever the data.
    """
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    # Open intervals: (lower end, upper end, rows below it, wanted ranks inside).
    open_ = [(ends["a"], ends["b"], 0, sorted(ranks))] if ranks and ends["a"] is not None else []
    found: list[Cut] = []
    bins = _BINS
    while open_:
        v, where, place = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b, _, _) in enumerate(open_):
            inside = v.between(F.lit(a), F.lit(b))
            step = F.least(F.floor((v - a) / (b - a) * bins), F.lit(bins - 1)) if a < b else F.lit(0)
            where = F.when(inside, i).otherwise(where)
            place = F.when(inside, step.cast("int")).otherwise(place)
        counted = rows.select("v", where.alias("i"), place.alias("bin")).where("i is not null")
        counted = counted.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        held: dict[int, list] = {}
        for r in counted.collect():  # at most open intervals x bins
            held.setdefault(r["i"], []).append((r["bin"], r["n"], r["a"], r["b"]))
        narrower = []
        for i, (_, _, below, wanted) in enumerate(open_):
            for _, n, a, b in sorted(held[i]):
                mine = [w for w in wanted if below <= w < below + n]
                if mine and a == b:
                    found += [Cut(w, a, below, n) for w in mine]
                elif mine:
                    narrower.append((a, b, below, mine))
                below += n
        open_, bins = narrower, _FINE_BINS
    return sorted(found, key=lambda c: c.rank)


def equal_count_groups(
    df: DataFrame, order: list[Column], total: int, groups: int, name: str = "group"
) -> DataFrame:
    """Contiguous groups whose sizes differ by at most one, larger ones first.

    The first order key is a number and decides alone, except for rows that share its value
    where a group begins: only those are ranked by the other keys.
    """
    small, larger = divmod(total, groups)
    starts = [g * small + min(g, larger) for g in range(1, groups) if g * small + min(g, larger) < total]
    score, *keys = order
    cuts = values_at_ranks(df, score, starts)
    # Past a start: a larger value, or an equal one that is not among the first `rank - below`.
    inner = [c for c in cuts if c.rank > c.below]
    clear = [F.lit(1)] + [(score > c.value if c.rank > c.below else score >= c.value).cast("int") for c in cuts]
    label = reduce(lambda a, b: a + b, clear)
    split = {c.value: c for c in inner}
    if not split:
        return df.withColumn(name, label.cast("int"))
    tied = score.isin(*split)
    free = df.where(~F.coalesce(tied, F.lit(False))).withColumn(name, label.cast("int"))
    ranked = global_rank(df.where(tied), [score, *keys])
    earlier, offset = 0, F.lit(0)
    for c in sorted(split.values(), key=lambda c: c.value):
        offset = F.when(score == c.value, c.below - earlier).otherwise(offset)
        earlier += c.ties
    rank = F.col("rank") - 1 + offset
    group = reduce(lambda a, b: a + b, [F.lit(1)] + [(rank >= s).cast("int") for s in starts])
    return free.unionByName(ranked.withColumn(name, group.cast("int")).drop("rank"))
