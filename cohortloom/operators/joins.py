"""Equi-joins on one key, with the null, naming and pivot rules of the spec step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOIN_TYPES = ("left", "inner", "outer")


def pivot_long(
    df: DataFrame,
    index: str,
    columns: str,
    values: str,
    prefix: str = "",
    *,
    order_by: str,
    column_values: list[str] | None = None,
) -> DataFrame:
    """Long to wide: the first present value per (index, column) by ``order_by``.

    Rows with a null index, column or value drop out. ``min_by`` combines on the
    map side, so a hot index never travels whole. Pass ``column_values`` when
    they are known: it saves the job that lists them.
    """
    for name in (index, columns, values, order_by):
        if name not in df.columns:
            raise ValueError(f"Pivot field is not in the join data file: {name}")
    order = F.col(f"`{order_by}`")
    narrow = df.select(
        F.col(f"`{index}`").alias("_i"), F.col(f"`{columns}`").cast("string").alias("_c"),
        F.col(f"`{values}`").alias("_v"), order.alias("_o"),
    ).na.drop(subset=["_i", "_c", "_v"])
    wide = narrow.groupBy("_i").pivot("_c", column_values).agg(F.min_by("_v", "_o"))
    names = {c: f"{prefix}{c}" for c in wide.columns if c != "_i"}
    return wide.select(
        F.col("_i").alias(index), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]
    )


def join_data(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    join_type: str = "left",
    columns: list[str] | None = None,
    right_prefix: str = "",
) -> DataFrame:
    """Join on one key where null matches null.

    One key name on both sides gives one key column; other names that clash get
    ``_x`` / ``_y``. The outer join is a left join plus the unmatched right rows:
    both halves are shapes whose hot keys adaptive execution can split, which a
    full outer join is not.
    """
    if join_type not in JOIN_TYPES:
        raise ValueError(f"Unsupported join type: {join_type}")
    if left_key not in left.columns:
        raise ValueError(f"Join left key is not in the working dataset: {left_key}")
    if right_key not in right.columns:
        raise ValueError(f"Join right key is not in the data file: {right_key}")

    wanted = [c for c in columns or [] if c in right.columns]
    if wanted:
        right = right.select(*[F.col(f"`{c}`") for c in dict.fromkeys([right_key, *wanted])])
    if right_prefix:
        right = right.withColumnsRenamed(
            {c: f"{right_prefix}{c}" for c in right.columns if c != right_key}
        )

    one_key = left_key == right_key
    shared = (set(left.columns) & set(right.columns)) - ({left_key} if one_key else set())
    left = left.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    lk = left_key + "_x" if left_key in shared else left_key
    rk = right_key + "_y" if right_key in shared else right_key

    left_out = list(left.columns)
    right_out = [c for c in right.columns if not (one_key and c == rk)]
    probe = right.withColumnRenamed(rk, "_rk")
    matched = F.col(f"`{lk}`").eqNullSafe(F.col("_rk"))
    how = "inner" if join_type == "inner" else "left"

    def right_columns() -> list:
        return [
            (F.col("_rk").alias(rk) if c == rk else F.col(f"`{c}`")) for c in right_out
        ]

    joined = left.join(probe, matched, how).select(
        *[F.col(f"`{c}`") for c in left_out], *right_columns()
    )
    if join_type != "outer":
        return joined
    keys = left.select(F.col(f"`{lk}`").alias("_lk")).distinct()
    extra = probe.join(keys, F.col("_rk").eqNullSafe(F.col("_lk")), "left_anti")
    fill = [
        (F.col("_rk") if one_key and f.name == lk else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in left.schema.fields
    ]
    return joined.unionByName(extra.select(*fill, *right_columns()))
