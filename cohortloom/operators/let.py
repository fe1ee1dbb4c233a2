"""Compute expressions once and refer to them by name afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later uses never re-expand the expressions.

    The optimizer inlines projected expressions into every filter and projection
    above them; long text rules then run many times per row and outgrow a
    generated method. Unnesting a one-row array is a step it does not inline
    through. Filters on untouched columns still move below it.
    """
    if not updates:
        return df
    cells = [c.alias(f"_let{i}") for i, c in enumerate(updates.values())]
    wide = df.select("*", F.inline(F.array(F.struct(*cells))))
    place = {name: F.col(f"_let{i}").alias(name) for i, name in enumerate(updates)}
    kept = [place.pop(c) if c in place else F.col(f"`{c}`") for c in df.columns]
    return wide.select(*kept, *place.values())
