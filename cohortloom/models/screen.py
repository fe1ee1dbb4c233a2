"""Univariate AUC screen: every predictor's apparent AUC in one pass, no fitting.

A one-term logistic model ranks rows by its term, upward or downward; the sign
of its slope is the sign of mean(x | event) - mean(x | no event). A model with
one indicator per level ranks rows by the event rate of their level. So the AUC
of the fitted model follows from value counts per class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import model_label, text_form, to_number
from ..session import materialize
from .evaluate import auc_from_table, roc_from_table
from .frame import Kinds, Outcome, choose_levels, encode_outcome, predictor_kinds


@dataclass
class Screen:
    outcome: Outcome
    design: Kinds
    leaderboard: DataFrame
    scores: DataFrame
    skipped: list[dict[str, str]]

    def roc_curves(self) -> DataFrame:
        return roc_from_table(self.scores, ["predictor"])


def _long_counts(df: DataFrame, outcome: Outcome, design: Kinds) -> DataFrame:
    """(predictor, number, level, pos, neg): value counts per class."""
    cells = []
    for name, kind in design.kinds.items():
        cell, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        level = model_label(cell, dtype) if kind == "binary" else text_form(cell, dtype)
        no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        cells.append(
            F.struct(
                F.lit(name).alias("predictor"),
                (to_number(cell, dtype) if kind == "numeric" else no_number).alias("number"),
                (no_text if kind == "numeric" else level).alias("level"),
            )
        )
    label = F.col("label")
    return (
        df.withColumn("label", outcome.label)
        .filter("label is not null")
        .select("label", F.inline(F.array(*cells)))
        .filter("number is not null or level is not null")
        .groupBy("predictor", "number", "level")
        .agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    )


def univariate_auc_screen(df: DataFrame, outcome: str, predictors: list[str]) -> Screen:
    encoded = encode_outcome(df, outcome)
    if not predictors:
        raise ValueError("A screen needs a predictor.")
    design = predictor_kinds(df.filter(encoded.label.isNotNull()), predictors, outcome)
    spark = df.sparkSession
    if not design.kinds:
        empty = spark.createDataFrame([], "predictor string, auc double, n bigint, events bigint")
        scores = spark.createDataFrame([], "predictor string, score double, pos bigint, neg bigint")
        return Screen(encoded, design, empty, scores, design.skipped)
    counts = materialize(_long_counts(df, encoded, design))
    pos, neg, x = F.col("pos"), F.col("neg"), F.col("number")
    numeric = x.isNotNull()
    facts = counts.groupBy("predictor").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.count("*").alias("levels"),
        F.try_divide(F.sum(pos * x), F.sum(F.when(numeric, pos))).alias("up"),
        F.try_divide(F.sum(neg * x), F.sum(F.when(numeric, neg))).alias("down"),
        F.min(F.when(pos > 0, x)).alias("p_lo"), F.max(F.when(pos > 0, x)).alias("p_hi"),
        F.min(F.when(neg > 0, x)).alias("q_lo"), F.max(F.when(neg > 0, x)).alias("q_hi"),
        F.max(((pos == 0) | (neg == 0)).cast("int")).alias("pure_level"),
        F.min("level").alias("first_level"),
    ).collect()
    by_name = {r["predictor"]: r for r in facts}
    skipped = list(design.skipped)
    sign, usable = {}, []
    for name in design.kinds:
        r = by_name.get(name)
        if r is None:
            skipped.append({"predictor": name, "reason": "No row has both values."})
        elif not r["p"] or not r["q"]:
            skipped.append({"predictor": name, "reason": "Only one outcome class has complete cases."})
        elif r["levels"] < 2:
            skipped.append({"predictor": name, "reason": "Fewer than two different values are present."})
        else:
            usable.append(name)
            if design.kinds[name] == "numeric":
                sign[name] = (r["up"] > r["down"]) - (r["up"] < r["down"])
    direction = F.lit(1.0)
    for name, s in sign.items():
        if s <= 0:
            # Equal class means give a flat model: every row ties.
            direction = F.when(F.col("predictor") == name, float(s)).otherwise(direction)
    # Class counts reach the score as a rate only for levels; + 0.0 folds -0.0 into 0.0.
    score = F.when(numeric, x * direction + 0.0).otherwise(pos / (pos + neg))
    scores = (
        counts.filter(F.col("predictor").isin(*usable))
        .withColumn("score", score)
        .groupBy("predictor", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    rows = encoded.rows
    aucs = auc_from_table(scores, ["predictor"])
    info = []
    for name in usable:
        r = by_name[name]
        kind = design.kinds[name]
        reference = None if kind == "numeric" else choose_levels(design.labels[name])[0] if kind == "binary" else r["first_level"]
        terms = r["levels"] - 1 if kind == "categorical" else 1
        separated = design.kinds[name] == "numeric" and (
            r["p_lo"] > r["q_hi"] or r["q_lo"] > r["p_hi"]
        )
        warnings = []
        if separated or (design.kinds[name] != "numeric" and r["pure_level"]):
            warnings.append("Model did not fully converge.")
        if min(r["p"], r["q"]) < fv.LOW_CLASS_COUNT:
            warnings.append("Few events or few non-events.")
        n = r["p"] + r["q"]
        info.append((name, terms, reference, rows - n, "; ".join(warnings)))
    table = spark.createDataFrame(
        info, "predictor string, term_count int, reference_level string, missing bigint, warnings string"
    )
    leaderboard = aucs.join(F.broadcast(table), "predictor").select(
        "predictor",
        F.round("auc", 3).alias("auc"),
        F.col("n").cast("bigint").alias("n"),
        F.col("events").cast("bigint").alias("events"),
        (F.col("n") - F.col("events")).cast("bigint").alias("non_events"),
        "missing", "term_count", "reference_level", "warnings",
    )
    return Screen(encoded, design, leaderboard, scores, skipped)


def ranked(leaderboard: DataFrame) -> DataFrame:
    """Best model first; a row per predictor, so one window task is enough."""
    order = Window.orderBy(F.col("auc").desc_nulls_last(), "predictor")
    return leaderboard.withColumn("rank", F.row_number().over(order))
