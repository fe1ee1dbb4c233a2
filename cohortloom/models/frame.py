"""From a clean table to a model frame: outcome, design terms, complete cases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.scalars import model_label, text_form, to_number
from ..operators.normalize import staged

# Columns that surely have more distinct cells than this need no list of them to tell their kind.
_LISTED = 16


@dataclass(frozen=True)
class Term:
    name: str
    predictor: str
    kind: str
    reference: str | None
    value: Column


@dataclass(frozen=True)
class Outcome:
    reference: str
    event: str
    label: Column
    count: int
    rows: int


@dataclass
class Design:
    terms: list[Term] = field(default_factory=list)
    skipped: list[dict[str, str]] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)


@dataclass
class ModelFrame:
    """Complete cases: ``label``, ``x`` (terms without intercept) and the row keys."""

    df: DataFrame
    terms: list[Term]
    skipped: list[dict[str, str]]
    outcome: Outcome | None
    input_rows: int
    n: int
    events: int

    def cells(self, rows: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
        """(label, x, extra..., n): distinct rows with counts."""
        return fold(self.df if rows is None else rows, ["label", "x", *extra])


def fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with counts; equal rows combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def choose_levels(values: list[str]) -> tuple[str, str]:
    """(reference, event) of two labels: a preferred word wins, else text order."""
    first, second = sorted(values)
    for word in fv.PREFERRED_EVENTS:
        if word in (first, second):
            return (second, first) if word == first else (first, second)
    return first, second


def encode_outcome(df: DataFrame, name: str) -> Outcome:
    if name not in df.columns:
        raise ValueError(f"The clean table has no outcome column {name}")
    label = model_label(F.col(f"`{name}`"), df.schema[name].dataType)
    # Two labels and perhaps null: a fourth group already means a wrong outcome.
    found = df.groupBy(label.alias("v")).agg(F.count("*").alias("c")).take(4)
    labels = [r["v"] for r in found if r["v"] is not None]
    if len(labels) != 2:
        raise ValueError("The outcome needs exactly two levels besides missing.")
    reference, event = choose_levels(labels)
    encoded = F.when(label == event, 1).when(label == reference, 0)
    known = sum(r["c"] for r in found if r["v"] is not None)
    return Outcome(reference, event, encoded, known, sum(r["c"] for r in found))


def _cell(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    return F.col(f"`{name}`"), df.schema[name].dataType


@dataclass
class Kinds:
    """What each usable predictor is, and the few cells that told it."""

    kinds: dict[str, str]
    values: dict[str, list[str]]
    labels: dict[str, list[str]]
    skipped: list[dict[str, str]]


def predictor_kinds(df: DataFrame, predictors: list[str], outcome: str | None = None) -> Kinds:
    """numeric, binary or categorical, in two small passes.

    Pass one counts. Pass two lists cells and labels only where there are few of them, so
    the driver holds a few words per predictor, however many levels a column has.
    """
    found = Kinds({}, {}, {}, [])
    usable = []
    for name in dict.fromkeys(predictors):
        if name != outcome and name in df.columns:
            usable.append(name)
            continue
        reason = "It is the outcome itself." if name == outcome else "The clean table has no such column."
        found.skipped.append({"predictor": name, "reason": reason})
    if not usable:
        return found
    counts = []
    for i, name in enumerate(usable):
        cell, dtype = _cell(df, name)
        text = text_form(cell, dtype)
        counts += [
            F.count(text).alias(f"n{i}"),
            F.count(to_number(cell, dtype)).alias(f"m{i}"),
            F.approx_count_distinct(text).alias(f"d{i}"),
            F.approx_count_distinct(F.when(text.isNotNull(), model_label(cell, dtype))).alias(f"l{i}"),
        ]
    head = df.agg(*counts).first()
    cells = []
    for i, name in enumerate(usable):
        cell, dtype = _cell(df, name)
        text = text_form(cell, dtype)
        for what, value in (("d", text), ("l", F.when(text.isNotNull(), model_label(cell, dtype)))):
            if head[f"{what}{i}"] <= _LISTED:
                cells.append(F.struct(F.lit(i).alias("i"), F.lit(what).alias("what"), value.alias("value")))
    listed: dict[tuple[int, str], list[str]] = {}
    if cells:
        for row in df.select(F.inline(F.array(*cells))).filter("value is not null").distinct().collect():
            listed.setdefault((row["i"], row["what"]), []).append(row["value"])
    for i, name in enumerate(usable):
        values = listed.get((i, "d"), []) if head[f"d{i}"] <= _LISTED else None
        labels = listed.get((i, "l"), []) if head[f"l{i}"] <= _LISTED else None
        if values is not None and len(values) < 2:
            found.skipped.append({"predictor": name, "reason": "Fewer than two different values are present."})
            continue
        if head[f"m{i}"] == head[f"n{i}"] and (values is None or len(values) > 2):
            found.kinds[name] = "numeric"
        elif labels is not None and len(labels) == 2:
            found.kinds[name], found.labels[name] = "binary", sorted(labels)
        else:
            found.kinds[name] = "categorical"
            if values is not None:
                found.values[name] = sorted(values)
    return found


def build_design(df: DataFrame, predictors: list[str], outcome: str | None = None) -> Design:
    """Terms of every predictor. A categorical column has a term per level but the first, so
    its levels come to the driver as the coefficients will."""
    known = predictor_kinds(df, predictors, outcome)
    design = Design(skipped=known.skipped, kinds=known.kinds)
    wide = [n for n, kind in known.kinds.items() if kind == "categorical" and n not in known.values]
    if wide:
        cells = F.array(*[F.struct(F.lit(n).alias("name"), text_form(*_cell(df, n)).alias("value")) for n in wide])
        for row in df.select(F.inline(cells)).filter("value is not null").distinct().collect():
            known.values.setdefault(row["name"], []).append(row["value"])
    for name, kind in known.kinds.items():
        cell, dtype = _cell(df, name)
        if kind == "numeric":
            design.terms.append(Term(name, name, "numeric", None, to_number(cell, dtype)))
        elif kind == "binary":
            reference, event = choose_levels(known.labels[name])
            label = model_label(cell, dtype)
            value = F.when(label == event, 1.0).when(label == reference, 0.0)
            design.terms.append(Term(f"{name}: {event}", name, "indicator", reference, value))
        else:
            first, *others = sorted(known.values[name])
            text = text_form(cell, dtype)
            for value in others:
                design.terms.append(Term(f"{name}: {value}", name, "indicator", first, (text == value).cast("double")))
    return design


def _usable_terms(df: DataFrame, terms: list[Term], extra: list[Column]) -> tuple[list[int], dict]:
    """Indexes of terms that vary on the complete cases, and the counts taken on the way."""
    spread = [F.stddev_pop(F.get("x", F.lit(i))) for i in range(len(terms))]
    head = df.agg(F.count("*").alias("n"), *extra, F.array(*spread).alias("spread")).first().asDict()
    keep = [i for i, s in enumerate(head.pop("spread")) if (s or 0.0) > fv.MIN_SPREAD]
    return keep, head


def _with_terms(df: DataFrame, terms: list[Term], keep: list[Column]) -> DataFrame:
    x = F.array(*[t.value.cast("double") for t in terms])
    complete = F.forall("x", lambda v: v.isNotNull())
    return df.select(*keep, x.alias("x")).filter(complete)


def build_model_frame(
    df: DataFrame, outcome: str, predictors: list[str], row_keys: list[str] | None = None
) -> ModelFrame:
    """Complete cases of outcome and predictors, without terms that do not vary."""
    encoded = encode_outcome(df, outcome)
    if not predictors:
        raise ValueError("A model needs a predictor.")
    design = build_design(df, predictors, outcome)
    if not design.terms:
        raise ValueError("No predictor can be turned into a term.")
    keys = [F.col(f"`{k}`") for k in row_keys or []]
    rows = _with_terms(df, design.terms, [encoded.label.cast("double").alias("label"), *keys]).filter(
        "label is not null"
    )
    keep, head = _usable_terms(rows, design.terms, [F.sum("label").alias("events")])
    if not head["n"]:
        raise ValueError("Every row lacks the outcome or some predictor.")
    events = int(head["events"])
    if events in (0, head["n"]):
        raise ValueError("The complete rows hold one outcome class only.")
    if not keep:
        raise ValueError("All terms are constant over the complete rows.")
    if len(keep) < len(design.terms):
        rows = rows.withColumn("x", F.array(*[F.get("x", F.lit(i)) for i in keep]))
    return ModelFrame(
        rows, [design.terms[i] for i in keep], design.skipped, encoded,
        encoded.rows, head["n"], events,
    )


# ----------------------------------------------------------------- survival


@dataclass
class SurvivalRows:
    """Rows with time to event, and where the others went."""

    df: DataFrame
    checked: DataFrame


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "date" in c.lower() or c.lower() in fv.DATE_NAMES]


def survival_rows(df: DataFrame, start: str, event: str, censor: str | None = None) -> SurvivalRows:
    """Whole days from start to event, else to the censor date, else to the
    latest date of the row over all date-named columns."""
    for name, label in ((start, "Index date"), (event, "Event date")):
        if name not in df.columns:
            raise ValueError(f"The clean table has no column {name} for the {label.lower()}")
    if censor and censor not in df.columns:
        raise ValueError(f"The clean table has no column {censor} for the censor date")

    dated = list(dict.fromkeys([start, event, *([censor] if censor else []), *date_columns(df)]))
    helper, values, _, helpers = staged(df, [(c, "date") for c in dated])
    day = dict(zip(dated, values, strict=True))
    others = [day[c] for c in date_columns(df)]
    latest = F.greatest(*others) if len(others) > 1 else (others or [F.lit(None).cast("date")])[0]
    helper = helper.withColumns(
        {
            "_start": day[start],
            "_event": day[event],
            "_censor": day[censor] if censor else F.lit(None).cast("date"),
            "_latest": latest,
        }
    ).drop(*helpers)
    end = F.coalesce(F.col("_event"), F.col("_censor"), F.col("_latest"))
    checked = helper.withColumns(
        {
            "duration_days": F.datediff(end, F.col("_start")),
            "event": F.col("_event").isNotNull().cast("int"),
        }
    ).withColumn(
        "exclusion",
        F.when(F.col("_start").isNull(), "Missing index date.")
        .when(F.col("duration_days").isNull(), "Missing event or censor date.")
        .when(F.col("duration_days") <= 0, "Non-positive follow-up time."),
    ).drop("_start", "_event", "_censor", "_latest")
    return SurvivalRows(checked.filter("exclusion is null").drop("exclusion"), checked)


def exclusion_counts(checked: DataFrame) -> DataFrame:
    return (
        checked.filter("exclusion is not null")
        .groupBy(F.col("exclusion").alias("reason"))
        .agg(F.count("*").alias("rows"))
    )


# -------------------------------------------------------------------- folds

_FOLD_BUCKETS = 3  # hex digits: 4,096 buckets per class


def stratified_folds(
    df: DataFrame, row_keys: list[str], folds: int, seed: int = fv.FOLD_SEED
) -> DataFrame:
    """Add ``fold`` (0-based): per class, rows in hash order dealt round-robin.

    The hash is uniform, so its leading digits cut each class into even buckets
    without sampling: bucket totals give offsets, and each bucket is ordered on
    its own. The result depends only on keys and seed, not on the layout.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in row_keys])
    rows = df.withColumn("_h", F.md5(text)).withColumn("_b", F.substring("_h", 1, _FOLD_BUCKETS))
    totals = rows.groupBy("label", "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("label", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    here = Window.partitionBy("label", "_b").orderBy("_h", *row_keys)
    # At most 4,096 offsets per class.
    return (
        rows.withColumn("_r", F.row_number().over(here))
        .join(F.broadcast(starts), ["label", "_b"])
        .withColumn("fold", ((F.col("_o") + F.col("_r") - 1) % folds).cast("int"))
        .drop("_h", "_b", "_r", "_o")
    )


def complete_case_count(df: DataFrame, fields: list[str]) -> int:
    present = [text_form(*_cell(df, f)).isNotNull() for f in fields]
    condition = present[0]
    for p in present[1:]:
        condition = condition & p
    return df.filter(condition).count()
