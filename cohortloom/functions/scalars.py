"""Column expressions for registry cells: null tokens, text, dates, numbers.

Every function returns a ``Column`` made of built-in expressions, so a whole
cleaning chain stays inside one generated code span.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv

# Characters that count as blank: all Unicode white space plus the four ASCII
# separators, so that trimming follows the usual text-processing convention.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(
    chr(code)
    for code in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
STRING = T.StringType()

# A cell that is nothing but a null token between blanks. One precompiled match
# reads the cell once, where trim + lower + list lookup would copy it twice.
_BLANK_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in BLANKS) + "]*"
MISSING_PATTERN = (
    "(?i)^" + _BLANK_CLASS + "(?:" + "|".join(re.escape(t) for t in fv.NULL_TOKENS) + ")" + _BLANK_CLASS + "$"
)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def plain_decimal(c: Column) -> Column:
    """Text of a double without an exponent: 12345678.0, 0.0001."""
    text = c.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.ltrim(F.substring_index(text, "E", 1), F.lit("-")), r"\.0$|\.", "")
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."))
    rest = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(whole, F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return F.when(F.contains(text, F.lit("E")), F.concat(sign, F.when(power >= 0, large).otherwise(small))).otherwise(text)


def text_form(c: Column, dtype: T.DataType = STRING) -> Column:
    """The cell as text; booleans read True/False, NaN is null."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), plain_decimal(c))
    if is_nested(dtype):
        return F.to_json(c)
    return c.cast("string")


def present_text(c: Column, dtype: T.DataType = STRING) -> Column:
    """Trimmed text, or null when the cell is blank or a null token."""
    if is_nested(dtype):
        return text_form(c, dtype)
    text = text_form(c, dtype)
    return F.when(~text.rlike(MISSING_PATTERN), strip(text))


def missing_to_null(c: Column, dtype: T.DataType = STRING) -> Column:
    """The untrimmed cell, or null when it is missing; nested cells recurse."""
    if isinstance(dtype, T.StringType):
        return F.when(~c.rlike(MISSING_PATTERN), c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        return F.transform(c, lambda item: missing_to_null(item, inner))
    if isinstance(dtype, T.MapType):
        inner = dtype.valueType
        return F.transform_values(c, lambda _, item: missing_to_null(item, inner))
    if isinstance(dtype, T.StructType):
        parts = [
            missing_to_null(c.getField(f.name), f.dataType).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c


def is_missing(c: Column, dtype: T.DataType = STRING) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(c.rlike(MISSING_PATTERN), F.lit(True))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def title_case(c: Column, dtype: T.DataType = STRING) -> Column:
    """Title case where every run of letters starts a word (King'S, Post-Op)."""
    return title_text(present_text(c, dtype))


def title_text(text: Column) -> Column:
    lowered = F.lower(text)
    runs = F.regexp_extract_all(lowered, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def leading_word(text: Column) -> Column:
    """First word in lower case, long dashes folded, edge punctuation cut."""
    spaces = BLANKS.replace(" ", "")
    folded = F.translate(F.lower(text), "–—" + spaces, "--" + " " * len(spaces))
    return F.btrim(F.substring_index(folded, " ", 1), F.lit(fv.LEADING_WORD_PUNCTUATION))


def boolean_word(word: Column) -> Column:
    return F.when(word.isin(*fv.TRUE_WORDS), True).when(word.isin(*fv.FALSE_WORDS), False)


def to_boolean(c: Column, dtype: T.DataType = STRING) -> Column:
    return boolean_word(leading_word(present_text(c, dtype)))


# --- dates ------------------------------------------------------------------
# Every written form has one anchored pattern that recognizes it; its parts are then cut out
# by their separator and put in ISO order for a single cast. Slash dates are day-first unless
# the middle part cannot be a month; dash dates that end in the year are month-first unless
# the first part cannot be one. Two-digit years: 69-99 are 19xx, 00-68 are 20xx. What no
# pattern knows is null, but for bare years and year-months, which the cast reads.
_SLASHED = r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$"
_SLASHED_YEAR_FIRST = r"^\d{4}/\d{1,2}/\d{1,2}$"
_DASHED = r"^\d{4}(-\d{1,2}(-\d{1,2})?)?$"
_DASHED_YEAR_LAST = r"^\d{1,2}-\d{1,2}-\d{4}$"
_COMPACT = r"^\d{8}$"
_WITH_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
_MONTH = (
    "(?i:(Jan)(?:uary)?|(Feb)(?:ruary)?|(Mar)(?:ch)?|(Apr)(?:il)?|(May)|(Jun)e?|(Jul)y?"
    "|(Aug)(?:ust)?|(Sep)(?:tember)?|(Oct)(?:ober)?|(Nov)(?:ember)?|(Dec)(?:ember)?)"
)
_HAS_MONTH = r"^(\d{1,2} )?[A-Za-z]{3,9} (\d{1,2},? )?\d{4}$"
_MONTH_FIRST = r"^" + _MONTH + r" (\d{1,2}),? (\d{4})$"
_DAY_MONTH = r"^(\d{1,2}) " + _MONTH + r" (\d{4})$"
_PICK_FIRST = "$13 " + "".join(f"${i}" for i in range(1, 13)) + " $14"
_PICK_SECOND = "$1 " + "".join(f"${i}" for i in range(2, 14)) + " $14"


def _iso(text: Column, sep: str, first_is_day: bool) -> Column:
    """ISO text of `a<sep>b<sep>year`; the two small parts swap where they cannot be read as told."""
    one, two, year = (F.split_part(text, F.lit(sep), F.lit(i)) for i in (1, 2, 3))
    century = F.when(year.cast("int") >= 69, "19").otherwise("20")
    full = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
    doubtful = two if first_is_day else one
    swap = doubtful.cast("int") > 12
    as_told = (two, one) if first_is_day else (one, two)
    return F.when(swap, F.concat_ws("-", full, *as_told[::-1])).otherwise(F.concat_ws("-", full, *as_told))


def date_text(text: Column) -> Column:
    """Date of present text."""
    # A byte search picks the patterns, so a cell meets only those of its own form.
    slashed = F.when(text.rlike(_SLASHED), _iso(text, "/", True)).when(
        text.rlike(_SLASHED_YEAR_FIRST), F.translate(text, "/", "-")
    )
    dashed = (
        F.when(text.rlike(_DASHED), text)
        .when(text.rlike(_DASHED_YEAR_LAST), _iso(text, "-", False))
        .when(text.rlike(_COMPACT), F.concat_ws("-", F.left(text, F.lit(4)), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        .when(text.rlike(_WITH_TIME), F.left(text, F.lit(10)))
    )
    iso = F.when(F.contains(text, F.lit("/")), slashed).otherwise(dashed)
    worded = F.regexp_replace(
        F.regexp_replace(text, _MONTH_FIRST, _PICK_FIRST), _DAY_MONTH, _PICK_SECOND
    )
    # A failed parse costs an exception per row, so only month names get there.
    spelled = F.when(text.rlike(_HAS_MONTH), F.try_to_date(F.initcap(worded), "d MMM yyyy"))
    return F.coalesce(iso.try_cast("date"), spelled)


def to_date(c: Column, dtype: T.DataType = STRING) -> Column:
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return date_text(present_text(c, dtype))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column, dtype: T.DataType = STRING) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    return number_text(present_text(c, dtype))


def number_text(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def age_in_years(born: Column, seen: Column) -> Column:
    return F.floor(F.datediff(seen, born) / F.lit(365.25)).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.round(F.try_divide(numerator, denominator), 3)


def arithmetic(operator: str, left: Column, right: Column, precision: int | None) -> Column:
    if operator == "add":
        value = left + right
    elif operator == "subtract":
        value = left - right
    elif operator == "multiply":
        value = left * right
    elif operator == "divide":
        value = F.try_divide(left, right)
    else:
        raise ValueError(f"Unsupported math operator: {operator}")
    return value if precision is None else F.round(value, precision)


def presence_label(c: Column, dtype: T.DataType, yes: str, no: str) -> Column:
    return F.when(is_missing(c, dtype), no).otherwise(yes)


def recurrence_kind(text: Column, date: Column) -> Column:
    """Residual / Progression, the word Date for date-like text, else the category."""
    return (
        F.when(F.lower(text).isin("residual", "progression"), F.initcap(text))
        .when(date.isNotNull(), "Date")
        .otherwise(title_text(text))
    )


def report_status(c: Column, dtype: T.DataType = STRING) -> Column:
    """A lone question mark is a statement here, not a missing value."""
    return F.when(strip(text_form(c, dtype)) == "?", "Unknown").otherwise(
        present_text(c, dtype)
    )


def local_centre(c: Column, dtype: T.DataType = STRING) -> tuple[Column, Column]:
    """Split a local/centre cell into (is local, centre name)."""
    text = present_text(c, dtype)
    low = F.lower(text)
    affirmed = low.isin("yes", "qmc", "local")
    denied = low.isin("no", "non-local", "non local")
    is_local = F.when(affirmed, True).when(denied, False).when(text.isNotNull(), low.contains("qmc"))
    centre = F.when(affirmed, "QMC").when(~denied, text)
    return is_local, centre


def model_label(c: Column, dtype: T.DataType = STRING) -> Column:
    """Label of a cell used as a model level: yes / no folding, else lower text."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("string")
    if isinstance(dtype, T.NumericType):
        whole = c.cast("double").isin(0.0, 1.0)
        return F.when(whole, c.cast("int").cast("string")).otherwise(
            F.lower(text_form(c, dtype))
        )
    text = F.lower(strip(text_form(c, dtype)))
    word = leading_word(text)
    return (
        F.when(word.isin(*fv.MODEL_YES_WORDS), "yes")
        .when(word.isin(*fv.MODEL_NO_WORDS), "no")
        .otherwise(text)
    )


def profile_label(c: Column, dtype: T.DataType = STRING) -> Column:
    """Label of a cell for binary detection; unmatched text keeps its case."""
    present = missing_to_null(c, dtype)
    if isinstance(dtype, T.BooleanType):
        return present.cast("string")
    if is_nested(dtype):
        return F.to_json(present)
    text = text_form(present, dtype)
    word = leading_word(strip(text))
    label = F.when(word.isin(*fv.PROFILE_BINARY_WORDS), word).otherwise(text)
    if isinstance(dtype, T.NumericType):
        whole = c.cast("double").isin(0.0, 1.0)
        return F.when(whole, c.cast("int").cast("string")).otherwise(label)
    return label


def entity_key(file_name: Column) -> Column:
    """Upper-case entity key from a report file name; null when there is none."""
    stem = F.regexp_replace(F.url_decode(file_name), r"\.[^.]*$", "")
    key = F.upper(F.regexp_extract(stem, fv.ENTITY_KEY_PATTERN, 1))
    return F.when(key != "", key)


def count_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions], F.lit(0))
