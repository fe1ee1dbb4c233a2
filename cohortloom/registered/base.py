"""Shared pieces: table access, messy columns both engines can derive, SQL snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


# Messy cells derived from order columns; valid in both engines.
MESSY_BOOLEAN = (
    "case o_orderkey % 9 when 0 then ' Yes ' when 1 then 'n/a' when 2 then 'No - none' when 3 then 'ND' "
    "when 4 then 'y' when 5 then 'maybe' when 6 then 'FALSE' when 7 then '1' else null end"
)
MESSY_TEXT = (
    "case o_orderkey % 8 when 0 then concat('  ', o_orderpriority, ' ') when 1 then '?' when 2 then 'Not Documented' "
    "when 3 then '' when 4 then concat('king''s MILL ', lower(o_orderpriority)) when 5 then null "
    "when 6 then '  none ' else o_orderstatus end"
)
MESSY_DATE = (
    "case o_orderkey % 10 "
    "when 0 then concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) "
    "when 1 then concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate)) "
    "when 2 then concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate)) "
    "when 3 then concat(day(o_orderdate), '/', month(o_orderdate), '/', right(concat('', year(o_orderdate)), 2)) "
    "when 4 then 'not-a-date' when 5 then 'ND' "
    "when 6 then concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate)) "
    "when 7 then '31/02/2020' when 8 then concat(' ', day(o_orderdate), '/', month(o_orderdate), '/', 69, ' ') "
    "else null end"
)
MESSY_NUMBER = (
    "case o_orderkey % 7 when 0 then concat('', o_custkey) when 1 then concat(' ', o_custkey, '.5 ') when 2 then '4.2d' "
    "when 3 then 'n/a' when 4 then concat('-', o_custkey, 'e1') when 5 then '1,000' else null end"
)

_TOKENS = "('', '?', 'na', 'n/a', 'nd', 'not documented', 'none', 'null', 'nan')"


def sql_present(x: str) -> str:
    return f"case when lower(trim({x})) in {_TOKENS} then null else trim({x}) end"


def sql_missing(x: str) -> str:
    return f"({x} is null or lower(trim({x})) in {_TOKENS})"


def sql_title(x: str) -> str:
    runs = f"regexp_extract_all(lower({sql_present(x)}), '([a-z]+|[^a-z]+)')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || w[2:]), '')"


def sql_word(x: str) -> str:
    return f"trim(split_part(lower({sql_present(x)}), ' ', 1), ':-;,.')"


def sql_boolean(x: str) -> str:
    word = sql_word(x)
    return f"case when {word} in ('yes','y','true','1') then true when {word} in ('no','n','false','0') then false end"


def sql_date(x: str) -> str:
    p = sql_present(x)
    return (
        f"case when regexp_full_match({p}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
        f"then coalesce(try_strptime({p}, '%d/%m/%Y'), try_strptime({p}, '%m/%d/%Y')) "
        f"when regexp_full_match({p}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') "
        f"then coalesce(try_strptime({p}, '%d/%m/%y'), try_strptime({p}, '%m/%d/%y')) "
        f"when regexp_full_match({p}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_strptime({p}, '%Y-%m-%d') "
        f"when regexp_full_match({p}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') then try_strptime({p}, '%Y/%m/%d') end"
    )


def sql_number(x: str) -> str:
    p = sql_present(x)
    return (
        f"case when regexp_full_match({p}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
        f"then try_cast({p} as double) end"
    )


def sql_day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def sql_round(x: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds doubles."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 18)), {digits}) as double)"
