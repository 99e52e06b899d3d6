"""Checks on rows and keys, and alerts on abnormal values. All stateless, so they also run on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.filters import all_of, any_of


def no_whitespace(column: str) -> Column:
    """Rule broken by any white space in the text; NULL passes."""
    return F.coalesce(~F.col(column).rlike(r"\s"), F.lit(True))


def lower_case(column: str) -> Column:
    """Rule broken by any letter that is not lower case; NULL passes."""
    return F.coalesce(F.col(column) == F.lower(F.col(column)), F.lit(True))


def text_rules(columns: Sequence[str]) -> dict[str, Column]:
    """The rules for text columns: no white space, lower case only."""
    rules: dict[str, Column] = {}
    for c in columns:
        rules[f"{c}: white space"] = no_whitespace(c)
        rules[f"{c}: not lower case"] = lower_case(c)
    return rules


def with_broken_rules(df: DataFrame, rules: Mapping[str, Column], name: str = "broken_rules") -> DataFrame:
    """Add the array of rule names a row breaks, in the order of the rules."""
    broken = [F.when(~F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)))


def split_valid(
    df: DataFrame, rules: Mapping[str, Column], name: str = "broken_rules"
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, rejected rows with the names of the rules they break)."""
    checked = with_broken_rules(df, rules, name)
    return checked.filter(F.size(name) == 0).drop(name), checked.filter(F.size(name) > 0)


def alerts(
    df: DataFrame, limits: Mapping[str, float], mode: str = "all", message: str = "abnormal values",
    name: str = "alert",
) -> DataFrame:
    """Rows exceeding all (or any) of the limits, with a message naming the columns exceeded."""
    over = {c: F.col(c) > F.lit(limit) for c, limit in limits.items()}
    if mode == "all":
        condition = all_of(list(over.values()))
    elif mode == "any":
        condition = any_of(list(over.values()))
    else:
        raise ValueError("mode must be 'all' or 'any'")
    names = F.concat_ws(", ", *[F.when(test, F.lit(c)) for c, test in over.items()])
    return df.filter(condition).withColumn(name, F.concat(F.lit(f"{message}: "), names))


def check_key(df: DataFrame, columns: Sequence[str], name: str = "rows") -> DataFrame:
    """Key values that break a primary key: repeated, or NULL in any column."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    return counts.filter((F.col(name) > 1) | any_of([F.col(c).isNull() for c in columns]))
