"""Percentages: per class, per group, of a table total. Every form reads its input once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.numbers import percent
from cohortry.operators.aggregates import _rows_from_columns


def _class_counts(df: DataFrame, classes: Mapping[str, Column], within: Column | None, by: Sequence[str]) -> DataFrame:
    rows = F.count(F.lit(1)) if within is None else F.count_if(within)
    counters = [
        F.count_if(test if within is None else test & within).alias(f"k{i}")
        for i, test in enumerate(classes.values())
    ]
    return df.groupBy(*by).agg(rows.alias("rows"), *counters)


def distribution_wide(
    df: DataFrame, classes: Mapping[str, Column], *, within: Column | None = None, by: Sequence[str] = (),
    digits: int | None = 2,
) -> DataFrame:
    """One percentage column per class, of all rows or of those meeting ``within``."""
    counts = _class_counts(df, classes, within, by)
    return counts.select(
        *by, *[percent(F.col(f"k{i}"), F.col("rows"), digits).alias(name) for i, name in enumerate(classes)]
    )


def distribution_long(
    df: DataFrame, classes: Mapping[str, Column], *, within: Column | None = None, digits: int | None = 2,
    label: str = "label", name: str = "percentage",
) -> DataFrame:
    """One row per class; counts all classes in one scan and then turns columns into rows."""
    counts = _class_counts(df, classes, within, ())
    shares = counts.select(
        *[percent(F.col(f"k{i}"), F.col("rows"), digits).alias(f"p{i}") for i in range(len(classes))]
    )
    return _rows_from_columns(shares, [(key, [f"p{i}"]) for i, key in enumerate(classes)], label, [name])


def share_by(
    df: DataFrame, by: Sequence[str | Column], *, total: DataFrame | None = None, count: str = "n",
    name: str = "percentage", digits: int | None = None,
) -> DataFrame:
    """Rows per group and their percentage of all rows, or of the rows of another table.

    The total is a scalar subquery over the group counts, so no window gathers the groups.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))
    whole = counts.agg(F.sum(count)) if total is None else total.agg(F.count(F.lit(1)))
    return counts.withColumn(name, percent(F.col(count), whole.scalar(), digits))
