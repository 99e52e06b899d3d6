"""Counts, means, value lists and visits per period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.dates import date_text, month_name, week_text
from cohortry.functions.numbers import exact_mean, mean
from cohortry.plans.ordered import DEFAULT_GROUP_ROWS, nulls_last, numbered


def count_by(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    """Rows per group (frequencies, cross tabulation, counts per band)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def count_distinct(
    df: DataFrame, by: Sequence[str | Column], column: str | Column, name: str = "n", *, approx: bool = False
) -> DataFrame:
    """Distinct non-null values per group; exact unless ``approx``.

    The exact form is aggregated first by (group, value), so a hot group is spread over tasks.
    """
    counter = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(counter(column).alias(name))


def count_distinct_if(condition: Column, column: str) -> Column:
    """Distinct values among the rows meeting a condition."""
    return F.count_distinct(F.when(condition, F.col(column)))


def mean_by(
    df: DataFrame, by: Sequence[str | Column], column: str | Column, name: str = "mean", *,
    digits: int | None = 2, exact: bool = False,
) -> DataFrame:
    """Mean of a measure per group; ``exact`` adds two-decimal amounts as whole cents."""
    value = exact_mean(column, digits) if exact else mean(column, digits)
    return df.groupBy(*by).agg(value.alias(name))


def rate(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """Percentage of the rows meeting ``denominator`` that also meet ``numerator``."""
    part = F.count_if(numerator & denominator)
    whole = F.count_if(denominator)
    value = (F.lit(100) * part).cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return value if digits is None else F.round(value, digits)


def count_cases(df: DataFrame, cases: Mapping[str, Column], label: str = "label", name: str = "n") -> DataFrame:
    """One labelled row per condition, counted in a single pass over the table."""
    counts = df.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(cases.values())])
    return _rows_from_columns(counts, [(key, [f"c{i}"]) for i, key in enumerate(cases)], label, [name])


def _rows_from_columns(
    df: DataFrame, rows: Sequence[tuple[str, Sequence[str]]], label: str, names: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Turn columns of a (small) aggregate into rows."""
    entries = [
        F.struct(F.lit(key).alias(label), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
        for key, columns in rows
    ]
    exploded = df.select(*keep, F.explode(F.array(*entries)).alias("__row"))
    return exploded.select(*keep, f"__row.{label}", *[f"__row.{n}" for n in names])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs and rows per column, from one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    return _rows_from_columns(
        counts, [(c, [f"c{i}", "rows"]) for i, c in enumerate(columns)], "column_name", ["nulls", "rows"]
    )


def values_by(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    order: Sequence[str | Column] | None = None,
    *,
    name: str = "values",
    chunk_rows: int = 100_000,
    max_group_rows: int = DEFAULT_GROUP_ROWS,
) -> DataFrame:
    """The values of each group as sorted arrays.

    An array is one row, so a group of any size in one array cannot work. Groups of up to
    ``chunk_rows`` values give one row with ``chunk`` 0; larger ones continue in chunks 1, 2, ...
    of at most that many values each. Nothing is dropped but NULLs.
    """
    order = list(order or [column])
    present = df.filter(F.col(column).isNotNull())
    ranked = numbered(present, by, order, "__rn", max_group_rows=max_group_rows)
    chunked = ranked.withColumn("chunk", F.floor((F.col("__rn") - 1) / chunk_rows).cast("bigint"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("__rn"), F.col(column).alias("value"))))
    return (
        chunked.groupBy(*by, "chunk")
        .agg(pairs.alias("__pairs"))
        .select(*by, "chunk", F.col("__pairs.value").alias(name))
    )


def visits_by(
    df: DataFrame, ts: str, grain: str, *, id: str | None = None, min_count: int = 1, name: str = "visits"
) -> DataFrame:
    """Visits per ``month`` name, ``day`` or ISO ``week``; groups below ``min_count`` are left out.

    Months also carry the first visit, which is the calendar order of the names. With ``id`` the
    distinct ids are counted instead of the rows.
    """
    counted = F.count(F.lit(1)) if id is None else F.count_distinct(F.col(id))
    if grain == "month":
        # Group by the number and name the twelve results; formatting every row costs far more.
        months = df.groupBy(F.month(ts).alias("__month")).agg(counted.alias(name), F.min(ts).alias("first_visit"))
        grouped = months.select(month_name("first_visit").alias("month_name"), name, "first_visit")
    elif grain == "day":
        # Truncate first: a number is cheaper to group by than its text.
        days = df.groupBy(F.date_trunc("day", F.col(ts)).alias("__day")).agg(counted.alias(name))
        grouped = days.select(date_text("__day").alias("day"), name)
    elif grain == "week":
        # Grouped by the two numbers of the label: the last days of a year can belong to week 1.
        monday = F.date_trunc("week", F.col(ts))
        weeks = df.groupBy(F.year(monday).alias("__year"), F.weekofyear(monday).alias("__week"))
        grouped = weeks.agg(counted.alias(name)).select(week_text("__year", "__week").alias("week"), name)
    else:
        raise ValueError("grain must be 'month', 'day' or 'week'")
    return grouped.filter(F.col(name) >= min_count)


def date_span(df: DataFrame, ts: str, first: str = "first_visit", last: str = "last_visit") -> DataFrame:
    """First and last date of a table in one row."""
    return df.agg(F.min(ts).alias(first), F.max(ts).alias(last))


def sorted_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """Sort with NULLs last unless a key says otherwise."""
    return df.orderBy(*nulls_last(order))
