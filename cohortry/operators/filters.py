"""Row filters that need more than one comparison."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def rows_with_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one of the columns is NULL."""
    return df.filter(any_of([F.col(c).isNull() for c in columns]))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations; grouping without an aggregate is the same operator."""
    return df.select(*columns).distinct()


def where_equals_max(df: DataFrame, column: str) -> DataFrame:
    """Rows at the overall maximum, ties kept; the maximum is a scalar subquery run once."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())
