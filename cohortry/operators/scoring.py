"""Scoring rows by several tests at once."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import failed_names
from cohortry.operators.aggregates import count_by, count_distinct_if
from cohortry.operators.filters import any_of


def failed_count(tests: Sequence[Column]) -> Column:
    """How many tests hold; a test that is NULL does not."""
    return functools.reduce(operator.add, [F.when(t, F.lit(1)).otherwise(F.lit(0)) for t in tests])


def at_least_k(tests: Sequence[Column], k: int) -> Column:
    return failed_count(tests) >= k


def failed_combinations(
    df: DataFrame, tests: Mapping[str, Column], k: int, *, separator: str = ", ", label: str = "failed",
    name: str = "n",
) -> DataFrame:
    """Rows per combination of failed tests, for rows failing at least ``k``."""
    kept = df.filter(at_least_k(list(tests.values()), k))
    return count_by(kept, failed_names(tests, separator).alias(label), name=name)


def count_any(
    df: DataFrame, by: Sequence[str | Column], tests: Sequence[Column], id: str, name: str = "n"
) -> DataFrame:
    """Distinct ids per group with at least one test holding; groups without any show 0."""
    return df.groupBy(*by).agg(count_distinct_if(any_of(list(tests)), id).alias(name))
