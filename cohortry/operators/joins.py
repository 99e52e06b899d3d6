"""Joins along a star, through a bridge table, and existence tests.

No join here carries a broadcast hint: Spark broadcasts a side when its measured size is below the
session's threshold and shuffles otherwise, and adaptive execution splits skewed partitions. Only
the ways of writing a join that keep that possible are fixed here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.plans.outer import full_outer_chain, outer_join
from cohortry.plans.splittable import group_for_join

__all__ = [
    "Link", "anti", "bridge_join", "equi_join", "exists_other", "full_outer_chain", "membership", "not_in",
    "outer_join", "semi", "shared_values", "star_join", "wide_record",
]


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join on one key pair. Equal names collapse into one column, different names are both kept."""
    if left_key == right_key:
        return left.join(right, left_key, how)
    return left.join(right, left[left_key] == right[right_key], how)


@dataclass(frozen=True)
class Link:
    """One table of a star or a chain: ``hub_key`` (already joined) = ``key`` of ``table``."""

    table: DataFrame
    hub_key: str
    key: str


def star_join(hub: DataFrame, dims: Sequence[Link]) -> DataFrame:
    """Inner join of a hub with its dimensions, in the order given (smallest first)."""
    for dim in dims:
        hub = equi_join(hub, dim.table, dim.hub_key, dim.key)
    return hub


def bridge_join(
    left: DataFrame, bridge: DataFrame, right: DataFrame, left_keys: tuple[str, str], right_keys: tuple[str, str]
) -> DataFrame:
    """Two tables joined through a table of foreign keys.

    ``left_keys`` is (column of left, column of bridge), ``right_keys`` (column of bridge, column
    of right).
    """
    return equi_join(equi_join(left, bridge, *left_keys), right, *right_keys)


def wide_record(hub: DataFrame, links: Sequence[Link], columns: Mapping[str, Column]) -> DataFrame:
    """Denormalised record: a hub with every linked table, reduced to the named expressions.

    The result is lazy, so a filter or a choice of columns by the caller reaches the scans.
    """
    joined = star_join(hub, links)
    return joined.select(*[expr.alias(name) for name, expr in columns.items()])


def semi(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``other``; keys are made distinct before they are shuffled."""
    keys = group_for_join(other.select(F.col(other_key or key).alias(key)), [key])
    return df.join(keys, key, "left_semi").select(*df.columns)


def anti(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in ``other``; rows with a NULL key are kept."""
    keys = group_for_join(other.select(F.col(other_key or key).alias(key)), [key])
    return df.join(keys, key, "left_anti").select(*df.columns)


def not_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """SQL ``NOT IN``: nothing if the list holds a NULL; a NULL key passes only an empty list.

    Spark's own ``NOT IN`` broadcasts the list whatever its size. Here one scalar subquery tells
    whether the list is empty (NULL), holds a NULL (true) or neither (false), and the rest is an
    ordinary anti join, which shuffles when it must.
    """
    null_in_list = other.agg(F.max(F.col(other_key or key).isNull())).scalar()
    kept = df.filter(null_in_list.isNull() | (~null_in_list & F.col(key).isNotNull()))
    return anti(kept, other, key, other_key)


def exists_other(df: DataFrame, same: Sequence[str], differs: str) -> DataFrame:
    """Rows for which another row has the same values in ``same`` and a different ``differs``.

    Counting the distinct partners per key replaces the pairwise comparison: two extremes per key
    are enough, they combine before the shuffle, and no pairs are formed.
    """
    extremes = group_for_join(df, same, F.min(differs).alias("__lo"), F.max(differs).alias("__hi"))
    several = extremes.filter(F.col("__lo") != F.col("__hi")).select(*same)
    return df.filter(F.col(differs).isNotNull()).join(several, list(same), "left_semi").select(*df.columns)


def shared_values(df: DataFrame, keys: str | Sequence[str], min_rows: int = 2) -> DataFrame:
    """Rows whose value (or combination of values) occurs in at least ``min_rows`` rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = group_for_join(df, keys, F.count(F.lit(1)).alias("__n"))
    return df.join(counts.filter(F.col("__n") >= min_rows).select(*keys), keys, "left_semi").select(*df.columns)


def membership(values: DataFrame, table: DataFrame, key: str, table_key: str | None = None,
               flag: str = "found") -> DataFrame:
    """Every value with a flag saying whether the table holds it."""
    known = group_for_join(table.select(F.col(table_key or key).alias(key)), [key]).withColumn(flag, F.lit(True))
    return values.join(known, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
