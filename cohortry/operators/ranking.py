"""Top rows, ranks, pages, samples and running means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.exact import limbs_of
from cohortry.functions.numbers import cents
from cohortry.operators.filters import where_equals_max
from cohortry.plans.ordered import (
    DEFAULT_GROUP_ROWS,
    group_sizes,
    largest_group_rows,
    nulls_last,
    numbered,
    running_totals,
)

def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` rows of an order; each task keeps ``n`` rows, nothing is sorted globally."""
    return df.orderBy(*nulls_last(order)).limit(n)


def page(
    df: DataFrame, order: Sequence[str | Column], offset: int, n: int, *, max_head_rows: int = 100_000
) -> DataFrame:
    """Rows ``offset+1 .. offset+n`` of an order that must be unique.

    A shallow page takes the head of the order. A deep one numbers the rows in parallel instead of
    gathering everything before it into one task.
    """
    if offset + n <= max_head_rows:
        return df.orderBy(*nulls_last(order)).offset(offset).limit(n)
    ranked = numbered(df, [], order, "__rn", max_group_rows=max_head_rows)
    return ranked.filter((F.col("__rn") > offset) & (F.col("__rn") <= offset + n)).drop("__rn")


def sample_n(df: DataFrame, id: str, n: int, seed: int = 0, *, digest: str = "xxhash64") -> DataFrame:
    """Random rows that are the same on every run: the ``n`` smallest seeded hashes of a unique id."""
    if digest == "xxhash64":
        key = F.xxhash64(F.lit(seed), F.col(id))
    elif digest == "md5":
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))
    else:
        raise ValueError("digest must be 'xxhash64' or 'md5'")
    return df.orderBy(key, F.col(id)).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each group. Spark cuts every group to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*nulls_last(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def latest_per(df: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each group; ``tie`` decides between rows of the same time."""
    return top_per_group(df, by, [F.col(ts).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def dominant(df: DataFrame, by: Sequence[str | Column], category: str, name: str = "n") -> DataFrame:
    """The most frequent category of each group with its count; ties go to the first category."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias(name))
    keys = counts.columns[: len(list(by))]
    return top_per_group(counts, keys, [F.col(name).desc(), F.col(category).asc_nulls_last()])


def largest_group(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """The group with the most rows, as one row; ties go to the first name."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    return top_n(counts, [F.col(name).desc(), F.col(by).asc_nulls_last()], 1)


def rows_at_max(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """Rows at the overall maximum, ties kept; with ``key``, the per-key maxima that reach it."""
    source = df if key is None else df.groupBy(key).agg(F.max(column).alias(column))
    return where_equals_max(source, column)


def dense_rank_by(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    *,
    descending: bool = False,
    name: str = "rank",
    max_group_rows: int = DEFAULT_GROUP_ROWS,
) -> DataFrame:
    """Dense rank of a value within its group (or overall for an empty ``by``).

    While the largest group fits a task this is the window. Beyond that the distinct values are
    numbered, which combines before any shuffle, and joined back by value.
    """
    by = list(by)
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    if by and largest_group_rows(df, by) <= max_group_rows:
        return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(key)).cast("bigint"))
    values = df.select(*by, column).distinct()
    ranks = numbered(values, by, [key], name, max_group_rows=max_group_rows)
    right = ranks.select(*[F.col(c).alias(f"__{c}") for c in [*by, column]], name)
    same = None
    for c in [*by, column]:
        test = df[c].eqNullSafe(right[f"__{c}"])
        same = test if same is None else same & test
    return df.join(right, same, "inner").select(*[df[c] for c in df.columns], name)


def dense_rank_global(df: DataFrame, column: str, *, descending: bool = True, name: str = "rank",
                      max_group_rows: int = DEFAULT_GROUP_ROWS) -> DataFrame:
    """Dense rank over the whole table, by numbering the distinct values only."""
    return dense_rank_by(df, [], column, descending=descending, name=name, max_group_rows=max_group_rows)


def running_mean(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    column: str,
    *,
    name: str = "running_mean",
    digits: int | None = 4,
    exact: bool = False,
    max_group_rows: int = DEFAULT_GROUP_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """Mean of the group's rows up to and including this one; NULLs are not counted.

    The sum does not depend on the order of addition, so the plan for large groups gives the same
    answer: ``exact`` adds two-decimal amounts as whole cents, other fractions are added as whole numbers of
    their bits (see ``functions.exact``), whatever their magnitude, and their mean is rounded once. After a NaN, or infinities of both signs, the mean is
    NaN; after an infinity it is that infinity.
    """
    fractional = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) and not exact
    value = cents(column) if exact else F.col(column)
    flags: dict[str, Column] = {}
    if fractional:
        value = value.cast("double")
        special = {"__nan": F.isnan(value), "__high": value == float("inf"), "__low": value == float("-inf")}
        flags = {name: F.coalesce(test, F.lit(False)).cast("bigint") for name, test in special.items()}
        limbs = limbs_of(df, column)
        plain = F.when((F.abs(value) < float("inf")) & ~F.isnan(value), value)
        sums = {f"__sum{k}": limb for k, limb in enumerate(limbs.cut(plain))}
    else:
        sums = {"__sum": F.coalesce(value, F.lit(0))}
    addends = {**sums, "__n": F.when(F.col(column).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), **flags}
    summed = running_totals(df, by, order, addends, max_group_rows=max_group_rows, slices=slices)
    count = F.nullif(F.col("__n"), F.lit(0)) * F.lit(100 if exact else 1)
    result = limbs.mean([F.col(c) for c in sums], count) if fractional else F.col("__sum").cast("double") / count.cast("double")
    result = result if digits is None else F.round(result, digits)
    if flags:
        nan, high, low = (F.col(f) > 0 for f in flags)
        result = F.when(nan | (high & low), float("nan")).when(high, float("inf")).when(low, float("-inf")).otherwise(result)
    return summed.withColumn(name, result).drop(*addends)


def moving_mean(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], column: str, rows: int, *,
    name: str = "moving_mean", digits: int | None = 4, max_group_rows: int = DEFAULT_GROUP_ROWS,
) -> DataFrame:
    """Mean of this row and the ``rows - 1`` before it in the group.

    A group that fits a task is one window. A larger one is numbered and cut into stretches, each with
    a copy of the ``rows - 1`` rows before it, so every frame holds the same rows in the same order and
    the answer is the same.
    """
    keys = nulls_last(order)
    mean = F.avg(column)
    sizes = group_sizes(df, by)
    if sizes[0] <= max_group_rows:
        w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(-(rows - 1), Window.currentRow)
        return df.withColumn(name, mean.over(w) if digits is None else F.round(mean.over(w), digits))
    length = max(max_group_rows, rows)
    ranked = numbered(df, by, order, "__rn", max_group_rows=max_group_rows, sizes=sizes)
    stretch, place = F.floor((F.col("__rn") - 1) / length), (F.col("__rn") - 1) % length
    also = F.when(place > length - rows, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    copied = ranked.withColumn("__own", stretch).withColumn("__stretch", F.explode(also))
    w = Window.partitionBy(*by, "__stretch").orderBy("__rn").rowsBetween(-(rows - 1), Window.currentRow)
    result = copied.withColumn(name, mean.over(w) if digits is None else F.round(mean.over(w), digits))
    return result.filter(F.col("__own") == F.col("__stretch")).select(*df.columns, name)
