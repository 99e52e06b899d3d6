"""Running totals and row numbers over groups of any size.

A window sorts each group in one task. That is the right plan while the largest group fits a task,
and no plan at all when one group holds a third of the table. So the largest group is counted
first (one column, combined before the shuffle). Small enough: the plain window. Otherwise the
rows are range-partitioned by group and order, written once to the shared folder with the number
of their slice, totalled per slice in parallel, and shifted by what the earlier slices add up to.
Each slice continues at most one group of an earlier slice, so the table of shifts has fewer rows
than there are slices and can be broadcast whatever the size of the data.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.sources.workspace import materialise

DEFAULT_GROUP_ROWS = 4_000_000
MAX_SLICES = 20_000

_SLICE = "__slice"
_CARRY = "__carry_"


def nulls_last(order: Sequence[str | Column]) -> list[Column]:
    """Sort keys: plain names sort ascending with NULLs at the end, columns stay as given."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all); one aggregation over the grouping columns."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return row["largest"] or 0, row["total"] or 0


def largest_group_rows(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the largest group."""
    return group_sizes(df, by)[0]


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    *,
    max_group_rows: int | None = DEFAULT_GROUP_ROWS,
    slices: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add, per name, the sum of a non-null expression from the start of the group to this row.

    ``order`` must end in a unique column, otherwise ties are numbered arbitrarily. Pass
    ``max_group_rows=None`` to skip the count where the data model itself bounds the groups, or
    ``sizes`` where the caller has counted (see ``group_sizes``).
    """
    by = list(by)
    keys = nulls_last(order)
    largest, total = sizes or ((0, 0) if max_group_rows is None else group_sizes(df, by))
    if max_group_rows is None or largest <= max_group_rows:
        frame = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in totals.items()})
    if slices is None:
        # Slices of a size that fits a task, at least as many as any shuffle makes.
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = min(MAX_SLICES, max(2, least, math.ceil(total / DEFAULT_GROUP_ROWS)))
    return _sliced_totals(df, by, keys, totals, slices)


def _sliced_totals(
    df: DataFrame, by: list[str], keys: list[Column], totals: Mapping[str, Column], slices: int
) -> DataFrame:
    ranged = df.repartitionByRange(slices, *[F.col(c).asc_nulls_first() for c in by], *keys)
    ranged = materialise(ranged.withColumn(_SLICE, F.spark_partition_id()), "slices")

    per_slice = ranged.groupBy(_SLICE, *by).agg(*[F.sum(v).alias(name) for name, v in totals.items()])
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        F.col(_SLICE).alias(f"{_CARRY}slice"),
        *[F.col(c).alias(f"{_CARRY}by_{c}") for c in by],
        *[F.sum(name).over(earlier).alias(f"{_CARRY}{name}") for name in totals],
    ).filter(functools.reduce(operator.or_, [F.col(f"{_CARRY}{name}").isNotNull() for name in totals]))

    frame = (
        Window.partitionBy(_SLICE, *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = ranged.withColumns({name: F.sum(value).over(frame) for name, value in totals.items()})
    same_group = F.col(_SLICE) == F.col(f"{_CARRY}slice")
    for c in by:
        same_group = same_group & within[c].eqNullSafe(F.col(f"{_CARRY}by_{c}"))
    shifted = within.join(F.broadcast(carried), same_group, "left")
    return shifted.select(
        *df.columns,
        *[F.coalesce(F.col(name) + F.col(f"{_CARRY}{name}"), F.col(name)).alias(name) for name in totals],
    )


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    name: str = "row_number",
    *,
    max_group_rows: int | None = DEFAULT_GROUP_ROWS,
    slices: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Row number within each group (or overall for an empty ``by``), starting at 1."""
    one = {name: F.lit(1).cast("bigint")}
    return running_totals(df, by, order, one, max_group_rows=max_group_rows, slices=slices, sizes=sizes)
