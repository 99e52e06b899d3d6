"""Outer joins that survive a hot key on either side.

Adaptive execution splits a skewed partition only on the row-preserving side of an outer join, and
on neither side of a full one. Written as an inner join plus the rows without a partner, every
part is a join whose large side can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.plans.splittable import group_for_join
from cohortry.sources.workspace import materialise


def outer_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", *, hot_right: bool = True
) -> DataFrame:
    """``left`` or ``full`` outer join on equally named keys; the other columns must differ.

    Both inputs are read twice. With ``hot_right=False`` the caller says that no key of ``right`` has
    very many rows; a left join is then Spark's own, which reads each once and splits the left side.
    """
    if how not in ("left", "full"):
        raise ValueError("how must be 'left' or 'full'")
    on = list(on)
    if how == "left" and not hot_right:
        return left.join(right, on, "left")
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    matched = left.join(right, on, "inner").select(*columns)
    left_only = left.join(group_for_join(right, on), on, "left_anti")
    result = matched.unionByName(left_only, allowMissingColumns=True)
    if how == "full":
        right_only = right.join(group_for_join(left, on), on, "left_anti")
        result = result.unionByName(right_only, allowMissingColumns=True)
    return result.select(*columns)


def full_outer_chain(
    tables: Sequence[DataFrame], key: str, *, match_first_only: bool = True
) -> DataFrame:
    """Full outer join of several tables on one key; each row keeps one key column per table.

    Key columns come back as ``<key>_0``, ``<key>_1``, and so on. By default every table is
    matched against the key of the first one, so rows missing there do not meet each other; with
    ``match_first_only=False`` they meet on the coalesced key. Joins grow in proportion to the tables. The
    first table may hold a hot key; one of the others would multiply its rows anyway.
    """
    meeting = "__meeting"
    sides = [t.withColumn(f"{key}_{i}", F.col(key)).withColumnRenamed(key, meeting) for i, t in enumerate(tables)]
    keys = [f"{key}_{i}" for i in range(len(tables))]
    result, *rest = sides
    if match_first_only:
        # Rows without a partner in the first table meet nothing else, so each table adds its own once.
        first = group_for_join(sides[0], [meeting])
        for side in rest:
            # Dealt anew, so that a side grouped by the key does not keep Spark from splitting the other.
            spread = side.repartition(F.xxhash64(*side.columns))
            result = outer_join(result, spread, [meeting], hot_right=False)
        for side in rest:
            result = result.unionByName(side.join(first, meeting, "left_anti"), allowMissingColumns=True)
    else:
        for i, side in enumerate(rest):
            # Written between the steps: each uses what came before three times.
            result = outer_join(materialise(result, "chain") if i else result, side, [meeting], "full")
    return result.select(*keys, *[c for c in result.columns if c not in keys and c != meeting])
