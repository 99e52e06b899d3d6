"""Grouping one side of a join so that the other side can still be split.

Adaptive execution splits a skewed partition only where a shuffle feeds the join directly. A side
grouped by exactly the join keys is already partitioned for the join, gets no shuffle of its own
there, and so keeps a hot key of the other side in one task. Grouping by the keys and their hash
gives the same groups in another partitioning: Spark then shuffles the (already combined) groups
once more, and the large side can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_for_join(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per combination of keys (NULL included), with aggregates if any are given."""
    keys = list(keys)
    if aggregates:
        grouped = df.groupBy(*keys, F.xxhash64(*keys).alias("__hash")).agg(*aggregates)
        return grouped.drop("__hash")
    return df.select(*keys, F.xxhash64(*keys).alias("__hash")).distinct().select(*keys)
