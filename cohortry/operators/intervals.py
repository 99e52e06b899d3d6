"""Classes, alerts and labels by limits that are rows of a table, however many there are.

"low <= value < high" as a join condition alone compares all pairs. Here an interval is cut into bins about as wide as
itself, a power of two, so it lies in two or three of them, and a value looks into one bin of each width that the table
uses. That makes it an equality join on (group, width, bin), which Spark hashes and splits when one key is hot,
with the two comparisons as a test on what meets.

Pairs grow as the product of both tables where many intervals hold a value. Whoever only counts them, or wants the least or greatest
of a column, asks for ``totals``: values are numbered in their group, an interval becomes a run of numbers and is cut into at most
two blocks of each power of two, blocks are totalled, and a value looks up one block of each size that holds its number. No pairs are made.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.plans.ordered import group_sizes, running_totals
from cohortry.sources.workspace import materialise

_LEVEL, _BIN, _LOW, _HIGH, _TOTAL = "__level", "__bin", "__low", "__high", "__total_"
# Bins are numbered by whole numbers that a double holds exactly.
_MOST_BINS = 1 << 52


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def _levels(low: Column, high: Column) -> Column:
    """Exponent of the width: the least power of two that is not below the length, but wide enough for the numbers of its bins."""
    size = F.greatest(high - low, F.greatest(F.abs(low), F.abs(high)) / F.lit(float(_MOST_BINS)), F.lit(5e-300))
    return F.ceil(F.log2(size)).cast("int")


def interval_join(
    df: DataFrame, value: str, limits: DataFrame, low: str, high: str, *, by: Sequence[str] = (), closed: str = "left", how: str = "inner",
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Rows of ``df`` with the rows of ``limits`` whose interval holds their value, and whose columns ``by`` are equal to theirs (NULL only to NULL).

    ``closed``: which ends belong to an interval (``left``, ``right``, ``both``, ``neither``). A NULL limit is open. A NULL or NaN value
    lies in no interval; ``how="left"`` keeps the rows that meet none. Intervals may overlap, and a row is returned
    once for each that holds it. An interval whose ends are the wrong way round holds nothing. Column names must differ, except those of ``by``.

    ``totals`` (name: ``count``, ``min`` or ``max``, and a column of ``limits``) returns each row of ``df`` once, with these totals over the limits that
    hold it instead of their columns. A row that meets none has the count 0 and no least or greatest.
    """
    if how not in ("inner", "left") or closed not in ("left", "right", "both", "neither"):
        raise ValueError("how is inner or left, closed is left, right, both or neither")
    by = list(by)
    clash = (set(df.columns) & set(limits.columns)) - set(by)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    if totals is not None:
        return _interval_totals(df, value, limits, low, high, by, closed, how, totals)
    number = F.col(value).cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    first, last = df.agg(F.min(finite), F.max(finite)).first()
    first, last = (0.0, 0.0) if first is None else (first, last)
    # an open end reaches just beyond all values, and so does one that lies further out
    edge = max(abs(first), abs(last), 1e-280) * 2
    ends = limits.withColumns({_LOW: F.greatest(F.coalesce(F.col(low).cast("double"), F.lit(-math.inf)), F.lit(-edge)), _HIGH: F.least(F.coalesce(F.col(high).cast("double"), F.lit(math.inf)), F.lit(edge))})
    ends = ends.filter(F.col(_LOW) <= F.col(_HIGH)).withColumn(_LEVEL, _levels(F.col(_LOW), F.col(_HIGH)))
    levels = [r[_LEVEL] for r in ends.select(_LEVEL).distinct().collect()]  # exponents of a double: two thousand at most
    bins = F.sequence(_bin(F.col(_LOW), F.col(_LEVEL)), _bin(F.col(_HIGH), F.col(_LEVEL)))
    binned = ends.withColumn(_BIN, F.explode(bins))
    names = {c: f"__by_{c}" for c in by}
    right = binned.select(*[F.col(c).alias(names.get(c, c)) for c in limits.columns], _LEVEL, _BIN)
    inner = F.when(number < -edge, F.lit(-edge)).when(number > edge, F.lit(edge)).otherwise(number)  # infinities look where open ends lie
    probes = F.array(*[F.struct(F.lit(k).alias(_LEVEL), _bin(inner, F.lit(k)).alias(_BIN)) for k in levels]) if levels else F.array().cast(f"array<struct<{_LEVEL}: int, {_BIN}: bigint>>")
    left = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "rows") if how == "left" else df  # read twice, so rows must keep their numbers
    probing = left.filter(number.isNotNull() & ~F.isnan(number)).withColumn("__probe", F.explode(probes))
    probing = probing.select(*left.columns, F.col(f"__probe.{_LEVEL}").alias("__at"), F.col(f"__probe.{_BIN}").alias("__in"))
    test = (F.col("__at") == F.col(_LEVEL)) & (F.col("__in") == F.col(_BIN))
    for c in by:
        test = test & probing[c].eqNullSafe(F.col(names[c]))
    above = number >= F.col(low) if closed in ("left", "both") else number > F.col(low)
    beneath = number <= F.col(high) if closed in ("right", "both") else number < F.col(high)
    test = test & (F.col(low).isNull() | above) & (F.col(high).isNull() | beneath)
    added = [c for c in limits.columns if c not in by]
    met = probing.join(right, test).select(*left.columns, *added)
    if how == "inner":
        return met
    none = left.join(met.select("__row").distinct(), "__row", "left_anti").select(*left.columns, *[F.lit(None).cast(limits.schema[c].dataType).alias(c) for c in added])
    return met.unionByName(none).drop("__row")


def _merged(totals: Mapping[str, tuple[str, str]]) -> list[Column]:
    """The totals of totals."""
    return [(F.sum if kind == "count" else getattr(F, kind))(_TOTAL + name).alias(_TOTAL + name) for name, (kind, _) in totals.items()]


def _blocks(levels: int) -> Column:
    """The blocks of 2 ** level numbers, each beginning at a multiple of its size, that make up the numbers from __first to before __end."""
    one = F.lit(1).cast("bigint")

    def of_level(k: Column) -> Column:
        first = F.call_function("shiftright", F.col("__first") + F.call_function("shiftleft", one, k) - 1, k)
        end = F.call_function("shiftright", F.col("__end"), k)
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias(_LEVEL), first.alias(_BIN)))
        return F.array(left, F.when((first < end) & (end % 2 == 1), F.struct(k.alias(_LEVEL), (end - 1).alias(_BIN))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)), lambda b: b.isNotNull())


def _interval_totals(
    df: DataFrame, value: str, limits: DataFrame, low: str, high: str, by: list[str], closed: str, how: str, totals: Mapping[str, tuple[str, str]],
) -> DataFrame:
    if any(kind not in ("count", "min", "max") for kind, _ in totals.values()) or set(totals) & set(df.columns):
        raise ValueError("totals are count, min or max, under names that df does not have")
    number = F.col(value).cast("double") + F.lit(0.0)  # one zero
    points = df.filter(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias(_LOW)).distinct()
    ends = limits.select("*", (F.col(low).cast("double") + 0.0).alias(_LOW), (F.col(high).cast("double") + 0.0).alias(_HIGH))
    ends = ends.groupBy(*by, _LOW, _HIGH).agg(*[getattr(F, kind)(column).alias(_TOTAL + name) for name, (kind, column) in totals.items()])
    none = [F.lit(None).cast(ends.schema[_TOTAL + name].dataType).alias(_TOTAL + name) for name in totals]
    points = points.select(*by, _LOW, F.col(_LOW).alias(_HIGH), *none, F.lit(1).cast("bigint").alias("__point"))
    rows = points.union(ends.withColumn("__point", F.lit(0).cast("bigint")))
    # how many values come before the first one that an interval holds, and up to its last; an open end lies beyond all values
    point, sizes = F.col("__point"), group_sizes(rows, by)
    starts = F.when(point == 1, 1).otherwise(0 if closed in ("left", "both") else 2)
    rows = running_totals(rows, by, [F.col(_LOW).asc_nulls_first(), starts], {"__first": point}, sizes=sizes)
    stops = F.when(point == 1, 1).otherwise(2 if closed in ("right", "both") else 0)
    rows = running_totals(rows, by, [F.col(_HIGH).asc_nulls_last(), stops], {"__end": point}, sizes=sizes)
    rows = materialise(rows, "numbered")
    levels = (rows.agg(F.max("__first")).first()[0] or 0).bit_length()
    blocks = rows.filter((point == 0) & (F.col("__first") < F.col("__end"))).withColumn("__block", F.explode(_blocks(levels)))
    names = {c: f"__by_{c}" for c in by}
    blocks = blocks.groupBy(*[F.col(c).alias(names[c]) for c in by], f"__block.{_LEVEL}", f"__block.{_BIN}").agg(*_merged(totals))
    around = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("__at"), F.call_function("shiftright", F.col("__end") - 1, k).alias("__in")))
    probing = rows.filter(point == 1).select(*by, F.col(_LOW).alias("__value"), F.inline(around))
    test = (F.col("__at") == F.col(_LEVEL)) & (F.col("__in") == F.col(_BIN))
    for c in by:
        test = test & probing[c].eqNullSafe(F.col(names[c]))
    met = probing.join(blocks, test).groupBy(*[F.col(c).alias(f"__by_{c}") for c in by], "__value").agg(*_merged(totals))
    same = number == F.col("__value")
    for c in by:
        same = same & df[c].eqNullSafe(F.col(names[c]))
    found = {name: F.coalesce(F.col(_TOTAL + name), F.lit(0)) if kind == "count" else F.col(_TOTAL + name) for name, (kind, _) in totals.items()}
    return df.join(met, same, how).select(*[df[c] for c in df.columns], *[c.alias(name) for name, c in found.items()])
