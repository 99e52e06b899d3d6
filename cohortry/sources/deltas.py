"""Mergeable totals per key, kept as one folder per step and folded now and then.

A step (a micro-batch) writes the totals of its own rows to ``batch=<id>``, replaced as a whole when the
step is repeated. The totals of everything are those folders merged. ``fold`` merges them into
``upto=<id>``, so reading stays as cheap as the number of steps since. A folder counts once Spark has
marked it as complete, so a fold that fails midway leaves everything as it was.

What may be kept are totals that can be merged in any order and grouping: counts, sums of
whole numbers and decimals, extremes, sketches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.workspace import file_system


@dataclass(frozen=True)
class Measure:
    """An aggregate in mergeable parts, all in SQL: what a step adds up, how parts merge, what they mean.

    ``parts`` maps a suffix to the aggregate over rows, ``merges`` to the function that merges stored parts, and
    ``result`` has a place for each merged part.
    """

    parts: Mapping[str, str]
    merges: Mapping[str, str]
    result: str = "{0}"

    def stored(self, name: str) -> list[Column]:
        return [F.expr(aggregate).alias(f"{name}__{part}") for part, aggregate in self.parts.items()]

    def merged(self, name: str) -> list[Column]:
        return [F.expr(f"{merge}(`{name}__{part}`)").alias(f"{name}__{part}") for part, merge in self.merges.items()]

    def finished(self, name: str) -> Column:
        return F.expr(self.result.format(*[f"`{name}__{part}`" for part in self.parts])).alias(name)


def _cents(column: str) -> str:
    return f"sum(cast(round(`{column}` * 100) AS bigint))"


def rows() -> Measure:
    """Number of rows."""
    return Measure({"n": "count(1)"}, {"n": "sum"}, "coalesce({0}, 0L)")


def counted(column: str) -> Measure:
    """Number of rows with a value."""
    return Measure({"n": f"count(`{column}`)"}, {"n": "sum"}, "coalesce({0}, 0L)")


def summed(column: str) -> Measure:
    """Sum of whole numbers or decimals; NULL while no row has a value. Sums of doubles depend on their order: use ``money``."""
    return Measure({"s": f"sum(`{column}`)"}, {"s": "sum"})


def cents_of(column: str) -> Measure:
    """Sum of two-decimal amounts in whole cents."""
    return Measure({"c": _cents(column)}, {"c": "sum"})


def money(column: str) -> Measure:
    """Sum of two-decimal amounts, added as whole cents."""
    return Measure({"c": _cents(column)}, {"c": "sum"}, "cast({0} AS double) / 100")


def mean_of(column: str) -> Measure:
    """Mean of two-decimal amounts, added as whole cents."""
    return Measure({"c": _cents(column), "n": f"count(`{column}`)"}, {"c": "sum", "n": "sum"}, "cast({0} AS double) / cast(100 * nullif({1}, 0) AS double)")


def lowest(column: str) -> Measure:
    return Measure({"v": f"min(`{column}`)"}, {"v": "min"})


def highest(column: str) -> Measure:
    return Measure({"v": f"max(`{column}`)"}, {"v": "max"})


def distinct_estimate(column: str, lg_k: int = 12) -> Measure:
    """Estimated number of distinct values, by a sketch of fixed size (2 ** lg_k registers)."""
    return Measure({"sketch": f"hll_sketch_agg(`{column}`, {lg_k})"}, {"sketch": "hll_union_agg"}, "hll_sketch_estimate({0})")


class Deltas:
    """Totals per key in one folder; ``keys`` are columns of what is written, ``measures`` their totals."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: Mapping[str, Measure]):
        self.spark, self.path, self.keys, self.measures = spark, path.rstrip("/"), list(keys), dict(measures)

    def totals(self, df: DataFrame) -> DataFrame:
        """Totals of some rows, as they are stored."""
        return df.groupBy(*self.keys).agg(*[c for name, m in self.measures.items() for c in m.stored(name)])

    def write(self, df: DataFrame, step: int) -> None:
        """Store the totals of the rows of a step."""
        self.totals(df).write.mode("overwrite").parquet(f"{self.path}/batch={step}")

    def _folders(self) -> tuple[dict[int, str], dict[int, str]]:
        """Complete folders of folds and of steps."""
        system, where = file_system(self.spark, self.path)
        found: tuple[dict[int, str], dict[int, str]] = ({}, {})
        if system.exists(where):
            for status in system.listStatus(where):
                kind, _, number = status.getPath().getName().partition("=")
                done = file_system(self.spark, f"{status.getPath()}/_SUCCESS")[1]
                if kind in ("upto", "batch") and system.exists(done):
                    found[kind == "batch"][int(number)] = str(status.getPath())
        return found

    def _live(self, before: int | None = None) -> tuple[list[str], int | None]:
        """Folders that make up the totals of the steps below ``before``, and the last step among them."""
        folds, steps = ({k: v for k, v in f.items() if before is None or k < before} for f in self._folders())
        base = max(folds, default=None)
        new = {k: v for k, v in steps.items() if base is None or k > base}
        last = max([*new, *([base] if base is not None else [])], default=None)
        return [*([folds[base]] if base is not None else []), *new.values()], last

    def _schema(self, like: DataFrame) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.totals(like).schema.fields])

    def merged(self, like: DataFrame, before: int | None = None) -> DataFrame:
        """Stored totals of all steps, or of those below ``before``; ``like`` has the columns of the rows."""
        folders, _ = self._live(before)
        schema = self._schema(like)
        stored = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return stored.groupBy(*self.keys).agg(*[c for name, m in self.measures.items() for c in m.merged(name)])

    def finished(self, merged: DataFrame) -> DataFrame:
        return merged.select(*self.keys, *[m.finished(name) for name, m in self.measures.items()])

    def regrouped(self, like: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
        """Totals of coarser groups, merged from the stored ones without reading any row again."""
        merged = self.merged(like).groupBy(*[c.alias(name) for name, c in keys.items()])
        totals = merged.agg(*[c for name, m in self.measures.items() for c in m.merged(name)])
        return totals.select(*keys, *[m.finished(name) for name, m in self.measures.items()])

    def fold(self, like: DataFrame, *, before: int | None = None, after: int = 16) -> bool:
        """Merge the folders of the steps below ``before`` into one once there are more than ``after``.

        What an earlier fold replaced is removed now, not what this one does: tables read before may still need it.
        """
        folders, last = self._live(before)
        if len(folders) <= after or last is None:
            return False
        folds, steps = self._folders()
        old = [v for k, v in folds.items() if k < max(folds)] + [v for k, v in steps.items() if folds and k <= max(folds)]
        self.merged(like, before).write.mode("overwrite").parquet(f"{self.path}/upto={last}")
        for folder in old:
            system, where = file_system(self.spark, folder)
            system.delete(where, True)
        return True
