"""Tables that are written: appends, replacements, snapshots filled later, conditional updates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.workspace import file_system


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table with a declared schema and no rows."""
    return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    """Insert rows."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Put the rows in place of a table's: written beside it first, so a failure leaves the old rows.

    A query may read the very table it replaces.
    """
    beside, before = (f"{path.rstrip('/')}.{label}-{uuid.uuid4().hex}" for label in ("new", "old"))
    df.write.mode("errorifexists").parquet(beside)
    system, target = file_system(df.sparkSession, path)
    new, old = (file_system(df.sparkSession, p)[1] for p in (beside, before))
    there = system.exists(target)
    if there and not system.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not system.rename(new, target):
        if there:
            system.rename(old, target)
        raise OSError(f"cannot replace {path}")
    if there:
        system.delete(old, True)


def snapshot(df: DataFrame, path: str, *, sort_by: list[str] | None = None) -> DataFrame:
    """Create (or replace) a table from a query and return it.

    ``sort_by`` range-partitions and sorts the files by a lookup key, so that a later filter on
    it skips row groups by their min/max statistics. A hash of the row extends the key, so the
    rows of one frequent value are spread over several files.
    """
    if sort_by:
        df = df.repartitionByRange(*sort_by, F.xxhash64(*df.columns)).sortWithinPartitions(*sort_by)
    replace(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Name a query so SQL can read it; the view stays lazy and is inlined by the optimizer."""
    df.createOrReplaceTempView(name)
    return df


def drop_view(spark: SparkSession, name: str) -> bool:
    """Forget a named query; False when there was none."""
    return spark.catalog.dropTempView(name)


def update_where(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Set columns on the rows meeting ``condition``; a NULL condition leaves the row alone.

    Every new value is computed from the row as it was, so the order of ``changes`` is irrelevant.
    """
    unknown = set(changes) - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    return df.select(
        *[
            F.when(condition, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in df.columns
        ]
    )


def union_children(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """Read a parent table together with its children; columns only a child has are not shown."""
    result = parent
    for child in children:
        result = result.unionByName(child.select(*parent.columns))
    return result


class Snapshot:
    """A stored query result that can exist before it is first filled."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[], DataFrame]):
        self.spark = spark
        self.path = path
        self.build = build
        self.schema: T.StructType | None = None

    def _declared(self, query: DataFrame) -> T.StructType:
        # Parquet gives every column back as nullable, so declare it that way from the start.
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in query.schema.fields])

    def create_empty(self) -> DataFrame:
        """Store the schema of the query without running it."""
        self.schema = self._declared(self.build())
        replace(empty(self.spark, self.schema), self.path)
        return self.read()

    def refresh(self) -> DataFrame:
        """Run the query and replace the stored rows."""
        query = self.build()
        replace(query, self.path)
        self.schema = self._declared(query)
        return self.read()

    def read(self) -> DataFrame:
        if self.schema is None:
            raise RuntimeError("create_empty() or refresh() first")
        return self.spark.read.schema(self.schema).parquet(self.path)
