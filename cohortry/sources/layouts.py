"""Tables laid out for later reads: by buckets of a key, by partitions, and by pages of an order."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.plans.ordered import numbered
from cohortry.sources.workspace import new_path


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, *, path: str | None = None) -> DataFrame:
    """Store a query as the table ``name``, dealt to ``buckets`` by the hash of ``keys`` and sorted by them within each.

    Tables with the same buckets of the joined keys are joined, and grouped by these keys, without a shuffle. A key that holds a large
    share of the rows makes one large bucket: take such a table as it is and let adaptive execution split the join.
    Each task would write a file for each bucket, so rows are dealt to the buckets' tasks first.
    """
    keys = list(keys)
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path or new_path(df.sparkSession, f"bucketed-{name}")).saveAsTable(name)
    return df.sparkSession.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Remove a stored table's name; its files stay in the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write rows to the folders of their partitions, in place of what those held; other partitions keep their files.

    Rows of a partition are dealt to several tasks, so a large one does not gather in one.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(*by, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of such folders with declared types, also of the columns that are folder names."""
    return spark.read.schema(schema).parquet(path)


def counted_write(df: DataFrame, path: str, counts: dict[str, Column], *, by: Sequence[str] = ()) -> dict[str, int]:
    """Write a table and return how many of its rows meet each condition, counted by the write itself.

    Nothing is read twice: the counts are collected by the tasks that write. A condition that is NULL is not met.
    Counts of a write whose tasks were run again are those of the attempts that were kept.
    """
    seen = Observation()
    rows = "rows written" if "rows" in counts else "rows"
    met = [F.count(F.when(test, F.lit(1))).alias(name) for name, test in counts.items()]
    writer = df.observe(seen, F.count(F.lit(1)).alias(rows), *met).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return dict(seen.get)


@dataclass(frozen=True)
class PageDirectory:
    """Rows stored in an order, and where each page of them begins, so that any page is one range of keys."""

    rows: DataFrame
    pages: DataFrame  # page (from 0), rows, and the first and last values of the order's columns
    order: tuple[str, ...]

    def _bounds(self, page: int) -> dict | None:
        found = self.pages.filter(F.col("page") == page).first()
        return found.asDict() if found else None

    def read(self, page: int) -> DataFrame:
        """The rows of a page, in order; none beyond the last. Its range of keys reaches the Parquet reader, which opens only what overlaps."""
        bounds = self._bounds(page)
        if bounds is None:
            return self.rows.limit(0)
        lead = self.order[0]
        low, high = ([F.lit(bounds[f"{end}_{c}"]) for c in self.order] for end in ("first", "last"))
        inside = F.col(lead).between(low[0], high[0])
        if len(self.order) > 1:
            key = F.struct(*self.order)
            inside = inside & (key >= F.struct(*[v.alias(c) for v, c in zip(low, self.order, strict=True)])) & (key <= F.struct(*[v.alias(c) for v, c in zip(high, self.order, strict=True)]))
        return self.rows.filter(inside).orderBy(*self.order)


def page_directory(df: DataFrame, order: Sequence[str], page_rows: int, path: str, *, files: int | None = None) -> PageDirectory:
    """Store ``df`` sorted by ``order`` with a directory of pages of ``page_rows`` rows.

    ``order`` must be unique and without NULL. Rows are numbered slice by slice, never in one task, and the directory holds a row for each
    page, also stored. Finding a page reads that row; no page before it is read.
    """
    if page_rows < 1:
        raise ValueError("a page has at least one row")
    order = tuple(order)
    spark = df.sparkSession
    ranked = numbered(df, [], list(order), "__rn", max_group_rows=0)
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranked.schema.fields])
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    no_key = functools.reduce(operator.or_, [F.col(c).isNull() for c in order])
    if not stored.filter(no_key).isEmpty():
        raise ValueError("a column of the order is NULL")
    key = F.struct(*order)
    pages = stored.groupBy(F.floor((F.col("__rn") - 1) / page_rows).alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    pages = pages.select("page", "rows", *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in order])
    count = math.ceil(stored.count() / page_rows / 100_000) or 1
    pages.repartitionByRange(count, "page").sortWithinPartitions("page").write.mode("overwrite").parquet(f"{path}/pages")
    return open_pages(spark, path, df.schema, order)


def open_pages(spark: SparkSession, path: str, schema: T.StructType, order: Sequence[str]) -> PageDirectory:
    """A stored directory, opened again."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return PageDirectory(spark.read.schema(nullable).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/pages"), tuple(order))
