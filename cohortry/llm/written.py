"""Numbers of rows in the order in which one job wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.sources.workspace import materialise

_STRETCH = 1024  # files whose rows are added up in one group


def numbered_as_written(df: DataFrame, name: str) -> DataFrame:
    """Rows of Parquet files with their number, from 0, in the order in which one job wrote them.

    ``df`` must be a plain scan: files count in order of their part numbers, rows as they lie in them. Only the
    positions are read to total the files. The totals, a row a file, are summed in stretches of files and then over
    the stretches, and written, so that Spark knows their size when it joins them. Nothing goes to the driver. An empty table stays empty.
    """
    part = F.struct(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.file_name").alias("file"))
    placed = df.select("*", part.alias("__part"), F.col("_metadata.row_index").alias("__at"))
    sizes = placed.groupBy("__part").agg((F.max("__at") + 1).alias("__n")).withColumn("__stretch", F.expr(f"__part.part div {_STRETCH}"))
    totals = sizes.groupBy("__stretch").agg(F.sum("__n").alias("__t"))
    earlier = F.sum("__t").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("__stretch", F.coalesce(earlier, F.lit(0)).alias("__start"))
    within = F.sum("__n").over(Window.partitionBy("__stretch").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.withColumn("__within", F.coalesce(within, F.lit(0))).join(starts, "__stretch")
    known = materialise(before.select("__part", (F.col("__start") + F.col("__within")).alias("__before")), "files")
    return placed.join(known, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
