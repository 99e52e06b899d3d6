"""Streaming forms of the row checks, the alerts and the counts per day and week.

Checks of rows and alerts keep no state. Counts of ``count_windows``, sketches and running means keep totals in
the shared folder, which are complete at any time; the key check keeps a count per key in Spark's state store. The
windowed counts that write each window once, when it is final, keep one state row per open window (and id),
dropped once the watermark passes the window; rows later than ``lateness`` are not in them. Sinks and checkpoints live in the shared folder, and a batch that
is run again after a failure replaces its own output, so nothing is written twice.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.dates import date_text, week_label
from cohortry.functions.numbers import cents
from cohortry.operators.filters import any_of
from cohortry.operators.quality import alerts, with_broken_rules
from cohortry.plans.ordered import DEFAULT_GROUP_ROWS, running_totals
from cohortry.sources.deltas import Deltas, cents_of, counted, distinct_estimate, rows

# Windows start on Thursday 1970-01-01; four days later is a Monday.
_GRAINS = {"day": ("1 day", "0 days", date_text), "week": ("7 days", "4 days", week_label)}


def with_event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Event time as an instant with a watermark; file timestamps without zone are not accepted."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def visits_per_window(
    stream: DataFrame, ts: str, grain: str = "day", *, lateness: str = "1 hour", approx_id: str | None = None,
    name: str = "visits",
) -> DataFrame:
    """Rows per day or ISO week; with ``approx_id`` also the estimated number of distinct ids."""
    length, start, label = _GRAINS[grain]
    aggregates = [F.count(F.lit(1)).alias(name)]
    if approx_id is not None:
        aggregates.append(F.approx_count_distinct(approx_id).alias("ids"))
    windowed = with_event_time(stream, ts, lateness).groupBy(F.window(ts, length, startTime=start)).agg(*aggregates)
    return windowed.select(label("window.start").alias(grain), *windowed.columns[1:])


def users_per_window(
    stream: DataFrame, ts: str, id: str, grain: str = "day", *, lateness: str = "1 hour", name: str = "ids",
) -> DataFrame:
    """Exact distinct ids (and rows) per day or ISO week.

    A stream cannot count distinct values directly. Grouping by (window, id) first and counting
    those groups per window is exact, and spreads a busy window over all tasks.
    """
    length, start, label = _GRAINS[grain]
    per_id = (
        with_event_time(stream, ts, lateness)
        .groupBy(F.window(ts, length, startTime=start), id)
        .agg(F.count(F.lit(1)).alias("visits"))
    )
    windowed = per_id.groupBy(F.window(F.window_time("window"), length, startTime=start)).agg(
        F.count(F.lit(1)).alias(name), F.sum("visits").alias("visits")
    )
    return windowed.select(label("window.start").alias(grain), name, "visits")


def alert_stream(stream: DataFrame, limits: Mapping[str, float], mode: str = "all", message: str = "abnormal values") -> DataFrame:
    """Alerts on arriving rows; the batch operator applied to a stream."""
    return alerts(stream, limits, mode, message)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available, append closed results to a table, and return that table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def keep_totals(stream: DataFrame, deltas: Deltas, checkpoint: str, *, fold_after: int = 16) -> None:
    """Add the rows of what is available to stored totals, a step for each micro-batch.

    Batches before the running one are complete, so their totals are folded while the stream goes on.
    """
    like = stream.sparkSession.createDataFrame([], stream.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        deltas.fold(like, before=batch_id, after=fold_after)
        deltas.write(batch, batch_id)

    _run_batches(stream, write, checkpoint)
    deltas.fold(like, after=fold_after)


def count_windows(
    stream: DataFrame, ts: str, grain: str, path: str, checkpoint: str, *, id: str | None = None, name: str = "visits", fold_after: int = 16,
) -> DataFrame:
    """Rows (and exact distinct ids) of every day or ISO week of what is available, open windows included.

    Each micro-batch stores its own counts per window (and id), replaced as a whole when it is repeated;
    reading adds up those since the last fold. No state is kept in memory and no row is late, in whatever order files arrive.
    """
    length, start, label = _GRAINS[grain]
    window = F.window(F.col(ts).cast("timestamp"), length, startTime=start).alias("window")
    found = stream.select(window, *([F.col(id)] if id else []))
    deltas = Deltas(stream.sparkSession, path, found.columns, {name: rows()})
    keep_totals(found, deltas, checkpoint, fold_after=fold_after)
    per_key = deltas.finished(deltas.merged(stream.sparkSession.createDataFrame([], found.schema)))
    if id is None:
        return per_key.select(label("window.start").alias(grain), name)
    per_window = per_key.groupBy("window").agg(F.count(F.lit(1)).alias("ids"), F.sum(name).alias(name))
    return per_window.select(label("window.start").alias(grain), "ids", name)


def sketch_days(stream: DataFrame, ts: str, id: str, path: str, checkpoint: str, *, lg_k: int = 12) -> tuple[Deltas, DataFrame]:
    """Rows and a sketch of the distinct ids of each day (column ``day``, a date), stored as mergeable totals.

    Returns the stored totals and an empty table of the rows they are of: ``Deltas.regrouped`` unites days into weeks, months or any other
    period without reading a row again. A day's sketch has a fixed size however many ids it has.
    """
    found = stream.select(F.to_date(ts).alias("day"), F.col(id).alias("id"))
    deltas = Deltas(stream.sparkSession, path, ["day"], {"visits": rows(), "ids": distinct_estimate("id", lg_k)})
    keep_totals(found, deltas, checkpoint)
    return deltas, stream.sparkSession.createDataFrame([], found.schema)


def check_key_stream(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str, name: str = "rows") -> DataFrame:
    """Key values that break a primary key among all rows that ever arrived: repeated, or NULL in any column.

    The number of rows of each key is state that outlives batches and restarts. A batch stores the broken keys among
    those it changed with their counts so far, and the last count of a key is the highest. Files may come in any order.
    """
    counts = stream.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    broken = counts.filter((F.col(name) > 1) | any_of([F.col(c).isNull() for c in columns]))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run_batches(broken, write, checkpoint, "update")
    return _batches(stream.sparkSession, path, broken.schema).groupBy(*columns).agg(F.max(name).alias(name))


def running_mean_stream(
    stream: DataFrame, by: Sequence[str], order: Sequence[str], column: str, path: str, checkpoint: str, *,
    name: str = "running_mean", max_group_rows: int = DEFAULT_GROUP_ROWS, fold_after: int = 16,
) -> DataFrame:
    """Mean of a two-decimal amount over the group's rows up to each row, across micro-batches; NULLs are not counted.

    Rows count in the order of their batches and within a batch by ``order``, which must be unique in it, so rows that arrive in order get the batch
    operator's mean, and a row that comes late gets the mean of what had come before it. Carried from batch
    to batch are a sum in whole cents and a count for each group. A batch that is run again takes only earlier batches
    into account and replaces its own output.
    """
    spark, by = stream.sparkSession, list(by)
    like = spark.createDataFrame([], stream.schema)
    deltas = Deltas(spark, f"{path}/totals", by, {"sum": cents_of(column), "n": counted(column)})
    schema = T.StructType([*stream.schema.fields, T.StructField(name, T.DoubleType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            deltas.fold(like, before=batch_id, after=fold_after)
            addends = {"__sum": F.coalesce(cents(column), F.lit(0)), "__n": F.col(column).isNotNull().cast("bigint")}
            within = running_totals(batch, by, order, addends, max_group_rows=max_group_rows)
            before = deltas.finished(deltas.merged(like, batch_id)).select(*[F.col(c).alias(f"__before_{c}") for c in [*by, "sum", "n"]])
            same = functools.reduce(operator.and_, [within[c].eqNullSafe(before[f"__before_{c}"]) for c in by])
            total, n = (F.col(f"__{c}") + F.coalesce(f"__before_{c}", F.lit(0)) for c in ("sum", "n"))
            mean = total.cast("double") / (F.nullif(n, F.lit(0)) * 100).cast("double")
            within.join(before, same, "left").select(*stream.columns, mean.alias(name)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
            deltas.write(batch, batch_id)
        finally:
            batch.unpersist()

    _run_batches(stream, write, checkpoint)
    return _batches(spark, f"{path}/rows", schema)


def _run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything the micro-batches wrote; an empty folder makes that readable before the first."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def run_validation(
    stream: DataFrame, rules: Mapping[str, Column], good_path: str, rejected_path: str, checkpoint: str
) -> tuple[DataFrame, DataFrame]:
    """Send rows that pass every rule to one table and the others, with reasons, to another.

    Both tables have one folder per micro-batch, replaced as a whole when the batch is repeated.
    """
    checked = with_broken_rules(stream, rules)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            ok = F.size("broken_rules") == 0
            batch.filter(ok).drop("broken_rules").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            batch.filter(~ok).write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    _run_batches(checked, write, checkpoint)
    spark = stream.sparkSession
    return _batches(spark, good_path, stream.schema), _batches(spark, rejected_path, checked.schema)
