"""The streaming jobs, run over what is available and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.dates import week_label
from cohortry.operators.quality import text_rules
from cohortry.reports.registry import Tables, report
from cohortry.reports.writing import _BROKEN_SQL, outcome_counts, parts_to_check
from cohortry.sources import append, load_stream, new_path
from cohortry.streaming import (
    alert_stream,
    check_key_stream,
    count_windows,
    run_to_table,
    run_validation,
    running_mean_stream,
    sketch_days,
    users_per_window,
    visits_per_window,
)


def _run(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    base = new_path(t.spark, label)
    return run_to_table(stream, f"{base}/table", f"{base}/checkpoint")


@report("""
    SELECT event_id, user_id, value, concat('abnormal values: ', concat_ws(', ',
             CASE WHEN value > 100 THEN 'value' END, CASE WHEN user_id > 120 THEN 'user_id' END)) AS alert
    FROM events WHERE event_type = 'error' AND (value > 100 OR user_id > 120)""")
def stream_alerts(t: Tables) -> DataFrame:
    errors = load_stream(t.spark, t.folder, "events").filter(F.col("event_type") == "error")
    found = alert_stream(errors, {"value": 100, "user_id": 120}, mode="any")
    return _run(t, found.select("event_id", "user_id", "value", "alert"), "alerts")


@report(_BROKEN_SQL)
def stream_validate(t: Tables) -> DataFrame:
    base = new_path(t.spark, "validate")
    parts = parts_to_check(load_stream(t.spark, t.folder, "part"))
    good, rejected = run_validation(
        parts, text_rules(["p_name", "p_type"]), f"{base}/good", f"{base}/rejected", f"{base}/checkpoint"
    )
    return outcome_counts(good, rejected)


_WEEK = """CAST(year(date_trunc('week', ts)) AS VARCHAR) || '-W' ||
           lpad(CAST(weekofyear(date_trunc('week', ts)) AS VARCHAR), 2, '0')"""


def _counted(t: Tables, grain: str, id: str | None = None) -> DataFrame:
    base = new_path(t.spark, f"{grain}s")
    events = load_stream(t.spark, t.folder, "events")
    return count_windows(events, "ts", grain, f"{base}/table", f"{base}/checkpoint", id=id)


@report("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS visits FROM events GROUP BY 1")
def stream_day_counts(t: Tables) -> DataFrame:
    return _counted(t, "day")


@report(f"SELECT {_WEEK} AS week, count(*) AS visits FROM events GROUP BY 1")
def stream_week_counts(t: Tables) -> DataFrame:
    return _counted(t, "week")


@report(f"SELECT {_WEEK} AS week, count(DISTINCT user_id) AS ids, count(*) AS visits FROM events GROUP BY 1")
def stream_week_users(t: Tables) -> DataFrame:
    return _counted(t, "week", "user_id")


_CLOSED = "<= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@report(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS visits FROM events GROUP BY 1, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY {_CLOSED}")
def stream_closed_days(t: Tables) -> DataFrame:
    return _run(t, visits_per_window(load_stream(t.spark, t.folder, "events"), "ts", "day"), "closed")


@report(f"""
    SELECT {_WEEK} AS week, count(DISTINCT user_id) AS ids, count(*) AS visits FROM events
    GROUP BY 1, date_trunc('week', ts) HAVING date_trunc('week', ts) + INTERVAL 7 DAY {_CLOSED}""")
def stream_closed_week_users(t: Tables) -> DataFrame:
    return _run(t, users_per_window(load_stream(t.spark, t.folder, "events"), "ts", "user_id", "week"), "closed")


@report("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def stream_key_check(t: Tables) -> DataFrame:
    base = new_path(t.spark, "key")
    lines = load_stream(t.spark, t.folder, "lineitem")
    return check_key_stream(lines, ["l_orderkey", "l_linenumber"], f"{base}/broken", f"{base}/checkpoint")


@report("""
    SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / CAST(100 * count(value) OVER w AS DOUBLE) AS running_mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_running_mean(t: Tables) -> DataFrame:
    """The events arrive in four files in order of time, a micro-batch each."""
    base = new_path(t.spark, "means")
    events = t.events.select("event_id", "ts", "user_id", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * k / 4 for k in range(1, 4)]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        chosen = events.filter(F.lit(True) if low is None else F.col("ts") >= low).filter(F.lit(True) if high is None else F.col("ts") < high)
        append(chosen.coalesce(1), f"{base}/arrived")
    arriving = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrived")
    return running_mean_stream(arriving, ["user_id"], ["ts", "event_id"], "value", f"{base}/out", f"{base}/checkpoint").select("event_id", "user_id", "running_mean")


@report(f"SELECT {_WEEK} AS week, count(DISTINCT user_id) AS ids, count(*) AS visits, true AS near FROM events GROUP BY 1")
def sketch_week_users(t: Tables) -> DataFrame:
    """Weeks united from the sketches of their days, next to the exact count of ids: the estimate is within 5 %."""
    base = new_path(t.spark, "sketches")
    days, like = sketch_days(load_stream(t.spark, t.folder, "events"), "ts", "user_id", f"{base}/days", f"{base}/checkpoint")
    weeks = days.regrouped(like, {"start": F.date_trunc("week", "day")}).withColumnRenamed("ids", "estimate")
    exact = t.events.groupBy(F.date_trunc("week", "ts").alias("start")).agg(F.count_distinct("user_id").alias("ids"))
    near = F.abs(F.col("estimate") - F.col("ids")) * 20 <= F.col("ids")
    return weeks.join(exact, "start").select(week_label("start").alias("week"), "ids", "visits", near.alias("near"))
