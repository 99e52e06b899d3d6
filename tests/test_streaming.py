import json

from pyspark.sql import functions as F

from cohortry.operators.aggregates import visits_by
from cohortry.operators.quality import text_rules
from cohortry.sources import load, load_stream, new_path
from cohortry.streaming import (
    alert_stream, count_windows, run_to_table, run_validation, users_per_window, visits_per_window, with_event_time,
)
from tests.helpers import values

EVENT = "event_id int, ts timestamp_ntz, user_id int, value double"


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id int, t string, user_id int, value double")
    df = df.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "value")
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENT).parquet(path)


def test_closed_windows_equal_the_batch(spark, folder):
    base = new_path(spark, "w")
    events = load_stream(spark, folder, "events")
    got = run_to_table(visits_per_window(events, "ts", "day"), f"{base}/t", f"{base}/c")
    batch = visits_by(load(spark, folder, "events"), "ts", "day")
    closed, everything = values(got), values(batch)
    assert closed == everything[: len(closed)] and len(everything) - len(closed) == 1


def test_users_per_window_is_exact(spark, folder):
    base = new_path(spark, "u")
    events = load_stream(spark, folder, "events")
    got = run_to_table(users_per_window(events, "ts", "user_id", "week"), f"{base}/t", f"{base}/c")
    batch = dict(values(visits_by(load(spark, folder, "events"), "ts", "week", id="user_id")))
    assert got.count() > 0
    assert all(batch[r.week] == r.ids for r in got.collect())


def test_approximate_users(spark, folder):
    base = new_path(spark, "a")
    events = load_stream(spark, folder, "events")
    windows = visits_per_window(events, "ts", "week", approx_id="user_id")
    assert windows.columns == ["week", "visits", "ids"]
    assert run_to_table(windows, f"{base}/t", f"{base}/c").count() > 0


def test_late_row_is_dropped_and_restart_adds_nothing(spark):
    base = new_path(spark, "late")
    source = f"{base}/in"

    def run():
        return run_to_table(visits_per_window(stream(spark, source), "ts", "day"), f"{base}/t", f"{base}/c")

    write(spark, [(1, "2024-01-01 10:00:00", 1, 1.0), (2, "2024-01-01 12:00:00", 2, 1.0), (3, "2024-01-02 12:00:00", 1, 1.0)], source)
    assert values(run()) == [("2024-01-01", 2)]
    assert values(run()) == [("2024-01-01", 2)]  # restarted with nothing new
    write(spark, [(4, "2024-01-01 13:00:00", 3, 1.0), (5, "2024-01-03 09:00:00", 1, 1.0)], source)
    # Row 4 belongs to a window that is already closed: it is dropped, not added as a second row.
    assert values(run()) == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_alerts_across_a_restart(spark):
    base = new_path(spark, "alerts")
    source = f"{base}/in"

    def run():
        found = alert_stream(stream(spark, source), {"value": 100, "user_id": 5}, "any")
        return run_to_table(found.select("event_id", "alert"), f"{base}/t", f"{base}/c")

    write(spark, [(1, "2024-01-01", 1, 101.0), (2, "2024-01-01", 6, 1.0), (3, "2024-01-01", 1, 1.0)], source)
    first = [(1, "abnormal values: value"), (2, "abnormal values: user_id")]
    assert values(run()) == first
    write(spark, [(4, "2024-01-02", 9, 200.0)], source)
    assert values(run()) == [*first, (4, "abnormal values: value, user_id")]
    assert len(values(run())) == 3


def test_validation_replaces_a_repeated_batch(spark, folder):
    base = new_path(spark, "v")
    parts = load_stream(spark, folder, "part").select("p_partkey", F.lower("p_type").alias("p_type"), "p_name")
    rules = text_rules(["p_name"])
    paths = (f"{base}/good", f"{base}/rejected", f"{base}/c")
    good, rejected = run_validation(parts, rules, *paths)
    total = load(spark, folder, "part").count()
    counts = (good.count(), rejected.count())
    assert sum(counts) == total
    # The same batch once more under a new checkpoint writes to the same folder.
    good, rejected = run_validation(parts, rules, paths[0], paths[1], f"{base}/c2")
    assert (good.count(), rejected.count()) == counts


def test_event_time_keeps_its_columns(spark, folder):
    events = load_stream(spark, folder, "events")
    timed = with_event_time(events, "ts", "1 hour")
    assert timed.columns == events.columns and json.loads(timed.schema.json())["fields"][1]["type"] == "timestamp"


def test_counted_windows_are_complete_whatever_the_order_of_files(spark, folder):
    from pyspark.sql import functions as F

    from cohortry.sources import load

    events = load(spark, folder, "events")
    source = new_path(spark, "events")
    parts = events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    for k, part in enumerate((2, 0, 1)):  # every file holds all days; the newest comes first
        chosen = parts.filter(F.col("part") == part).drop("part").orderBy(F.desc("ts"))
        chosen.coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    base = new_path(spark, "windows")
    days = count_windows(arriving, "ts", "day", f"{base}/d", f"{base}/dc")
    want = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("visits"))
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, want.collect()))
    users = count_windows(arriving, "ts", "week", f"{base}/w", f"{base}/wc", id="user_id").collect()
    weeks = events.groupBy(F.date_trunc("week", "ts")).agg(F.count_distinct("user_id").alias("ids"), F.count("*").alias("visits"))
    assert sorted((r.ids, r.visits) for r in users) == sorted((r.ids, r.visits) for r in weeks.collect())
    more = count_windows(arriving, "ts", "day", f"{base}/d", f"{base}/dc")  # nothing new: the same counts
    assert more.agg(F.sum("visits")).first()[0] == events.count()
    nothing = spark.readStream.schema(events.schema).parquet(new_path(spark, "none") + "*")
    assert count_windows(nothing, "ts", "day", f"{base}/n", f"{base}/nc").count() == 0
