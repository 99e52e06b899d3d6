"""Streaming jobs that remember earlier batches."""

import glob
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.operators.quality import check_key
from cohortry.sources import load, new_path
from cohortry.streaming import check_key_stream, count_windows, running_mean_stream, sketch_days
from tests.helpers import values

ROW = "id int, part int, who string, value double"


def arrive(spark, rows, path):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(path)


def test_the_key_check_remembers_earlier_files(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 1, 2]), "w", 0.0) for _ in range(40)]
    for seed in (1, 2):  # files in any order
        base = new_path(spark, "key")
        order = rows[:]
        random.Random(seed).shuffle(order)
        for k in range(0, 40, 10):
            arrive(spark, order[k : k + 10], f"{base}/in")
            if k in (10, 30):  # every call is a restart from the checkpoint
                got = check_key_stream(stream(spark, f"{base}/in"), ["id", "part"], f"{base}/out", f"{base}/c")
                assert values(got) == values(check_key(spark.createDataFrame(order[: k + 10], ROW), ["id", "part"]))
        again = check_key_stream(stream(spark, f"{base}/in"), ["id", "part"], f"{base}/out", f"{base}/c")
        assert values(again) == values(got)


def test_the_key_check_of_a_sound_key_finds_nothing(spark):
    base = new_path(spark, "sound")
    arrive(spark, [(k, 1, "w", 0.0) for k in range(5)], f"{base}/in")
    arrive(spark, [(k, 2, "w", 0.0) for k in range(5)], f"{base}/in")
    assert check_key_stream(stream(spark, f"{base}/in"), ["id", "part"], f"{base}/out", f"{base}/c").count() == 0


def means(rows):
    out, state = [], {}
    for id, _, who, value in rows:
        total, n = state.get(who, (0, 0))
        if value is not None:
            total, n = total + round(value * 100), n + 1
        state[who] = (total, n)
        out.append((id, total / (100 * n) if n else None))
    return sorted(out)


def test_running_means_go_on_across_batches_and_restarts(spark):
    rng = random.Random(5)
    rows = [(k, 0, rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(-5, 900), 2)])) for k in range(60)]
    for group_rows, fold_after in ((4_000_000, 16), (3, 1)):  # the second: groups too large for a task, totals folded at every step
        base = new_path(spark, "means")

        def run(source=f"{base}/in", out=f"{base}/out", checkpoint=f"{base}/c", most=group_rows, fold=fold_after):
            return running_mean_stream(stream(spark, source), ["who"], ["id"], "value", out, checkpoint, max_group_rows=most, fold_after=fold)

        for k in range(0, 60, 15):
            arrive(spark, rows[k : k + 15], f"{base}/in")
            if k >= 15:
                assert values(run(), "id", "running_mean") == means(rows[: k + 15])
        assert values(run(), "id", "running_mean") == means(rows)
        # all batches once more under a new checkpoint replace their own output
        assert values(run(checkpoint=f"{base}/c2"), "id", "running_mean") == means(rows)
    folds = glob.glob(f"{base}/out/totals/upto=*")
    assert folds and all(spark.read.parquet(f).columns == ["who", "sum__c", "n__n"] and spark.read.parquet(f).count() <= 3 for f in folds)  # a row a person


def test_a_late_row_counts_when_it_comes(spark):
    base = new_path(spark, "late")
    arrive(spark, [(5, 0, "a", 4.0)], f"{base}/in")
    arrive(spark, [(1, 0, "a", 2.0), (9, 0, "a", 3.0)], f"{base}/in")
    got = running_mean_stream(stream(spark, f"{base}/in"), ["who"], ["id"], "value", f"{base}/out", f"{base}/c")
    assert values(got, "id", "running_mean") == [(1, 3.0), (5, 4.0), (9, 3.0)]


def test_week_sketches_are_the_union_of_their_days(spark, folder):
    events = load(spark, folder, "events")
    base = new_path(spark, "sketch")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    days, like = sketch_days(arriving, "ts", "user_id", f"{base}/days", f"{base}/c")
    week = F.date_trunc("week", "ts").alias("week")
    direct = events.groupBy(week).agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(12))).alias("ids"), F.count("*").alias("visits"))
    got = days.regrouped(like, {"week": F.date_trunc("week", "day")})
    assert values(got, "week", "visits", "ids") == values(direct, "week", "visits", "ids")
    exact = {r.week: r.ids for r in events.groupBy(week).agg(F.count_distinct("user_id").alias("ids")).collect()}
    assert all(abs(r.ids - exact[r.week]) * 20 <= exact[r.week] for r in got.collect())
    assert values(days.regrouped(like, {"all": F.lit(1)}), "visits") == [(events.count(),)]
    assert all(f"{base}/days" in f for f in got.inputFiles())  # no event is read again


def test_counted_windows_are_folded(spark, folder):
    events = load(spark, folder, "events")
    base = new_path(spark, "folded")
    for k in range(6):
        events.filter(F.col("event_id") % 6 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    got = count_windows(arriving, "ts", "week", f"{base}/t", f"{base}/c", id="user_id", fold_after=2)
    week = F.date_trunc("week", "ts")
    want = events.groupBy(week).agg(F.count_distinct("user_id").alias("ids"), F.count("*").alias("visits"))
    assert sorted((r.ids, r.visits) for r in got.collect()) == sorted((r.ids, r.visits) for r in want.collect())
    assert len(glob.glob(f"{base}/t/batch=*")) < 6 and len(glob.glob(f"{base}/t/upto=*")) <= 2


def test_means_in_time_order_equal_the_window(spark, folder):
    events = load(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    base = new_path(spark, "ordered")
    for part in events.orderBy("ts").randomSplit([1.0], 1):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    got = running_mean_stream(arriving, ["user_id"], ["ts", "event_id"], "value", f"{base}/out", f"{base}/c")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = events.select("event_id", (F.sum(F.round(F.col("value") * 100).cast("long")).over(w).cast("double") / (100 * F.count("value").over(w))).alias("running_mean"))
    assert values(got, "event_id", "running_mean") == values(want)
