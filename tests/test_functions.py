import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.functions import Band, at_least, band, band_by, band_gaps, below, between
from cohortry.functions.table_functions import monthly_share, register_monthly_share


def column(spark, data, expr, type_="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {type_}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_band_edges(spark):
    rpe = [
        between("Rest", 0, 0), between("Easy", 1, 3), between("Moderate", 4, 6), between("Hard", 7, 9),
        between("Max", 10, 10),
    ]
    got = column(spark, [0.0, 1.0, 3.0, 3.5, 4.0, 6.0, 9.0, 10.0, 11.0, None], band("x", rpe))
    assert got == ["Rest", "Easy", "Easy", None, "Moderate", "Moderate", "Hard", "Max", None, None]


def test_band_other_and_null(spark):
    ldl = [below("Optimal", 100), between("Near optimal", 100, 130, "left")]
    data = [99.9, 100.0, 129.5, 130.0, None]
    assert column(spark, data, band("x", ldl, "Very high")) == [
        "Optimal", "Near optimal", "Near optimal", "Very high", None]
    assert column(spark, data, band("x", ldl, "Very high", other_includes_null=True))[-1] == "Very high"


def test_band_first_match_wins(spark):
    overlapping = [between("normal", 70, 100), between("raised", 100, 120)]
    assert column(spark, [100.0, 100.1], band("x", overlapping)) == ["normal", "raised"]


def test_band_closed_ends(spark):
    for closed, expected in {
        "left": ["in", None], "right": [None, "in"], "both": ["in", "in"], "neither": [None, None],
    }.items():
        assert column(spark, [1.0, 2.0], band("x", [Band("in", 1, 2, closed)])) == expected
    with pytest.raises(ValueError):
        Band("x", 1, 2, "open")
    with pytest.raises(ValueError):
        Band("x")


def test_band_by_group(spark):
    limits = {
        "Male": [below("anemia", 41), between("normal", 41, 50), at_least("high", 50, inclusive=False)],
        "Female": [below("anemia", 36), between("normal", 36, 48), at_least("high", 48, inclusive=False)],
    }
    df = spark.createDataFrame(
        [(1, "Male", 40.9), (2, "Male", 41.0), (3, "Male", 50.0), (4, "Male", 50.1), (5, "Female", 40.9),
         (6, "Female", 48.1), (7, "Other", 45.0), (8, "Male", None)], "i int, g string, x double")
    got = [r.b for r in df.select("i", band_by("x", "g", limits).alias("b")).orderBy("i").collect()]
    assert got == ["anemia", "normal", "normal", "high", "normal", "high", None, None]
    got = [r.b for r in df.select("i", band_by("x", "g", limits, "none").alias("b")).orderBy("i").collect()]
    assert got[6:] == ["none", None]


def test_within_limits(spark):
    limits = {"Male": (65.4, 119.3), "Female": (52.2, 91.9)}
    df = spark.createDataFrame(
        [(1, "Male", 65.4), (2, "Male", 119.4), (3, "Female", 52.2), (4, "Female", 52.1), (5, "Male", None)],
        "i int, g string, x double")
    assert [r.i for r in df.filter(fn.within_limits("x", "g", limits)).orderBy("i").collect()] == [1, 3]


def test_band_gaps():
    inf = float("inf")
    assert band_gaps([below("a", 10), at_least("b", 10)]) == []
    assert band_gaps([below("a", 11), between("b", 12, 13), at_least("c", 13, inclusive=False)]) == [(11, 12, "left")]
    assert band_gaps([below("a", 100), at_least("b", 100, inclusive=False)]) == [(100, 100, "both")]
    assert band_gaps([between("a", 0, 1)]) == [(-inf, 0, "neither"), (1, inf, "neither")]
    assert band_gaps([below("a", 5, inclusive=True), between("b", 5, 9, "right")]) == [(9, inf, "neither")]
    assert band_gaps([below("a", 5), between("b", 2, 9, "left")]) == [(9, inf, "left")]


def test_bins(spark):
    ages = [-1, 0, 4, 5, 99, 100, 101, None]
    assert column(spark, ages, fn.bin_label("x", 10), "int") == [
        "-10--1", "0-9", "0-9", "0-9", "90-99", "100-109", "100-109", None]
    assert column(spark, [63], fn.bin_label("x", 10, upper="exclusive"), "int") == ["60-70"]
    assert column(spark, [5, 6, 10], fn.bin_label("x", 5, offset=1), "int") == ["0-4", "5-9", "5-9"]
    assert column(spark, ages, fn.bucket_number("x", 0, 100, 20), "int") == [0, 1, 1, 2, 20, 21, 21, None]
    assert column(spark, ages, fn.bucket_label("x", 0, 100, 20), "int") == [
        "-5 - -1", "0 - 4", "0 - 4", "5 - 9", "95 - 99", "100 - 104", "100 - 104", None]
    with pytest.raises(ValueError):
        fn.bin_label("x", 5, upper="open")


def test_numbers(spark):
    assert column(spark, [0.0, 4.0, None], fn.ratio(F.lit(10), "x")) == [None, 2.5, None]
    assert column(spark, [0.0, 3.0], fn.percent(F.lit(1), "x", 2)) == [None, 33.33]
    df = spark.createDataFrame([(0.1,), (0.2,), (0.35,), (None,)], "x double")
    row = df.agg(fn.exact_sum("x").alias("s"), fn.exact_mean("x").alias("m"), fn.exact_mean("x", 2).alias("r"),
                 fn.mean("x").alias("a")).first()
    assert (row.s, row.m, row.r, row.a) == (0.65, 65 / 300, 0.22, 0.22)
    assert df.filter("x > 5").agg(fn.exact_mean("x").alias("m")).first().m is None


def test_text_and_null(spark):
    df = spark.createDataFrame(
        [(1, "Ann", "Lee"), (2, None, "Lee"), (3, "Ann", None), (4, None, None)], "i int, f string, l string")
    rows = df.select(
        fn.full_name("f", "l").alias("full"), fn.concat_null("f", F.lit(" "), "l").alias("strict"),
        fn.csv_line("i", "f", "l").alias("csv"), fn.derived_id("i").alias("uid"),
        fn.prefixed("l", "f", {"Ann": "Ms. "}).alias("p"),
        fn.failed_names({"a": F.col("i") > 1, "b": F.col("f").isNull(), "c": F.col("f") == "Ann"}, ",").alias("t"),
    ).collect()
    assert [r.full for r in rows] == ["Ann Lee", " Lee", "Ann ", " "]
    assert [r.strict for r in rows] == ["Ann Lee", None, None, None]
    assert [r.csv for r in rows] == ["1,Ann,Lee", "2,,Lee", "3,Ann,", "4,,"]
    assert [r.uid for r in rows] == ["UID1000", "UID2000", "UID3000", "UID4000"]
    assert [r.p for r in rows] == ["Ms. Lee", None, None, None]
    assert [r.t for r in rows] == ["c", "a,b", "a,c", "a,b"]


def test_id_number_and_labels(spark):
    assert column(spark, ["S0030", "S7"], fn.id_number("x"), "string") == [30, 7]
    labels = fn.map_label("x", {"DM": "Diabetic"}, "Control")
    assert column(spark, ["DM", "Control", None], labels, "string") == ["Diabetic", "Control", "Control"]
    assert column(spark, ["DM", "c", None], fn.map_label("x", {"DM": "d"}), "string") == ["d", None, None]


def stamps(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.select("i", F.col("t").cast("timestamp_ntz").alias("x"))
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_dates(spark):
    edges = ["2006-03-31 23:59:59", "2006-04-01 00:00:00", None]
    assert stamps(spark, edges, fn.in_period("x", "2005-03-01", "2006-04-01")) == [True, False, None]
    assert stamps(spark, edges, fn.in_month("x", 2006, 3)) == [True, False, None]
    assert stamps(spark, ["2005-12-31 10:00:00", "2006-01-01"], fn.in_month("x", 2005, 12)) == [True, False]
    assert stamps(spark, ["2004-12-31 23:59:59", "2005-01-01"], fn.in_year("x", 2005)) == [False, True]
    hours = ["2005-01-01 08:59:59", "2005-01-01 09:00:00", "2005-01-01 12:59:59", "2005-01-01 13:00:00"]
    assert stamps(spark, hours, fn.hour_between("x", 9, 12)) == [False, True, True, False]
    assert stamps(spark, hours, fn.hour_between("x", 9, 12, inclusive=False)) == [False, True, False, False]
    weeks = ["2005-01-01", "2024-12-30", "2024-01-01"]
    assert stamps(spark, weeks, fn.week_label("x")) == ["2004-W53", "2024-W01", "2024-W01"]
    one = ["2005-07-09 15:04:05"]
    assert stamps(spark, one, fn.month_name("x")) == ["July"]
    assert stamps(spark, one, fn.date_text("x")) == ["2005-07-09"]
    assert stamps(spark, one, fn.time_text("x")) == ["15:04:05"]
    assert stamps(spark, one, fn.time_text_12h("x")) == ["03:04:05 PM"]
    assert stamps(spark, one, fn.timestamp_text("x")) == ["2005-07-09 15:04:05"]


def test_ages(spark):
    df = spark.createDataFrame([(1, "2005-06-01", 66), (2, "2006-01-01", None)], "i int, t string, age int")
    df = df.withColumn("v", F.col("t").cast("timestamp_ntz"))
    row = df.orderBy("i").select(
        fn.birth_year("v", "age").alias("b"), fn.age_on("v", "age", F.lit(dt.date(2024, 1, 1))).alias("a"),
        fn.decade_label(fn.birth_year("v", "age")).alias("d")).collect()
    assert [tuple(r) for r in row] == [(1939, 85, "1930-1939"), (None, None, "unknown")]
    assert column(spark, [1900, 1936, 2000, 1937], fn.is_leap_birth("x"), "int") == [False, True, True, False]
    assert column(spark, [1900], fn.is_leap_birth("x", gregorian=False), "int") == [True]


def test_measures(spark):
    df = spark.createDataFrame([(120.0, 80.0, 1.78, 24.9, 450.0)], "s double, d double, h double, b double, dist double")
    row = df.select(
        fn.mean_arterial_pressure("s", "d", 2).alias("map"), fn.feet_and_inches("h").alias("ft"),
        fn.weight_from_bmi("b", "h").alias("kg"), fn.distance_per_minute("dist").alias("pm")).first()
    assert tuple(row) == (93.33, "5'10\"", 78.89, 75.0)


def test_monthly_share(spark):
    df = spark.createDataFrame(
        [(1, "2005-01-05"), (1, "2005-01-09"), (2, "2006-01-01"), (2, "2006-03-01"), (3, None), (4, "2005-12-31")],
        "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    rows = {r.month_name: (r.month, r.ids, r.percentage) for r in monthly_share(df, "t", "id").collect()}
    assert len(rows) == 12
    assert rows["January"] == (1, 2, 50.0) and rows["March"] == (3, 1, 25.0) and rows["June"] == (6, 0, 0.0)
    df.createOrReplaceTempView("visits_view")
    register_monthly_share(spark, "share_per_month", "visits_view", "t", "id")
    again = {r.month_name: (r.month, r.ids, r.percentage) for r in spark.sql("SELECT * FROM share_per_month()").collect()}
    assert again == rows
