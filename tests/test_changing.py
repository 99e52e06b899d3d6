"""Stored results that are brought up to date, and tables changed by key."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources import Deltas, IncrementalSnapshot, VersionConflict, VersionedTable, append, new_path
from cohortry.sources.deltas import counted, distinct_estimate, highest, lowest, mean_of, money, rows, summed
from tests.helpers import values

VISIT = "visit int, lab string, day string, cost double"
MEASURES = {"n": rows(), "costs": counted("cost"), "total": money("cost"), "mean": mean_of("cost"), "first": lowest("day"), "last": highest("day"), "visits": summed("visit")}


def visits(spark, data):
    return spark.createDataFrame(data, VISIT)


def files(path):
    return sorted(glob.glob(f"{path}/*.parquet"))


def full(df, prepare=lambda d: d):
    made = prepare(df).groupBy("lab").agg(
        F.count("*").alias("n"), F.count("cost").alias("costs"), (F.sum(F.round(F.col("cost") * 100).cast("long")) / 100).alias("total"),
        (F.sum(F.round(F.col("cost") * 100).cast("long")).cast("double") / (100 * F.count("cost"))).alias("mean"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum("visit").alias("visits"))
    return values(made, "lab", *MEASURES)


PARTS = [
    [(1, "A", "2024-01-01", 1.1), (2, "A", "2024-01-03", None), (3, None, "2024-01-02", 0.1)],
    [(4, "B", "2024-01-01", 2.2), (5, "A", "2023-12-31", 3.3)],
    [(6, "C", None, None)],
]


def test_a_refresh_equals_the_full_query(spark):
    base = new_path(spark, "inc")
    stored = IncrementalSnapshot(spark, f"{base}/r", f"{base}/s", visits(spark, []).schema, ["lab"], MEASURES, fold_after=2)
    assert stored.read().count() == 0
    for k, part in enumerate(PARTS):
        append(visits(spark, part), f"{base}/s")
        assert values(stored.refresh(), "lab", *MEASURES) == full(spark.read.schema(VISIT).parquet(f"{base}/s"))
        assert stored.rows_read == len(part), k
    stored.refresh()
    assert stored.rows_read == 0
    assert values(stored.read(), "lab", *MEASURES) == full(spark.read.schema(VISIT).parquet(f"{base}/s"))


def test_a_refresh_reads_only_new_files(spark):
    base = new_path(spark, "new")
    stored = IncrementalSnapshot(spark, f"{base}/r", f"{base}/s", visits(spark, []).schema, ["lab"], {"n": rows()})
    append(visits(spark, PARTS[0]), f"{base}/s")
    stored.refresh()
    for path in files(f"{base}/s"):  # whoever reads these now fails
        with open(path, "wb") as f:
            f.write(b"not parquet")
        os.utime(path, (1, 1))
    append(visits(spark, PARTS[1]), f"{base}/s")
    assert values(stored.refresh(), "lab", "n") == [(None, 1), ("A", 3), ("B", 1)]


def test_a_failed_refresh_is_repeated(spark):
    base = new_path(spark, "fail")
    fail = {"on": False}

    def prepare(df):
        return df.withColumn("cost", F.when(F.col("visit") == 5, F.raise_error(F.lit("midway")).cast("double")).otherwise(F.col("cost"))) if fail["on"] else df

    stored = IncrementalSnapshot(spark, f"{base}/r", f"{base}/s", visits(spark, []).schema, ["lab"], MEASURES, prepare, files_per_step=1)
    for k, part in enumerate(PARTS):
        append(visits(spark, part), f"{base}/s")
        fail["on"] = k == 1
        if fail["on"]:
            before = values(stored.read(), "lab", *MEASURES)
            with pytest.raises(Exception, match="midway"):
                stored.refresh()
            assert values(stored.read(), "lab", *MEASURES) == before
            fail["on"] = False
            stored = IncrementalSnapshot(spark, f"{base}/r", f"{base}/s", visits(spark, []).schema, ["lab"], MEASURES, prepare, files_per_step=1)  # another process
        stored.refresh()
    assert values(stored.read(), "lab", *MEASURES) == full(spark.read.schema(VISIT).parquet(f"{base}/s"))


def test_rebuild_after_a_dimension_changed(spark):
    base = new_path(spark, "dim")
    names = {"A": "Alpha", "B": "Beta"}

    def prepare(df):
        labs = spark.createDataFrame(list(names.items()), "lab string, name string")
        return df.join(labs, "lab").select("visit", F.col("name").alias("lab"), "day", "cost")

    stored = IncrementalSnapshot(spark, f"{base}/r", f"{base}/s", visits(spark, []).schema, ["lab"], {"n": rows()}, prepare)
    append(visits(spark, [r for p in PARTS for r in p]), f"{base}/s")
    assert values(stored.refresh(), "lab", "n") == [("Alpha", 3), ("Beta", 1)]
    names["A"] = "Omega"
    assert values(stored.refresh(), "lab", "n") == [("Alpha", 3), ("Beta", 1)]
    assert values(stored.rebuild(), "lab", "n") == [("Beta", 1), ("Omega", 3)]
    append(visits(spark, [(9, "A", None, None)]), f"{base}/s")
    assert values(stored.refresh(), "lab", "n") == [("Beta", 1), ("Omega", 4)]
    assert values(stored.rebuild(), "lab", "n") == [("Beta", 1), ("Omega", 4)]


def test_an_unfinished_fold_changes_nothing(spark):
    base = new_path(spark, "fold")
    deltas = Deltas(spark, base, ["lab"], {"n": rows(), "ids": distinct_estimate("visit")})
    like = visits(spark, [])
    assert not deltas.fold(like) and deltas.finished(deltas.merged(like)).count() == 0
    for step, part in enumerate(PARTS):
        deltas.write(visits(spark, part), step)
        deltas.write(visits(spark, part), step)  # repeated
    want = values(deltas.finished(deltas.merged(like)))
    assert [r[:2] for r in want] == [(None, 1), ("A", 3), ("B", 1), ("C", 1)] and [r[2] for r in want] == [1, 3, 1, 1]
    assert [r[:2] for r in values(deltas.finished(deltas.merged(like, before=1)))] == [(None, 1), ("A", 2)]
    os.makedirs(f"{base}/upto=2")  # a fold that was lost before it was complete
    assert values(deltas.finished(deltas.merged(like))) == want
    assert deltas.fold(like, after=1) and values(deltas.finished(deltas.merged(like))) == want
    deltas.write(visits(spark, [(7, "C", None, None)]), 3)
    assert deltas.fold(like, after=1) and not glob.glob(f"{base}/batch=0") and not glob.glob(f"{base}/batch=2")
    assert [r[:2] for r in values(deltas.finished(deltas.merged(like)))] == [(None, 1), ("A", 3), ("B", 1), ("C", 2)]
    assert not deltas.fold(like, after=1)


ROW = "id int, name string, v double"


def made(spark, n=100, parts=5):
    table = VersionedTable(spark, new_path(spark, "ver"), T._parse_datatype_string(ROW), ["id"])
    table.create(spark.range(n).select(F.col("id").cast("int"), F.concat(F.lit("n"), "id").alias("name"), F.lit(0.5).alias("v")), parts=parts)
    return table


def change(spark, rows_):
    return spark.createDataFrame(rows_, ROW)


def test_an_upsert_rewrites_only_the_files_it_touches(spark):
    table = made(spark)
    before = table.files()
    assert len(before) == 5
    done = table.upsert(change(spark, [(3, "x", 1.0), (5, None, None), (200, "new", 2.0)]))
    assert done == {"updated": 2, "inserted": 1, "files": 1}
    after = table.files()
    assert len(set(before) - set(after)) == 1 and set(before[1:]) <= set(after)
    got = {r.id: (r.name, r.v) for r in table.read().collect()}
    assert len(got) == 101 and got[3] == ("x", 1.0) and got[5] == (None, None) and got[200] == ("new", 2.0) and got[6] == ("n6", 0.5)
    assert table.upsert(change(spark, [(3, "x", 1.0), (5, None, None), (200, "new", 2.0)])) == {"updated": 0, "inserted": 0, "files": 0}
    assert table.files() == after and table.versions() == [1, 2]
    assert {r.id for r in table.read(1).collect()} == set(range(100))


def test_keys_of_changes_are_checked(spark):
    table = made(spark)
    for bad in ([(1, "a", 1.0), (1, "b", 1.0)], [(None, "a", 1.0)]):
        with pytest.raises(ValueError, match="key"):
            table.upsert(change(spark, bad))
    assert table.versions() == [1] and table.upsert(change(spark, [])) == {"updated": 0, "inserted": 0, "files": 0}
    with pytest.raises(ValueError, match="column"):
        VersionedTable(spark, new_path(spark, "v"), T._parse_datatype_string(ROW), ["nope"])
    with pytest.raises(ValueError, match="holds"):
        table.create(change(spark, []))


def test_a_writer_that_fails_leaves_the_version_before(spark):
    table = made(spark)
    rows_ = change(spark, [(1, "a", 1.0)])
    with pytest.raises(Exception, match="lost"):
        table.upsert(rows_.withColumn("v", F.when(F.col("id") == 1, F.raise_error(F.lit("lost")).cast("double"))))
    assert table.versions() == [1] and table.read().count() == 100
    table._written(rows_.coalesce(1))  # a file that no version lists
    live = table.files()
    assert table.read().count() == 100
    gone = table.clean()
    assert len(gone) == 1 and table.files() == live and table.read().count() == 100


def test_of_two_writers_one_wins(spark):
    table, other = (made(spark) for _ in range(2))
    other = VersionedTable(spark, table.path, table.schema, table.key)
    seen = other.files()
    table.upsert(change(spark, [(1, "first", 1.0)]))
    with pytest.raises(VersionConflict):
        other._replaced(1, seen, {seen[0]}, other._scan(seen[:1]))
    assert table.read().filter("id = 1").first().name == "first"
    other.upsert(change(spark, [(1, "second", 1.0)]))  # starts from the version that won
    assert table.read().filter("id = 1").first().name == "second"


def test_updates_and_deletes_by_condition(spark):
    table = made(spark)
    before = table.files()
    assert table.update(F.col("id").between(0, 4), {"v": F.col("v") + F.col("id")}) == 1
    assert set(before[1:]) <= set(table.files())
    assert table.delete(F.when(F.col("id") != 7, F.col("id") < 10)) == 1  # NULL for 7: it stays
    assert table.delete(F.col("id") > 1000) == 0 and len(table.versions()) == 3
    assert sorted(r.id for r in table.read().collect()) == [7, *range(10, 100)]
    with pytest.raises(ValueError, match="key"):
        table.update(F.lit(True), {"id": F.lit(1)})
    assert table.delete(F.lit(True)) == len([f for f in table.files() if f]) or table.read().count() == 0
    table.clean()
    assert table.read().count() == 0 and table.upsert(change(spark, [(1, "again", None)]))["inserted"] == 1


def test_changes_are_looked_up_by_key_range(spark):
    table = made(spark)
    plan = table._scan(table.files()).filter(F.col("id").between(3, 5)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,3), LessThanOrEqual(id,5)]" in plan
