"""Layouts of stored tables, limits in a table, deep hierarchies."""

import glob
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from cohortry.operators import hierarchy, intervals
from cohortry.operators.hierarchy import CycleError, roots
from cohortry.operators.intervals import interval_join
from cohortry.sources import new_path
from cohortry.sources.layouts import bucketed, counted_write, forget, open_pages, page_directory, read_partitions, write_partitions
from tests.helpers import plan, values


def test_bucketed_sides_are_joined_without_a_shuffle(spark):
    names = [f"b_{uuid.uuid4().hex}" for _ in range(3)]
    rows = spark.range(400).select((F.col("id") % 90).alias("k"), F.col("id").alias("v"))
    left, right = bucketed(rows, names[0], ["k"], 4), bucketed(rows.select(F.col("k").alias("j"), F.col("v").alias("w")), names[1], ["j"], 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = left.join(right, left.k == right.j)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert "Exchange" not in plan(left.groupBy("k").count())
        plain = spark.read.schema(left.schema).parquet(*left.inputFiles())
        assert "Exchange" in plan(plain.join(right, plain.k == right.j))
        expected = sorted((a % 90, a, a % 90, b) for a in range(400) for b in range(a % 90, 400, 90))
        assert values(joined, "k", "v", "j", "w") == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            forget(spark, name)
    assert not spark.catalog.tableExists(names[0])


def test_one_partition_is_replaced_and_others_keep_their_files(spark):
    path = new_path(spark, "parts")
    rows = spark.range(60).select("id", (F.col("id") % 3).cast("int").alias("m"))
    write_partitions(rows, path, ["m"])
    before = {m: sorted(glob.glob(f"{path}/m={m}/*.parquet")) for m in range(3)}
    write_partitions(rows.filter("m = 1 AND id < 30").withColumn("id", F.col("id") + 1000), path, ["m"])
    after = {m: sorted(glob.glob(f"{path}/m={m}/*.parquet")) for m in range(3)}
    assert before[0] == after[0] and before[2] == after[2] and not set(before[1]) & set(after[1])
    stored = read_partitions(spark, path, rows.schema)
    assert values(stored.filter("m = 1"), "id") == [(k + 1000,) for k in range(1, 30, 3)] and stored.count() == 50


def test_a_filter_on_a_dimension_prunes_partitions(spark):
    path, dims = new_path(spark, "parts"), new_path(spark, "dims")
    rows = spark.range(600).select("id", (F.col("id") % 12).cast("int").alias("m"))
    write_partitions(rows, path, ["m"])
    spark.range(12).select(F.col("id").cast("int").alias("m"), F.when(F.col("id") < 2, F.lit("first")).otherwise(F.lit("later")).alias("kind")).write.parquet(dims)
    chosen = spark.read.parquet(dims).filter(F.col("kind") == "first")
    joined = read_partitions(spark, path, rows.schema).join(chosen, "m")
    assert "dynamicpruning" in plan(joined)
    assert joined.count() == 100


def test_counts_of_a_write(spark):
    path = new_path(spark, "seen")
    reads = spark.sparkContext.accumulator(0)
    rows = spark.range(50).select("id", F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))

    def watched(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    found = counted_write(rows.mapInArrow(watched, rows.schema), path, {"missing": F.col("v").isNull(), "high": F.col("v") > 40, "rows": F.lit(True)}, by=["v"])
    assert found == {"rows written": 50, "missing": 10, "high": 8, "rows": 50}
    assert reads.value == 50 and spark.read.parquet(path).count() == 50  # every row is read once
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        counted_write(rows, path, {})


def test_any_page_is_one_range_of_keys(spark):
    path = new_path(spark, "pages")
    rows = spark.range(95).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), F.lit("x").alias("c"))
    pages = page_directory(rows, ["a", "b"], 10, path, files=4)
    want = sorted((k % 7, k) for k in range(95))
    for page in (0, 3, 9):
        assert [(r.a, r.b) for r in pages.read(page).collect()] == want[10 * page : 10 * page + 10]
    assert pages.read(10).count() == 0 and pages.pages.agg(F.sum("rows")).first()[0] == 95
    assert open_pages(spark, path, rows.schema, ["a", "b"]).read(2).count() == 10
    got = plan(pages.read(3))
    bounds = pages._bounds(3)
    assert f"GreaterThanOrEqual(a,{bounds['first_a']})" in got and f"LessThanOrEqual(a,{bounds['last_a']})" in got
    single = page_directory(rows.select("b"), ["b"], 10, new_path(spark, "p"), files=5)
    asked = single.read(4)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(b,40\), LessThanOrEqual\(b,49\)", plan(asked))
    assert [r.b for r in asked.collect()] == list(range(40, 50))
    with pytest.raises(ValueError, match="NULL"):
        page_directory(spark.createDataFrame([(None,), (1,)], "b int"), ["b"], 10, new_path(spark, "p"))
    assert page_directory(rows.limit(0), ["a", "b"], 10, new_path(spark, "p")).read(0).count() == 0


def holds(v, low, high, closed):
    if v is None or math.isnan(v):
        return False
    above = low is None or (v >= low if closed in ("left", "both") else v > low)
    return above and (high is None or (v <= high if closed in ("right", "both") else v < high))


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_limits_of_a_table(spark, closed):
    rng = random.Random(closed)
    limits = [(k, rng.choice(["f", "m", None]), rng.choice([None, rng.uniform(-1e3, 1e3), float(rng.randint(-5, 5)), rng.uniform(-1e12, 1e12), 1e-9])) for k in range(150)]
    limits = [(k, g, low, None if rng.random() < 0.1 else (low or 0.0) + rng.choice([0.0, 1e-9, 1.0, 250.0, 1e11, -1.0])) for k, g, low in limits]
    points = [None, math.nan, math.inf, -math.inf, 0.0, 1e-9, 1e300, -1e300, *[x for _, _, a, b in limits for x in (a, b) if x is not None], *[rng.uniform(-1e3, 1e3) for _ in range(40)]]
    rows = [(k, rng.choice(["f", "m", None]), v) for k, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id int, sex string, v double")
    table = spark.createDataFrame(limits, "limit int, sex string, low double, high double")
    expected = sorted((i, k) for i, g, v in rows for k, h, low, high in limits if g == h and holds(v, low, high, closed))
    assert values(interval_join(df, "v", table, "low", "high", by=["sex"], closed=closed), "id", "limit") == expected
    left = values(interval_join(df, "v", table, "low", "high", by=["sex"], closed=closed, how="left"), "id", "limit")
    alone = {i for i, _, _ in rows} - {i for i, _ in expected}
    assert sorted(left, key=str) == sorted([*expected, *[(i, None) for i in alone]], key=str)


def test_limits_join_by_hash_and_without_limits(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("v"))
    limits = spark.range(3000).select(F.col("id").alias("limit"), (F.col("id") / 3).alias("low"), (F.col("id") / 3 + 1.5).alias("high"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = interval_join(df, "v", limits, "low", "high")
        text = plan(joined)
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text
        assert joined.count() == sum(1 for v in range(1000) for k in range(max(0, 3 * v - 5), min(3000, 3 * v + 1)) if k / 3 <= v < k / 3 + 1.5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert interval_join(df, "v", limits.limit(0), "low", "high").count() == 0
    assert interval_join(df, "v", limits.limit(0), "low", "high", how="left").count() == 1000
    assert interval_join(df.limit(0), "v", limits, "low", "high").count() == 0
    with pytest.raises(ValueError, match="columns of both"):
        interval_join(df, "v", df, "id", "v")


@pytest.mark.parametrize(("closed", "slices"), [("left", False), ("right", True), ("both", True), ("neither", False)])
def test_totals_over_the_limits_that_hold_a_value(spark, monkeypatch, closed, slices):
    if slices:
        monkeypatch.setattr(intervals, "group_sizes", lambda df, by: (10_000_000, 10_000_000))
    rnd, inf, nan = random.Random(closed), float("inf"), float("nan")
    odd = [None, nan, inf, -inf, 0.0, -0.0, 1e300]
    draw = lambda: rnd.choice(odd) if rnd.random() < 0.2 else rnd.randint(-20, 20) / 2
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 60), draw()) for _ in range(150)]
    table = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), draw(), draw()) for _ in range(200)]
    df = spark.createDataFrame(rows, "sex string, id int, v double")
    limits = spark.createDataFrame(table, "sex string, limit int, low double, high double")
    totals = {"k": ("count", "limit"), "least": ("min", "limit"), "most": ("max", "limit")}

    def holds(v, low, high):
        above = low is None or v > low or (v == low and closed in ("left", "both"))
        return above and (high is None or math.isnan(high) or v < high or (v == high and closed in ("right", "both")))

    def wanted(sex, v):
        met = [] if v is None or math.isnan(v) else [k for s, k, low, high in table if s == sex and holds(v, low, high)]
        known = [k for k in met if k is not None]
        return len(met), (len(known), min(known, default=None), max(known, default=None))

    expected = [((sex, k, v), *wanted(sex, v)) for sex, k, v in rows]
    text = lambda found: sorted(str(tuple(r)).replace("-0.0", "0.0") for r in found)
    found = interval_join(df, "v", limits, "low", "high", by=["sex"], closed=closed, how="left", totals=totals)
    assert text(found.collect()) == text(row + total for row, _, total in expected)
    found = interval_join(df, "v", limits, "low", "high", by=["sex"], closed=closed, totals=totals)
    assert text(found.collect()) == text(row + total for row, met, total in expected if met)


def test_totals_make_no_pairs(spark):
    df = spark.range(20_000).select("id", F.col("id").cast("double").alias("v"))
    limits = spark.range(20_000).select(F.col("id").alias("limit"), (-F.col("id")).alias("low"), F.lit(None).cast("double").alias("high"))
    found = interval_join(df, "v", limits, "low", "high", totals={"n": ("count", "limit"), "least": ("min", "limit")})
    assert found.filter("n = 20000 AND least = 0").count() == 20_000
    assert interval_join(df, "v", limits.limit(0), "low", "high", how="left", totals={"n": ("count", "limit")}).filter("n = 0").count() == 20_000
    assert interval_join(df.limit(0), "v", limits, "low", "high", totals={"n": ("count", "limit")}).count() == 0
    with pytest.raises(ValueError, match="count, min or max"):
        interval_join(df, "v", limits, "low", "high", totals={"n": ("sum", "limit")})


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    chain = [(k, k - 1 if k else None) for k in range(1000)] + [(2000 + k, 5) for k in range(50)] + [(5000, 4999)]
    random.Random(1).shuffle(chain)
    written = []
    real = hierarchy.materialise
    monkeypatch.setattr(hierarchy, "materialise", lambda df, label="stage": written.append(label) or real(df, label))
    got = {r.node: (r.root, r.depth) for r in roots(spark.createDataFrame(chain, "node int, parent int")).collect()}
    assert all(got[k] == (0, k) for k in range(1000)) and all(got[2000 + k] == (0, 6) for k in range(50))
    assert got[5000] == (4999, 1) and got[4999] == (4999, 0) and len(got) == 1052
    assert written.count("roots") - 1 <= 12


def test_forests_that_are_none(spark):
    def forest(rows):
        return roots(spark.createDataFrame(rows, "node int, parent int"))

    with pytest.raises(CycleError):
        forest([(1, 2), (2, 3), (3, 1), (4, None)])
    with pytest.raises(CycleError):
        forest([(1, 1)])
    with pytest.raises(ValueError, match="two parents"):
        forest([(1, 2), (1, 3)])
    assert values(forest([])) == []
    assert values(forest([(1, None), (1, None), (None, 1), (2, 1), (2, 1)])) == [(1, 1, 0), (2, 1, 1)]
