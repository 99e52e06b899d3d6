import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import text
from cohortry.operators import aggregates as agg
from cohortry.operators import joins, quality, ranking, scoring
from cohortry.operators.distributions import distribution_long, distribution_wide, share_by
from cohortry.operators.filters import distinct_values, rows_with_nulls, where_equals_max
from cohortry.operators.hierarchy import expand_hierarchy
from cohortry.plans.outer import full_outer_chain, outer_join
from cohortry.sources import (
    Snapshot, append, as_view, drop_view, empty, load, materialise, new_path, replace, scratch, shared_dir, snapshot, union_children,
    update_where,
)
from tests.helpers import plan, values


@pytest.fixture(scope="module")
def patients(spark):
    return spark.createDataFrame(
        [
            ("S1", "Ann", "Lee", 61, 1.6, "DM", 12.0), ("S2", "Bob", "Lee", 55, 1.7, "Control", 0.0),
            ("S3", "Cid", "Ray", 70, 1.7, "DM", 3.0), ("S4", "Ann", "Poe", 70, None, "DM", None),
            ("S5", None, "Kay", None, 1.8, None, 7.0),
        ],
        "id string, first string, last string, age int, height double, grp string, duration double",
    )


def test_filters(patients):
    assert values(rows_with_nulls(patients, ["age", "height"]), "id") == [("S4",), ("S5",)]
    assert values(distinct_values(patients, "last")) == [("Kay",), ("Lee",), ("Poe",), ("Ray",)]
    assert values(where_equals_max(patients, "age"), "id") == [("S3",), ("S4",)]


def test_semi_anti_cover_input(spark, patients):
    labs = spark.createDataFrame([("S1",), ("S1",), ("S3",), ("S9",)], "patient string")
    assert values(joins.semi(patients, labs, "id", "patient"), "id") == [("S1",), ("S3",)]
    assert values(joins.anti(patients, labs, "id", "patient"), "id") == [("S2",), ("S4",), ("S5",)]


def test_not_in_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some = spark.createDataFrame([(1,)], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "k int")
    none = spark.createDataFrame([], "k int")
    for other, expected in ((some, [(2,)]), (with_null, []), (none, [(None,), (1,), (2,)])):
        assert values(joins.not_in(df, other, "k")) == expected
        df.createOrReplaceTempView("l")
        other.createOrReplaceTempView("r")
        assert values(spark.sql("SELECT k FROM l WHERE k NOT IN (SELECT k FROM r)")) == expected


def test_not_in_never_forces_a_broadcast(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders, customer = load(spark, folder, "orders"), load(spark, folder, "customer")
        text = plan(joins.not_in(customer, orders, "c_custkey", "o_custkey"))
        assert "Broadcast" not in text and "LeftAnti" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exists_other_equals_the_pairwise_test(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (None, "a"), (6, "c"), (6, "c")]
    df = spark.createDataFrame(rows, "id int, name string")
    df.createOrReplaceTempView("p")
    pairs = spark.sql("SELECT * FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.name = p.name AND q.id <> p.id)")
    assert values(joins.exists_other(df, ["name"], "id")) == values(pairs) == [(1, "a"), (2, "a")]
    assert values(joins.shared_values(df, "name")) == [(None, "a"), (1, "a"), (2, "a"), (6, "c"), (6, "c")]


def test_membership(spark):
    asked = spark.createDataFrame([("White",), ("Asian",), (None,)], "race string")
    known = spark.createDataFrame([("White",), ("White",), ("Black",)], "r string")
    assert values(joins.membership(asked, known, "race", "r")) == [(None, False), ("Asian", False), ("White", True)]


def test_star_bridge_and_wide(spark):
    hub = spark.createDataFrame([("S1", "g1", "k1"), ("S2", "g2", "k2"), ("S3", "g9", "k3")], "id string, gid string, link string")
    group = spark.createDataFrame([("g1", "DM"), ("g2", "Control")], "gid string, name string")
    bridge = spark.createDataFrame([("k1", "u1"), ("k2", "u2"), ("k3", "u3")], "link string, uid string")
    urine = spark.createDataFrame([("u1", 1.5), ("u3", 2.5)], "urine string, albumin double")
    assert values(joins.star_join(hub, [joins.Link(group, "gid", "gid")]), "id", "name") == [("S1", "DM"), ("S2", "Control")]
    bridged = joins.bridge_join(hub, bridge, urine, ("link", "link"), ("uid", "urine"))
    assert values(bridged, "id", "albumin") == [("S1", 1.5), ("S3", 2.5)]
    wide = joins.wide_record(
        hub,
        [joins.Link(group, "gid", "gid"), joins.Link(bridge, "link", "link"), joins.Link(urine, "uid", "urine")],
        {"id": F.col("id"), "albumin": F.col("albumin") * 2},
    )
    assert values(wide) == [("S1", 3.0)]


def test_outer_joins_equal_the_native_ones(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "k int, r string")
    for how in ("left", "full"):
        assert values(outer_join(left, right, ["k"], how)) == values(left.join(right, "k", how))
    assert values(outer_join(left, right, ["k"], hot_right=False)) == values(left.join(right, "k", "left"))
    with pytest.raises(ValueError):
        outer_join(left, right, ["k"], "right")


def test_left_join_without_a_hot_right_side_reads_each_side_once(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = load(spark, folder, "customer").select("c_custkey", "c_name")
    assert plan(outer_join(orders, customers, ["c_custkey"], hot_right=False)).count("Scan parquet") == 2


def test_joins_of_a_full_outer_chain_grow_with_its_tables(spark):
    def joins_of(n: int, first: bool) -> int:
        tables = [spark.createDataFrame([(k, k) for k in range(i, i + 4)], f"id int, v{i} int") for i in range(n)]
        return plan(full_outer_chain(tables, "id", match_first_only=first)).count("Join")

    three, four, five = (joins_of(n, True) for n in (3, 4, 5))
    assert five - four == four - three
    assert joins_of(5, False) == joins_of(4, False)  # the steps before the last are tables


def test_full_outer_chain(spark):
    verbal = spark.createDataFrame([("S1", 20.0), ("S2", 30.0)], "id string, wtar double")
    motor = spark.createDataFrame([("S1", 40.0), ("S3", 50.0)], "id string, tm double")
    people = spark.createDataFrame([("S1", 60), ("S3", 61), ("S4", 62)], "id string, age int")
    first = values(full_outer_chain([verbal, motor, people], "id"))
    assert first == [
        (None, None, "S3", None, None, 61), (None, None, "S4", None, None, 62), (None, "S3", None, None, 50.0, None),
        ("S1", "S1", "S1", 20.0, 40.0, 60), ("S2", None, None, 30.0, None, None)]
    met = values(full_outer_chain([verbal, motor, people], "id", match_first_only=False))
    assert (None, "S3", "S3", None, 50.0, 61) in met and len(met) == 4


def test_hierarchy(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("a", "c"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert values(expand_hierarchy(seeds, edges)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert values(expand_hierarchy(seeds, edges, max_depth=1)) == [("a", 0), ("b", 1), ("c", 1)]
    assert values(expand_hierarchy(seeds, edges, max_depth=0)) == [("a", 0)]
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(18)], "parent string, child string")
    deep = expand_hierarchy(spark.createDataFrame([("0",)], "node string"), chain)
    assert deep.count() == 19 and deep.agg(F.max("depth")).first()[0] == 18


def test_aggregates(patients):
    assert values(agg.count_by(patients, "grp")) == [(None, 1), ("Control", 1), ("DM", 3)]
    assert values(agg.count_distinct(patients, ["grp"], "first")) == [(None, 0), ("Control", 1), ("DM", 2)]
    assert values(agg.mean_by(patients, ["grp"], "age")) == [(None, None), ("Control", 55.0), ("DM", 67.0)]
    row = patients.agg(
        agg.rate(F.col("age") > 60, F.col("grp") == "DM", 2).alias("dm"),
        agg.rate(F.col("age") > 60, F.col("grp") == "none").alias("none"),
        agg.count_distinct_if(F.col("age") >= 61, "first").alias("names")).first()
    assert tuple(row) == (100.0, None, 2)
    cases = agg.count_cases(patients, {"tall": F.col("height") > 1.65, "short": F.col("height") < 1.65})
    assert values(cases) == [("short", 1), ("tall", 3)]
    assert values(agg.null_profile(patients, ["age", "grp", "id"])) == [("age", 1, 5), ("grp", 1, 5), ("id", 0, 5)]


@pytest.mark.parametrize("group_rows", [4_000_000, 1])
def test_values_by(spark, patients, group_rows):
    got = values(agg.values_by(patients, ["height"], "age", ["age", "id"], name="ages", max_group_rows=group_rows))
    assert got == [(None, 0, [70]), (1.6, 0, [61]), (1.7, 0, [55, 70])]
    many = spark.range(250).select((F.col("id") % 2).alias("g"), "id")
    chunks = values(agg.values_by(many, ["g"], "id", chunk_rows=50, max_group_rows=group_rows))
    assert [len(c[2]) for c in chunks] == [50, 50, 25, 50, 50, 25]
    assert sum((c[2] for c in chunks if c[0] == 1), []) == list(range(1, 250, 2))


def test_visits(spark):
    df = spark.createDataFrame(
        [(1, "2005-02-03 10:00:00"), (1, "2005-02-03 11:00:00"), (2, "2005-01-31 09:00:00"), (3, "2006-02-01 09:00:00")],
        "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert values(agg.visits_by(df, "t", "month"), "month_name", "visits") == [("February", 3), ("January", 1)]
    assert values(agg.visits_by(df, "t", "day", min_count=2)) == [("2005-02-03", 2)]
    assert values(agg.visits_by(df, "t", "week")) == [("2005-W05", 3), ("2006-W05", 1)]
    assert values(agg.visits_by(df, "t", "week", id="id", min_count=2)) == [("2005-W05", 2)]
    first, last = agg.date_span(df, "t").first()
    assert (str(first), str(last)) == ("2005-01-31 09:00:00", "2006-02-01 09:00:00")
    with pytest.raises(ValueError):
        agg.visits_by(df, "t", "year")


def test_distributions(patients):
    classes = {"old": F.col("age") >= 60, "young": F.col("age") < 60}
    assert distribution_wide(patients, classes).first().asDict() == {"old": 60.0, "young": 20.0}
    assert distribution_wide(patients, classes, within=F.col("age").isNotNull()).first().asDict() == {"old": 75.0, "young": 25.0}
    assert values(distribution_wide(patients, classes, by=["grp"])) == [(None, 0.0, 0.0), ("Control", 0.0, 100.0), ("DM", 100.0, 0.0)]
    assert values(distribution_long(patients, classes)) == [("old", 60.0), ("young", 20.0)]
    assert values(distribution_long(patients.filter("age > 99"), classes)) == [("old", None), ("young", None)]
    shares = values(share_by(patients, ["grp"]))
    assert shares == [(None, 1, 20.0), ("Control", 1, 20.0), ("DM", 3, 60.0)]
    dm = patients.filter("grp = 'DM'")
    assert values(share_by(dm, ["first"], total=patients, digits=2)) == [("Ann", 2, 40.0), ("Cid", 1, 20.0)]


def test_long_distribution_reads_once(spark, folder):
    lines = load(spark, folder, "lineitem")
    text = plan(distribution_long(lines, {str(i): F.col("l_quantity") > i for i in range(4)}))
    assert text.count("FileScan") == 1 and "struct<l_quantity:double>" in text


def test_scoring(spark):
    df = spark.createDataFrame(
        [("a", 13.0, 14.0, 15.0), ("b", 14.0, 14.0, 15.0), ("c", 14.0, 15.0, 15.0), ("d", None, 14.0, 14.0)],
        "id string, ds double, hvlt double, gds double")
    tests = {"DS": F.col("ds") <= 13, "HVLT": F.col("hvlt") <= 14, "GDS": F.col("gds") >= 15}
    assert values(df.select("id", scoring.failed_count(list(tests.values())))) == [("a", 3), ("b", 2), ("c", 1), ("d", 1)]
    assert values(df.filter(scoring.at_least_k(list(tests.values()), 2)), "id") == [("a",), ("b",)]
    assert values(scoring.failed_combinations(df, tests, 1)) == [("DS, HVLT, GDS", 1), ("GDS", 1), ("HVLT", 1), ("HVLT, GDS", 1)]
    counted = scoring.count_any(df, [F.lit("all").alias("g")], [F.col("ds") <= 13, F.col("hvlt") <= 14], "id")
    assert values(counted) == [("all", 3)]
    assert text.failed_names is not None


def test_ranking(spark, patients):
    assert values(ranking.top_n(patients, [F.col("age").desc_nulls_last(), "id"], 2), "id") == [("S3",), ("S4",)]
    assert values(ranking.top_n(patients, ["age", "id"], 1), "id") == [("S2",)]
    assert values(ranking.latest_per(patients, ["last"], "age", "id"), "id") == [("S1",), ("S3",), ("S4",), ("S5",)]
    assert values(ranking.dominant(patients, ["grp"], "first")) == [(None, None, 1), ("Control", "Bob", 1), ("DM", "Ann", 2)]
    assert ranking.largest_group(patients, "grp").first().grp == "DM"
    assert values(ranking.rows_at_max(patients, "age", key="grp")) == [("DM", 70)]
    pages = [values(ranking.page(patients.select("id"), ["id"], 1, 2, max_head_rows=limit)) for limit in (100, 1)]
    assert pages[0] == pages[1] == [("S2",), ("S3",)]
    for digest in ("xxhash64", "md5"):
        one = values(ranking.sample_n(patients, "id", 3, seed=5, digest=digest), "id")
        assert len(one) == 3 and one == values(ranking.sample_n(patients, "id", 3, seed=5, digest=digest), "id")
    with pytest.raises(ValueError):
        ranking.sample_n(patients, "id", 3, digest="rand")


def test_sample_takes_the_smallest_hashes(spark):
    from cohortry.reports.registry import REPORTS

    rows = spark.range(500).withColumn("h", F.xxhash64(F.lit(5), "id")).collect()
    want = sorted(r.id for r in sorted(rows, key=lambda r: (r.h, r.id))[:20])
    assert sorted(r.id for r in ranking.sample_n(spark.range(500).repartition(7), "id", 20, seed=5).collect()) == want
    assert sorted(r.id for r in ranking.sample_n(spark.range(9), "id", 20).collect()) == list(range(9))
    assert REPORTS["sample_hashed"].sql is None and "sample_whole" not in REPORTS


def test_sample_query_returns_a_fixed_number(spark, folder):
    import __spark_entry__ as entry

    orders = load(spark, folder, "orders").withColumn("h", F.xxhash64(F.lit(7), "o_orderkey")).collect()
    want = {r.o_orderkey for r in sorted(orders, key=lambda r: (r.h, r.o_orderkey))[:10]}
    assert {r.o_orderkey for r in entry.queries()["sample_hashed"](spark, folder).collect()} == want


def test_top_one_per_group_is_cut_before_the_shuffle(spark, folder):
    orders = load(spark, folder, "orders")
    text = plan(ranking.latest_per(orders, ["o_custkey"], "o_orderdate", "o_orderkey"))
    assert text.count("WindowGroupLimit") == 2


def test_quality(spark):
    df = spark.createDataFrame([(1, "ok", "fine"), (2, "a b", "fine"), (3, "Up", "x\ty"), (4, None, "fine")], "i int, a string, b string")
    good, rejected = quality.split_valid(df, quality.text_rules(["a", "b"]))
    assert values(good, "i") == [(1,), (4,)]
    assert {r.i: r.broken_rules for r in rejected.collect()} == {
        2: ["a: white space"], 3: ["a: not lower case", "b: white space"]}
    labs = spark.createDataFrame([("L1", 6.0, 120.0), ("L2", 5.7, 120.0), ("L3", None, 150.0)], "id string, hb double, glucose double")
    limits = {"hb": 5.7, "glucose": 100}
    assert values(quality.alerts(labs, limits), "id", "alert") == [("L1", "abnormal values: hb, glucose")]
    assert values(quality.alerts(labs, limits, "any"), "id") == [("L1",), ("L2",), ("L3",)]
    with pytest.raises(ValueError):
        quality.alerts(labs, limits, "some")
    keys = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert values(quality.check_key(keys, ["k"])) == [(None, 1), (1, 2)]


def test_snapshots(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), False)])
    path = new_path(spark, "t")
    assert path.startswith(shared_dir(spark))
    append(empty(spark, schema), path)
    assert spark.read.schema(schema).parquet(path).count() == 0
    append(spark.createDataFrame([(1, "NICK")], schema), path)
    append(spark.createDataFrame([(2, "ANNA")], schema), path)
    table = spark.read.schema(schema).parquet(path)
    assert values(table) == [(1, "NICK"), (2, "ANNA")]
    changed = update_where(table, F.col("id") == 2, {"name": F.lit("EVE"), "id": F.col("id") * 10})
    assert values(changed) == [(1, "NICK"), (20, "EVE")]
    with pytest.raises(ValueError):
        update_where(table, F.col("id") == 2, {"nope": F.lit(1)})
    child = spark.createDataFrame([("x", 3, "KID")], "extra string, id int, name string")
    assert values(union_children(table, child)) == [(1, "NICK"), (2, "ANNA"), (3, "KID")]
    assert values(snapshot(table, new_path(spark, "s"), sort_by=["id"])) == values(table)
    assert values(materialise(table)) == values(table)
    as_view(table, "customer_view")
    assert spark.sql("SELECT count(*) FROM customer_view").first()[0] == 2
    assert drop_view(spark, "customer_view") and not drop_view(spark, "customer_view")


def test_snapshot_filled_later(spark, patients):
    stored = Snapshot(spark, new_path(spark, "m"), lambda: agg.count_by(patients, "grp"))
    with pytest.raises(RuntimeError):
        stored.read()
    assert values(stored.create_empty()) == []
    assert values(stored.refresh()) == [(None, 1), ("Control", 1), ("DM", 3)]
    assert values(stored.read()) == values(stored.refresh())


def test_failed_refresh_keeps_the_old_rows(spark):
    rows = [spark.range(3)]
    stored = Snapshot(spark, new_path(spark, "m"), lambda: rows[0])
    assert values(stored.refresh()) == [(0,), (1,), (2,)]
    rows[0] = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        stored.refresh()
    assert values(stored.read()) == [(0,), (1,), (2,)]
    replace(stored.read().filter("id > 0"), stored.path)  # reads what it replaces
    assert values(stored.read()) == [(1,), (2,)]


def test_a_rewritten_table_shows_its_new_columns(spark):
    from cohortry.sources import TableFolder

    folder = new_path(spark, "tables")
    replace(spark.range(2), f"{folder}/numbers.parquet")
    assert TableFolder(spark, folder).numbers.columns == ["id"]
    replace(spark.range(2).withColumn("twice", F.col("id") * 2), f"{folder}/numbers.parquet")
    assert TableFolder(spark, folder).numbers.columns == ["id", "twice"]


def test_stages_are_removed_after_use(spark, patients):
    import os

    from cohortry.operators import ranking

    before = set(os.listdir(f"{shared_dir(spark)}/cohortry")) if os.path.isdir(f"{shared_dir(spark)}/cohortry") else set()
    with scratch(spark):
        kept = ranking.running_mean(patients, ["grp"], ["id"], "age", max_group_rows=0, slices=3).collect()
        assert set(os.listdir(f"{shared_dir(spark)}/cohortry")) > before
    assert len(kept) == patients.count()
    assert set(os.listdir(f"{shared_dir(spark)}/cohortry")) == before


def test_period_reaches_the_scan(spark, folder):
    from cohortry.functions import in_month, in_period, in_year

    orders = load(spark, folder, "orders")
    for condition in (in_period("o_orderdate", "1997-01-01", "1997-02-01"), in_year("o_orderdate", 1997), in_month("o_orderdate", 1997, 12)):
        text = plan(orders.filter(condition).select("o_orderkey"))
        assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
        assert "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_filter_on_a_band_join_reads_two_columns(spark, folder):
    from cohortry.functions import below, band

    lines = load(spark, folder, "lineitem")
    text = plan(agg.count_by(lines, band("l_quantity", [below("low", 12)], "other").alias("b")))
    assert "ReadSchema: struct<l_quantity:double>" in text and text.count("Exchange") == 1


def test_share_counts_the_groups_once(spark, folder):
    events = load(spark, folder, "events")
    shares = share_by(events, ["event_type"])
    shares.collect()
    assert "ReusedExchange" in plan(shares)


def test_no_report_needs_a_cross_join_or_python(spark, folder):
    import __spark_entry__ as entry

    for name in ("wide_record", "not_in", "full_outer_chain", "share_by_category", "exists_other", "dense_rank_global"):
        text = plan(entry.queries()[name](spark, folder))
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert node not in text, (name, node)


class _Session:
    """Only what shared_dir asks of a session."""

    class _Context:
        def __init__(self, folder):
            self.folder = folder

        def getCheckpointDir(self):
            return self.folder

    class _Conf:
        def __init__(self, settings):
            self.settings = settings

        def get(self, name, default=None):
            return self.settings.get(name, default)

    def __init__(self, settings, folder=None):
        self.conf, self.sparkContext = self._Conf(settings), self._Context(folder)


def test_shared_folder():
    named = {"spark.checkpoint.dir": "hdfs://shared/ck", "spark.master": "yarn"}
    assert shared_dir(_Session(named)) == "hdfs://shared/ck"
    assert shared_dir(_Session({"spark.master": "yarn"}, "hdfs://set/later")) == "hdfs://set/later"
    with pytest.raises(RuntimeError):
        shared_dir(_Session({"spark.master": "yarn"}))
    local = _Session({"spark.master": "local[2]", "spark.app.id": "a1"})
    assert shared_dir(local) == shared_dir(local)
