"""The plans for groups too large for one task give what the plain window gives."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.functions.exact import limbs_of
from cohortry.operators import ranking
from cohortry.plans.ordered import largest_group_rows, numbered, running_totals
from cohortry.sources import load, materialise
from tests.helpers import plan, values


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, many small ones, a NULL group, ties and NULL values."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        group = "hot" if i % 3 else (None if i % 33 == 0 else f"g{i % 40}")
        rows.append((i, group, rng.randrange(8), None if i % 17 == 0 else rng.randrange(10000) / 100))
    return spark.createDataFrame(rows, "id int, g string, day int, v double").repartition(5)


def test_largest_group(skewed):
    assert largest_group_rows(skewed, ["g"]) == 800
    assert largest_group_rows(skewed, []) == 1200
    assert largest_group_rows(skewed.filter("id < 0"), ["g"]) == 0


@pytest.mark.parametrize("by", [["g"], [], ["g", "day"]])
@pytest.mark.parametrize("slices", [2, 7])
def test_sliced_totals_equal_the_window(skewed, by, slices):
    order = ["day", F.col("id").desc()]
    totals = {"n": F.lit(1).cast("bigint"), "s": F.coalesce(F.col("v") * 100, F.lit(0)).cast("bigint")}
    plain = running_totals(skewed, by, order, totals, max_group_rows=None)
    sliced = running_totals(skewed, by, order, totals, max_group_rows=0, slices=slices)
    assert sliced.columns == plain.columns
    assert values(sliced, "id", "n", "s") == values(plain, "id", "n", "s")


def test_sliced_plan_keeps_groups_apart(skewed):
    sliced = running_totals(skewed, ["g"], ["id"], {"n": F.lit(1)}, max_group_rows=0, slices=6)
    text = plan(sliced)
    assert "__slice" in text and "SinglePartition" not in text


def test_numbered(skewed):
    got = values(numbered(skewed.filter("g = 'hot'"), ["g"], ["id"], "rn", max_group_rows=0, slices=5), "id", "rn")
    assert [rn for _, rn in got] == list(range(1, 801))


@pytest.mark.parametrize("digits, exact", [(4, False), (None, True), (2, True)])
def test_running_mean(skewed, digits, exact):
    args = (skewed, ["g"], ["day", "id"], "v")
    plain = ranking.running_mean(*args, digits=digits, exact=exact)
    sliced = ranking.running_mean(*args, digits=digits, exact=exact, max_group_rows=0, slices=5)
    assert plain.columns == [*skewed.columns, "running_mean"]
    assert values(sliced, "id", "running_mean") == values(plain, "id", "running_mean")


def test_running_mean_values(spark):
    df = spark.createDataFrame([("A", 1, 4), ("A", 2, None), ("A", 3, 7), ("B", 4, 1), ("C", 5, None)], "g string, id int, d int")
    expected = [(1, 4.0), (2, 4.0), (3, 5.5), (4, 1.0), (5, None)]
    assert values(ranking.running_mean(df, ["g"], ["id"], "d"), "id", "running_mean") == expected
    assert values(ranking.running_mean(df, ["g"], ["id"], "d", max_group_rows=0), "id", "running_mean") == expected


def test_moving_mean(skewed):
    for limit, rows in ((0, 5), (7, 5), (50, 1)):
        plain = ranking.moving_mean(skewed, ["g"], ["day", "id"], "v", rows, digits=None)
        sliced = ranking.moving_mean(skewed, ["g"], ["day", "id"], "v", rows, digits=None, max_group_rows=limit)
        assert values(plain, "id", "moving_mean") == values(sliced, "id", "moving_mean")


def test_means_of_odd_doubles_do_not_depend_on_the_plan(spark):
    inf, nan = float("inf"), float("nan")
    given = [1e16, 1.0, 2.0, 3.0, None, nan, 4.0, 5.0, 6.0, inf, 7.0, -inf, 8.0, 9.0, 0.1, 0.2, -0.3]
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(given)], "g string, id int, v double")
    text = lambda d, c: [str(r) for r in values(d, "id", c)]  # noqa: E731  NaN equals itself as text
    plain = ranking.moving_mean(df, ["g"], ["id"], "v", 2, digits=None)
    cut = ranking.moving_mean(df, ["g"], ["id"], "v", 2, digits=None, max_group_rows=3)
    assert text(cut, "moving_mean") == text(plain, "moving_mean")
    assert [r.moving_mean for r in cut.orderBy("id").limit(4).collect()] == [1e16, 5e15, 1.5, 2.5]
    plain = ranking.running_mean(df, ["g"], ["id"], "v", digits=None)
    cut = ranking.running_mean(df, ["g"], ["id"], "v", digits=None, max_group_rows=0, slices=4)
    assert text(cut, "running_mean") == text(plain, "running_mean")
    means = [r.running_mean for r in cut.orderBy("id").collect()]
    assert means[4] == (1e16 + 6) / 4 and str(means[5]) == str(means[-1]) == "nan"
    mixed = ranking.running_mean(df.filter("id > 6"), ["g"], ["id"], "v", digits=None)
    assert [str(r.running_mean) for r in mixed.orderBy("id").collect()][:6] == ["5.0", "5.5", "inf", "inf", "nan", "nan"]
    assert {r.running_mean for r in ranking.running_mean(df.withColumn("v", F.lit(1e300)), ["g"], ["id"], "v", digits=None).collect()} == {1e300}


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("descending", [True, False])
def test_dense_rank(skewed, by, descending):
    key = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    window = skewed.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(key)))
    for limit in (10_000, 0):
        got = ranking.dense_rank_by(skewed, by, "v", descending=descending, max_group_rows=limit)
        assert values(got, "id", "rank") == values(window, "id", "rank")


def test_dense_rank_ties(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 25.0), (3, 30.0), (4, None), (5, 20.0)], "id int, bmi double")
    assert values(ranking.dense_rank_global(df, "bmi")) == [(1, 30.0, 1), (2, 25.0, 2), (3, 30.0, 1), (4, None, 4), (5, 20.0, 3)]


def test_global_rank_never_gathers_the_rows(spark, folder):
    part = load(spark, folder, "part").select("p_partkey", "p_size")
    text = plan(ranking.dense_rank_global(part, "p_size"))
    # The single partition holds distinct sizes only: a grouping comes before it.
    single = text[text.index("SinglePartition"):]
    assert "HashAggregate(keys=[p_size" in single


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.openCostInBytes": "64MB",  # one task per file
}


@pytest.fixture
def split_early(spark):
    """Adaptive limits small enough for the test tables to count as skewed."""
    before = {k: spark.conf.get(k, None) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot_orders(spark, folder):
    """Orders of which a third belong to one customer, spread over many map tasks."""
    lines = load(spark, folder, "lineitem")
    customer = F.when(F.xxhash64("l_orderkey", "l_linenumber", "l_shipdate") % 3 == 0, 7).otherwise(F.col("l_suppkey") * 100 + F.col("l_partkey"))
    return materialise(lines.select(customer.alias("k"), "l_orderkey", "l_extendedprice").repartition(12))


def final_plan(df):
    rows = df.collect()
    return len(rows), plan(df)


@pytest.mark.parametrize("case", ["semi", "anti", "not_in", "exists", "shared", "membership", "inner", "left", "full"])
def test_a_hot_key_is_split(spark, hot_orders, split_early, case):
    from cohortry.operators import joins

    keys = hot_orders.select("k").distinct()
    some, others = keys.filter("k % 2 = 1"), keys.filter("k % 2 = 0")
    right = some.withColumn("name", F.col("k").cast("string"))
    query = {
        "semi": lambda: joins.semi(hot_orders, some, "k"),
        "anti": lambda: joins.anti(hot_orders, others, "k"),
        "not_in": lambda: joins.not_in(hot_orders, others, "k"),
        "exists": lambda: joins.exists_other(hot_orders, ["k"], "l_orderkey"),
        "shared": lambda: joins.shared_values(hot_orders, "k"),
        "membership": lambda: joins.membership(hot_orders, some, "k"),
        "inner": lambda: joins.equi_join(hot_orders, right.repartition("name"), "k", "k"),
        "left": lambda: joins.outer_join(right.repartition("name"), hot_orders, ["k"]),
        "full": lambda: joins.outer_join(right.repartition("name"), hot_orders, ["k"], "full"),
    }[case]()
    rows, text = final_plan(query)
    assert rows > 0 and "skew=true" in text, text


@pytest.mark.parametrize("case", ["anti", "full", "chain"])
def test_a_third_of_null_keys_is_split(spark, hot_orders, split_early, case):
    from cohortry.operators import joins

    holed = hot_orders.withColumn("k", F.nullif(F.col("k"), F.lit(7)))
    keys = hot_orders.select("k").distinct().filter("k % 2 = 0")
    right = keys.withColumn("name", F.col("k").cast("string"))
    query = {
        "anti": lambda: joins.anti(holed, keys, "k"),
        "full": lambda: joins.outer_join(holed, right, ["k"], "full"),
        "chain": lambda: joins.full_outer_chain([holed, right], "k"),
    }[case]()
    rows, text = final_plan(query)
    assert rows > 0 and "skew=true" in text, text


def test_native_full_join_is_not_split(hot_orders, split_early):
    """Why outer_join exists: Spark leaves the hot key of a full join in one task."""
    right = hot_orders.select("k").distinct().withColumn("name", F.col("k").cast("string")).repartition("name")
    assert "skew=true" not in final_plan(right.join(hot_orders, "k", "full"))[1]


def test_grouping_by_the_join_key_alone_is_not_split(hot_orders, split_early):
    """Why group_for_join exists: without the second shuffle the hot key stays in one task."""
    keys = hot_orders.filter("k % 2 = 1").select("k").distinct()
    assert "skew=true" not in final_plan(hot_orders.join(keys, "k", "left_semi"))[1]


MAGNITUDES = {
    "tiny": [1e-10, 3e-10, 4.4e-10, None, -1e-10],
    "smallest": [5e-324, 1e-310, -5e-324, 2.5e-308, 5e-324],
    "cancelling": [1e17, 1.0, -1e17, 1e-9, 2.0],
    "cents": [0.1, 0.2, 0.3, 1234567.89, -0.6],
    "one": [7.25] * 5,
    "zeros": [0.0, -0.0, None, 0.0, 0.0],
    "all": [1e250, 1e-250, -1e250, 3.0, 1e-300],
}


@pytest.mark.parametrize("kind", sorted(MAGNITUDES))
def test_running_means_at_any_magnitude(spark, kind):
    given = MAGNITUDES[kind] * 4
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(given)], "g string, id int, v double").repartition(3)
    want, seen = [], []
    for v in given:
        seen += [] if v is None else [Fraction(v)]
        want.append(float(sum(seen) / len(seen)) if seen else None)
    plain = ranking.running_mean(df, ["g"], ["id"], "v", digits=None)
    cut = ranking.running_mean(df, ["g"], ["id"], "v", digits=None, max_group_rows=0, slices=4)
    got = [r.running_mean for r in plain.orderBy("id").collect()]
    assert got == [r.running_mean for r in cut.orderBy("id").collect()]
    assert all(x == w or abs(x - w) <= 4 * math.ulp(max(abs(w), 5e-324)) for x, w in zip(got, want, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_running_means_are_rounded_once(spark, seed):
    """A sum that is rounded before the division is off by a bit, and beyond the largest double it is infinite."""
    rng = random.Random(seed)
    near = [rng.uniform(-1, 1) for _ in range(150)]
    far = [math.ldexp(rng.uniform(-1, 1), rng.randint(-200, 200)) for _ in range(50)]
    groups = {"same": [0.1] * 60, "large": [1e300] * 60, "below": [-1e300] * 60, "most": [1.7e308, -1.7e308, 1.7e308, 1.7e308, 1.7e308], "near": near, "far": far}
    df = spark.createDataFrame([(g, k, v) for g, values in groups.items() for k, v in enumerate(values)], "g string, id int, v double")
    for name, values in groups.items():
        own = df.filter(F.col("g") == name)  # a group alone chooses its own limbs
        got = [r.running_mean for r in ranking.running_mean(own, ["g"], ["id"], "v", digits=None).orderBy("id").collect()]
        assert got == [float(sum(map(Fraction, values[: k + 1])) / (k + 1)) for k in range(len(values))], name


def test_limbs_hold_every_bit(spark):
    rng = random.Random(4)
    numbers = [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randint(-1073, 1000)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    limbs = limbs_of(df, "v")
    cut = df.select("v", *[c.alias(f"l{k}") for k, c in enumerate(limbs.cut(F.col("v")))])
    for r in cut.collect():
        assert sum(Fraction(r[1 + k]) * Fraction(2) ** (limbs.low + 24 * k) for k in range(limbs.count)) == Fraction(r.v)
    sums = cut.agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(limbs.count)])
    total = sums.select(limbs.value([F.col(f"l{k}") for k in range(limbs.count)])).first()[0]
    exact = float(sum(Fraction(v) for v in numbers))
    assert abs(total - exact) <= 4 * math.ulp(exact)
    assert limbs_of(df.filter("v > 1e308"), "v").count == 1
