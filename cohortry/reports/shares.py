"""Counts, percentages, means and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import exact_mean, exact_sum, hour_between, in_period
from cohortry.functions.table_functions import monthly_share as monthly_share_of
from cohortry.functions.table_functions import register_monthly_share
from cohortry.operators import aggregates as agg
from cohortry.operators.distributions import distribution_long as long_distribution
from cohortry.operators.distributions import distribution_wide as wide_distribution
from cohortry.operators.distributions import share_by
from cohortry.operators.quality import check_key as key_violations
from cohortry.reports.registry import Tables, report
from cohortry.sources.snapshots import as_view



def _classes() -> dict:
    quantity = F.col("l_quantity")
    return {
        "low": quantity < 10,
        "normal": quantity.between(10, 30),
        "raised": (quantity > 30) & (quantity <= 40),
        "high": quantity > 40,
    }


_CLASS_SQL = {
    "low": "l_quantity < 10",
    "normal": "l_quantity BETWEEN 10 AND 30",
    "raised": "l_quantity > 30 AND l_quantity <= 40",
    "high": "l_quantity > 40",
}


def _pct(condition: str, within: str = "true") -> str:
    return (
        f"CAST(100 * count(CASE WHEN ({condition}) AND ({within}) THEN 1 END) AS DOUBLE)"
        f" / CAST(nullif(count(CASE WHEN {within} THEN 1 END), 0) AS DOUBLE)"
    )


@report("SELECT " + ", ".join(f'{_pct(c)} AS "{n}"' for n, c in _CLASS_SQL.items()) + " FROM lineitem")
def distribution_wide(t: Tables) -> DataFrame:
    return wide_distribution(t.lineitem, _classes(), digits=None)


@report(" UNION ALL ".join(
    f"SELECT '{n}' AS label, {_pct(c)} AS percentage FROM lineitem" for n, c in _CLASS_SQL.items()))
def distribution_long(t: Tables) -> DataFrame:
    return long_distribution(t.lineitem, _classes(), digits=None)


@report("SELECT " + ", ".join(
    f"{_pct('l_discount > 0.05', f_)} AS rate_{n}"
    for n, f_ in (("a", "l_returnflag = 'A'"), ("n", "l_returnflag = 'N'"), ("r", "l_returnflag = 'R'"),
                  ("none", "l_returnflag = 'X'"))) + " FROM lineitem")
def rate_within_group(t: Tables) -> DataFrame:
    discounted = F.col("l_discount") > 0.05
    return t.lineitem.agg(
        *[
            agg.rate(discounted, F.col("l_returnflag") == flag).alias(f"rate_{name}")
            for name, flag in (("a", "A"), ("n", "N"), ("r", "R"), ("none", "X"))
        ]
    )


@report("""
    SELECT event_type, count(*) AS n,
           CAST(100 * count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS percentage
    FROM events GROUP BY event_type""")
def share_by_category(t: Tables) -> DataFrame:
    return share_by(t.events, ["event_type"])


@report("""
    SELECT n_name, count(*) AS n,
           CAST(100 * count(*) AS DOUBLE) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS percentage
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name""")
def share_of_table_total(t: Tables) -> DataFrame:
    # Counted per key first, named afterwards: the join sees one row per nation.
    shares = share_by(t.customer.filter(F.col("c_acctbal") > 0), ["c_nationkey"], total=t.customer)
    named = shares.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "n", "percentage")


@report("""
    SELECT strftime(o_orderdate, '%B') AS month_name, count(*) AS n, min(o_orderdate) AS first_visit
    FROM orders GROUP BY 1""")
def month_counts(t: Tables) -> DataFrame:
    return agg.sorted_by(agg.visits_by(t.orders, "o_orderdate", "month", name="n"), "first_visit")


@report("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1""")
def day_counts(t: Tables) -> DataFrame:
    return agg.sorted_by(agg.visits_by(t.events, "ts", "day", min_count=2, name="n"), "day")


@report("""
    SELECT CAST(year(date_trunc('week', ts)) AS VARCHAR) || '-W' ||
           lpad(CAST(weekofyear(date_trunc('week', ts)) AS VARCHAR), 2, '0') AS week,
           count(DISTINCT user_id) AS n
    FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1""")
def week_counts(t: Tables) -> DataFrame:
    return agg.sorted_by(agg.visits_by(t.events, "ts", "week", id="user_id", min_count=2, name="n"), "week")


def _spine_sql(table: str, ts: str, id: str) -> str:
    return f"""
    SELECT CAST(m AS INTEGER) AS month, strftime(make_date(2000, CAST(m AS INTEGER), 1), '%B') AS month_name,
           count(DISTINCT {id}) AS ids,
           CAST(100 * count(DISTINCT {id}) AS DOUBLE)
             / CAST((SELECT count(DISTINCT {id}) FROM {table}) AS DOUBLE) AS percentage
    FROM range(1, 13) r(m) LEFT JOIN {table} ON month({ts}) = m GROUP BY m"""


@report(_spine_sql("orders", "o_orderdate", "o_custkey"))
def monthly_share(t: Tables) -> DataFrame:
    return monthly_share_of(t.orders, "o_orderdate", "o_custkey")


@report(_spine_sql("events", "ts", "user_id"))
def monthly_share_function(t: Tables) -> DataFrame:
    as_view(t.events, "cohortry_events")
    register_monthly_share(t.spark, "cohortry_monthly_share", "cohortry_events", "ts", "user_id")
    return t.spark.sql("SELECT * FROM cohortry_monthly_share()")


@report("""
    SELECT count(DISTINCT user_id) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""")
def period_distinct(t: Tables) -> DataFrame:
    return agg.count_distinct(t.events.filter(in_period("ts", "2024-01-05", "2024-01-12")), [], "user_id")


@report("SELECT count(event_id) AS n FROM events WHERE hour(ts) BETWEEN 9 AND 12")
def hour_range_count(t: Tables) -> DataFrame:
    return t.events.filter(hour_between("ts", 9, 12)).agg(F.count("event_id").alias("n"))


@report("SELECT min(o_orderdate) AS first_visit, max(o_orderdate) AS last_visit FROM orders")
def date_span(t: Tables) -> DataFrame:
    return agg.date_span(t.orders, "o_orderdate")


@report("""
    SELECT count(*) AS orders, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled,
           min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS total,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS mean,
           avg(o_custkey) AS mean_key
    FROM orders""")
def global_stats(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
        F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"),
        exact_sum("o_totalprice").alias("total"),
        exact_mean("o_totalprice").alias("mean"),
        F.avg("o_custkey").alias("mean_key"),
    )


@report("""
    SELECT 'ship after order' AS label, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate < l_shipdate
    UNION
    SELECT 'order after ship', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate > l_shipdate""")
def count_cases(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return agg.count_cases(
        joined,
        {
            "ship after order": F.col("o_orderdate") < F.col("l_shipdate"),
            "order after ship": F.col("o_orderdate") > F.col("l_shipdate"),
        },
    )


@report("""
    WITH made AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
                         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
                         nullif(c_nationkey, 3) AS nation FROM customer)
    SELECT 'c_custkey' AS column_name, count(*) FILTER (c_custkey IS NULL) AS nulls, count(*) AS rows FROM made
    UNION ALL SELECT 'segment', count(*) FILTER (segment IS NULL), count(*) FROM made
    UNION ALL SELECT 'balance', count(*) FILTER (balance IS NULL), count(*) FROM made
    UNION ALL SELECT 'nation', count(*) FILTER (nation IS NULL), count(*) FROM made""")
def null_profile(t: Tables) -> DataFrame:
    return agg.null_profile(customers_with_nulls(t))


def customers_with_nulls(t: Tables) -> DataFrame:
    """The given tables hold no NULLs, so some values are turned into NULL, on both sides alike."""
    return t.customer.select(
        "c_custkey",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"),
    )


@report("SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def frequencies(t: Tables) -> DataFrame:
    return agg.count_by(t.lineitem, "l_linenumber")


@report("SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size")
def dedup_group(t: Tables) -> DataFrame:
    from cohortry.operators.filters import distinct_values

    return distinct_values(t.part, "p_brand", "p_size")


@report("""
    SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS n
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def group_dependent(t: Tables) -> DataFrame:
    per_nation = agg.count_distinct(t.customer, ["c_nationkey"], "c_custkey")
    named = per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_nationkey", "n_name", "n")


_VALUES_SQL = """
    SELECT {by}, CAST(floor((rn - 1) / {chunk}) AS BIGINT) AS chunk, list({col} ORDER BY rn) AS "values"
    FROM (SELECT {by}, {col}, row_number() OVER (PARTITION BY {by} ORDER BY {col}, {tie}) AS rn FROM {table}) q
    GROUP BY 1, 2"""


@report(_VALUES_SQL.format(by="p_brand", col="p_size", tie="p_partkey", table="part", chunk="100000.0"))
def values_by(t: Tables) -> DataFrame:
    return agg.values_by(t.part, ["p_brand"], "p_size", ["p_size", "p_partkey"])


@report(_VALUES_SQL.format(by="c_mktsegment", col="c_name", tie="c_custkey", table="customer", chunk="100.0"))
def values_by_chunks(t: Tables) -> DataFrame:
    return agg.values_by(t.customer, ["c_mktsegment"], "c_name", ["c_name", "c_custkey"], chunk_rows=100)


@report("""
    SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_key(t: Tables) -> DataFrame:
    return key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@report("""
    SELECT r_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
      JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    GROUP BY r_name ORDER BY r_name""")
def chart_table(t: Tables) -> DataFrame:
    # Lines are counted per supplier before the joins, so only counts are shuffled.
    per_supplier = agg.count_by(t.lineitem, "l_suppkey")
    per_nation = (
        per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey").agg(F.sum("n").alias("n"))
    )
    named = per_nation.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return agg.sorted_by(named.groupBy("r_name").agg(F.sum("n").alias("n")), "r_name")
