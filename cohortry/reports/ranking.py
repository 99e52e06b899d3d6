"""Ranks, top rows, pages, samples and running means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import ranking as rank
from cohortry.operators.joins import semi
from cohortry.reports.registry import Tables, report


@report("""
    SELECT p_partkey, p_name, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)""")
def rows_at_max(t: Tables) -> DataFrame:
    return rank.rows_at_max(t.part, "p_size").select("p_partkey", "p_name", "p_size")


@report("""
    WITH m AS (SELECT l_suppkey, max(l_quantity * (1 - l_discount)) AS top_line FROM lineitem GROUP BY l_suppkey)
    SELECT s_name, l_suppkey, top_line FROM m JOIN supplier ON s_suppkey = l_suppkey
    WHERE top_line = (SELECT max(top_line) FROM m)""")
def keys_at_max(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_suppkey", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("top_line"))
    best = rank.rows_at_max(lines, "top_line", key="l_suppkey")
    return best.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "l_suppkey", "top_line")


@report("""
    SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q
    WHERE rn = 1""")
def latest_per(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rank.latest_per(orders, ["o_custkey"], "o_orderdate", "o_orderkey")


@report("""
    SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal <> 0 GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 1""")
def largest_group(t: Tables) -> DataFrame:
    return rank.largest_group(t.customer.filter(F.col("c_acctbal") != 0), "c_mktsegment")


@report("""
    SELECT n_name FROM nation WHERE n_nationkey =
      (SELECT c_nationkey FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 1)""")
def name_of_largest_group(t: Tables) -> DataFrame:
    winner = rank.largest_group(t.customer.filter(F.col("c_acctbal") < 0), "c_nationkey")
    return semi(t.nation, winner, "n_nationkey", "c_nationkey").select("n_name")


@report("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_totalprice")
    return rank.top_n(orders, [F.col("o_totalprice").desc_nulls_last(), "o_orderkey"], 10)


@report("""
    SELECT o_orderkey, o_totalprice, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey ORDER BY o_totalprice, o_orderkey LIMIT 3""")
def bottom_n(t: Tables) -> DataFrame:
    # Every order has its customer and nation, so the three rows are chosen before they are joined.
    few = rank.top_n(t.orders, ["o_totalprice", "o_orderkey"], 3)
    named = few.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return named.select("o_orderkey", "o_totalprice", "c_mktsegment", "n_name")


@report("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 11 OFFSET 29")
def page(t: Tables) -> DataFrame:
    return rank.page(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], 29, 11)


@report("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 11 OFFSET 129")
def deep_page(t: Tables) -> DataFrame:
    customers = t.customer.select("c_custkey", "c_name")
    return rank.page(customers, ["c_name", "c_custkey"], 129, 11, max_head_rows=100)


@report("""
    SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'
    ORDER BY md5(concat('7:', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 10""")
def sample_n(t: Tables) -> DataFrame:
    group = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    return rank.sample_n(group, "c_custkey", 10, seed=7, digest="md5").select("c_custkey", "c_name")


@report("""
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity,
           dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rank
    FROM lineitem""")
def dense_rank_by(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rank.dense_rank_by(lines, ["l_suppkey"], "l_quantity")


@report("SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size DESC) AS rank FROM part")
def dense_rank_global(t: Tables) -> DataFrame:
    return rank.dense_rank_global(t.part.select("p_partkey", "p_size"), "p_size")


_RUNNING_SQL = """
    SELECT o_custkey, o_orderkey,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS DOUBLE)
             / CAST(100 * count(*) OVER w AS DOUBLE) AS running_mean
    FROM orders WINDOW w AS (PARTITION BY {by} ORDER BY o_orderdate, o_orderkey
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@report(_RUNNING_SQL.format(by="o_custkey"))
def running_mean(t: Tables) -> DataFrame:
    result = rank.running_mean(
        t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", digits=None, exact=True
    )
    return result.select("o_custkey", "o_orderkey", "running_mean")


@report(_RUNNING_SQL.format(by="o_orderpriority"))
def running_mean_large_groups(t: Tables) -> DataFrame:
    # Five groups hold all orders; the low limit makes even the small test tables take the sliced plan.
    result = rank.running_mean(
        t.orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_totalprice", digits=None, exact=True,
        max_group_rows=100,
    )
    return result.select("o_custkey", "o_orderkey", "running_mean")


# Prices from 1e-13 to 1e19 in one column; eleven digits of a mean are the same however it is added.
_VALUES_SQL = """
    WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1e-18 WHEN 1 THEN 1.0 ELSE 1e14 END AS v FROM orders)
    SELECT o_orderkey, format('{{:.10e}}', avg(v) OVER (PARTITION BY {by} ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS running_mean
    FROM v"""


def _means_of_values(t: Tables, by: str, **plan: int) -> DataFrame:
    scale = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1e-18)).when(F.col("o_orderkey") % 3 == 1, F.lit(1.0)).otherwise(F.lit(1e14))
    found = rank.running_mean(t.orders.withColumn("v", F.col("o_totalprice") * scale), [by], ["o_orderdate", "o_orderkey"], "v", digits=None, **plan)
    return found.select("o_orderkey", F.format_string("%.10e", "running_mean").alias("running_mean"))


@report(_VALUES_SQL.format(by="o_custkey"))
def running_mean_of_values(t: Tables) -> DataFrame:
    return _means_of_values(t, "o_custkey")


@report(_VALUES_SQL.format(by="o_orderpriority"))
def running_mean_of_values_large_groups(t: Tables) -> DataFrame:
    return _means_of_values(t, "o_orderpriority", max_group_rows=100)


@report("""
    SELECT p_brand, p_partkey, round(avg(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey
             ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS moving_mean
    FROM part""")
def moving_mean(t: Tables) -> DataFrame:
    result = rank.moving_mean(t.part, ["p_brand"], ["p_partkey"], "p_size", 4, digits=2)
    return result.select("p_brand", "p_partkey", "moving_mean")


@report("""
    SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving_mean
    FROM orders""")
def moving_mean_large_groups(t: Tables) -> DataFrame:
    # A low limit, so that even the small test tables are cut into stretches.
    result = rank.moving_mean(
        t.orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_totalprice", 5, max_group_rows=100
    )
    return result.select("o_orderkey", "moving_mean")


@report()
def sample_hashed(t: Tables) -> DataFrame:
    # The default digest has no counterpart in SQL; tests hold it against brute force.
    return rank.sample_n(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 10, seed=7)
