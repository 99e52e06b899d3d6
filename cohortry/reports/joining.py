"""Joins and existence tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import below, band, between, at_least, csv_line, failed_names, in_year, map_label
from cohortry.operators import joins
from cohortry.operators.aggregates import count_by
from cohortry.operators.hierarchy import expand_hierarchy as expand
from cohortry.operators.joins import Link
from cohortry.reports.registry import Tables, report


@report("""
    SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice > 300000 AND c_acctbal > 0""")
def inner_join(t: Tables) -> DataFrame:
    rich = t.customer.filter(F.col("c_acctbal") > 0)
    large = t.orders.filter(F.col("o_totalprice") > 300000)
    return joins.equi_join(rich, large, "c_custkey", "o_custkey").select(
        "c_custkey", "c_name", "o_orderkey", "o_totalprice"
    )


@report("""
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def existence_join(t: Tables) -> DataFrame:
    returned = t.lineitem.filter(F.col("l_returnflag") == "R")
    return count_by(joins.semi(t.orders, returned, "o_orderkey", "l_orderkey"), "o_orderpriority")


@report("""
    SELECT r_name, c_mktsegment, count(*) AS n FROM customer
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE c_acctbal < 1000 GROUP BY 1, 2""")
def star_join(t: Tables) -> DataFrame:
    poor = t.customer.filter(F.col("c_acctbal") < 1000)
    star = joins.star_join(
        poor, [Link(t.nation, "c_nationkey", "n_nationkey"), Link(t.region, "n_regionkey", "r_regionkey")]
    )
    return count_by(star, "r_name", "c_mktsegment")


@report("""
    SELECT c_mktsegment, l_returnflag, count(*) AS n
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_quantity > 30 GROUP BY 1, 2""")
def bridge_join(t: Tables) -> DataFrame:
    heavy = t.lineitem.filter(F.col("l_quantity") > 30)
    joined = joins.bridge_join(
        t.customer, t.orders, heavy, ("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")
    )
    return count_by(joined, "c_mktsegment", "l_returnflag")


def _wide_links(t: Tables) -> list[Link]:
    return [
        Link(t.orders, "l_orderkey", "o_orderkey"),
        Link(t.customer, "o_custkey", "c_custkey"),
        Link(t.part, "l_partkey", "p_partkey"),
        Link(t.supplier, "l_suppkey", "s_suppkey"),
        Link(t.nation, "c_nationkey", "n_nationkey"),
        Link(t.region, "n_regionkey", "r_regionkey"),
    ]


@report("""
    SELECT o_orderkey, c_name, s_name, r_name, p_brand, l_quantity, l_extendedprice,
           CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'cars' ELSE 'other' END AS segment_group,
           CASE WHEN l_quantity < 12 THEN 'low' WHEN l_quantity <= 30 THEN 'normal' WHEN l_quantity > 30 THEN 'high' END
             AS quantity_band,
           concat_ws(',', CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_tax <= 0.01 THEN 'tax' END)
             AS remarks
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE o_totalprice > 400000""")
def wide_record(t: Tables) -> DataFrame:
    record = joins.wide_record(
        t.lineitem,
        _wide_links(t),
        {
            "o_orderkey": F.col("o_orderkey"),
            "c_name": F.col("c_name"),
            "s_name": F.col("s_name"),
            "r_name": F.col("r_name"),
            "p_brand": F.col("p_brand"),
            "l_quantity": F.col("l_quantity"),
            "l_extendedprice": F.col("l_extendedprice"),
            "o_totalprice": F.col("o_totalprice"),
            "segment_group": map_label("c_mktsegment", {"AUTOMOBILE": "cars"}, "other"),
            "quantity_band": band(
                "l_quantity",
                [below("low", 12), between("normal", 12, 30), at_least("high", 30, inclusive=False)],
            ),
            "remarks": failed_names(
                {"discount": F.col("l_discount") >= 0.09, "tax": F.col("l_tax") <= 0.01}, ","
            ),
        },
    )
    # Filtered on the finished record, as a user of the view would; it still reaches the scan.
    return record.filter(F.col("o_totalprice") > 400000).drop("o_totalprice")


@report("""
    SELECT concat(CAST(o_orderkey AS VARCHAR), ',', coalesce(nullif(o_orderstatus, 'P'), ''), ',', c_mktsegment, ',',
                  n_name, ',', r_name, ',', CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR)) AS record
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      JOIN region ON r_regionkey = n_regionkey""")
def csv_line_records(t: Tables) -> DataFrame:
    star = joins.star_join(
        t.orders,
        [
            Link(t.customer, "o_custkey", "c_custkey"),
            Link(t.nation, "c_nationkey", "n_nationkey"),
            Link(t.region, "n_regionkey", "r_regionkey"),
        ],
    )
    return star.select(
        csv_line(
            "o_orderkey",
            F.nullif(F.col("o_orderstatus"), F.lit("P")),
            "c_mktsegment",
            "n_name",
            "r_name",
            F.round("o_totalprice").cast("bigint"),
        ).alias("record")
    )


@report("""
    SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE year(o_orderdate) = 1997) o ON o_custkey = c_custkey""")
def left_join_all(t: Tables) -> DataFrame:
    orders = t.orders.filter(in_year("o_orderdate", 1997)).select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"
    )
    return joins.outer_join(t.customer.select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


@report("""
    SELECT o_orderkey, o_totalprice, c_custkey, c_mktsegment
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")
def left_join_unique(t: Tables) -> DataFrame:
    rich = t.customer.filter(F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment")
    orders = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("__key"))
    known = rich.withColumn("__key", F.col("c_custkey"))
    return joins.outer_join(orders, known, ["__key"], hot_right=False).drop("__key")


_CHAIN_SQL = """
    WITH a AS (SELECT o_custkey AS id, max(o_totalprice) AS top_order FROM orders
               WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY 1),
         b AS (SELECT user_id AS id, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1),
         c AS (SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000)
    SELECT a.id AS id_0, b.id AS id_1, c.id AS id_2, a.top_order, b.errors, c.balance
    FROM a FULL JOIN b ON a.id = b.id FULL JOIN c ON {key} = c.id"""


def _chain(t: Tables) -> list[DataFrame]:
    urgent = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000))
    errors = t.events.filter((F.col("event_type") == "error") & (F.col("value") > 60))
    return [
        urgent.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("top_order")),
        errors.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("errors")),
        t.customer.filter(F.col("c_acctbal") > 5000).select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")
        ),
    ]


@report(_CHAIN_SQL.format(key="a.id"))
def full_outer_chain(t: Tables) -> DataFrame:
    return joins.full_outer_chain(_chain(t), "id")


@report(_CHAIN_SQL.format(key="coalesce(a.id, b.id)"))
def full_outer_chain_coalesced(t: Tables) -> DataFrame:
    return joins.full_outer_chain(_chain(t), "id", match_first_only=False)


@report("""
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
      (SELECT o_custkey FROM orders WHERE o_orderkey IN
        (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1))""")
def semi_in(t: Tables) -> DataFrame:
    lines = t.lineitem.filter((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1))
    orders = joins.semi(t.orders, lines, "o_orderkey", "l_orderkey")
    return joins.semi(t.customer, orders, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@report("""
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders p WHERE EXISTS
      (SELECT 1 FROM orders q WHERE q.o_custkey = p.o_custkey AND q.o_orderdate = p.o_orderdate
                                AND q.o_orderkey <> p.o_orderkey)""")
def exists_other(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.exists_other(orders, ["o_custkey", "o_orderdate"], "o_orderkey")


@report("""
    SELECT p_partkey, p_brand, p_size FROM part
    WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) > 1)""")
def shared_values(t: Tables) -> DataFrame:
    return joins.shared_values(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])


def _urgent(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_totalprice") > 400000) & (F.col("o_orderpriority") == "1-URGENT"))


@report("""
    SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderpriority = '1-URGENT')""")
def not_in(t: Tables) -> DataFrame:
    return joins.not_in(t.customer, _urgent(t), "c_custkey", "o_custkey").select("c_custkey").distinct()


@report("""
    SELECT 'list with NULL' AS list_kind, count(*) AS n FROM customer WHERE c_custkey NOT IN
      (SELECT nullif(o_custkey, (SELECT min(o_custkey) FROM orders)) FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL
    SELECT 'empty list', count(*) FROM customer WHERE nullif(c_nationkey, 3) NOT IN
      (SELECT n_nationkey FROM nation WHERE n_name = 'NOWHERE')
    UNION ALL
    SELECT 'NULL keys', count(*) FROM customer WHERE nullif(c_nationkey, 3) NOT IN
      (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def not_in_with_nulls(t: Tables) -> DataFrame:
    lowest = t.orders.agg(F.min("o_custkey")).scalar()
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    with_null = urgent.select(F.nullif(F.col("o_custkey"), lowest).alias("id"))
    customers = t.customer.withColumn("nation", F.nullif(F.col("c_nationkey"), F.lit(3)))
    cases = [
        ("list with NULL", joins.not_in(t.customer, with_null, "c_custkey", "id")),
        ("empty list", joins.not_in(customers, t.nation.filter(F.col("n_name") == "NOWHERE"), "nation", "n_nationkey")),
        ("NULL keys", joins.not_in(customers, t.nation.filter(F.col("n_regionkey") == 2), "nation", "n_nationkey")),
    ]
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("list_kind"), "n") for k, df in cases]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@report("""
    SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
      (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000 AND o_orderpriority = '1-URGENT')""")
def anti_join(t: Tables) -> DataFrame:
    return joins.anti(t.customer, _urgent(t), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@report("""
    SELECT v.p_type AS p_type, v.p_brand, b.brand IS NOT NULL AS found
    FROM (SELECT DISTINCT p_type, p_brand FROM part) v
    LEFT JOIN (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size = 50) b ON b.brand = v.p_brand""")
def membership(t: Tables) -> DataFrame:
    pairs = t.part.select("p_type", "p_brand").distinct()
    return joins.membership(pairs, t.part.filter(F.col("p_size") == 50), "p_brand")


@report("""
    WITH RECURSIVE edges AS (
      SELECT 'region ' || n_regionkey AS parent, 'nation ' || n_nationkey AS child FROM nation
      UNION ALL SELECT 'nation ' || c_nationkey, 'customer ' || c_custkey FROM customer
      UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation),
    walk AS (
      SELECT 'region ' || r_regionkey AS node, 0 AS depth FROM region WHERE r_name = 'ASIA'
      UNION SELECT child, depth + 1 FROM walk JOIN edges ON parent = node WHERE depth < 4)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def expand_hierarchy(t: Tables) -> DataFrame:
    # The third set of edges points back up, so the graph has cycles.
    def name(kind: str, column: str):
        return F.concat(F.lit(f"{kind} "), F.col(column).cast("string"))

    edges = (
        t.nation.select(name("region", "n_regionkey").alias("parent"), name("nation", "n_nationkey").alias("child"))
        .unionByName(
            t.customer.select(name("nation", "c_nationkey").alias("parent"), name("customer", "c_custkey").alias("child"))
        )
        .unionByName(
            t.nation.select(name("nation", "n_nationkey").alias("parent"), name("region", "n_regionkey").alias("child"))
        )
    )
    seeds = t.region.filter(F.col("r_name") == "ASIA").select(name("region", "r_regionkey").alias("node"))
    return expand(seeds, edges)
