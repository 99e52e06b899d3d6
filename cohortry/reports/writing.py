"""Tables that are written and read back, and the row checks and alerts in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.aggregates import count_by
from cohortry.operators.quality import alerts, split_valid, text_rules
from cohortry.reports.registry import Tables, report
from cohortry.sources import (
    Snapshot,
    append,
    as_view,
    drop_view,
    empty,
    new_path,
    snapshot,
    union_children as union_of,
    update_where as update,
)

_PART = T.StructType(
    [T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
     T.StructField("p_size", T.IntegerType())]
)


@report("""
    SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40
    UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 10""")
def append_rows(t: Tables) -> DataFrame:
    path = new_path(t.spark, "append")
    append(empty(t.spark, _PART), path)
    for test in (F.col("p_size") > 40, F.col("p_size") < 10):
        append(t.part.filter(test).select(*_PART.names), path)
    return t.spark.read.schema(_PART).parquet(path)


@report("""
    SELECT s_suppkey, CASE WHEN s_nationkey = 5 THEN 'moved ' || s_name ELSE s_name END AS s_name, s_nationkey,
           CASE WHEN s_nationkey = 5 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def update_where(t: Tables) -> DataFrame:
    moved = update(
        t.supplier,
        F.col("s_nationkey") == 5,
        {"s_name": F.concat(F.lit("moved "), "s_name"), "s_acctbal": F.lit(0.0)},
    )
    return snapshot(moved, new_path(t.spark, "update"))


@report("""
    SELECT p_partkey, p_name FROM part WHERE p_size <= 25
    UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size > 25""")
def union_children(t: Tables) -> DataFrame:
    parent = t.part.filter(F.col("p_size") <= 25).select("p_partkey", "p_name")
    child = t.part.filter(F.col("p_size") > 25).select("p_size", "p_name", "p_partkey")
    return union_of(parent, child)


@report("""
    SELECT c_mktsegment, count(c_mktsegment) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def snapshot_refresh(t: Tables) -> DataFrame:
    def build() -> DataFrame:
        joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.groupBy("c_mktsegment").agg(F.count("c_mktsegment").alias("n"))

    stored = Snapshot(t.spark, new_path(t.spark, "snapshot"), build)
    stored.create_empty()
    return stored.refresh()


@report("""
    SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN nation ON n_nationkey = c_nationkey WHERE year(o_orderdate) - c_nationkey = 1990""")
def table_from_query(t: Tables) -> DataFrame:
    born = F.year("o_orderdate") - F.col("c_nationkey")
    joined = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .filter(born == 1990)
        .select("o_orderkey", "c_name", "n_name", "o_totalprice")
    )
    return snapshot(joined, new_path(t.spark, "table"), sort_by=["o_orderkey"])


@report("SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 3 AND 6 GROUP BY 1")
def named_view(t: Tables) -> DataFrame:
    lines = t.lineitem.filter(F.col("l_quantity").between(3, 6)).select("l_linenumber", "l_quantity")
    as_view(lines, "cohortry_small_lines")
    result = t.spark.sql("SELECT l_linenumber, count(*) AS n FROM cohortry_small_lines GROUP BY l_linenumber")
    drop_view(t.spark, "cohortry_small_lines")
    return result


_BROKEN_SQL = """
    SELECT broken, count(*) AS n FROM (
      SELECT concat_ws(', ', CASE WHEN regexp_matches(p_name, '\\s') THEN 'p_name: white space' END,
               CASE WHEN p_name <> lower(p_name) THEN 'p_name: not lower case' END,
               CASE WHEN regexp_matches(p_type, '\\s') THEN 'p_type: white space' END,
               CASE WHEN p_type <> lower(p_type) THEN 'p_type: not lower case' END) AS broken
      FROM (SELECT p_partkey, CASE WHEN p_size > 20 THEN replace(p_name, ' ', '_') ELSE p_name END AS p_name,
                   CASE WHEN p_size > 10 THEN lower(p_type) ELSE p_type END AS p_type FROM part) m) q
    GROUP BY broken"""


def parts_to_check(parts: DataFrame) -> DataFrame:
    """Names and types, made acceptable for some sizes so that both outcomes occur."""
    return parts.select(
        "p_partkey",
        F.when(F.col("p_size") > 20, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_size") > 10, F.lower("p_type")).otherwise(F.col("p_type")).alias("p_type"),
    )


def outcome_counts(good: DataFrame, rejected: DataFrame) -> DataFrame:
    reasons = F.concat_ws(", ", "broken_rules")
    passed = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("broken"), "n").filter(F.col("n") > 0)
    return passed.unionByName(count_by(rejected, reasons.alias("broken")))


@report(_BROKEN_SQL)
def validate_split(t: Tables) -> DataFrame:
    return outcome_counts(*split_valid(parts_to_check(t.part), text_rules(["p_name", "p_type"])))


def _alert_sql(mode: str) -> str:
    return f"""
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
           concat('abnormal values: ', concat_ws(', ', CASE WHEN l_quantity > 45 THEN 'l_quantity' END,
             CASE WHEN l_discount > 0.08 THEN 'l_discount' END)) AS alert
    FROM lineitem WHERE l_quantity > 45 {mode} l_discount > 0.08"""


_ALERT_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "alert"]


@report(_alert_sql("AND"))
def alerts_all(t: Tables) -> DataFrame:
    return alerts(t.lineitem, {"l_quantity": 45, "l_discount": 0.08}).select(*_ALERT_COLUMNS)


@report(_alert_sql("OR"))
def alerts_any(t: Tables) -> DataFrame:
    return alerts(t.lineitem, {"l_quantity": 45, "l_discount": 0.08}, mode="any").select(*_ALERT_COLUMNS)
