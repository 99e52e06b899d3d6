"""Tables laid out for what reads them, limits kept in a table, and hierarchies of any depth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.bands import at_least, band, below, between
from cohortry.operators.hierarchy import roots
from cohortry.operators.intervals import interval_join
from cohortry.operators.joins import Link, wide_record
from cohortry.operators.quality import text_rules, with_broken_rules
from cohortry.reports.registry import Tables, report
from cohortry.reports.writing import parts_to_check
from cohortry.sources import new_path
from cohortry.sources.layouts import bucketed, counted_write, forget, page_directory, read_partitions, write_partitions


@report("""
    SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice, o_orderpriority, l_quantity,
           CASE WHEN l_quantity < 12 THEN 'low' WHEN l_quantity <= 30 THEN 'normal' WHEN l_quantity > 30 THEN 'high' END AS quantity_band
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 5""")
def wide_record_bucketed(t: Tables) -> DataFrame:
    """The two large tables are stored in buckets of the key that joins them."""
    names = [f"cohortry_{label}_{uuid.uuid4().hex}" for label in ("lines", "orders")]
    lines = bucketed(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), names[0], ["l_orderkey"], 8)
    orders = bucketed(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), names[1], ["o_orderkey"], 8)
    bands = [below("low", 12), between("normal", 12, 30), at_least("high", 30, inclusive=False)]
    kept = ["l_orderkey", "l_linenumber", "o_custkey", "o_totalprice", "o_orderpriority", "l_quantity"]
    record = wide_record(lines, [Link(orders, "l_orderkey", "o_orderkey")], {**{c: F.col(c) for c in kept}, "quantity_band": band("l_quantity", bands)})
    for name in names:
        forget(t.spark, name)
    return record.filter(F.col("l_quantity") > 5)


@report("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS visits,
           sum(CAST(round(CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-06' THEN value + 1 ELSE value END * 100) AS BIGINT))::BIGINT AS cents
    FROM events WHERE dayofweek(ts) IN (0, 6) GROUP BY 1, 2""")
def visits_of_period_partitioned(t: Tables) -> DataFrame:
    """Events lie by day; one day is corrected in place, and weekends are read through a table of days."""
    path = new_path(t.spark, "visits")
    events = t.events.select("event_id", "ts", "event_type", "value", F.to_date("ts").alias("day"))
    write_partitions(events, path, ["day"])
    first = F.col("day") == F.lit("2024-01-06").cast("date")
    stored = read_partitions(t.spark, path, events.schema)
    corrected = stored.filter(first).withColumn("value", F.col("value") + 1)
    beside = new_path(t.spark, "corrected")  # a query cannot read the files it replaces
    corrected.write.parquet(beside)
    write_partitions(t.spark.read.schema(corrected.schema).parquet(beside), path, ["day"])
    days = new_path(t.spark, "days")
    events.select("day", F.when(F.dayofweek("day").isin(1, 7), F.lit("weekend")).otherwise(F.lit("week")).alias("kind")).distinct().write.parquet(days)
    weekends = t.spark.read.schema("day date, kind string").parquet(days).filter(F.col("kind") == "weekend")
    found = read_partitions(t.spark, path, events.schema).join(weekends, "day").groupBy("day", "event_type")
    totals = found.agg(F.count(F.lit(1)).alias("visits"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return totals.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@report("""
    SELECT s_suppkey, count(c_custkey) AS customers, min(c_custkey) AS first, max(c_custkey) AS last
    FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND s_acctbal >= c_acctbal
      AND (CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal + c_custkey % 1000 END IS NULL
           OR s_acctbal < CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal + c_custkey % 1000 END)
    GROUP BY s_suppkey""")
def limits_table_join(t: Tables) -> DataFrame:
    """Each customer sets limits for the suppliers of their nation; some have no upper limit."""
    upper = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + F.col("c_custkey") % 1000)
    limits = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("low"), upper.alias("high"))
    suppliers = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    totals = {"customers": ("count", "c_custkey"), "first": ("min", "c_custkey"), "last": ("max", "c_custkey")}
    met = interval_join(suppliers, "s_acctbal", limits, "low", "high", by=["nation"], how="left", totals=totals)
    return met.groupBy("s_suppkey").agg(F.sum("customers").alias("customers"), F.min("first").alias("first"), F.max("last").alias("last"))


@report("""
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def deep_hierarchy(t: Tables) -> DataFrame:
    """Each order points at the one before it of the same customer."""
    previous = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return roots(t.orders.select("o_orderkey", previous.alias("previous")), node="o_orderkey", parent="previous")


@report("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 350")
def page_by_directory(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    pages = page_directory(orders, ["o_orderdate", "o_orderkey"], 50, new_path(t.spark, "pages"))
    return pages.read(7).select("o_orderkey", "o_orderdate", "o_totalprice")


@report(r"""
    WITH m AS (SELECT CASE WHEN p_size > 20 THEN replace(p_name, ' ', '_') ELSE p_name END AS p_name, CASE WHEN p_size > 10 THEN lower(p_type) ELSE p_type END AS p_type FROM part)
    SELECT 'p_name: white space' AS rule, count(*) FILTER (WHERE regexp_matches(p_name, '\s')) AS broken, count(*) AS rows FROM m
    UNION ALL SELECT 'p_name: not lower case', count(*) FILTER (WHERE p_name <> lower(p_name)), count(*) FROM m
    UNION ALL SELECT 'p_type: white space', count(*) FILTER (WHERE regexp_matches(p_type, '\s')), count(*) FROM m
    UNION ALL SELECT 'p_type: not lower case', count(*) FILTER (WHERE p_type <> lower(p_type)), count(*) FROM m""")
def validate_observed(t: Tables) -> DataFrame:
    """The write that sets rejected rows apart also counts which rules they break."""
    rules = text_rules(["p_name", "p_type"])
    checked = with_broken_rules(parts_to_check(t.part), rules).withColumn("ok", F.size("broken_rules") == 0)
    counts = counted_write(checked, new_path(t.spark, "observed"), {rule: F.array_contains("broken_rules", rule) for rule in rules}, by=["ok"])
    return t.spark.createDataFrame([(rule, counts[rule], counts["rows"]) for rule in rules], "rule string, broken long, rows long")
