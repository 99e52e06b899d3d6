"""Date, text and NULL handling, filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.operators.aggregates import count_by
from cohortry.operators.filters import distinct_values as distinct_of
from cohortry.operators.filters import rows_with_nulls
from cohortry.reports.registry import Tables, report
from cohortry.reports.shares import customers_with_nulls


@report("""
    SELECT CAST(year(o_orderdate) - (o_custkey % 90) AS BIGINT) AS born, count(*) AS n FROM orders
    GROUP BY 1 ORDER BY 1 DESC""")
def birth_year(t: Tables) -> DataFrame:
    # Age stands in as a number from 0 to 89.
    born = fn.birth_year("o_orderdate", F.col("o_custkey") % 90)
    return count_by(t.orders, born.alias("born")).orderBy(F.col("born").desc_nulls_last())


@report("""
    SELECT CASE WHEN y IS NULL THEN 'unknown' ELSE
             CAST(CAST(floor(y / 10.0) AS BIGINT) * 10 AS VARCHAR) || '-' ||
             CAST(CAST(floor(y / 10.0) AS BIGINT) * 10 + 9 AS VARCHAR) END AS decade, count(*) AS n
    FROM (SELECT year(o_orderdate) - nullif(o_custkey % 90, 7) AS y FROM orders) q GROUP BY 1""")
def birth_decades(t: Tables) -> DataFrame:
    born = fn.birth_year("o_orderdate", F.nullif(F.col("o_custkey") % 90, F.lit(7)))
    return count_by(t.orders, fn.decade_label(born).alias("decade"))


@report("""
    SELECT count(*) FILTER (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) AS leap, count(*) FILTER (y % 4 = 0) AS by_four
    FROM (SELECT year(o_orderdate) - (o_custkey % 120) AS y FROM orders) q""")
def leap_birth(t: Tables) -> DataFrame:
    years = t.orders.select(fn.birth_year("o_orderdate", F.col("o_custkey") % 120).alias("y"))
    return years.agg(
        F.count_if(fn.is_leap_birth("y")).alias("leap"),
        F.count_if(fn.is_leap_birth("y", gregorian=False)).alias("by_four"),
    )


@report("""
    SELECT CAST(2024 - year(o_orderdate) + o_custkey % 90 AS BIGINT) AS age, count(*) AS n FROM orders GROUP BY 1""")
def age_on_date(t: Tables) -> DataFrame:
    age = fn.age_on("o_orderdate", F.col("o_custkey") % 90, as_of=F.lit("2024-06-30").cast("date"))
    return count_by(t.orders, age.alias("age"))


@report("""
    SELECT event_id, CAST(ts AS DATE) AS visit_date, strftime(ts, '%H:%M:%S') AS visit_time,
           strftime(ts, '%I:%M:%S %p') AS visit_time_12h, strftime(ts, '%Y-%m-%d %H:%M:%S') AS visit_text
    FROM events""")
def split_date_time(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.to_date("ts").alias("visit_date"),
        fn.time_text("ts").alias("visit_time"),
        fn.time_text_12h("ts").alias("visit_time_12h"),
        fn.timestamp_text("ts").alias("visit_text"),
    )


@report("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
           CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
           CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
           CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month,
           upper(strftime(o_orderdate, '%B')) AS month_upper, strftime(o_orderdate, '%Y') AS year_text
    FROM orders""")
def date_scalars(t: Tables) -> DataFrame:
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey",
        F.year(d).cast("bigint").alias("y"),
        F.month(d).cast("bigint").alias("m"),
        F.hour(d).cast("bigint").alias("h"),
        F.to_date(F.date_trunc("month", d)).alias("month_start"),
        F.to_date(F.date_trunc("week", d)).alias("week_start"),
        F.add_months(d, 1).alias("next_month"),
        F.upper(fn.month_name(d)).alias("month_upper"),
        F.date_format(d, "yyyy").alias("year_text"),
    )


@report("""
    SELECT p_partkey, concat(p_name, ' ', p_brand) AS full_name, upper(concat(p_name, ' ', p_brand)) AS upper_name,
           lower(left(p_brand, 5)) AS brand_start, right(CAST(p_size AS VARCHAR), 2) AS size_end,
           substring(p_brand, 7, 2) AS brand_number, CAST(position('e' IN p_name) AS INTEGER) AS e_at,
           replace(p_type, 'S', 'Z') AS replaced, CAST(length(concat(p_name, ' ', p_brand)) + 1 AS INTEGER) AS length_plus,
           list_aggregate(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))),
                          'string_agg', ' ') AS title,
           concat_ws('/', p_brand, p_type) AS path, chr(39) || p_brand || '"' AS quoted
    FROM part""")
def string_functions(t: Tables) -> DataFrame:
    name = fn.full_name("p_name", "p_brand")
    return t.part.select(
        "p_partkey",
        name.alias("full_name"),
        F.upper(name).alias("upper_name"),
        F.lower(F.left("p_brand", F.lit(5))).alias("brand_start"),
        F.right(F.col("p_size").cast("string"), F.lit(2)).alias("size_end"),
        F.substring("p_brand", 7, 2).alias("brand_number"),
        F.instr("p_name", "e").alias("e_at"),
        F.replace("p_type", F.lit("S"), F.lit("Z")).alias("replaced"),
        (F.length(name) + 1).alias("length_plus"),
        F.initcap("p_name").alias("title"),
        F.concat_ws("/", "p_brand", "p_type").alias("path"),
        F.concat(F.lit("'"), "p_brand", F.lit('"')).alias("quoted"),
    )


@report("SELECT substr(c_name, 1, 1) AS first_letter, count(1) AS n FROM customer GROUP BY 1")
def first_letters(t: Tables) -> DataFrame:
    return count_by(t.customer, F.left("c_name", F.lit(1)).alias("first_letter"))


@report("""
    SELECT c_custkey, concat(nullif(c_mktsegment, 'BUILDING'), ' ', c_name) AS skipping,
           nullif(c_mktsegment, 'BUILDING') || ' ' || c_name AS propagating,
           concat_ws('-', nullif(c_mktsegment, 'BUILDING'), c_name) AS separated
    FROM customer""")
def null_concat(t: Tables) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select(
        "c_custkey",
        fn.full_name(segment, "c_name").alias("skipping"),
        fn.concat_null(segment, F.lit(" "), "c_name").alias("propagating"),
        F.concat_ws("-", segment, "c_name").alias("separated"),
    )


@report("""
    SELECT c_custkey, CAST(substring(c_name, 10) AS BIGINT) AS number,
           CASE WHEN CAST(substring(c_name, 10) AS BIGINT) % 2 = 0 THEN 'true' ELSE 'false' END AS even,
           CASE WHEN CAST(substring(c_name, 10) AS BIGINT) % 2 = 0 THEN 'false' ELSE 'true' END AS odd
    FROM customer""")
def id_parity(t: Tables) -> DataFrame:
    number = fn.id_number("c_name", skip=9)
    even = number % 2 == 0
    return t.customer.select(
        "c_custkey",
        number.alias("number"),
        F.when(even, "true").otherwise("false").alias("even"),
        F.when(even, "false").otherwise("true").alias("odd"),
    )


@report("SELECT p_partkey, 'UID' || CAST(p_partkey * 1000 AS VARCHAR) AS user_id FROM part")
def derived_id(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.derived_id("p_partkey").alias("user_id"))


@report("""
    SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Mr. ' || c_name WHEN 'BUILDING' THEN 'Ms. ' || c_name
           END AS prefixed_name FROM customer""")
def map_label(t: Tables) -> DataFrame:
    named = fn.prefixed("c_name", "c_mktsegment", {"AUTOMOBILE": "Mr. ", "BUILDING": "Ms. "})
    return t.customer.select("c_custkey", named.alias("prefixed_name"))


@report("""
    SELECT p_partkey, p_name, p_name LIKE 's%' AS prefix, p_name LIKE '%an%' AS inside, p_brand LIKE 'B%3' AS both_ends,
           p_name ILIKE 'S%R%' AS any_case, regexp_matches(p_name, '[aeiou]{2}') AS pattern
    FROM part WHERE p_name LIKE '%e%' OR p_name ILIKE 'S%' OR regexp_matches(p_type, '[[:space:]]')""")
def pattern_filters(t: Tables) -> DataFrame:
    kept = t.part.filter(
        F.col("p_name").contains("e") | F.col("p_name").ilike("S%") | F.col("p_type").rlike(r"\s")
    )
    return kept.select(
        "p_partkey",
        "p_name",
        F.col("p_name").startswith("s").alias("prefix"),
        F.col("p_name").contains("an").alias("inside"),
        F.col("p_brand").like("B%3").alias("both_ends"),
        F.col("p_name").ilike("S%R%").alias("any_case"),
        F.col("p_name").rlike("[aeiou]{2}").alias("pattern"),
    )


@report("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity IN (8, 17, 49)")
def in_list(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_quantity").isin(8, 17, 49)).select("l_orderkey", "l_linenumber", "l_quantity")


@report("""
    SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 10 AND 20) AS inside,
           count(*) FILTER (l_quantity NOT BETWEEN 10 AND 20) AS outside,
           count(*) FILTER (nullif(l_quantity, 5) NOT BETWEEN 10 AND 20) AS outside_known
    FROM lineitem WHERE l_discount NOT BETWEEN 0.02 AND 0.03 GROUP BY 1""")
def between_filters(t: Tables) -> DataFrame:
    kept = t.lineitem.filter(~F.col("l_discount").between(0.02, 0.03))
    inside = F.col("l_quantity").between(10, 20)
    known = F.nullif(F.col("l_quantity"), F.lit(5.0)).between(10, 20)
    return kept.groupBy("l_returnflag").agg(
        F.count_if(inside).alias("inside"),
        F.count_if(~inside).alias("outside"),
        F.count_if(~known).alias("outside_known"),
    )


@report("""
    SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem
    WHERE l_discount < l_tax AND (l_linestatus <> 'O' OR l_quantity >= 25)""")
def column_compare(t: Tables) -> DataFrame:
    kept = t.lineitem.filter(
        (F.col("l_discount") < F.col("l_tax")) & ((F.col("l_linestatus") != "O") | (F.col("l_quantity") >= 25))
    )
    return kept.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


_NULLED_SQL = """(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
      CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, nullif(c_nationkey, 3) AS nation FROM customer)"""


@report(f"""SELECT * FROM {_NULLED_SQL} q WHERE segment IS NULL OR balance IS NULL OR nation IS NULL""")
def any_null_rows(t: Tables) -> DataFrame:
    return rows_with_nulls(customers_with_nulls(t), ["segment", "balance", "nation"])


@report(f"""
    SELECT c_custkey, CASE WHEN balance IS NOT NULL THEN 'known' ELSE 'unknown' END AS state FROM {_NULLED_SQL} q
    WHERE segment IS NULL AND nation IS NOT NULL""")
def null_filters(t: Tables) -> DataFrame:
    kept = customers_with_nulls(t).filter(F.col("segment").isNull() & F.col("nation").isNotNull())
    return kept.select("c_custkey", F.when(F.col("balance").isNotNull(), "known").otherwise("unknown").alias("state"))


@report("SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def distinct_values(t: Tables) -> DataFrame:
    return distinct_of(t.part.filter(F.col("p_brand").startswith("Brand#1")), "p_brand")


@report("""
    SELECT p_partkey, p_size, 'Prediabetic' AS label FROM (SELECT * FROM part WHERE p_size > 24.9) AS p
    WHERE p_brand = 'Brand#1' OR p_brand <> 'Brand#2'""")
def derived_table(t: Tables) -> DataFrame:
    large = t.part.filter(F.col("p_size") > 24.9)
    kept = large.filter((F.col("p_brand") == "Brand#1") | (F.col("p_brand") != "Brand#2"))
    return kept.select("p_partkey", "p_size", F.lit("Prediabetic").alias("label"))
