"""Bands, bins and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import (
    at_least,
    band,
    band_by,
    below,
    between,
    bin_label,
    bucket_label,
    bucket_number,
    mean_arterial_pressure,
    ratio,
    within_limits,
)
from cohortry.functions.bands import bin_start
from cohortry.operators.aggregates import count_by, count_distinct, mean_by, sorted_by
from cohortry.operators.joins import semi
from cohortry.operators.ranking import dominant
from cohortry.operators.scoring import at_least_k, count_any, failed_combinations, failed_count
from cohortry.reports.registry import Tables, report

QUANTITY_BANDS = [
    below("low", 12), between("normal", 12, 30, "left"), between("raised", 30, 45, "left"), at_least("high", 45),
]


@report("""
    SELECT order_year, price_bin, n FROM (
      SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year,
             CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) * 50000 AS VARCHAR) || '-' ||
             CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) * 50000 + 49999 AS VARCHAR) AS price_bin,
             count(*) AS n,
             row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY count(*) DESC,
               CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) * 50000 AS VARCHAR) || '-' ||
               CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) * 50000 + 49999 AS VARCHAR)) AS rn
      FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
      GROUP BY year(o_orderdate), floor(o_totalprice / 50000)) q
    WHERE rn = 1""")
def dominant_bin_per_year(t: Tables) -> DataFrame:
    heavy = t.lineitem.filter(F.col("l_quantity") > 45)
    orders = semi(t.orders, heavy, "o_orderkey", "l_orderkey").select(
        F.year("o_orderdate").cast("bigint").alias("order_year"),
        bin_label("o_totalprice", 50000).alias("price_bin"),
    )
    return sorted_by(dominant(orders, ["order_year"], "price_bin"), "order_year")


@report("""
    SELECT CASE WHEN l_quantity < 12 THEN 'low' WHEN l_quantity < 30 THEN 'normal'
                WHEN l_quantity < 45 THEN 'raised' ELSE 'high' END AS quantity_band, count(*) AS n
    FROM lineitem GROUP BY 1""")
def band_counts(t: Tables) -> DataFrame:
    return count_by(t.lineitem, band("l_quantity", QUANTITY_BANDS).alias("quantity_band"))


@report("""
    SELECT CASE WHEN l_returnflag = 'A' AND l_quantity < 10 THEN 'low'
                WHEN l_returnflag = 'A' AND l_quantity BETWEEN 10 AND 40 THEN 'normal'
                WHEN l_returnflag = 'A' THEN 'high'
                WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 'low'
                WHEN l_returnflag = 'R' AND l_quantity BETWEEN 5 AND 25 THEN 'normal'
                WHEN l_returnflag = 'R' THEN 'high'
                ELSE 'no limits' END AS quantity_band, count(*) AS n
    FROM lineitem GROUP BY 1""")
def band_counts_by_group(t: Tables) -> DataFrame:
    bands = {
        flag: [below("low", lo), between("normal", lo, hi), at_least("high", hi, inclusive=False)]
        for flag, lo, hi in (("A", 10, 40), ("R", 5, 25))
    }
    return count_by(t.lineitem, band_by("l_quantity", "l_returnflag", bands, "no limits").alias("quantity_band"))


@report("""
    SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE (l_returnflag = 'A' AND l_discount BETWEEN 0.02 AND 0.06)
       OR (l_returnflag = 'R' AND l_discount BETWEEN 0.04 AND 0.09)
    GROUP BY l_returnflag""")
def within_group_limits(t: Tables) -> DataFrame:
    inside = within_limits("l_discount", "l_returnflag", {"A": (0.02, 0.06), "R": (0.04, 0.09)})
    return count_by(t.lineitem.filter(inside), "l_returnflag")


_FLAGS_SQL = """(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END + CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END +
      CASE WHEN l_tax <= 0.01 THEN 1 ELSE 0 END + CASE WHEN nullif(l_linenumber, 1) >= 6 THEN 1 ELSE 0 END)"""


def _flags() -> dict:
    return {
        "quantity": F.col("l_quantity") >= 45,
        "discount": F.col("l_discount") >= 0.09,
        "tax": F.col("l_tax") <= 0.01,
        "line": F.nullif(F.col("l_linenumber"), F.lit(1)) >= 6,
    }


@report(f"""
    SELECT l_returnflag, CAST({_FLAGS_SQL} AS BIGINT) AS failed, count(*) AS n FROM lineitem
    WHERE {_FLAGS_SQL} >= 2 GROUP BY 1, 2""")
def k_of_n(t: Tables) -> DataFrame:
    tests = list(_flags().values())
    kept = t.lineitem.filter(at_least_k(tests, 2))
    return count_by(kept, "l_returnflag", failed_count(tests).cast("bigint").alias("failed"))


@report(f"""
    SELECT concat_ws(', ', CASE WHEN l_quantity >= 45 THEN 'quantity' END,
                     CASE WHEN l_discount >= 0.09 THEN 'discount' END,
                     CASE WHEN l_tax <= 0.01 THEN 'tax' END,
                     CASE WHEN nullif(l_linenumber, 1) >= 6 THEN 'line' END) AS failed, count(*) AS n
    FROM lineitem WHERE {_FLAGS_SQL} >= 2 GROUP BY 1""")
def failed_names_counts(t: Tables) -> DataFrame:
    return failed_combinations(t.lineitem, _flags(), 2)


@report("""
    SELECT CAST(CAST(floor((l_quantity - 1) / 5) AS BIGINT) * 5 AS VARCHAR) || '-' ||
           CAST(CAST(floor((l_quantity - 1) / 5) AS BIGINT) * 5 + 4 AS VARCHAR) AS quantity_bin,
           count(DISTINCT CASE WHEN l_discount >= 0.09 OR l_tax <= 0.01 OR l_linenumber >= 6 THEN l_suppkey END) AS n
    FROM lineitem GROUP BY 1""")
def any_of_n_by_bin(t: Tables) -> DataFrame:
    tests = [F.col("l_discount") >= 0.09, F.col("l_tax") <= 0.01, F.col("l_linenumber") >= 6]
    return count_any(t.lineitem, [bin_label("l_quantity", 5, offset=1).alias("quantity_bin")], tests, "l_suppkey")


@report("""
    SELECT CAST(CAST(floor(p_size / 5.0) AS BIGINT) * 5 AS VARCHAR) || '-' ||
           CAST(CAST(floor(p_size / 5.0) AS BIGINT) * 5 + 5 AS VARCHAR) AS size_bin, count(*) AS n
    FROM part GROUP BY 1""")
def bin_floor(t: Tables) -> DataFrame:
    return count_by(t.part, bin_label("p_size", 5, upper="exclusive").alias("size_bin"))


@report("""
    SELECT bucket, CAST(10 + (bucket - 1) * 5 AS VARCHAR) || ' - ' || CAST(10 + bucket * 5 - 1 AS VARCHAR) AS size_range,
           count(*) AS n
    FROM (SELECT CAST(CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7
                           ELSE floor((p_size - 10) / 5.0) + 1 END AS BIGINT) AS bucket FROM part) q
    GROUP BY 1, 2""")
def bin_bucket(t: Tables) -> DataFrame:
    counts = count_by(
        t.part,
        bucket_number("p_size", 10, 40, 6).alias("bucket"),
        bucket_label("p_size", 10, 40, 6).alias("size_range"),
    )
    return sorted_by(counts, "bucket")


@report("""
    SELECT CAST(floor(p_retailprice / 10) AS BIGINT) * 10 AS price_bin, round(avg(p_size), 2) AS mean_size
    FROM part GROUP BY 1""")
def mean_by_bin(t: Tables) -> DataFrame:
    return mean_by(t.part, [bin_start("p_retailprice", 10).alias("price_bin")], "p_size", "mean_size")


@report("""
    SELECT CASE WHEN p_size <= 10 THEN '1-10' WHEN p_size <= 20 THEN '11-20' WHEN p_size <= 30 THEN '21-30'
                ELSE '30+' END AS size_class,
           CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS mean_price
    FROM part GROUP BY 1""")
def money_mean_by_class(t: Tables) -> DataFrame:
    size_class = band(
        "p_size",
        [below("1-10", 10, inclusive=True), below("11-20", 20, inclusive=True), below("21-30", 30, inclusive=True)],
        "30+",
    )
    return mean_by(t.part, [size_class.alias("size_class")], "p_retailprice", "mean_price", digits=None, exact=True)


@report("""
    SELECT o_orderkey, (2 * o_totalprice + c_acctbal) / 3 AS weighted_mean
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def mean_pressure(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", mean_arterial_pressure("c_acctbal", "o_totalprice").alias("weighted_mean"))


@report("""
    SELECT p_partkey, p_size * (p_retailprice * p_retailprice) AS product,
           p_retailprice / nullif(CAST(p_size - 1 AS DOUBLE), 0) AS ratio, p_retailprice - p_size AS difference,
           p_retailprice / 6 AS per_minute
    FROM part""")
def derived_measures(t: Tables) -> DataFrame:
    from cohortry.functions import distance_per_minute, weight_from_bmi

    return t.part.select(
        "p_partkey",
        weight_from_bmi("p_size", "p_retailprice", digits=None).alias("product"),
        ratio("p_retailprice", F.col("p_size") - 1).alias("ratio"),
        (F.col("p_retailprice") - F.col("p_size")).alias("difference"),
        distance_per_minute("p_retailprice", 6, digits=None).alias("per_minute"),
    )


@report("""
    SELECT height_text, count(*) AS n FROM (
      SELECT CAST(CAST(floor(f) AS BIGINT) AS VARCHAR) || chr(39) ||
             CAST(CAST(floor((f - floor(f)) * 12) AS BIGINT) AS VARCHAR) || '"' AS height_text
      FROM (SELECT l_quantity / 20 * 3.28084::DOUBLE AS f FROM lineitem) a) b
    GROUP BY 1""")
def feet_inches(t: Tables) -> DataFrame:
    from cohortry.functions import feet_and_inches

    return count_by(t.lineitem, feet_and_inches(F.col("l_quantity") / 20).alias("height_text"))


@report("""
    SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE l_extendedprice / nullif(l_quantity, 0) > 1500 AND l_quantity * (1 - l_discount) > 20
    GROUP BY 1""")
def ratio_filter(t: Tables) -> DataFrame:
    kept = t.lineitem.filter(
        (ratio("l_extendedprice", "l_quantity") > 1500) & (F.col("l_quantity") * (1 - F.col("l_discount")) > 20)
    )
    return count_by(kept, "l_returnflag")


@report("""
    SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(floor(o_totalprice / 100000) AS BIGINT) * 100000 AS price_bin,
           count(*) AS n
    FROM orders GROUP BY 1, 2""")
def crosstab_counts(t: Tables) -> DataFrame:
    counts = count_by(
        t.orders,
        F.year("o_orderdate").cast("bigint").alias("order_year"),
        bin_start("o_totalprice", 100000).alias("price_bin"),
    )
    return sorted_by(counts, "order_year", "price_bin")


@report("""
    SELECT p_partkey, CAST(p_retailprice AS DECIMAL(10,2)) AS price_decimal, CAST(p_size AS VARCHAR) AS size_text,
           round(p_size / 4.0, 1)::DOUBLE AS size_round, CAST(floor(p_retailprice) AS BIGINT) AS price_floor,
           CAST(ceil(p_retailprice) AS BIGINT) AS price_ceil, CAST(p_size % 7 AS BIGINT) AS size_mod,
           CAST(CASE WHEN p_size < 0 THEN 0 WHEN p_size >= 50 THEN 11 ELSE floor(p_size / 5.0) + 1 END AS BIGINT) AS size_bucket,
           p_retailprice * 2 - p_size + 1 AS arithmetic
    FROM part""")
def math_scalars(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.col("p_retailprice").cast("decimal(10,2)").alias("price_decimal"),
        F.col("p_size").cast("string").alias("size_text"),
        F.round(F.col("p_size") / 4, 1).alias("size_round"),
        F.floor("p_retailprice").cast("bigint").alias("price_floor"),
        F.ceil("p_retailprice").cast("bigint").alias("price_ceil"),
        (F.col("p_size") % 7).cast("bigint").alias("size_mod"),
        bucket_number("p_size", 0, 50, 10).alias("size_bucket"),
        (F.col("p_retailprice") * 2 - F.col("p_size") + 1).alias("arithmetic"),
    )


@report("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def distinct_per_group(t: Tables) -> DataFrame:
    return count_distinct(t.orders, ["o_orderpriority"], "o_custkey")
