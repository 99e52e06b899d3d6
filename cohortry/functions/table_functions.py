"""Parameterised reports, as functions of a table and as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.numbers import percent


def month_spine(spark: SparkSession) -> DataFrame:
    """The twelve months with their names, in order."""
    month = F.col("id").cast("int")
    name = F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
    return spark.range(1, 13, numPartitions=1).select(month.alias("month"), name.alias("month_name"))


def monthly_share(df: DataFrame, ts: str, id: str, *, digits: int | None = None) -> DataFrame:
    """Percentage of all distinct ids seen in each calendar month, twelve rows, 0 for empty months."""
    spine = month_spine(df.sparkSession)
    per_month = df.groupBy(F.month(ts).alias("month")).agg(F.count_distinct(F.col(id)).alias("ids"))
    total = df.agg(F.count_distinct(F.col(id))).scalar()
    # The spine has twelve rows and the aggregate at most twelve: both sides are of fixed size.
    joined = spine.join(F.broadcast(per_month), "month", "left")
    ids = F.coalesce(F.col("ids"), F.lit(0))
    return joined.select("month", "month_name", ids.alias("ids"), percent(ids, total, digits).alias("percentage"))


def quoted(name: str) -> str:
    """A name as SQL writes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def register_monthly_share(spark: SparkSession, function: str, view: str, ts: str, id: str) -> None:
    """Make the report a table function over a view: ``SELECT * FROM function()``.

    The names are quoted; dots separate the parts of the view's name.
    """
    function, ts, id = quoted(function), quoted(ts), quoted(id)
    view = ".".join(quoted(part) for part in view.split("."))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {function}()
        RETURNS TABLE (month INT, month_name STRING, ids BIGINT, percentage DOUBLE)
        RETURN
          SELECT s.month, s.month_name, coalesce(m.ids, 0L),
                 cast(100 * coalesce(m.ids, 0L) AS DOUBLE)
                   / cast(nullif((SELECT count(DISTINCT {id}) FROM {view}), 0) AS DOUBLE)
          FROM (SELECT cast(id AS INT) AS month, date_format(make_date(2000, cast(id AS INT), 1), 'MMMM') AS month_name
                FROM range(1, 13)) s
          LEFT JOIN (SELECT month({ts}) AS month, count(DISTINCT {id}) AS ids
                     FROM {view} GROUP BY month({ts})) m
            ON s.month = m.month
    """)
