"""Questions about visit dates and labs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.functions.table_functions import monthly_share
from cohortry.operators import aggregates as agg
from cohortry.operators.distributions import share_by
from cohortry.operators.filters import distinct_values
from cohortry.sources import update_where
from cohortry.study.people import NAME
from cohortry.study.questions import question
from cohortry.study.tables import Study


@question("M9")
def visit_share_per_month(s: Study) -> DataFrame:
    return monthly_share(s.patients, "visit_date", "patient_id")


@question("M25")
def visits_per_lab_in_year(s: Study, labs: Sequence[str] = ("Cultivate Lab", "Genesis Lab"), year: int = 2005) -> DataFrame:
    kept = s.lab_visit.filter(F.col("lab_name").isin(*labs) & fn.in_year("lab_visit_date", year))
    return kept.groupBy("lab_name").agg(F.count("lab_visit_id").alias("n"))


@question("M26")
def cholesterol_in_month(s: Study, year: int = 2006, month: int = 2) -> DataFrame:
    visits = s.lab_visit.filter(fn.in_month("lab_visit_date", year, month))
    rows = s.lipid_lab_test.join(s.link_reference, "lipid_id").join(visits, "lab_visit_id")
    return rows.select(
        "patient_id", "fasting_cholesterol", F.upper(fn.month_name("lab_visit_date")).alias("month"),
        F.date_format("lab_visit_date", "yyyy").alias("year"),
    )


@question("M30")
def visits_between_hours(s: Study, first: int = 9, last: int = 12) -> DataFrame:
    return s.lab_visit.filter(fn.hour_between("lab_visit_date", first, last)).agg(F.count("lab_visit_id").alias("n"))


@question("M34")
def visit_times(s: Study) -> DataFrame:
    return s.patients.select(
        *NAME, fn.time_text_12h("visit_date").alias("visit_time"), fn.date_text("visit_date").alias("visit_day")
    )


@question("M35")
def visits_per_month(s: Study) -> DataFrame:
    months = agg.visits_by(s.patients, "visit_date", "month", name="n")
    return agg.sorted_by(months, "first_visit").drop("first_visit")


@question("M42")
def renamed_lab(s: Study, lab_visit_id: str = "LB002", lab_name: str = "Cultivate Lab") -> DataFrame:
    return update_where(s.lab_visit, F.col("lab_visit_id") == lab_visit_id, {"lab_name": F.lit(lab_name)})


@question("M44")
def lab_dates_and_times(s: Study) -> DataFrame:
    return s.lab_visit.select(
        F.to_date("lab_visit_date").alias("lab_visit_date"), fn.time_text("lab_visit_date").alias("lab_visit_time")
    )


@question("M51")
def labs_like(s: Study, pattern: str = "G%b") -> DataFrame:
    return distinct_values(s.lab_visit.filter(F.col("lab_name").like(pattern)), "lab_name")


@question("M70")
def visit_share_per_lab(s: Study) -> DataFrame:
    return share_by(s.lab_visit, ["lab_name"]).select("lab_name", "percentage")


@question("M73")
def patients_in_period(s: Study, start: str = "2005-03-01", end: str = "2006-04-01") -> DataFrame:
    return agg.count_distinct(s.patients.filter(fn.in_period("visit_date", start, end)), [], "patient_id")


@question("M74", "A107")
def patients_per_lab(s: Study) -> DataFrame:
    return agg.sorted_by(agg.count_distinct(s.linked("lab_visit"), ["lab_name"], "patient_id"), "lab_name")


@question("M75")
def patients_per_group_and_lab(s: Study) -> DataFrame:
    counts = agg.count_distinct(s.linked("lab_visit"), ["lab_name", "group_id"], "patient_id")
    return s.described(counts, "group").select("group", "lab_name", "n")


@question("A10")
def first_and_last_visit(s: Study) -> DataFrame:
    return agg.date_span(s.patients, "visit_date")


@question("A68")
def visit_times_24h(s: Study) -> DataFrame:
    return s.patients.select("patient_id", F.substring(fn.timestamp_text("visit_date"), 12, 8).alias("visit_time"))


@question("A79")
def distinct_labs(s: Study) -> DataFrame:
    return agg.count_distinct(s.lab_visit, [], "lab_name")


@question("A86")
def title_case_labs(s: Study) -> DataFrame:
    return distinct_values(s.lab_visit.select(F.initcap("lab_name").alias("lab_name")), "lab_name")


@question("A105")
def busy_days(s: Study, min_visits: int = 2) -> DataFrame:
    return agg.sorted_by(agg.visits_by(s.lab_visit, "lab_visit_date", "day", min_count=min_visits), "day")


@question("A106")
def busy_weeks(s: Study, min_visits: int = 2) -> DataFrame:
    weeks = agg.visits_by(s.lab_visit, "lab_visit_date", "week", id="lab_visit_id", min_count=min_visits)
    return agg.sorted_by(weeks, "week")


@question("A116")
def patients_of_each_lab(s: Study, chunk_rows: int = 100_000) -> DataFrame:
    return agg.values_by(s.linked("lab_visit"), ["lab_name"], "patient_id", name="patients", chunk_rows=chunk_rows)
