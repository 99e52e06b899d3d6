"""Questions about the cognitive tests."""

from __future__ import annotations

import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.operators import aggregates as agg
from cohortry.operators import joins
from cohortry.operators.filters import any_of
from cohortry.operators.scoring import at_least_k, count_any, failed_combinations
from cohortry.study import limits as lim
from cohortry.study.people import NAME, name_column
from cohortry.study.questions import question
from cohortry.study.tables import Study

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def conditions_of(tests: Mapping[str, tuple[str, str, float]]) -> dict[str, Column]:
    """Conditions from (column, comparison, limit)."""
    return {name: _COMPARE[sign](F.col(column), F.lit(limit)) for name, (column, sign, limit) in tests.items()}


@question("M36")
def visual_motor_impairments(s: Study, k: int = 2) -> DataFrame:
    tested = s.link_chain("visual_motor_cog", "memory_cognitive")
    return failed_combinations(tested, conditions_of(lim.VISUAL_MOTOR_TESTS), k, label="abnormal_conditions")


@question("M71")
def verbally_impaired(s: Study, k: int = 2) -> DataFrame:
    tested = s.verbal_cognitive.join(s.link_reference, "vc_id").join(s.memory_cognitive, "mc_id")
    return tested.filter(at_least_k(list(conditions_of(lim.VERBAL_TESTS).values()), k)).select("patient_id")


@question("M72")
def memory_impaired(s: Study, gds: float = 15, shortest: int = 5, longest: int = 30) -> DataFrame:
    people = s.patients.filter(F.col("diabetes_duration").between(shortest, longest))
    return s.linked("memory_cognitive", people=people).filter(F.col("gds") >= gds).select(*NAME)


@question("A7")
def dementia_among_diabetics(s: Study, glucose: float = 120) -> DataFrame:
    tests = any_of(list(conditions_of(lim.SUGAR_DEMENTIA_TESTS).values()))
    tested = s.link_chain("lab_test", "visual_motor_cog", "memory_cognitive").filter(F.col("fasting_glucose") > glucose)
    return tested.agg(
        F.count(F.lit(1)).alias("diabetic"), F.count_if(tests).alias("with_dementia"),
        agg.rate(tests, F.lit(True), 2).alias("percentage"),
    )


@question("A45")
def slow_trail_makers(s: Study, tm: float = 42) -> DataFrame:
    return s.linked("visual_motor_cog").filter(F.col("tm") >= tm).select(name_column().alias("patient"))


@question("A65")
def bads_classes(s: Study) -> DataFrame:
    return agg.count_by(s.linked("memory_cognitive"), fn.band("bads", lim.BADS).alias("bads_category"))


@question("A66")
def below_average_bads(s: Study, below: float = 16) -> DataFrame:
    tested = s.linked("memory_cognitive", people=s.people("gender"))
    return agg.count_by(tested.filter(F.col("bads") < below), "gender")


@question("A67")
def impaired_by_gds(s: Study, gds: float = 15) -> DataFrame:
    return s.linked("memory_cognitive").filter(F.col("gds") >= gds).agg(F.count(F.lit(1)).alias("n"))


@question("A73")
def dementia_levels(s: Study) -> DataFrame:
    own = s.verbal_cognitive.join(s.link_reference.select("vc_id"), "vc_id")
    known = joins.semi(own, s.patients, "patient_id")
    return agg.count_by(known, fn.band("hvlt", lim.HVLT, "NORMAL").alias("dementia_level"))


@question("A83", "A88")
def clock_scores(s: Study) -> DataFrame:
    return s.visual_motor_cog.groupBy("clock").agg(F.count("patient_id").alias("n"))


@question("A89")
def slow_trail_maker_count(s: Study, tm: float = 42) -> DataFrame:
    return s.visual_motor_cog.filter(F.col("tm") >= tm).agg(F.count(F.lit(1)).alias("n"))


@question("A108")
def low_gds_per_race_and_gender(s: Study, above: float = 0, below: float = 14.9) -> DataFrame:
    tested = s.linked("memory_cognitive").filter((F.col("gds") > above) & (F.col("gds") < below))
    counts = agg.count_by(tested, "race_id", "gender_id")
    return s.described(counts, "race", "gender").groupBy("race", "gender").agg(F.sum("n").alias("n"))


@question("A109")
def any_impairment_per_age(s: Study) -> DataFrame:
    """Patients with all three kinds of test who fail any of them, per five years of age.

    Each kind of test is reduced to one flag per patient before the joins, so several tests of a
    patient never meet each other.
    """
    tests = conditions_of(lim.DEMENTIA_TESTS)

    def failed(table: DataFrame, key: str, columns: list[str], flag: str) -> DataFrame:
        names = [n for n, (column, _, _) in lim.DEMENTIA_TESTS.items() if column in columns]
        any_failed = F.coalesce(any_of([tests[n] for n in names]), F.lit(False))
        return table.groupBy(key).agg(F.bool_or(any_failed).alias(flag))

    memory = failed(s.memory_cognitive, "mc_id", ["iadl", "mmse", "gds"], "memory")
    motor = failed(s.visual_motor_cog, "patient_id", ["rcft_ir", "tm", "clock"], "motor")
    verbal = failed(s.verbal_cognitive, "patient_id", ["ds", "hvlt", "vf", "wtar"], "verbal")
    rows = (
        s.patients.select("patient_id", "age", "link_reference_id")
        .join(s.link_reference.select("link_reference_id", "mc_id"), "link_reference_id")
        .join(memory, "mc_id").join(motor, "patient_id").join(verbal, "patient_id")
    )
    bins = [fn.bin_label("age", 5, offset=1).alias("age_range"), fn.bin_start("age", 5, offset=1).alias("start")]
    counts = count_any(rows, bins, [F.col("memory"), F.col("motor"), F.col("verbal")], "patient_id")
    return agg.sorted_by(counts, "start").drop("start")


@question("A121")
def verbal_and_kidney_issues(s: Study, age: int = 55) -> DataFrame:
    lo, hi = lim.ALBUMIN_RANGE
    people = s.described(s.patients.filter(F.col("age") > age), "race")
    tests = conditions_of({"DS": ("ds", "<", 13), "VF": ("vf", "<", 42), "WTAR": ("wtar", "<=", 20)})
    kept = s.linked("verbal_cognitive", "urine_test", people=people).filter(
        ~F.col("albumin").between(lo, hi) & any_of(list(tests.values()))
    )
    return kept.select(name_column().alias("patient_name"), "race", "age")


@question("A125")
def test_scores(s: Study, match_first_only: bool = True) -> DataFrame:
    """The newest score of each kind per patient."""
    tables = [
        s.newest("verbal_cognitive").select("patient_id", "wtar"),
        s.newest("visual_motor_cog").select("patient_id", "tm"),
        s.patients.select("patient_id", "age"),
    ]
    joined = joins.full_outer_chain(tables, "patient_id", match_first_only=match_first_only)
    return joined.select(F.col("patient_id_0").alias("patient_id"), "wtar", "tm", "age")
