"""Questions about blood pressure, heart rate, walking and eye exams, and the wide records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.operators import aggregates as agg
from cohortry.operators import joins, quality, ranking
from cohortry.operators.filters import distinct_values
from cohortry.sources import as_view
from cohortry.study import limits as lim
from cohortry.study.cognition import conditions_of
from cohortry.study.people import NAME, distinct_names, members, name_column
from cohortry.study.questions import question
from cohortry.study.tables import LINKED, Study


@question("M3")
def start_exertion_between(s: Study, lo: int = 4, hi: int = 6) -> DataFrame:
    return s.examined("walking_test").filter(F.col("rpe_start").between(lo, hi)).select(*NAME)


def _pressures(digits: int | None = None) -> dict[str, Column]:
    return {
        "day_map": fn.mean_arterial_pressure("day_sbp", "day_dbp", digits),
        "night_map": fn.mean_arterial_pressure("night_sbp", "night_dbp", digits),
    }


@question("M5")
def highest_pressure(s: Study, group: str = "DM", by: str = "day_map") -> DataFrame:
    rows = s.tested("blood_pressure", people=members(s, group)).withColumns(_pressures())
    best = ranking.top_n(rows, [F.col(by).desc_nulls_last(), "patient_id"], 1)
    return best.select("firstname", "lastname", "day_map", "night_map")


@question("M8")
def hypertensive_patients(
    s: Study, gender: str = "Male", youngest: int = 40, oldest: int = 60, systolic: float = 120, diastolic: float = 80
) -> DataFrame:
    people = s.described(s.patients.filter(F.col("age").between(youngest, oldest)), "gender")
    people = people.filter(F.col("gender") == gender)
    kept = s.examined("blood_pressure", people=people).filter(
        (F.col("day_sbp") > systolic) & (F.col("day_dbp") > diastolic)
    )
    return kept.select(*NAME, "age", "gender", "day_sbp", "day_dbp")


@question("M15")
def eye_damage(s: Study) -> DataFrame:
    damaged = (F.col("diabetic_retinopathy") > 0) | (F.col("macular_edema") > 0)
    return distinct_names(s.examined("opthalmology").filter(damaged))


@question("M16")
def end_exertion_levels(s: Study) -> DataFrame:
    return s.walking_test.select("patient_id", fn.band("rpe_end", lim.EXERTION).alias("intensity"))


@question("M20")
def far_and_fast(s: Study, distance: float = 400, speed: float = 1, group: str | None = None) -> DataFrame:
    people = s.patients if group is None else members(s, group)
    kept = s.tested("walking_test", people=people).filter(
        (F.col("dt_distance") > distance) & (F.col("dt_speed") > speed)
    )
    return kept.select(name_column().alias("patient"), "dt_distance", "dt_speed")


@question("M21")
def patients_view(s: Study, view: str = "patients_view") -> DataFrame:
    people = s.people("group", "gender", "race").join(
        s.link_reference.select("link_reference_id", "lipid_id", "lab_id"), "link_reference_id"
    )
    rows = s.examined("blood_pressure", "opthalmology", people=people).select(
        *NAME, "visit_date", "age", "height", "bmi", "group", "gender", "race", "day_sbp", "day_dbp", "day_hr",
        "diabetic_retinopathy", "macular_edema", "lipid_id", "lab_id",
    )
    return as_view(rows, view)


@question("M38")
def heart_rate_difference(s: Study) -> DataFrame:
    difference = fn.round_half_up(F.col("day_hr") - F.col("night_hr"), 2)
    return s.blood_pressure.select("patient_id", difference.alias("hr_difference"))


@question("M49")
def mean_age_high_pressure(s: Study, systolic: float = 129, diastolic: float = 79) -> DataFrame:
    high = s.blood_pressure.filter(
        (F.col("day_sbp") > systolic) & (F.col("night_sbp") > systolic)
        & (F.col("day_dbp") > diastolic) & (F.col("night_dbp") > diastolic)
    )
    return high.select("patient_id").join(s.patients.select("patient_id", "age"), "patient_id").agg(F.avg("age").alias("mean_age"))


@question("M55")
def worst_eye_damage(s: Study) -> DataFrame:
    worst = ranking.rows_at_max(s.opthalmology, "diabetic_retinopathy", key="opthal_id")
    return s.patients.join(worst, "opthal_id").select(
        name_column().alias("patient"), "opthal_id", F.col("diabetic_retinopathy").alias("most_damage")
    )


@question("M63")
def heart_rate_alerts(s: Study, rows: DataFrame | None = None) -> DataFrame:
    """Alerts for the stored rates, or for rows (a table or a stream) about to be added."""
    source = (s.blood_pressure if rows is None else rows).select("bp_id", "patient_id", "day_hr", "night_hr")
    limits = {"day_hr": lim.HEART_RATE_ALERT_DAY, "night_hr": lim.HEART_RATE_ALERT_NIGHT}
    return quality.alerts(source, limits, "any", "Abnormal Heart Rate")


@question("M64")
def exertion_changes(s: Study) -> DataFrame:
    known = s.walking_test.filter(F.col("patient_id").isNotNull())
    return agg.count_cases(
        known,
        {
            "RPE_END>START": F.col("rpe_start") < F.col("rpe_end"),
            "RPE_START>END": F.col("rpe_start") > F.col("rpe_end"),
        },
        label="type",
    )


@question("M69")
def fastest_walker(s: Study, n: int = 1) -> DataFrame:
    rows = s.examined("walking_test").select("patient_id", "firstname", "lastname", "dt_speed")
    return ranking.top_n(rows, [F.col("dt_speed").desc_nulls_last(), "patient_id"], n).drop("patient_id")


@question("M77")
def csv_records(s: Study) -> DataFrame:
    rows = s.linked("lab_test", people=s.examined("opthalmology", people=s.people("group", "race", "gender")))
    line = fn.csv_line("patient_id", "group", "race", "gender", "diabetic_retinopathy", "fasting_glucose")
    return rows.select(line.alias("record"))


@question("M79")
def mean_pressures(s: Study) -> DataFrame:
    return s.examined("blood_pressure").select("patient_id", *[c.alias(n) for n, c in _pressures(2).items()])


@question("A1")
def moderate_exertion(s: Study, lo: int = 4, hi: int = 6) -> DataFrame:
    kept = s.examined("walking_test").filter(F.col("rpe_start").between(lo, hi) & F.col("rpe_end").between(lo, hi))
    name = fn.concat_null("firstname", F.lit(" "), "lastname").alias("full_name")
    return kept.select("patient_id", name, "rpe_start", "rpe_end")


@question("A13")
def mean_pressure_per_gender(s: Study) -> DataFrame:
    columns = ["day_sbp", "day_dbp", "night_sbp", "night_dbp"]
    tested = s.tested("blood_pressure", people=s.people("gender"))
    return tested.groupBy("gender").agg(*[fn.mean(c, digits=None).alias(f"mean_{c}") for c in columns])


@question("A19")
def distinct_patients_measured(s: Study) -> DataFrame:
    return agg.count_distinct(s.blood_pressure, [], "patient_id")


def _mean_rate() -> Column:
    return (F.col("day_hr") + F.col("night_hr")) / 2


@question("A26")
def heart_rate_per_age(s: Study) -> DataFrame:
    age_group = fn.bin_label("age", 5).alias("age_group")
    means = s.examined("blood_pressure").groupBy(age_group).agg(fn.decimal_mean(_mean_rate()).alias("mean_rate"))
    return agg.sorted_by(means, "age_group")


@question("A30")
def blood_pressures(s: Study) -> DataFrame:
    return s.blood_pressure


@question("A34")
def high_pressure_names(s: Study) -> DataFrame:
    high = ((F.col("day_sbp") > 135) & (F.col("day_dbp") > 85)) | ((F.col("night_sbp") > 120) & (F.col("night_dbp") > 70))
    return distinct_names(s.tested("blood_pressure").filter(high))


def _per_age_bucket(rows: DataFrame, value: Column) -> DataFrame:
    means = rows.groupBy(
        fn.bucket_number("age", 0, 100, 20).alias("bucket"), fn.bucket_label("age", 0, 100, 20).alias("age_range")
    ).agg(value)
    return agg.sorted_by(means, "bucket").drop("bucket")


@question("A48")
def heart_rate_per_bucket(s: Study) -> DataFrame:
    return _per_age_bucket(s.examined("blood_pressure"), fn.decimal_mean(_mean_rate()).alias("mean_rate"))


def _gait(s: Study) -> DataFrame:
    walked = s.examined("walking_test", people=s.people("gender"))
    label = fn.band_by("dt_speed", "gender", lim.GAIT_SPEED_BY_GENDER).alias("gait_speed")
    return walked.select("patient_id", label)


@question("A52")
def gait_speed_per_patient(s: Study) -> DataFrame:
    return _gait(s)


@question("A53")
def gait_speed_classes(s: Study) -> DataFrame:
    return agg.count_by(_gait(s), "gait_speed")


@question("A87")
def distances_per_minute(s: Study) -> DataFrame:
    return s.walking_test.select("patient_id", fn.distance_per_minute("dt_distance").alias("distance_per_minute"))


@question("A94")
def both_eye_conditions(s: Study) -> DataFrame:
    kept = s.examined("opthalmology").filter((F.col("diabetic_retinopathy") > 0) & (F.col("macular_edema") > 0))
    return kept.select(name_column().alias("patient"))


@question("A112")
def speeds_at_age(s: Study, age: int = 55) -> DataFrame:
    people = s.patients.filter(F.col("age") == age).select("walktest_id", "age")
    return distinct_values(people.join(s.walking_test, "walktest_id"), "age", "patient_id", "dt_speed")


@question("A113")
def mean_speed_per_bucket(s: Study) -> DataFrame:
    return _per_age_bucket(s.examined("walking_test"), fn.decimal_mean("dt_speed").alias("mean_speed"))


@question("A117")
def both_eye_conditions_per_race(s: Study) -> DataFrame:
    kept = s.examined("opthalmology").filter((F.col("diabetic_retinopathy") != 0) & (F.col("macular_edema") != 0))
    return agg.count_by(s.described(kept, "race"), "race")


@question("A120")
def shortest_distances(s: Study, n: int = 3) -> DataFrame:
    rows = s.examined("walking_test", people=s.people("gender", "race"))
    best = ranking.top_n(rows.select("age", "gender", "race", "dt_distance", "patient_id"), ["dt_distance", "patient_id"], n)
    return best.select("age", "gender", "race")


def _urine_class() -> Column:
    lo, hi = lim.ALBUMIN_RANGE
    creatinine_normal = fn.within_limits("creatinine", "gender", lim.CREATININE_BY_GENDER)
    albumin_normal = F.col("albumin").between(lo, hi)
    both_known = F.col("creatinine").isNotNull() & F.col("albumin").isNotNull()
    listed = F.col("gender").isin(*lim.CREATININE_BY_GENDER)
    label = (
        F.when(listed & creatinine_normal & albumin_normal, "Normal")
        .when(listed & ~creatinine_normal, "A.Creat")
        .when(~albumin_normal, "A.Alb")
        .otherwise("A.Creat, A.Alb")
    )
    return F.when(both_known, label)


def _pressure_class() -> Column:
    day, night = _pressures().values()
    low, normal = lim.PRESSURE
    return (
        F.when(low.holds(day) | low.holds(night), low.label)
        .when(normal.holds(day) | normal.holds(night), normal.label)
        .when(day.isNotNull() | night.isNotNull(), "High")
    )


@question("A62")
def patient_info(s: Study, view: str | None = "patient_info", people_last: bool = True) -> DataFrame:
    """The wide record with its seven derived labels, over all fifteen tables.

    The tables of most columns come late, and the patients last, so that the link rows stay narrow on their way.
    """
    people = s.examined("blood_pressure", "opthalmology", people=s.people("gender", "race", "group"))
    people = joins.semi(people, s.walking_test, "walktest_id")
    wide = s.linked(
        "lipid_lab_test", "lab_test", "lab_visit", "urine_test", "memory_cognitive", "visual_motor_cog", "verbal_cognitive",
        people=people, people_last=people_last,
    )
    result = wide.select(
        "patient_id", name_column().alias("full_name"), "gender", "age", "race", "lab_name",
        fn.map_label("group", {"DM": "Diabetic"}, "Control").alias("group"),
        _pressure_class().alias("map"),
        F.when(F.col("macular_edema") != 0, "Macular_Edema")
        .when(F.col("diabetic_retinopathy") != 0, "Diabetic_Retinopathy").otherwise("No").alias("eye_damage"),
        fn.band("fasting_cholesterol", [fn.below("Normal", 150)], "High").alias("cholesterol"),
        fn.band("fasting_glucose", lim.GLUCOSE_RECORD).alias("insulin"),
        fn.failed_names(conditions_of(lim.DEMENTIA_TESTS), ",").alias("dementia"),
        _urine_class().alias("lipid"),
    )
    return as_view(result, view) if view else result


@question("A64")
def patient_info_of(s: Study, patient_id: str = "S0308") -> DataFrame:
    """One patient's record; the filter reaches the scan of the patients."""
    return patient_info(s, view=None, people_last=False).filter(F.col("patient_id") == patient_id)


@question("A101")
def numeric_record(s: Study) -> DataFrame:
    """One row per patient with all measures: the newest test of each kind, the newest visit's linked tests.

    Tests are reduced to one per patient before they meet, so a patient with many of each does not multiply.
    """
    people = s.examined("blood_pressure", "opthalmology", people=s.people("gender", "race"))
    wide = joins.semi(people, s.group, "group_id").join(s.newest_link(), "link_reference_id")
    for name in ("memory_cognitive", "urine_test"):
        wide = wide.join(s[name].drop("patient_id"), LINKED[name])
    wide = wide.drop("lab_id", "lipid_id", "vm_id", "vc_id", "lab_visit_id", "walktest_id")
    for name in ("lab_test", "lipid_lab_test", "visual_motor_cog", "verbal_cognitive", "walking_test"):
        wide = wide.join(s.newest(name), "patient_id")
    return wide.select(
        "patient_id", name_column().alias("full_name"), "age", "bmi", "gender", "race", "day_sbp", "day_dbp", "day_hr",
        "fasting_glucose", "fasting_cholesterol", "macular_edema", "gds", "clock", "albumin", "ds", "dt_distance",
    )
