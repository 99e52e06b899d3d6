"""Questions about blood, lipid and urine tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import functions as fn
from cohortry.operators import aggregates as agg
from cohortry.operators import joins, quality, ranking
from cohortry.operators.distributions import distribution_long, distribution_wide, share_by
from cohortry.operators.filters import all_of, any_of, rows_with_nulls
from cohortry.sources import as_view
from cohortry.study import limits as lim
from cohortry.study.people import NAME, members, name_column
from cohortry.study.questions import question
from cohortry.study.tables import Study


@question("M6")
def white_cell_view(s: Study, lo: float = 3, hi: float = 6, view: str = "bc_test_result") -> DataFrame:
    kept = s.lab_test.filter(F.col("wbc").between(lo, hi))
    return as_view(kept.select("lab_id", "patient_id", "wbc", "platelets"), view)


@question("M11")
def missing_lipids(s: Study) -> DataFrame:
    return rows_with_nulls(
        s.lipid_lab_test, ["fasting_cholesterol", "fasting_triglyc", "fasting_hdl", "fasting_ldl"]
    )


@question("M24")
def leukopenia(s: Study, below: float = 3) -> DataFrame:
    return s.tested("lab_test").filter(F.col("wbc") < below).select(*NAME)


@question("M29")
def abnormal_creatinine_levels(s: Study, gender: str = "Male", age: int = 35) -> DataFrame:
    lo, hi = lim.CREATININE_BY_GENDER[gender]
    people = s.described(s.patients.filter(F.col("age") > age), "gender").filter(F.col("gender") == gender)
    kept = s.linked("urine_test", people=people).filter(~F.col("creatinine").between(lo, hi))
    return kept.select(F.ceil("creatinine").cast("bigint").alias("creatinine_level"))


@question("M37")
def glucose_values(s: Study, wanted: Sequence[float] = (80, 85, 89)) -> DataFrame:
    return s.lab_test.filter(F.col("fasting_glucose").isin(*wanted)).select("patient_id")


@question("M40")
def creatinine_albumin(s: Study, group: str = "DM") -> DataFrame:
    people = s.described(members(s, group), "group")
    value = fn.ratio("creatinine", "albumin").alias("creatinine_albumin")
    return s.linked("urine_test", people=people).select(*NAME, "group", value)


@question("M41")
def normal_creatinine_per_gender(s: Study) -> DataFrame:
    tested = s.linked("urine_test", people=s.people("gender"))
    normal = fn.within_limits("creatinine", "gender", lim.CREATININE_BY_GENDER)
    return agg.count_by(tested.filter(normal), "gender")


def _below_own_limit(column: str, limits: dict[str, float]) -> Column:
    return any_of([(F.col("gender") == g) & (F.col(column) < limit) for g, limit in limits.items()])


@question("M46")
def anemic_diabetics_per_gender(s: Study) -> DataFrame:
    people = s.described(s.patients.filter(F.col("diabetes_duration") > 0), "gender")
    tested = s.tested("lab_test", people=people)
    anemic = _below_own_limit("hgb", lim.ANEMIA_BELOW)
    return tested.groupBy("gender").agg(agg.count_distinct_if(anemic, "patient_id").alias("n"))


@question("M57")
def high_triglycerides(s: Study, group: str = "DM", above: float = 150) -> DataFrame:
    people = s.described(members(s, group), "gender", "race", "group")
    kept = s.tested("lipid_lab_test", people=people).filter(F.col("fasting_triglyc") > above)
    return kept.select(*NAME, "age", "gender", "race", "group", "fasting_triglyc")


@question("M60")
def abnormal_sugar_alerts(s: Study, rows: DataFrame | None = None) -> DataFrame:
    """Alerts for the stored tests, or for rows (a table or a stream) about to be added."""
    return quality.alerts(s.lab_test if rows is None else rows, lim.LAB_ALERT, "all", "Abnormal values")


@question("M62")
def normal_platelets_per_group(s: Study, lo: float = 150, hi: float = 450) -> DataFrame:
    # The link table is asked only whether the test is linked: a semi join, so no row is repeated.
    tests = s.lab_test.filter(F.col("platelets").between(lo, hi)).select("lab_id", "patient_id")
    linked = joins.semi(tests, s.link_reference, "lab_id")
    return agg.count_by(linked.join(s.patients.select("patient_id", "group_id"), "patient_id"), "group_id")


@question("M68")
def kidney_risk(s: Study, albumin: float = 30) -> DataFrame:
    kept = s.linked("urine_test").filter(F.col("albumin") >= albumin)
    return kept.select(fn.concat_null("firstname", F.lit(" "), "lastname").alias("patient"))


@question("M78")
def prediabetic(s: Study, groups: Sequence[str] = ("DM", "Control"), lo: float = 100, hi: float = 125) -> DataFrame:
    people = s.people("group").filter(F.col("group").isin(*groups))
    kept = s.linked("lab_test", people=people).filter(F.col("fasting_glucose").between(lo, hi))
    return kept.select("patient_id", "group", F.lit("Prediabetic").alias("label"))


def _glucose_classes() -> dict[str, Column]:
    return {band.label: band.holds(F.col("fasting_glucose")) for band in lim.GLUCOSE}


@question("A3")
def glucose_distribution(s: Study) -> DataFrame:
    return distribution_wide(s.tested("lab_test"), _glucose_classes())


@question("A4")
def diabetic_rate_per_gender(s: Study, above: float = 120) -> DataFrame:
    high = F.col("fasting_glucose") > above
    rates = [
        agg.rate(high, F.col("gender") == g, 2).alias(f"{g.lower()}_diabetics") for g in ("Male", "Female")
    ]
    return s.tested("lab_test", people=s.people("gender")).agg(*rates)


@question("A5")
def insulin_status(s: Study, abnormal_lipids_only: bool = False) -> DataFrame:
    """Insulin classes of patients with a lipid test and their share of all lipid tests."""
    lipids = s.lipid_lab_test
    if abnormal_lipids_only:
        lipids = lipids.filter(
            all_of([F.col("fasting_hdl") < 50, F.col("fasting_ldl") > 130, F.col("fasting_triglyc") > 150])
        )
    # Counted per patient on both sides first: tests of one patient are multiplied, not paired up.
    status = fn.band("insulin", lim.INSULIN).alias("insulin_status")
    insulin = agg.count_by(s.lab_test, "patient_id", status, name="tests")
    both = insulin.join(agg.count_by(lipids, "patient_id", name="lipids"), "patient_id")
    counts = both.groupBy("insulin_status").agg(F.sum(F.col("tests") * F.col("lipids")).alias("n"))
    total = s.lipid_lab_test.agg(F.count(F.lit(1))).scalar()
    return agg.sorted_by(counts.withColumn("percentage", fn.percent("n", total, 2)), "insulin_status")


@question("A6")
def liver_risk_per_gender(s: Study) -> DataFrame:
    tested = s.linked("urine_test", people=s.people("gender"))
    value = fn.ratio("creatinine", "albumin")
    high = any_of([(F.col("gender") == g) & (value > limit) for g, limit in lim.CREATININE_RATIO_ABOVE.items()])
    return agg.count_by(tested.filter(high), "gender")


@question("A8")
def diabetics_per_year_and_age(s: Study, above: float = 120) -> DataFrame:
    rows = _diabetic_ages(s, above)
    return agg.sorted_by(agg.count_by(rows, "year", "age_group"), "year", "age_group")


@question("A9", "A12")
def dominant_age_per_year(s: Study, above: float = 120) -> DataFrame:
    return agg.sorted_by(ranking.dominant(_diabetic_ages(s, above), ["year"], "age_group"), "year")


def _diabetic_ages(s: Study, above: float) -> DataFrame:
    high = s.lab_test.filter(F.col("fasting_glucose") > above).select("patient_id")
    return high.join(s.patients.select("patient_id", "visit_date", "age"), "patient_id").select(
        F.year("visit_date").alias("year"), fn.bin_label("age", 10, upper="exclusive").alias("age_group")
    )


@question("A11")
def glucose_distribution_rows(s: Study) -> DataFrame:
    return distribution_long(s.tested("lab_test"), _glucose_classes(), label="condition")


@question("A14")
def mean_cholesterol_per_age(s: Study) -> DataFrame:
    age_group = fn.band("age", lim.CHOLESTEROL_AGES).alias("age_group")
    means = s.tested("lipid_lab_test").groupBy(age_group).agg(fn.decimal_mean("fasting_cholesterol").alias("mean_cholesterol"))
    return agg.sorted_by(means, "age_group")


RESULTS = ["wbc", "rbc", "hgb", "hct", "platelets", "hb_a1c", "fasting_glucose", "insulin"]


@question("A15")
def latest_results(s: Study) -> DataFrame:
    """Each patient's tests at their latest lab visit."""
    visits = s.link_reference.join(s.lab_visit, "lab_visit_id").join(s.lab_test.drop("patient_id"), "lab_id")
    linked = s.patients.select(*NAME, "link_reference_id").join(visits, "link_reference_id")
    newest = ranking.latest_per(linked, ["patient_id"], "lab_visit_date", "lab_id")
    return newest.select(*NAME, "lab_name", *RESULTS)


@question("A16", "A29")
def mean_glucose_per_age(s: Study, group: str = "DM") -> DataFrame:
    age_group = fn.band("age", lim.GLUCOSE_AGES, "Above 70").alias("age_group")
    tested = s.tested("lab_test", people=members(s, group))
    means = tested.groupBy(age_group).agg(fn.decimal_mean("fasting_glucose").alias("mean_glucose"))
    return agg.sorted_by(means, "age_group")


@question("A18")
def last_digits(s: Study, digits: int = 2) -> DataFrame:
    text = F.col("fasting_cholesterol").cast("decimal(18,6)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return s.lipid_lab_test.select("lipid_id", F.right(plain, F.lit(digits)).alias("last_digits"))


@question("A22")
def without_lab_test(s: Study, null_aware: bool = True) -> DataFrame:
    """``null_aware`` follows NOT IN: one test without a patient empties the result."""
    pick = joins.not_in if null_aware else joins.anti
    return pick(s.patients, s.lab_test, "patient_id").select("patient_id").distinct()


@question("A24")
def high_hemoglobin(s: Study, above: float = 15) -> DataFrame:
    kept = s.linked("lab_test").filter(F.col("hgb") > above)
    name = fn.concat_null("firstname", F.lit(" "), "lastname").alias("full_name")
    return kept.select(name, "link_reference_id", "hgb")


@question("A31", "A37")
def lab_tests(s: Study) -> DataFrame:
    return s.lab_test


@question("A33")
def mean_hba1c_per_group(s: Study) -> DataFrame:
    return s.tested("lab_test", people=s.people("group")).groupBy("group").agg(fn.decimal_mean("hb_a1c").alias("mean_hb_a1c"))


@question("A35")
def mean_hba1c_in_group(s: Study, group: str = "DM") -> DataFrame:
    return s.tested("lab_test", people=members(s, group)).agg(fn.decimal_mean("hb_a1c").alias("mean_hb_a1c"))


@question("A36")
def glucose_classes(s: Study) -> DataFrame:
    known = s.lab_test.filter(F.col("fasting_glucose").isNotNull())
    return agg.count_by(known, fn.band("fasting_glucose", lim.GLUCOSE).alias("diabetic_status"))


@question("A38", "A39")
def white_cell_classes(s: Study) -> DataFrame:
    known = s.lab_test.filter(F.col("wbc").isNotNull() & F.col("patient_id").isNotNull())
    return agg.count_by(known, fn.band("wbc", lim.WHITE_CELLS).alias("wbc_condition"))


@question("A41")
def platelet_classes(s: Study) -> DataFrame:
    label = fn.band("platelets", lim.PLATELETS, "Abnormal").alias("platelet_range")
    return agg.count_by(joins.semi(s.lab_test, s.patients, "patient_id"), label)


def _hematocrit(s: Study) -> DataFrame:
    label = fn.band_by("hct", "gender", lim.HEMATOCRIT_BY_GENDER).alias("hematocrit")
    return s.tested("lab_test", people=s.people("gender")).select("patient_id", label)


@question("A50")
def hematocrit_per_patient(s: Study) -> DataFrame:
    return _hematocrit(s)


@question("A51")
def hematocrit_classes(s: Study) -> DataFrame:
    return agg.count_by(_hematocrit(s), "hematocrit")


@question("A55", "A74")
def insulin_classes(s: Study) -> DataFrame:
    return agg.count_by(s.lab_test, fn.band("insulin", lim.INSULIN).alias("insulin_level"))


@question("A61")
def insulin_with_abnormal_platelets(s: Study, lo: float = 150, hi: float = 450) -> DataFrame:
    kept = s.lab_test.filter((F.col("platelets") < lo) | (F.col("platelets") > hi))
    return agg.count_by(kept, fn.band("insulin", lim.INSULIN).alias("insulin_level"))


@question("A70")
def creatinine_classes(s: Study) -> DataFrame:
    tested = s.linked("urine_test", people=s.people("gender")).filter(F.col("creatinine").isNotNull())
    normal = fn.within_limits("creatinine", "gender", lim.CREATININE_BY_GENDER)
    return agg.count_by(tested, F.when(normal, "Normal").otherwise("Abnormal Creatinine").alias("creatinine_level"))


@question("A71")
def albumin_classes(s: Study) -> DataFrame:
    tested = s.linked("urine_test", people=s.people("gender")).filter(F.col("creatinine").isNotNull())
    return agg.count_by(tested, fn.band("albumin", lim.ALBUMIN).alias("albumin_level"))


@question("A76")
def bmi_and_cholesterol(s: Study) -> DataFrame:
    return s.tested("lipid_lab_test").select(
        "patient_id", "bmi", "fasting_cholesterol", fn.band("bmi", lim.BMI).alias("bmi_category"),
        fn.band("fasting_cholesterol", lim.CHOLESTEROL).alias("cholesterol_category"),
    )


@question("A77")
def bmi_and_cholesterol_sorted(s: Study) -> DataFrame:
    return agg.sorted_by(bmi_and_cholesterol(s), "bmi_category")


@question("A91")
def highest(s: Study, column: str = "hb_a1c", n: int = 5) -> DataFrame:
    known = s.tested("lab_test").filter(F.col(column).isNotNull())
    rows = known.select(name_column().alias("patient_name"), column, "patient_id", "lab_id")
    return ranking.top_n(rows, [F.col(column).desc(), "patient_id", "lab_id"], n).select("patient_name", column)


@question("A95")
def mean_ldl_per_gender(s: Study) -> DataFrame:
    tested = s.tested("lipid_lab_test", people=s.people("gender"))
    return tested.groupBy("gender").agg(fn.decimal_mean("fasting_ldl").alias("mean_ldl"))


@question("A96")
def ldl_classes(s: Study) -> DataFrame:
    return agg.count_by(s.lipid_lab_test, fn.band("fasting_ldl", lim.LDL).alias("ldl_level"))


@question("A97")
def triglyceride_classes(s: Study) -> DataFrame:
    return agg.count_by(s.lipid_lab_test, fn.band("fasting_triglyc", lim.TRIGLYCERIDES).alias("triglyceride_level"))


@question("A98")
def heart_risk(s: Study, gender: str = "Male", hdl: float = 40) -> DataFrame:
    people = s.people("gender").filter(F.col("gender") == gender)
    return s.tested("lipid_lab_test", people=people).filter(F.col("fasting_hdl") > hdl).agg(F.count(F.lit(1)).alias("n"))


@question("A100")
def hemoglobin_classes(s: Study) -> DataFrame:
    normal = fn.within_limits("hgb", "gender", lim.HEMOGLOBIN_BY_GENDER)
    label = F.when(normal, "Normal").when(F.col("hgb").isNotNull(), "Abnormal").alias("hemoglobin_level")
    return agg.count_by(s.tested("lab_test", people=s.people("gender")), label)


def _per_race_and_gender(s: Study, table: str, condition: Column, measure: str) -> DataFrame:
    # Counted per patient first: a patient with very many tests is one row in the joins.
    counts = agg.count_by(s[table].filter(condition), "patient_id")
    people = s.patients.select("patient_id", "gender_id", "race_id")
    by_key = counts.join(people, "patient_id").groupBy("gender_id", "race_id").agg(F.sum("n").alias("n"))
    return s.described(by_key, "gender", "race").groupBy("gender", "race").agg(F.sum("n").alias(measure))


@question("A103")
def thrombocytopenia(s: Study, below: float = 150) -> DataFrame:
    return _per_race_and_gender(s, "lab_test", F.col("platelets") < below, "n")


@question("A104")
def high_glucose(s: Study, above: float = 120) -> DataFrame:
    return _per_race_and_gender(s, "lab_test", F.col("fasting_glucose") > above, "n")


@question("A111")
def high_cholesterol(s: Study, above: float = 240) -> DataFrame:
    return _per_race_and_gender(s, "lipid_lab_test", F.col("fasting_cholesterol") > above, "n")


@question("A118")
def insulin_out_of_range(s: Study, lo: float = 2.6, hi: float = 24.6) -> DataFrame:
    kept = s.tested("lab_test").filter(~F.col("insulin").between(lo, hi))
    return kept.select(name_column().alias("patient_name"))


@question("A119")
def prediabetic_share_per_gender(s: Study) -> DataFrame:
    tested = s.linked("lab_test", people=s.people("gender"))
    kept = tested.filter(F.col("hb_a1c").between(5.7, 6.4) | (F.col("fasting_glucose") == 100))
    return share_by(kept, ["gender"]).select("gender", "percentage")


@question("A123")
def high_hba1c(s: Study, above: float = 6.5) -> DataFrame:
    over = s.lab_test.filter(F.col("hb_a1c") > above)
    people = joins.semi(s.patients.select("patient_id"), over, "patient_id")
    return people.join(s.lab_test.select("patient_id", "hb_a1c"), "patient_id")


@question("A124")
def low_insulin(s: Study, below: float = 2.6) -> DataFrame:
    # The correlated test repeats the filter on the same table, so the filter alone decides.
    low = s.lab_test.filter(F.col("insulin") < below).select("patient_id", "insulin")
    return s.patients.select("patient_id").join(low, "patient_id")
