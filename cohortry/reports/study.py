"""Questions of the clinical study over the tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.reports.registry import REPORTS, Report, Tables
from cohortry.study import SCHEMAS, ask
from cohortry.study.derived import DERIVED_SQL, derive

_LINKED = "patients JOIN link_reference USING (link_reference_id)"
_NAME = "patient_id, firstname, lastname"
_FULL = "concat(firstname, ' ', lastname)"


def _mean(x: str) -> str:
    """Mean of two-decimal values, rounded half up in whole numbers."""
    return f"CAST((2 * sum(CAST(round(({x}) * 100) AS BIGINT)) + count({x})) // (2 * count({x})) AS DOUBLE) / 100e0"


def _share(part: str, whole: str) -> str:
    """Percentage rounded half up to two places in whole numbers."""
    return f"CAST((20000 * ({part}) + ({whole})) // (2 * nullif({whole}, 0)) AS DOUBLE) / 100e0"


def _bands(x: str, *pairs: str, other: str | None = None) -> str:
    """``(condition, label)`` pairs as text ``condition: label``."""
    cases = " ".join("WHEN {} THEN '{}'".format(*[p.strip() for p in pair.split(":")]) for pair in pairs)
    tail = f" WHEN {x} IS NOT NULL THEN '{other}'" if other else ""
    return f"CASE {cases}{tail} END"


def _count(label: str, name: str, source: str, where: str = "true") -> str:
    return f"SELECT {label} AS {name}, count(*) AS n FROM {source} WHERE {where} GROUP BY 1"


def _register(name: str, sql: str | None, **parameters) -> None:
    def run(spark, folder) -> DataFrame:
        return ask(derive(Tables(spark, folder)), name, **parameters)

    key = f"study_{name}"
    REPORTS[key] = Report(key, run, None if sql is None else f"WITH {DERIVED_SQL} {sql}")


def _newest(table: str, key: str) -> str:
    """The newest test of each patient."""
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {key} DESC) = 1)"


_TESTED = "patients JOIN lab_test USING (patient_id)"
_SEXED = f"{_TESTED} JOIN gender USING (gender_id)"
_IN_DM = "group_id = 'GRP_02'"
_GLUCOSE = {
    "Hypoglycemia": "fasting_glucose < 70", "Normal": "fasting_glucose BETWEEN 70 AND 100",
    "Prediabetic": "fasting_glucose > 100 AND fasting_glucose <= 120", "Diabetic": "fasting_glucose > 120",
}
_BMI_SQL = _bands("bmi", "bmi < 18.5: Underweight", "bmi < 25: Normal", "bmi < 30: Overweight", "bmi >= 30: Obese")
_INSULIN_SQL = _bands("insulin", "insulin < 2.6: Low Insulin", "insulin <= 24.9: Normal Insulin", "insulin > 24.9: High Insulin")
_AGE_BUCKET = "CAST(floor(age / 5e0) AS BIGINT)"
_AGE_RANGE = f"({_AGE_BUCKET} * 5) || ' - ' || ({_AGE_BUCKET} * 5 + 4)"
_WEEK = """year(date_trunc('week', lab_visit_date)) || '-W' ||
           lpad(CAST(weekofyear(date_trunc('week', lab_visit_date)) AS VARCHAR), 2, '0')"""
_DEMENTIA = (
    "iadl <= 14: IADL", "mmse <= 23: MMSE", "gds >= 15: GDS", "rcft_ir <= 71: RCFT_IR", "tm >= 42: TM", "clock <= 2: Clock",
    "ds < 13: DS", "hvlt < 19: HVLT", "vf < 42: VF", "wtar <= 20: WTAR",
)


def _ones(*tests: str) -> str:
    return " + ".join(f"CAST({t} AS INTEGER)" for t in tests)


def _names(separator: str, *pairs: str) -> str:
    return f"concat_ws('{separator}', " + ", ".join(_bands("", p) for p in pairs) + ")"


_EYES = "patients JOIN opthalmology USING (opthal_id)"
_PRESSURED = "patients JOIN blood_pressure USING (bp_id)"
_WALKED = "patients JOIN walking_test w USING (walktest_id)"

# People
_register("full_names", f"SELECT {_FULL} AS full_name FROM patients WHERE starts_with(lastname, 'Ma')")
_register("long_diabetes", """SELECT patient_id, "group" FROM patients JOIN groups USING (group_id) WHERE diabetes_duration > 10""")
_register("first_letters", "SELECT firstname[1] AS first_letter, count(*) AS n FROM patients GROUP BY ALL")
_register("user_ids", "SELECT patient_id, 'UID' || (CAST(patient_id[2:] AS BIGINT) * 1000) AS user_id FROM patients")
_register("replaced_last_names", f"""SELECT {_NAME}, replace(lastname, 'Po', 'Be') AS new_lastname FROM patients
    WHERE starts_with(lastname, 'Po')""")
_register("salutations", f"""SELECT CASE gender_id WHEN 'GEN_1' THEN 'Mr. ' ELSE 'Ms. ' END || {_FULL} AS prefixed_name FROM patients""")
_register("names_like", "SELECT concat(firstname, lastname) AS full_name FROM patients WHERE concat(firstname, lastname) ILIKE 's%r%b%'")
_register("race_with_most_diabetics", """SELECT arg_min(race, (-n, race_id)) AS race FROM
    (SELECT race_id, count(*) AS n FROM patients WHERE diabetes_duration <> 0 GROUP BY 1) q JOIN race USING (race_id)""")
_register("tall_heavy_patients", """SELECT firstname, lastname FROM patients
    WHERE gender_id = 'GEN_1' AND age > 60 AND bmi > 18.5 AND height > 1.5""")
_register("name_checks", r"""SELECT patient_id, list_filter([
      CASE WHEN regexp_matches(firstname, '\s') THEN 'firstname: white space' END,
      CASE WHEN firstname <> lower(firstname) THEN 'firstname: not lower case' END,
      CASE WHEN regexp_matches(lastname, '\s') THEN 'lastname: white space' END,
      CASE WHEN lastname <> lower(lastname) THEN 'lastname: not lower case' END], lambda x: x IS NOT NULL) AS broken_rules
    FROM patients WHERE regexp_matches(concat(firstname, lastname), '\s') OR firstname <> lower(firstname) OR lastname <> lower(lastname)""")
_register("running_duration", f"""SELECT {_NAME}, diabetes_duration, CAST((20000 * s + c) // (2 * c) AS DOUBLE) / 10000e0 AS moving_average
    FROM (SELECT *, sum(diabetes_duration) OVER w AS s, count(*) OVER w AS c FROM patients WHERE {_IN_DM}
          WINDOW w AS (ORDER BY patient_id ROWS UNBOUNDED PRECEDING)) q""")
_register("born_in", f"""SELECT {_NAME}, gender, race, age, height, bmi, CAST(1939 AS BIGINT) AS birth_year
    FROM patients JOIN gender USING (gender_id) JOIN race USING (race_id) WHERE year(visit_date) - age = 1939""")
_register("id_parity", """SELECT n AS pat_id, CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END AS even,
    CASE WHEN n % 2 = 1 THEN 'true' ELSE 'false' END AS odd FROM (SELECT CAST(patient_id[2:] AS BIGINT) AS n FROM patients) q""")
_register("leap_year_births", """SELECT count(*) AS n FROM (SELECT year(visit_date) - age AS y FROM patients) q
    WHERE y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)""")
_register("same_last_name", """SELECT firstname, lastname FROM
    (SELECT *, count(*) OVER (PARTITION BY lastname) AS c FROM patients) q WHERE c > 1""")
_register("group_over_age", f"SELECT patient_id, age FROM patients WHERE {_IN_DM} AND age > 60")
_register("age_bins", f"SELECT {_AGE_RANGE} AS age_range, count(*) AS n FROM patients GROUP BY 1")
_register("gender_percentages", f"""SELECT {_share("count(*) FILTER (gender_id = 'GEN_1')", "count(*)")} AS male,
    {_share("count(*) FILTER (gender_id = 'GEN_2')", "count(*)")} AS female FROM patients""")
_register("names_and_race", f"""SELECT patient_id, chunk, list(n ORDER BY rn) AS names FROM
    (SELECT patient_id, n, rn, (rn - 1) // 2 AS chunk FROM
      (SELECT patient_id, n, row_number() OVER (PARTITION BY patient_id ORDER BY n) AS rn FROM
        (SELECT patient_id, {_FULL} || ' ' || race AS n FROM patients JOIN race USING (race_id)) x WHERE n IS NOT NULL) y) q
    GROUP BY 1, 2""", chunk_rows=2)
_register("race_percentages", f"""SELECT race, count(*) AS n, {_share("count(*)", "any_value(t)")} AS percentage
    FROM patients JOIN race USING (race_id), (SELECT count(*) AS t FROM patients) q GROUP BY race""")
_register("bmi_classes", _count(_BMI_SQL, "bmi_class", "patients"))
_register("weights", """SELECT height, bmi, CAST((2 * v + 1000000) // 2000000 AS DOUBLE) / 100e0 AS weight FROM
    (SELECT *, CAST(round(bmi * 10) AS BIGINT) * CAST(round(height * 100) AS BIGINT) * CAST(round(height * 100) AS BIGINT) * 1000 AS v
     FROM patients) q""")
_register("heights_in_feet", """SELECT patient_id, height, CAST(floor(height * 3.28084e0) AS BIGINT) || chr(39) ||
    CAST(floor((height * 3.28084e0 - floor(height * 3.28084e0)) * 12) AS BIGINT) || '"' AS height_in_feet FROM patients""")
_register("repeated_first_names", """SELECT patient_id, firstname FROM
    (SELECT *, count(*) OVER (PARTITION BY firstname) AS c FROM patients WHERE firstname IS NOT NULL) q WHERE c > 1""")
_register("mean_bmi_per_group", f"""SELECT "group", {_mean("bmi")} AS mean_bmi FROM patients JOIN groups USING (group_id) GROUP BY 1""")
_register("bmi_ranks", "SELECT patient_id, height, bmi, dense_rank() OVER (ORDER BY bmi DESC) AS bmi_rank FROM patients")
_register("ages_per_height", """SELECT height, chunk, list(age ORDER BY rn) AS ages FROM
    (SELECT height, age, rn, (rn - 1) // 10 AS chunk FROM
      (SELECT height, age, row_number() OVER (PARTITION BY height ORDER BY age, patient_id) AS rn FROM patients WHERE age IS NOT NULL) y) q
    GROUP BY 1, 2""", chunk_rows=10)

# Labs
_register("missing_lipids", "SELECT * FROM lipid_lab_test WHERE fasting_hdl IS NULL OR fasting_ldl IS NULL")
_register("leukopenia", f"SELECT {_NAME} FROM {_TESTED} WHERE wbc < 3")
_register("abnormal_creatinine_levels", f"""SELECT CAST(ceil(creatinine) AS BIGINT) AS creatinine_level
    FROM {_LINKED} JOIN urine_test USING (urine_id)
    WHERE gender_id = 'GEN_1' AND age > 35 AND (creatinine < 65.4e0 OR creatinine > 119.3e0)""")
_register("creatinine_albumin", f"""SELECT {_NAME}, 'DM' AS "group", creatinine / nullif(albumin, 0) AS creatinine_albumin
    FROM {_LINKED} JOIN urine_test USING (urine_id) WHERE {_IN_DM}""")
_register("normal_creatinine_per_gender", f"""SELECT gender, count(*) AS n FROM {_LINKED} JOIN urine_test USING (urine_id)
    JOIN gender USING (gender_id) WHERE CASE gender WHEN 'Male' THEN creatinine BETWEEN 65.4e0 AND 119.3e0
    ELSE creatinine BETWEEN 52.2e0 AND 91.9e0 END GROUP BY gender""")
_register("anemic_diabetics_per_gender", f"""SELECT gender, count(DISTINCT patient_id) FILTER
      (hgb < CASE gender WHEN 'Male' THEN 13.2e0 ELSE 11.6e0 END) AS n FROM {_SEXED} WHERE diabetes_duration > 0 GROUP BY gender""")
_register("normal_platelets_per_group", f"""SELECT group_id, count(*) AS n FROM {_TESTED}
    WHERE platelets BETWEEN 150 AND 450 AND lab_id IN (SELECT lab_id FROM link_reference) GROUP BY group_id""")
_register("abnormal_sugar_alerts", """SELECT *, 'Abnormal values: hb_a1c, fasting_glucose' AS alert FROM lab_test
    WHERE hb_a1c > 5.7e0 AND fasting_glucose > 100""")
_register("glucose_distribution", "SELECT " + ", ".join(
    f'{_share(f"count(*) FILTER ({c})", "count(*)")} AS "{n}"' for n, c in _GLUCOSE.items()) + f" FROM {_TESTED}")
_register("glucose_distribution_rows", " UNION ALL ".join(
    f"""SELECT '{n}' AS condition, {_share(f"count(*) FILTER ({c})", "count(*)")} AS percentage FROM {_TESTED}"""
    for n, c in _GLUCOSE.items()))
_register("diabetic_rate_per_gender", "SELECT " + ", ".join(
    f"""{_share(f"count(*) FILTER (fasting_glucose > 120 AND gender = '{g}')", f"count(*) FILTER (gender = '{g}')")}
        AS {g.lower()}_diabetics""" for g in ("Male", "Female")) + f" FROM {_SEXED}")
_register("insulin_status", f"""SELECT {_INSULIN_SQL} AS insulin_status, count(*) AS n, {_share("count(*)", "any_value(t)")} AS percentage
    FROM lab_test JOIN lipid_lab_test USING (patient_id), (SELECT count(*) AS t FROM lipid_lab_test) q GROUP BY 1""")
_register("liver_risk_per_gender", f"""SELECT gender, count(*) AS n FROM {_LINKED} JOIN urine_test USING (urine_id)
    JOIN gender USING (gender_id)
    WHERE creatinine / nullif(albumin, 0) > CASE gender WHEN 'Male' THEN 17 ELSE 25 END GROUP BY gender""")
_AGE_TEN = "(age // 10 * 10) || '-' || (age // 10 * 10 + 10)"
_register("diabetics_per_year_and_age", f"""SELECT CAST(year(visit_date) AS INTEGER) AS year, {_AGE_TEN} AS age_group, count(*) AS n
    FROM {_TESTED} WHERE fasting_glucose > 120 GROUP BY 1, 2""")
_register("dominant_age_per_year", f"""SELECT year, arg_min(age_group, (-n, coalesce(age_group, 'z'))) AS age_group, max(n) AS n
    FROM (SELECT CAST(year(visit_date) AS INTEGER) AS year, {_AGE_TEN} AS age_group, count(*) AS n
    FROM {_TESTED} WHERE fasting_glucose > 120 GROUP BY 1, 2) q GROUP BY year""")
_register("mean_cholesterol_per_age", f"""SELECT {_bands("age", "age <= 55: 50-55", "age <= 60: 56-60", "age <= 65: 61-65",
    "age <= 70: 66-70", other="70+")} AS age_group, {_mean("fasting_cholesterol")} AS mean_cholesterol
    FROM patients JOIN lipid_lab_test USING (patient_id) GROUP BY 1""")
_register("mean_glucose_per_age", f"""SELECT {_bands("age", "age BETWEEN 51 AND 55: 51-55", "age BETWEEN 56 AND 60: 56-60",
    "age BETWEEN 61 AND 65: 61-65", "age BETWEEN 66 AND 70: 66-70", other="Above 70")} AS age_group,
    {_mean("fasting_glucose")} AS mean_glucose FROM {_TESTED} WHERE {_IN_DM} GROUP BY 1""")
_register("latest_results", f"""SELECT {_NAME}, lab_name, wbc, rbc, hgb, hct, platelets, hb_a1c, fasting_glucose, insulin
    FROM {_LINKED} JOIN lab_visit USING (lab_visit_id) JOIN (SELECT * EXCLUDE patient_id FROM lab_test) l USING (lab_id)
    QUALIFY row_number() OVER (PARTITION BY patients.patient_id ORDER BY lab_visit_date DESC, lab_id DESC) = 1""")
_register("last_digits", "SELECT lipid_id, right(CAST(CAST(fasting_cholesterol AS BIGINT) AS VARCHAR), 2) AS last_digits FROM lipid_lab_test")
_register("without_lab_test", """SELECT patient_id FROM patients EXCEPT SELECT patient_id FROM lab_test""")
_register("mean_hba1c_per_group", f"""SELECT "group", {_mean("hb_a1c")} AS mean_hb_a1c FROM {_TESTED}
    JOIN groups USING (group_id) GROUP BY 1""")
_register("glucose_classes", _count(_bands("", *[f"{c}: {n}" for n, c in _GLUCOSE.items()]), "diabetic_status", "lab_test",
                                     "fasting_glucose IS NOT NULL"))
_register("white_cell_classes", _count(_bands("wbc", "wbc < 4.5: LEUKOPENIA", "wbc <= 11: NORMAL", "wbc > 11: LEUKOCYTOSIS"),
                                        "wbc_condition", "lab_test", "wbc IS NOT NULL"))
_register("platelet_classes", _count(_bands("platelets", "platelets BETWEEN 150 AND 450: Normal", other="Abnormal"),
                                      "platelet_range", "lab_test"))
_HCT_SQL = """CASE WHEN hct < CASE gender WHEN 'Male' THEN 41 ELSE 36 END THEN 'ANEMIA'
    WHEN hct > CASE gender WHEN 'Male' THEN 50 ELSE 48 END THEN 'High Hematocrit' WHEN hct IS NOT NULL THEN 'NORMAL' END"""
_register("hematocrit_per_patient", f"SELECT patient_id, {_HCT_SQL} AS hematocrit FROM {_SEXED}")
_register("hematocrit_classes", _count(_HCT_SQL, "hematocrit", _SEXED))
_register("insulin_classes", _count(_INSULIN_SQL, "insulin_level", "lab_test"))
_register("insulin_with_abnormal_platelets", _count(_INSULIN_SQL, "insulin_level", "lab_test", "platelets NOT BETWEEN 150 AND 450"))
_URINE_SEXED = f"{_LINKED} JOIN urine_test USING (urine_id) JOIN gender USING (gender_id)"
_register("creatinine_classes", _count("""CASE WHEN creatinine BETWEEN CASE gender WHEN 'Male' THEN 65.4e0 ELSE 52.2e0 END
    AND CASE gender WHEN 'Male' THEN 119.3e0 ELSE 91.9e0 END THEN 'Normal' ELSE 'Abnormal Creatinine' END""",
    "creatinine_level", _URINE_SEXED, "creatinine IS NOT NULL"))
_register("albumin_classes", _count(_bands("albumin", "albumin < 30: Normal Albumin", "albumin >= 30: Abnormal Albumin"),
                                     "albumin_level", _URINE_SEXED, "creatinine IS NOT NULL"))
_register("bmi_and_cholesterol", f"""SELECT patient_id, bmi, fasting_cholesterol, {_BMI_SQL} AS bmi_category,
    {_bands("", "fasting_cholesterol < 200: Desirable", "fasting_cholesterol < 240: Borderline", "fasting_cholesterol >= 240: High Risk")}
    AS cholesterol_category FROM patients JOIN lipid_lab_test USING (patient_id)""")
_register("highest", f"""SELECT {_FULL} AS patient_name, hb_a1c FROM {_TESTED} ORDER BY hb_a1c DESC, patient_id, lab_id LIMIT 5""")
_register("mean_ldl_per_gender", f"""SELECT gender, {_mean("fasting_ldl")} AS mean_ldl FROM patients
    JOIN lipid_lab_test USING (patient_id) JOIN gender USING (gender_id) GROUP BY 1""")
_register("ldl_classes", _count(_bands("", "fasting_ldl < 100: Optimal", "fasting_ldl < 130: Near Optimal",
    "fasting_ldl < 160: Borderline High", "fasting_ldl < 190: High", "fasting_ldl >= 190: Very High"), "ldl_level", "lipid_lab_test"))
_register("triglyceride_classes", _count(_bands("", "fasting_triglyc < 150: Normal", "fasting_triglyc < 200: Borderline",
    "fasting_triglyc < 500: High", "fasting_triglyc >= 500: Very High"), "triglyceride_level", "lipid_lab_test"))
_register("hemoglobin_classes", _count("""CASE WHEN hgb BETWEEN CASE gender WHEN 'Male' THEN 13.2e0 ELSE 11.5e0 END
    AND CASE gender WHEN 'Male' THEN 16.6e0 ELSE 15e0 END THEN 'Normal' ELSE 'Abnormal' END""", "hemoglobin_level", _SEXED))
_PEOPLE = "patients JOIN gender USING (gender_id) JOIN race USING (race_id)"
_register("thrombocytopenia", f"""SELECT gender, race, count(*) AS n FROM {_PEOPLE} JOIN lab_test USING (patient_id)
    WHERE platelets < 150 GROUP BY ALL""")
_register("prediabetic_share_per_gender", f"""SELECT gender, CAST(100 * count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS percentage
    FROM {_LINKED} JOIN (SELECT * EXCLUDE patient_id FROM lab_test) l USING (lab_id) JOIN gender USING (gender_id)
    WHERE hb_a1c BETWEEN 5.7e0 AND 6.4e0 OR fasting_glucose = 100 GROUP BY gender""")
_register("high_hba1c", """SELECT patient_id, hb_a1c FROM lab_test WHERE patient_id IN (SELECT patient_id FROM lab_test WHERE hb_a1c > 6.5e0)""")
_register("low_insulin", "SELECT patient_id, insulin FROM lab_test WHERE insulin < 2.6e0")

# Exams
_register("start_exertion_between", f"SELECT {_NAME.replace('patient_id', 'patients.patient_id')} FROM {_WALKED} WHERE rpe_start IN (4, 5, 6)")
_MAP = "(2 * {0}_dbp + {0}_sbp) / 3"
_register("highest_pressure", f"""SELECT firstname, lastname, {_MAP.format("day")} AS day_map, {_MAP.format("night")} AS night_map
    FROM patients JOIN blood_pressure USING (patient_id) WHERE {_IN_DM} ORDER BY day_map DESC, patient_id LIMIT 1""")
_register("hypertensive_patients", f"""SELECT patients.patient_id, firstname, lastname, age, gender, day_sbp, day_dbp FROM {_PRESSURED}
    JOIN gender USING (gender_id) WHERE gender = 'Male' AND age BETWEEN 40 AND 60 AND day_sbp > 120 AND day_dbp > 80""")
_register("eye_damage", f"SELECT DISTINCT {_FULL} AS patient FROM {_EYES} WHERE diabetic_retinopathy > 0 OR macular_edema > 0")
_register("end_exertion_levels", f"""SELECT patient_id, {_bands("", "rpe_end = 0: Rest", "rpe_end <= 3: EASY INTENSITY",
    "rpe_end <= 6: MODERATE INTENSITY", "rpe_end <= 9: HARD INTENSITY", "rpe_end = 10: MAX EFFORT INTENSITY")} AS intensity FROM walking_test""")
_register("heart_rate_difference", """SELECT patient_id,
    CAST(CAST(round(day_hr * 10) AS BIGINT) - CAST(round(night_hr * 10) AS BIGINT) AS DOUBLE) / 10e0 AS hr_difference FROM blood_pressure""")
_register("mean_age_high_pressure", """SELECT avg(age) AS mean_age FROM patients JOIN blood_pressure USING (patient_id)
    WHERE least(day_sbp, night_sbp) > 129 AND least(day_dbp, night_dbp) > 79""")
_register("worst_eye_damage", f"""SELECT {_FULL} AS patient, opthal_id, 3 AS most_damage FROM {_EYES} WHERE diabetic_retinopathy = 3""")
_register("heart_rate_alerts", f"""SELECT bp_id, patient_id, day_hr, night_hr, 'Abnormal Heart Rate: ' ||
    {_names(", ", "day_hr > 120: day_hr", "night_hr > 100: night_hr")} AS alert FROM blood_pressure WHERE day_hr > 120 OR night_hr > 100""")
_register("exertion_changes", """SELECT CASE WHEN rpe_end > rpe_start THEN 'RPE_END>START' ELSE 'RPE_START>END' END AS type, count(*) AS n
    FROM walking_test WHERE rpe_end <> rpe_start GROUP BY 1""")
_register("csv_records", f"""SELECT patients.patient_id || ',' || "group" || ',' || race || ',' || gender || ',' || diabetic_retinopathy || ',' ||
      coalesce(CAST(fasting_glucose AS VARCHAR), '') AS record FROM {_EYES} JOIN link_reference USING (link_reference_id)
      JOIN lab_test USING (lab_id) JOIN groups USING (group_id) JOIN race USING (race_id) JOIN gender USING (gender_id)""")
_register("mean_pressure_per_gender", f"""SELECT gender, {", ".join(f"avg({c}) AS mean_{c}" for c in
    ("day_sbp", "day_dbp", "night_sbp", "night_dbp"))} FROM {_PRESSURED} JOIN gender USING (gender_id) GROUP BY gender""")
_register("heart_rate_per_age", f"""SELECT (age // 5 * 5) || '-' || (age // 5 * 5 + 4) AS age_group,
    {_mean("(day_hr + night_hr) / 2")} AS mean_rate FROM {_PRESSURED} GROUP BY 1""")
_register("heart_rate_per_bucket", f"SELECT {_AGE_RANGE} AS age_range, {_mean('(day_hr + night_hr) / 2')} AS mean_rate FROM {_PRESSURED} GROUP BY 1")
_register("high_pressure_names", f"""SELECT DISTINCT {_FULL} AS patient FROM {_PRESSURED}
    WHERE (day_sbp > 135 AND day_dbp > 85) OR (night_sbp > 120 AND night_dbp > 70)""")
_register("gait_speed_classes", _count("CASE WHEN dt_speed < CASE gender WHEN 'Male' THEN 1.08e0 ELSE 0.92e0 END THEN 'LOW' ELSE 'NORMAL' END",
                                        "gait_speed", f"{_WALKED} JOIN gender USING (gender_id)"))
_register("speeds_at_age", f"SELECT DISTINCT age, w.patient_id, dt_speed FROM {_WALKED} WHERE age = 55")
_register("mean_speed_per_bucket", f"SELECT {_AGE_RANGE} AS age_range, {_mean('dt_speed')} AS mean_speed FROM {_WALKED} GROUP BY 1")
_register("both_eye_conditions_per_race", f"""SELECT race, count(*) AS n FROM {_EYES} JOIN race USING (race_id)
    WHERE diabetic_retinopathy * macular_edema <> 0 GROUP BY race""")
_register("shortest_distances", f"""SELECT age, gender, race FROM {_WALKED} JOIN gender USING (gender_id) JOIN race USING (race_id)
    ORDER BY dt_distance, w.patient_id LIMIT 3""")
_ALL_LINKED = f"""{_LINKED} JOIN blood_pressure bp USING (bp_id) JOIN opthalmology USING (opthal_id) JOIN gender USING (gender_id)
    JOIN race USING (race_id) JOIN groups USING (group_id) JOIN urine_test USING (urine_id) JOIN lipid_lab_test USING (lipid_id)
    JOIN memory_cognitive USING (mc_id) JOIN visual_motor_cog USING (vm_id) JOIN verbal_cognitive USING (vc_id)
    JOIN lab_test USING (lab_id) JOIN lab_visit USING (lab_visit_id)"""
_register("patient_info", f"""SELECT patients.patient_id AS patient_id, {_FULL} AS full_name, gender, age, race, lab_name,
    CASE WHEN {_IN_DM} THEN 'Diabetic' ELSE 'Control' END AS "group",
    CASE WHEN least({_MAP.format("day")}, {_MAP.format("night")}) < 70 THEN 'Low'
         WHEN least({_MAP.format("day")}, {_MAP.format("night")}) <= 100 THEN 'Normal' ELSE 'High' END AS map,
    CASE WHEN macular_edema <> 0 THEN 'Macular_Edema' WHEN diabetic_retinopathy <> 0 THEN 'Diabetic_Retinopathy' ELSE 'No' END AS eye_damage,
    CASE WHEN fasting_cholesterol < 150 THEN 'Normal' ELSE 'High' END AS cholesterol,
    {_bands("", "fasting_glucose <= 70: Hypoglycemia", "fasting_glucose <= 100: Normal", "fasting_glucose <= 120: Pre_Diabetic",
            "fasting_glucose > 120: Diabetic")} AS insulin,
    {_names(",", *_DEMENTIA)} AS dementia,
    CASE WHEN creatinine IS NULL OR albumin IS NULL THEN NULL
         WHEN creatinine NOT BETWEEN CASE gender WHEN 'Male' THEN 65.4e0 ELSE 52.2e0 END AND CASE gender WHEN 'Male' THEN 119.3e0 ELSE 91.9e0 END
           THEN 'A.Creat'
         WHEN albumin BETWEEN 3.4e0 AND 5.4e0 THEN 'Normal' ELSE 'A.Alb' END AS lipid
    FROM {_ALL_LINKED}""", view=None)
_register("numeric_record", f"""SELECT patients.patient_id AS patient_id, {_FULL} AS full_name, age, bmi, gender, race, day_sbp, day_dbp,
    day_hr, fasting_glucose, fasting_cholesterol, macular_edema, gds, clock, albumin, ds, dt_distance
    FROM patients JOIN gender USING (gender_id) JOIN race USING (race_id) JOIN groups USING (group_id)
    JOIN blood_pressure USING (bp_id) JOIN opthalmology USING (opthal_id) JOIN walking_test USING (walktest_id)
    JOIN (SELECT * FROM link_reference QUALIFY row_number() OVER (PARTITION BY link_reference_id ORDER BY lab_visit_id DESC) = 1) k
      USING (link_reference_id)
    JOIN memory_cognitive USING (mc_id) JOIN urine_test USING (urine_id)
    JOIN {_newest("lab_test", "lab_id")} l ON l.patient_id = patients.patient_id
    JOIN {_newest("lipid_lab_test", "lipid_id")} i ON i.patient_id = patients.patient_id
    JOIN {_newest("visual_motor_cog", "vm_id")} m ON m.patient_id = patients.patient_id
    JOIN {_newest("verbal_cognitive", "vc_id")} v ON v.patient_id = patients.patient_id""")

# Cognition
_FLAGS = ("rcft_ir <= 71: RCFT", "tm >= 42: TM", "clock <= 2: Clock", "gds >= 15: GDS")
_register("visual_motor_impairments", f"""SELECT {_names(", ", *_FLAGS)} AS abnormal_conditions, count(*) AS n
    FROM link_reference JOIN visual_motor_cog USING (vm_id) JOIN memory_cognitive USING (mc_id)
    WHERE {_ones(*[f.split(":")[0] for f in _FLAGS])} >= 2 GROUP BY 1""")
_register("verbally_impaired", f"""SELECT patient_id FROM verbal_cognitive JOIN link_reference USING (vc_id) JOIN memory_cognitive USING (mc_id)
    WHERE {_ones("ds <= 13", "hvlt <= 14", "vf <= 42", "wtar <= 20", "gds >= 15")} >= 2""")
_register("memory_impaired", f"""SELECT {_NAME} FROM {_LINKED} JOIN memory_cognitive USING (mc_id)
    WHERE diabetes_duration BETWEEN 5 AND 30 AND gds >= 15""")
_SUGAR = "(rcft_ir > 71 OR tm > 42 OR clock <= 2 OR gds >= 15)"
_register("dementia_among_diabetics", f"""SELECT count(*) AS diabetic, count(*) FILTER {_SUGAR} AS with_dementia,
    {_share(f"count(*) FILTER {_SUGAR}", "count(*)")} AS percentage FROM link_reference JOIN lab_test USING (lab_id)
    JOIN visual_motor_cog USING (vm_id) JOIN memory_cognitive USING (mc_id) WHERE fasting_glucose > 120""")
_register("bads_classes", _count(_bands("", "bads < 11: IMPAIRED", "bads IN (12, 13): BORDERLINE", "bads IN (14, 15): LOW AVERAGE",
    "bads BETWEEN 16 AND 20: AVERAGE", "bads IN (21, 22): HIGH AVERAGE", "bads IN (23, 24): SUPERIOR"), "bads_category",
    f"{_LINKED} JOIN memory_cognitive USING (mc_id)"))
_register("below_average_bads", f"""SELECT gender, count(*) AS n FROM {_LINKED} JOIN memory_cognitive USING (mc_id)
    JOIN gender USING (gender_id) WHERE bads < 16 GROUP BY gender""")
_register("dementia_levels", _count(_bands("", "hvlt < 14: DEMENTIA", "hvlt <= 19: MILD DEMENTIA", "hvlt > 19: NORMAL"),
                                     "dementia_level", "verbal_cognitive", "vc_id IN (SELECT vc_id FROM link_reference)"))
_register("clock_scores", "SELECT clock, count(*) AS n FROM visual_motor_cog GROUP BY clock")
_register("low_gds_per_race_and_gender", f"""SELECT race, gender, count(*) AS n FROM {_PEOPLE} JOIN link_reference USING (link_reference_id)
    JOIN memory_cognitive USING (mc_id) WHERE gds > 0 AND gds < 14.9 GROUP BY ALL""")
_register("any_impairment_per_age", f"""SELECT ((age - 1) // 5 * 5) || '-' || ((age - 1) // 5 * 5 + 4) AS age_range,
    count(DISTINCT patient_id) FILTER ({" OR ".join(d.split(":")[0] for d in _DEMENTIA)}) AS n
    FROM {_LINKED} JOIN memory_cognitive USING (mc_id) JOIN visual_motor_cog USING (patient_id)
    JOIN verbal_cognitive USING (patient_id) GROUP BY 1""")
_register("verbal_and_kidney_issues", f"""SELECT {_FULL} AS patient_name, race, age FROM {_PEOPLE} JOIN link_reference USING (link_reference_id)
    JOIN (SELECT * EXCLUDE patient_id FROM verbal_cognitive) v USING (vc_id) JOIN urine_test USING (urine_id)
    WHERE age > 55 AND albumin NOT BETWEEN 3.4e0 AND 5.4e0 AND (ds < 13 OR vf < 42 OR wtar <= 20)""")

# Visits
_register("visit_share_per_month", """SELECT CAST(m AS INTEGER) AS month, monthname(make_date(2000, CAST(m AS INTEGER), 1)) AS month_name,
    count(DISTINCT patient_id) AS ids, CAST(100 * count(DISTINCT patient_id) AS DOUBLE)
      / CAST((SELECT count(DISTINCT patient_id) FROM patients) AS DOUBLE) AS percentage
    FROM range(1, 13) r(m) LEFT JOIN patients ON month(visit_date) = m GROUP BY m""")
_register("visits_per_lab_in_year", """SELECT lab_name, count(*) AS n FROM lab_visit
    WHERE lab_name IN ('Cultivate Lab', 'Genesis Lab') AND year(lab_visit_date) = 1998 GROUP BY 1""", year=1998)
_register("cholesterol_in_month", """SELECT patient_id, fasting_cholesterol, 'FEBRUARY' AS month, '2000' AS year
    FROM lipid_lab_test JOIN link_reference USING (lipid_id) JOIN lab_visit USING (lab_visit_id)
    WHERE strftime(lab_visit_date, '%Y-%m') = '2000-02'""", year=2000, month=2)
_register("visits_between_hours", "SELECT count(*) AS n FROM lab_visit WHERE hour(lab_visit_date) IN (9, 10, 11, 12)")
_register("visit_times", f"""SELECT {_NAME}, strftime(visit_date, '%I:%M:%S %p') AS visit_time, strftime(visit_date, '%Y-%m-%d') AS visit_day
    FROM patients""")
_register("visits_per_month", "SELECT monthname(visit_date) AS month_name, count(*) AS n FROM patients GROUP BY 1")
_register("renamed_lab", """SELECT lab_visit_id, CASE WHEN lab_visit_id = 'LB000000000002' THEN 'Cultivate Lab' ELSE lab_name END AS lab_name,
    lab_visit_date FROM lab_visit""", lab_visit_id="LB000000000002")
_register("lab_dates_and_times", """SELECT CAST(lab_visit_date AS DATE) AS lab_visit_date, strftime(lab_visit_date, '%H:%M:%S') AS lab_visit_time
    FROM lab_visit""")
_register("labs_like", "SELECT DISTINCT lab_name FROM lab_visit WHERE lab_name LIKE 'G%b'")
_register("visit_share_per_lab", """SELECT lab_name, CAST(100 * count(*) AS DOUBLE) / CAST((SELECT count(*) FROM lab_visit) AS DOUBLE) AS percentage
    FROM lab_visit GROUP BY 1""")
_register("patients_in_period", """SELECT count(DISTINCT patient_id) AS n FROM patients
    WHERE CAST(visit_date AS DATE) BETWEEN DATE '2005-03-01' AND DATE '2006-03-31'""")
_register("patients_per_group_and_lab", f"""SELECT "group", lab_name, count(DISTINCT patient_id) AS n FROM {_LINKED}
    JOIN lab_visit USING (lab_visit_id) JOIN groups USING (group_id) GROUP BY 1, 2""")
_register("title_case_labs", "SELECT DISTINCT CASE lab_name WHEN 'green lab' THEN 'Green Lab' WHEN 'Gamma lab' THEN 'Gamma Lab' ELSE lab_name END AS lab_name FROM lab_visit")
_register("busy_days", """SELECT strftime(lab_visit_date, '%Y-%m-%d') AS day, count(*) AS visits FROM lab_visit GROUP BY 1 HAVING count(*) >= 2""")
_register("busy_weeks", f"SELECT {_WEEK} AS week, count(*) AS visits FROM lab_visit GROUP BY 1 HAVING count(*) >= 2")
_register("patients_of_each_lab", f"""SELECT lab_name, chunk, list(patient_id ORDER BY rn) AS patients FROM
    (SELECT lab_name, patient_id, rn, (rn - 1) // 25 AS chunk FROM
      (SELECT lab_name, patient_id, row_number() OVER (PARTITION BY lab_name ORDER BY patient_id) AS rn
       FROM {_LINKED} JOIN lab_visit USING (lab_visit_id)) y) q
    GROUP BY 1, 2""", chunk_rows=25)

# Short lists and counts
_register("random_patients", f"SELECT * FROM patients WHERE {_IN_DM} ORDER BY md5('0:' || patient_id), patient_id LIMIT 10", digest="md5")
_register("senior_patients", f"SELECT {_NAME}, age FROM patients WHERE age >= 71")
_register("first_names_starting", "SELECT firstname, lastname FROM patients WHERE lower(firstname[1]) = 't'")
_register("patients_named", f"SELECT {_NAME}, age FROM patients WHERE firstname = 'Gabriel'")
_register("name_positions", """SELECT patient_id, lastname, CAST(instr(lastname, 'an') AS INTEGER) AS position FROM patients
    WHERE contains(lastname, 'an')""")
_register("patient_page", f"SELECT {_NAME} FROM patients ORDER BY patient_id LIMIT 11 OFFSET 29")
_register("patients_per_race", "SELECT race, count(*) AS n FROM patients JOIN race USING (race_id) GROUP BY race")
_register("patients_per_race_key", "SELECT race_id, race, count(*) AS n FROM patients JOIN race USING (race_id) GROUP BY ALL")
_register("distinct_patients_per_race", "SELECT race, count(DISTINCT patient_id) AS n FROM patients JOIN race USING (race_id) GROUP BY 1")
_register("total_duration", f"SELECT CAST(sum(diabetes_duration) AS BIGINT) AS total FROM patients WHERE {_IN_DM}")
_register("name_lengths", f"""SELECT {_FULL} AS full_name, CAST(1 + coalesce(len(firstname), 0) + 1 + len(lastname) AS INTEGER) AS length_plus
    FROM patients""")
_register("group_members_per_gender", f"SELECT gender, count(*) AS n FROM patients JOIN gender USING (gender_id) WHERE {_IN_DM} GROUP BY 1")
_register("name_starts", "SELECT patient_id, lower(firstname[1:5]) AS name_start FROM patients")
_register("walk_ranks", """SELECT patient_id, group_id, opthal_id, dense_rank() OVER (PARTITION BY opthal_id ORDER BY walktest_id) AS walk_rank
    FROM patients""")
_register("overweight_in_group", f"SELECT count(*) AS n FROM patients WHERE bmi > 24.9e0 AND {_IN_DM}")
_register("overweight_per_gender", "SELECT gender, count(*) AS n FROM patients JOIN gender USING (gender_id) WHERE bmi > 24.9e0 GROUP BY 1")
_register("overweight_per_race", "SELECT race, count(*) AS n FROM patients JOIN race USING (race_id) WHERE bmi > 24.9e0 GROUP BY 1")
_register("null_values", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS rows FROM patients" for c in SCHEMAS["patients"].names) + ") q")
_register("members_without_duration", f"SELECT patient_id FROM patients WHERE {_IN_DM} AND diabetes_duration = 0")
_register("ages_by_parity", "SELECT firstname || ' ' || lastname AS full_name, age FROM patients WHERE age & 1 = 1")
_register("patients_aged", "SELECT * FROM patients WHERE age = 61")
for _name, _column, _table in (
    ("distinct_races", "race", "race"), ("distinct_first_names", "firstname", "patients"), ("distinct_last_names", "lastname", "patients"),
    ("distinct_patients_measured", "patient_id", "blood_pressure"), ("distinct_labs", "lab_name", "lab_visit"),
):
    _register(_name, f"SELECT count(DISTINCT {_column}) AS n FROM {_table}")
_register("upper_case_names", "SELECT patient_id, concat(upper(firstname), ' ', upper(lastname)) AS full_name FROM patients")
_register("ids_containing", "SELECT patient_id FROM patients WHERE contains(patient_id, '2')")
_register("heavy_patients", "SELECT patient_id, age, bmi FROM patients WHERE bmi >= 25")
_register("white_cell_view", "SELECT lab_id, patient_id, wbc, platelets FROM lab_test WHERE wbc >= 3 AND wbc <= 6")
_register("glucose_values", "SELECT patient_id FROM lab_test WHERE list_contains([80, 85, 89], fasting_glucose)")
_register("high_triglycerides", f"""SELECT {_NAME}, age, gender, race, 'DM' AS "group", fasting_triglyc FROM {_PEOPLE}
    JOIN lipid_lab_test USING (patient_id) WHERE {_IN_DM} AND fasting_triglyc > 150""")
_register("kidney_risk", f"""SELECT firstname || ' ' || lastname AS patient FROM {_LINKED} JOIN urine_test USING (urine_id) WHERE albumin >= 30""")
_register("prediabetic", """SELECT patients.patient_id AS patient_id, "group", 'Prediabetic' AS label FROM patients JOIN link_reference USING (link_reference_id)
    JOIN lab_test USING (lab_id) JOIN groups USING (group_id) WHERE fasting_glucose BETWEEN 100 AND 125""")
_register("high_hemoglobin", """SELECT firstname || ' ' || lastname AS full_name, link_reference_id, hgb FROM patients
    JOIN link_reference USING (link_reference_id) JOIN lab_test USING (lab_id) WHERE hgb > 15""")
_register("lab_tests", "SELECT * FROM lab_test")
_register("blood_pressures", "SELECT * FROM blood_pressure")
_register("mean_hba1c_in_group", f"SELECT {_mean('hb_a1c')} AS mean_hb_a1c FROM {_TESTED} WHERE {_IN_DM}")
_register("heart_risk", "SELECT count(*) AS n FROM patients JOIN lipid_lab_test USING (patient_id) WHERE gender_id = 'GEN_1' AND fasting_hdl > 40")
_register("high_glucose", f"""SELECT gender, race, count(*) AS n FROM {_PEOPLE} JOIN lab_test USING (patient_id)
    WHERE fasting_glucose > 120 GROUP BY ALL""")
_register("high_cholesterol", f"""SELECT gender, race, count(*) AS n FROM {_PEOPLE} JOIN lipid_lab_test USING (patient_id)
    WHERE fasting_cholesterol > 240 GROUP BY ALL""")
_register("insulin_out_of_range", f"SELECT {_FULL} AS patient_name FROM {_TESTED} WHERE insulin < 2.6e0 OR insulin > 24.6e0")
_register("far_and_fast", f"""SELECT {_FULL} AS patient, dt_distance, dt_speed FROM patients JOIN walking_test USING (patient_id)
    WHERE dt_distance > 400 AND dt_speed > 1""")
_register("patients_view", f"""SELECT patients.patient_id AS patient_id, firstname, lastname, visit_date, age, height, bmi, "group", gender, race,
    day_sbp, day_dbp, day_hr, diabetic_retinopathy, macular_edema, lipid_id, lab_id FROM {_EYES} JOIN blood_pressure USING (bp_id)
    JOIN groups USING (group_id) JOIN gender USING (gender_id) JOIN race USING (race_id) JOIN link_reference USING (link_reference_id)""")
_register("fastest_walker", f"SELECT firstname, lastname, dt_speed FROM {_WALKED} ORDER BY dt_speed DESC, w.patient_id LIMIT 1")
_register("mean_pressures", "SELECT patients.patient_id AS patient_id, " + ", ".join(
    f"CAST((200 * (2 * CAST({d}_dbp AS BIGINT) + CAST({d}_sbp AS BIGINT)) + 3) // 6 AS DOUBLE) / 100e0 AS {d}_map" for d in ("day", "night"))
    + f" FROM {_PRESSURED}")
_register("moderate_exertion", f"""SELECT w.patient_id AS patient_id, firstname || ' ' || lastname AS full_name, rpe_start, rpe_end FROM {_WALKED}
    WHERE rpe_start IN (4, 5, 6) AND rpe_end IN (4, 5, 6)""")
_register("gait_speed_per_patient", f"""SELECT w.patient_id AS patient_id,
    CASE WHEN dt_speed < CASE gender WHEN 'Male' THEN 1.08e0 ELSE 0.92e0 END THEN 'LOW' ELSE 'NORMAL' END AS gait_speed
    FROM {_WALKED} JOIN gender USING (gender_id)""")
_register("distances_per_minute", """SELECT patient_id, CAST((200 * CAST(dt_distance AS BIGINT) + 6) // 12 AS DOUBLE) / 100e0 AS distance_per_minute
    FROM walking_test""")
_register("both_eye_conditions", f"SELECT {_FULL} AS patient FROM {_EYES} WHERE diabetic_retinopathy > 0 AND macular_edema > 0")
_register("patient_info_of", REPORTS["study_patient_info"].sql.split(DERIVED_SQL)[1] + " WHERE patients.patient_id = 'S000000000000'",
          patient_id="S000000000000")
_register("slow_trail_makers", f"""SELECT {_FULL} AS patient FROM {_LINKED} JOIN (SELECT vm_id, tm FROM visual_motor_cog) v USING (vm_id)
    WHERE tm >= 42""")
_register("impaired_by_gds", f"SELECT count(*) AS n FROM {_LINKED} JOIN memory_cognitive USING (mc_id) WHERE gds >= 15")
_register("slow_trail_maker_count", "SELECT count(*) AS n FROM visual_motor_cog WHERE tm >= 42")
_register("test_scores", f"""SELECT v.patient_id, wtar, tm, age FROM {_newest("verbal_cognitive", "vc_id")} v
    FULL JOIN {_newest("visual_motor_cog", "vm_id")} m ON m.patient_id = v.patient_id
    FULL JOIN patients p ON p.patient_id = v.patient_id""")
_register("patients_per_lab", f"SELECT lab_name, count(DISTINCT patient_id) AS n FROM {_LINKED} JOIN lab_visit USING (lab_visit_id) GROUP BY 1")
_register("first_and_last_visit", "SELECT min(visit_date) AS first_visit, max(visit_date) AS last_visit FROM patients")
_register("visit_times_24h", "SELECT patient_id, strftime(visit_date, '%H:%M:%S') AS visit_time FROM patients")
_register("bmi_and_cholesterol_sorted", REPORTS["study_bmi_and_cholesterol"].sql.split(DERIVED_SQL)[1])

_register("birth_years", f"SELECT {_FULL} AS patient_name, year(visit_date) - age AS birth_year FROM patients")


# Questions that need more than the study: a date, a list of names, further rows.
def _special(name: str, sql: str, run: Callable[[Tables], DataFrame]) -> None:
    key = f"study_{name}"
    start, joint = ("WITH RECURSIVE", ", ") if sql.startswith("walk AS") else ("WITH", " ")
    REPORTS[key] = Report(key, lambda spark, folder: run(Tables(spark, folder)), f"{start} {DERIVED_SQL}{joint}{sql}")


def _as_of() -> Column:
    return F.lit("2024-06-30").cast("date")


_special(
    "birth_year_ranges",
    f"""SELECT {_NAME}, CASE WHEN age IS NULL THEN 'unknown' ELSE
    ((2024 - age) // 10 * 10) || '-' || ((2024 - age) // 10 * 10 + 9) END AS birth_year_range FROM patients""",
    lambda t: ask(derive(t), "birth_year_ranges", as_of=_as_of()),
)
_special(
    "insulin_status_abnormal_lipids",
    f"""SELECT {_INSULIN_SQL} AS insulin_status, count(*) AS n, {_share("count(*)", "any_value(t)")} AS percentage
    FROM lab_test JOIN (SELECT * FROM lipid_lab_test WHERE fasting_hdl < 50 AND fasting_ldl > 130 AND fasting_triglyc > 150) l
      USING (patient_id), (SELECT count(*) AS t FROM lipid_lab_test) q GROUP BY 1""",
    lambda t: ask(derive(t), "insulin_status", abnormal_lipids_only=True),
)
_special(
    "current_ages", "SELECT patient_id, 2024 - year(visit_date) + age AS current_age FROM patients",
    lambda t: ask(derive(t), "current_ages", as_of=_as_of()),
)
_special(
    "gender_snapshot", "SELECT gender, count(*) AS n FROM patients JOIN gender USING (gender_id) GROUP BY gender",
    lambda t: ask(derive(t), "gender_snapshot").refresh(),
)
_special(
    "customer_view", """SELECT CAST(c_custkey AS INTEGER) AS customer_id, c_name AS customer_name, c_mktsegment AS address, n_name AS place
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    lambda t: ask(
        derive(t), "customer_view", view="customers_of_nations",
        rows=t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("address"), F.col("n_name").alias("place"),
        ),
    ),
)
_special(
    "reachable", """walk AS (
      SELECT patient_id AS node, 0 AS depth FROM patients WHERE age > 70
      UNION SELECT child, depth + 1 FROM walk JOIN (
        SELECT patient_id AS parent, group_id AS child FROM patients UNION ALL SELECT group_id, 'G' || gender_id FROM patients) e ON parent = node)
    SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    lambda t: ask(
        derive(t), "reachable", seeds=derive(t).patients.filter(F.col("age") > 70).select(F.col("patient_id").alias("node")),
        edges=derive(t).patients.select(F.col("patient_id").alias("parent"), F.col("group_id").alias("child")).unionByName(
            derive(t).patients.select(F.col("group_id").alias("parent"), F.concat(F.lit("G"), "gender_id").alias("child"))
        ),
    ),
)
_special(
    "races_known", """SELECT name AS race, name IN (SELECT race FROM race) AS found
    FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation) q""",
    lambda t: ask(
        derive(t), "races_known",
        names=t.region.select(F.col("r_name").alias("race")).union(t.nation.select("n_name")),
    ),
)
_special(
    "with_children", "SELECT * FROM patients UNION ALL SELECT * FROM patients WHERE age > 70",
    lambda t: ask(derive(t), "with_children", child=derive(t).patients.filter(F.col("age") > 70).withColumn("ward", F.lit("A"))),
)
