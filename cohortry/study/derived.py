"""A study derived from the given tables, so that every question runs on data that grows with them.

Customers are the patients who come, and orders their lab visits: each is a visit with a test of every kind. Suppliers
are patients who have registered and never came, so they have no tests and no visits. Each value is a plain function of a
column: remainders of the balance and of the order total in cents spread the measures over their
clinical range. Every table is a projection of one given table, that of patients of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import cents
from cohortry.sources.tables import TableFolder
from cohortry.study.tables import Study

FIRST_NAMES = ["Tom", "Sara", "Ann", "Gabriel", "Rob", "tia", "Mary Ann", "Sorab", "Lee"]
LAST_NAMES = ["Martin", "Mason", "Porter", "Pohl", "Sanders", "Anand", "Reed", "Stone", "Lane", "Berg", "Urban"]
NEVER_CAME = 900_000_000_000  # added to the keys of suppliers
LABS = ["Genesis Lab", "Cultivate Lab", "green lab", "Gamma lab"]


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 12, "0"))


def _after(start: Column, days: Column | None, seconds: Column) -> Column:
    zero = F.lit(0)
    return start + F.make_dt_interval(zero if days is None else days.cast("int"), zero, zero, seconds.cast("decimal(18,6)"))


def _double(value: Column, divisor: float = 1.0) -> Column:
    return value.cast("double") / F.lit(divisor)


def _unless(multiple: int, value: Column, seed: Column) -> Column:
    """NULL where the seed is a multiple: the given tables hold no NULLs of their own."""
    return F.when(seed % multiple != 0, value)


def derive(tables: TableFolder) -> Study:
    customer = tables.customer.withColumn("a", cents("c_acctbal") + 100000)
    never_came = tables.supplier.select(
        (F.col("s_suppkey") + NEVER_CAME).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.lit("").alias("c_mktsegment"),
        (cents("s_acctbal") + 100000).alias("a"))
    registered = customer.select(*never_came.columns).unionByName(never_came)
    orders = tables.orders.withColumn("k", cents("o_totalprice"))
    region = tables.region
    tests = orders.select("o_custkey", F.col("o_orderkey").alias("visit"), "k")
    a, k = F.col("a"), F.col("k")
    diabetic = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")
    epoch = F.lit("2005-01-01 00:00:00").cast("timestamp_ntz")
    patient = _id("S", "o_custkey").alias("patient_id")
    key = F.col("r_regionkey")

    def pair(id_name: str, prefix: str, name: str, first: str, second: str) -> DataFrame:
        return region.filter(key < 2).select(
            F.concat(F.lit(prefix), (key + 1).cast("string")).alias(id_name),
            F.when(key == 0, first).otherwise(second).alias(name),
        )

    return Study({
        "patients": lambda: registered.select(
            _id("S", "c_custkey").alias("patient_id"),
            _unless(41, _pick(FIRST_NAMES, a % 9), a).alias("firstname"),
            _pick(LAST_NAMES, a % 11).alias("lastname"),
            _unless(47, (40 + a % 53).cast("int"), a).alias("age"),
            _double(140 + a % 61, 100).alias("height"),
            _double(160 + a % 211, 10).alias("bmi"),
            F.when(diabetic, a % 31).otherwise(0).cast("int").alias("diabetes_duration"),
            _after(epoch, a % 730, a % 86399).alias("visit_date"),
            F.when(diabetic, "GRP_02").otherwise("GRP_01").alias("group_id"),
            F.concat(F.lit("GEN_"), (a % 2 + 1).cast("string")).alias("gender_id"),
            F.concat(F.lit("RACE_"), (F.col("c_nationkey") % 5).cast("string")).alias("race_id"),
            _id("BP", "c_custkey").alias("bp_id"),
            _id("OP", "c_custkey").alias("opthal_id"),
            _id("WT", "c_custkey").alias("walktest_id"),
            _id("LR", "c_custkey").alias("link_reference_id"),
        ),
        "group": lambda: pair("group_id", "GRP_0", "group", "Control", "DM"),
        "gender": lambda: pair("gender_id", "GEN_", "gender", "Male", "Female"),
        "race": lambda: region.select(
            F.concat(F.lit("RACE_"), key.cast("string")).alias("race_id"), F.col("r_name").alias("race")
        ),
        "blood_pressure": lambda: customer.select(
            _id("BP", "c_custkey").alias("bp_id"), _id("S", "c_custkey").alias("patient_id"),
            _double(100 + a % 61).alias("day_sbp"), _double(60 + a % 43).alias("day_dbp"),
            _double(95 + a % 59).alias("night_sbp"), _double(55 + a % 37).alias("night_dbp"),
            _double(600 + a % 701, 10).alias("day_hr"), _double(500 + a % 601, 10).alias("night_hr"),
        ),
        "opthalmology": lambda: customer.select(
            _id("OP", "c_custkey").alias("opthal_id"), (a % 4).cast("int").alias("diabetic_retinopathy"),
            (a % 3).cast("int").alias("macular_edema"),
        ),
        "walking_test": lambda: customer.select(
            _id("WT", "c_custkey").alias("walktest_id"), _id("S", "c_custkey").alias("patient_id"),
            (a % 11).cast("int").alias("rpe_start"), F.least(a % 13, F.lit(10)).cast("int").alias("rpe_end"),
            _double(300 + a % 301).alias("dt_distance"), _double(60 + a % 91, 100).alias("dt_speed"),
        ),
        "lab_test": lambda: tests.select(
            _id("L", "visit").alias("lab_id"), patient,
            _unless(19, _double(20 + k % 113, 10), k).alias("wbc"), _double(35 + k % 29, 10).alias("rbc"),
            _double(100 + k % 83, 10).alias("hgb"), _double(30 + k % 27).alias("hct"),
            _double(100 + k % 431).alias("platelets"), _double(40 + k % 41, 10).alias("hb_a1c"),
            _unless(37, _double(60 + k % 90), k).alias("fasting_glucose"),
            _unless(43, _double(10 + k % 311, 10), k).alias("insulin"),
        ),
        "lipid_lab_test": lambda: tests.select(
            _id("LP", "visit").alias("lipid_id"), patient,
            _double(120 + k % 181).alias("fasting_cholesterol"), _double(60 + k % 571).alias("fasting_triglyc"),
            _unless(31, _double(20 + k % 67), k).alias("fasting_hdl"),
            _unless(23, _double(500 + k % 1601, 10), k).alias("fasting_ldl"),
        ),
        "urine_test": lambda: tests.select(
            _id("UR", "visit").alias("urine_id"), _unless(29, _double(400 + k % 1001, 10), k).alias("creatinine"),
            _double(k % 701, 10).alias("albumin"),
        ),
        "visual_motor_cog": lambda: tests.select(
            _id("VM", "visit").alias("vm_id"), patient, _double(50 + k % 61).alias("rcft_ir"),
            _double(20 + k % 53).alias("tm"), _double(k % 6).alias("clock"),
        ),
        "verbal_cognitive": lambda: tests.select(
            _id("VC", "visit").alias("vc_id"), patient, _double(8 + k % 17).alias("ds"),
            _double(8 + k % 19).alias("hvlt"), _double(25 + k % 41).alias("vf"), _double(10 + k % 31).alias("wtar"),
        ),
        "memory_cognitive": lambda: tests.select(
            _id("MC", "visit").alias("mc_id"), _double(k % 22).alias("gds"), _double(8 + k % 17).alias("iadl"),
            _double(15 + k % 16).alias("mmse"), _double(5 + k % 20).alias("bads"),
        ),
        "lab_visit": lambda: orders.select(
            _id("LB", "o_orderkey").alias("lab_visit_id"), _pick(LABS, k % 4).alias("lab_name"),
            _after(F.col("o_orderdate"), None, k % 86399).alias("lab_visit_date"),
        ),
        "link_reference": lambda: tests.select(
            _id("LR", "o_custkey").alias("link_reference_id"), _id("LP", "visit").alias("lipid_id"),
            _id("L", "visit").alias("lab_id"), _id("LB", "visit").alias("lab_visit_id"),
            _id("UR", "visit").alias("urine_id"), _id("VM", "visit").alias("vm_id"),
            _id("VC", "visit").alias("vc_id"), _id("MC", "visit").alias("mc_id"),
        ),
    })


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# The same tables in SQL, as common table expressions.
DERIVED_SQL = f"""
  cu AS (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) + 100000 AS a, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id,
                c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS dm FROM customer),
  vi AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS k FROM orders),
  od AS (SELECT 'S' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS patient_id, k,
                lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM vi),
  re AS (SELECT a, id, dm, c_nationkey FROM cu
     UNION ALL SELECT CAST(round(s_acctbal * 100) AS BIGINT) + 100000, lpad(CAST(s_suppkey + {NEVER_CAME} AS VARCHAR), 12, '0'), false, s_nationkey FROM supplier),
  patients AS (SELECT 'S' || id AS patient_id, CASE WHEN a % 41 <> 0 THEN {_sql_list(FIRST_NAMES)}[a % 9 + 1] END AS firstname,
     {_sql_list(LAST_NAMES)}[a % 11 + 1] AS lastname, CASE WHEN a % 47 <> 0 THEN CAST(40 + a % 53 AS INTEGER) END AS age,
     (140 + a % 61) / 100e0 AS height, (160 + a % 211) / 10e0 AS bmi,
     CAST(CASE WHEN dm THEN a % 31 ELSE 0 END AS INTEGER) AS diabetes_duration,
     TIMESTAMP '2005-01-01' + to_days(CAST(a % 730 AS INTEGER)) + to_seconds(a % 86399) AS visit_date,
     CASE WHEN dm THEN 'GRP_02' ELSE 'GRP_01' END AS group_id, 'GEN_' || (a % 2 + 1) AS gender_id,
     'RACE_' || (c_nationkey % 5) AS race_id, 'BP' || id AS bp_id, 'OP' || id AS opthal_id, 'WT' || id AS walktest_id,
     'LR' || id AS link_reference_id FROM re),
  groups AS (SELECT * FROM (VALUES ('GRP_01', 'Control'), ('GRP_02', 'DM')) v(group_id, "group")),
  gender AS (SELECT * FROM (VALUES ('GEN_1', 'Male'), ('GEN_2', 'Female')) v(gender_id, gender)),
  race AS (SELECT 'RACE_' || r_regionkey AS race_id, r_name AS race FROM region),
  blood_pressure AS (SELECT 'BP' || id AS bp_id, 'S' || id AS patient_id, 100e0 + a % 61 AS day_sbp, 60e0 + a % 43 AS day_dbp,
     95e0 + a % 59 AS night_sbp, 55e0 + a % 37 AS night_dbp, (600 + a % 701) / 10e0 AS day_hr,
     (500 + a % 601) / 10e0 AS night_hr FROM cu),
  opthalmology AS (SELECT 'OP' || id AS opthal_id, CAST(a % 4 AS INTEGER) AS diabetic_retinopathy,
     CAST(a % 3 AS INTEGER) AS macular_edema FROM cu),
  walking_test AS (SELECT 'WT' || id AS walktest_id, 'S' || id AS patient_id, CAST(a % 11 AS INTEGER) AS rpe_start,
     CAST(least(a % 13, 10) AS INTEGER) AS rpe_end, 300e0 + a % 301 AS dt_distance, (60 + a % 91) / 100e0 AS dt_speed FROM cu),
  lab_test AS (SELECT 'L' || id AS lab_id, patient_id, CASE WHEN k % 19 <> 0 THEN (20 + k % 113) / 10e0 END AS wbc,
     (35 + k % 29) / 10e0 AS rbc, (100 + k % 83) / 10e0 AS hgb, 30e0 + k % 27 AS hct, 100e0 + k % 431 AS platelets,
     (40 + k % 41) / 10e0 AS hb_a1c, CASE WHEN k % 37 <> 0 THEN 60e0 + k % 90 END AS fasting_glucose,
     CASE WHEN k % 43 <> 0 THEN (10 + k % 311) / 10e0 END AS insulin FROM od),
  lipid_lab_test AS (SELECT 'LP' || id AS lipid_id, patient_id, 120e0 + k % 181 AS fasting_cholesterol,
     60e0 + k % 571 AS fasting_triglyc, CASE WHEN k % 31 <> 0 THEN 20e0 + k % 67 END AS fasting_hdl,
     CASE WHEN k % 23 <> 0 THEN (500 + k % 1601) / 10e0 END AS fasting_ldl FROM od),
  urine_test AS (SELECT 'UR' || id AS urine_id, CASE WHEN k % 29 <> 0 THEN (400 + k % 1001) / 10e0 END AS creatinine,
     (k % 701) / 10e0 AS albumin FROM od),
  visual_motor_cog AS (SELECT 'VM' || id AS vm_id, patient_id, 50e0 + k % 61 AS rcft_ir, 20e0 + k % 53 AS tm,
     0e0 + k % 6 AS clock FROM od),
  verbal_cognitive AS (SELECT 'VC' || id AS vc_id, patient_id, 8e0 + k % 17 AS ds, 8e0 + k % 19 AS hvlt,
     25e0 + k % 41 AS vf, 10e0 + k % 31 AS wtar FROM od),
  memory_cognitive AS (SELECT 'MC' || id AS mc_id, 0e0 + k % 22 AS gds, 8e0 + k % 17 AS iadl, 15e0 + k % 16 AS mmse,
     5e0 + k % 20 AS bads FROM od),
  lab_visit AS (SELECT 'LB' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS lab_visit_id, {_sql_list(LABS)}[k % 4 + 1] AS lab_name,
     o_orderdate + to_seconds(k % 86399) AS lab_visit_date FROM vi),
  link_reference AS (SELECT 'LR' || patient_id[2:] AS link_reference_id, 'LP' || id AS lipid_id, 'L' || id AS lab_id,
     'LB' || id AS lab_visit_id, 'UR' || id AS urine_id, 'VM' || id AS vm_id, 'VC' || id AS vc_id, 'MC' || id AS mc_id FROM od)
"""
