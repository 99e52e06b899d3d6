"""Questions of the study on a few typed-in patients, with typed-in answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortry.functions import band_gaps
from cohortry.sources import new_path
from cohortry.streaming import run_to_table
from cohortry.study import QUESTIONS, SCHEMAS, Study, ask
from cohortry.study import limits as lim
from cohortry.study.questions import numbers
from tests.helpers import plan, values


def at(text):
    return dt.datetime.fromisoformat(text)


def patient(i, first, last, age, height, bmi, years, visit, group, gender, race):
    return (f"S{i:04}", first, last, age, height, bmi, years, at(visit), group, gender, race, f"B{i}", f"O{i}", f"W{i}", f"LR{i}")


ROWS = {
    "patients": [
        patient(1, "Tom", "Martin", 61, 1.75, 24.9, 12, "2005-03-01 09:00:00", "GRP_02", "M", "R1"),
        patient(2, "Sara", "Porter", 55, 1.6, 25.0, 0, "2006-03-31 23:59:59", "GRP_01", "F", "R2"),
        patient(3, "Bob", "Martin", 70, 1.75, 30.0, 5, "2006-04-01 00:00:00", "GRP_02", "M", "R1"),
        patient(4, None, "Pohl", 72, 1.5, 18.4, 0, "2005-03-05 12:59:59", "GRP_02", "F", "R1"),
        patient(12, "tia", "Anand", None, None, None, None, "2004-12-31 13:00:00", "GRP_01", "F", "R3"),
    ],
    "group": [("GRP_01", "Control"), ("GRP_02", "DM")],
    "gender": [("M", "Male"), ("F", "Female")],
    "race": [("R1", "White"), ("R2", "Black"), ("R3", "Asian")],
    "blood_pressure": [
        ("B1", "S0001", 120.0, 80.0, 110.0, 70.0, 125.0, 80.5), ("B2", "S0002", 136.0, 86.0, 100.0, 60.0, 70.0, 60.25),
        ("B3", "S0003", 150.0, 95.0, 140.0, 90.0, 110.0, 101.0), ("B4", "S0004", 90.0, 50.0, 90.0, 55.0, 120.0, 100.0),
    ],
    "lab_test": [
        ("L1", "S0001", 2.9, 4.0, 13.1, 40.9, 150.0, 6.6, 121.0, 2.5), ("L2", "S0002", 4.5, 4.0, 11.6, 36.0, 451.0, 5.7, 100.0, 24.9),
        ("L3", "S0003", 11.1, 4.0, 15.1, 50.1, 200.0, 5.8, 110.0, 25.0), ("L4", "S0004", None, 4.0, 11.5, 48.1, 149.0, None, None, None),
        ("L9", "S0099", 5.0, 4.0, 14.0, 45.0, 300.0, 5.0, 80.0, 10.0),
    ],
    "lipid_lab_test": [
        ("P1", "S0001", 199.0, 151.0, 45.0, 131.0), ("P2", "S0002", 200.0, 150.0, 41.0, 100.0),
        ("P3", "S0003", 241.5, 499.5, 40.0, 129.5), ("P4", "S0004", None, 149.0, 60.0, None),
    ],
    "urine_test": [("U1", 120.0, 4.0), ("U2", 60.0, 0.0), ("U3", 65.4, 30.0), ("U4", None, 5.0)],
    "walking_test": [
        ("W1", "S0001", 4, 6, 401.0, 1.08), ("W2", "S0002", 6, 4, 400.0, 0.91), ("W3", "S0003", 3, 10, 350.0, 1.5),
        ("W4", "S0004", 0, 0, 350.0, 0.92),
    ],
    "opthalmology": [("O1", 0, 0), ("O2", 2, 0), ("O3", 3, 1), ("O4", 3, 0)],
    "visual_motor_cog": [
        ("V1", "S0001", 71.0, 42.0, 3.0), ("V2", "S0002", 72.0, 41.0, 2.0), ("V3", "S0003", 72.0, 41.0, 3.0), ("V8", "S0098", 10.0, 50.0, 1.0),
    ],
    "verbal_cognitive": [
        ("C1", "S0001", 13.0, 14.0, 43.0, 21.0), ("C2", "S0002", 14.0, 19.0, 42.0, 20.0), ("C3", "S0003", 20.0, 25.0, 50.0, 30.0),
    ],
    "memory_cognitive": [("M1", 15.0, 20.0, 30.0, 10.0), ("M2", 0.0, 20.0, 30.0, 11.0), ("M3", 14.0, 20.0, 30.0, 24.0), ("M4", 16.0, 20.0, 30.0, 16.0)],
    "lab_visit": [
        ("LB001", "Genesis Lab", at("2005-02-03 09:00:00")), ("LB002", "gen x lab", at("2006-02-28 12:59:59")),
        ("LB003", "Cultivate Lab", at("2005-02-03 13:00:00")), ("LB004", "Genesis Lab", at("2005-01-01 08:59:59")),
    ],
    "link_reference": [
        ("LR1", "P1", "L1", "LB001", "U1", "V1", "C1", "M1"), ("LR2", "P2", "L2", "LB002", "U2", "V2", "C2", "M2"),
        ("LR3", "P3", "L3", "LB003", "U3", "V3", "C3", "M3"), ("LR4", "P4", "L4", "LB004", "U4", None, None, "M4"),
    ],
}


@pytest.fixture(scope="module")
def study(spark):
    return Study({name: spark.createDataFrame(ROWS[name], schema) for name, schema in SCHEMAS.items()})


ANSWERS = {
    "M2": [("Bob Martin",), ("Tom Martin",)],
    "M3": [("S0001", "Tom", "Martin"), ("S0002", "Sara", "Porter")],
    "M5": [("Bob", "Martin", 340 / 3, 320 / 3)],
    "M6": [("L2", "S0002", 4.5, 451.0), ("L9", "S0099", 5.0, 300.0)],
    "M7": [("S0001", "DM")],
    "M8": [],
    "M10": [(None, 1), ("B", 1), ("S", 1), ("T", 1), ("t", 1)],
    "M11": [("P4", "S0004", None, 149.0, 60.0, None)],
    "M12": [("S0001", "UID1000"), ("S0002", "UID2000"), ("S0003", "UID3000"), ("S0004", "UID4000"), ("S0012", "UID12000")],
    "M13": [("S0002", "Sara", "Porter", "Berter"), ("S0004", None, "Pohl", "Behl")],
    "M14": [("tia Anand", None), (" Pohl", 1933), ("Bob Martin", 1936), ("Sara Porter", 1951), ("Tom Martin", 1944)],
    "M15": [(" Pohl",), ("Bob Martin",), ("Sara Porter",)],
    "M16": [("S0001", "MODERATE INTENSITY"), ("S0002", "MODERATE INTENSITY"), ("S0003", "MAX EFFORT INTENSITY"), ("S0004", "Rest")],
    "M17": [("S0004", None, "Pohl", 72)],
    "M19": [("Mr. Bob Martin",), ("Mr. Tom Martin",), ("Ms.  Pohl",), ("Ms. Sara Porter",), ("Ms. tia Anand",)],
    "M20": [("Tom Martin", 401.0, 1.08)],
    "M23": [("White",)],
    "M24": [("S0001", "Tom", "Martin")],
    "M25": [("Cultivate Lab", 1), ("Genesis Lab", 2)],
    "M26": [("S0002", 200.0, "FEBRUARY", "2006")],
    "M27": [("Tom", "Martin"), ("tia", "Anand")],
    "M28": [("Bob", "Martin"), ("Tom", "Martin")],
    "M29": [(120,)],
    "M30": [(2,)],
    "M31": [("S0001", ["firstname: not lower case", "lastname: not lower case"]), ("S0002", ["firstname: not lower case", "lastname: not lower case"]),
            ("S0003", ["firstname: not lower case", "lastname: not lower case"]), ("S0004", ["lastname: not lower case"]),
            ("S0012", ["lastname: not lower case"])],
    "M32": [("S0001", "Tom", "Martin", 12, 12.0), ("S0003", "Bob", "Martin", 5, 8.5), ("S0004", None, "Pohl", 0, 5.6667)],
    "M34": [("S0001", "Tom", "Martin", "09:00:00 AM", "2005-03-01"), ("S0002", "Sara", "Porter", "11:59:59 PM", "2006-03-31"),
            ("S0003", "Bob", "Martin", "12:00:00 AM", "2006-04-01"), ("S0004", None, "Pohl", "12:59:59 PM", "2005-03-05"),
            ("S0012", "tia", "Anand", "01:00:00 PM", "2004-12-31")],
    "M35": [("April", 1), ("December", 1), ("March", 3)],
    "M36": [("RCFT, TM, GDS", 1)],
    "M37": [("S0099",)],
    "M38": [("S0001", 44.5), ("S0002", 9.75), ("S0003", 9.0), ("S0004", 20.0)],
    "M40": [("S0001", "Tom", "Martin", "DM", 30.0), ("S0003", "Bob", "Martin", "DM", 2.18), ("S0004", None, "Pohl", "DM", None)],
    "M41": [("Female", 1), ("Male", 1)],
    "M42": [("LB001", "Genesis Lab"), ("LB002", "Cultivate Lab"), ("LB003", "Cultivate Lab"), ("LB004", "Genesis Lab")],
    "M45": [(1, "false", "true"), (2, "true", "false"), (3, "false", "true"), (4, "true", "false"), (12, "true", "false")],
    "M46": [("Male", 1)],
    "M47": [("S0012", "Anand", 3)],
    "M49": [(70.0,)],
    "M51": [("Genesis Lab",)],
    "M53": [(2,)],
    "M54": [("S0001", 61), ("S0003", 70), ("S0004", 72)],
    "M55": [(" Pohl", "O4", 3), ("Bob Martin", "O3", 3)],
    "M57": [("S0001", "Tom", "Martin", 61, "Male", "White", "DM", 151.0), ("S0003", "Bob", "Martin", 70, "Male", "White", "DM", 499.5)],
    "M58": [("Asian", 1), ("Black", 1), ("White", 3)],
    "M60": [("L1", "Abnormal values: hb_a1c, fasting_glucose"), ("L3", "Abnormal values: hb_a1c, fasting_glucose")],
    "M61": [(None, 1), ("55 - 59", 1), ("60 - 64", 1), ("70 - 74", 2)],
    "M62": [("GRP_02", 2)],
    "M63": [("B1", "Abnormal Heart Rate: day_hr"), ("B3", "Abnormal Heart Rate: night_hr")],
    "M64": [("RPE_END>START", 2), ("RPE_START>END", 1)],
    "M66": [("Bob", "Martin"), ("Tom", "Martin")],
    "M67": [(17,)],
    "M68": [("Bob Martin",)],
    "M69": [("Bob", "Martin", 1.5)],
    "M70": [("Cultivate Lab", 25.0), ("Genesis Lab", 50.0), ("gen x lab", 25.0)],
    "M71": [("S0001",), ("S0002",)],
    "M72": [("S0001", "Tom", "Martin")],
    "M73": [(3,)],
    "M74": [("Cultivate Lab", 1), ("Genesis Lab", 2), ("gen x lab", 1)],
    "M75": [("Control", "gen x lab", 1), ("DM", "Cultivate Lab", 1), ("DM", "Genesis Lab", 2)],
    "M76": [(" Pohl", 6), ("Bob Martin", 11), ("Sara Porter", 12), ("Tom Martin", 11), ("tia Anand", 10)],
    "M77": [("S0001,DM,White,Male,0,121.0",), ("S0002,Control,Black,Female,2,100.0",), ("S0003,DM,White,Male,3,110.0",), ("S0004,DM,White,Female,3,",)],
    # 121, 100 and 110 all lie in 100-125.
    "M78": [("S0001", "DM", "Prediabetic"), ("S0002", "Control", "Prediabetic"), ("S0003", "DM", "Prediabetic")],
    "M79": [("S0001", 93.33, 83.33), ("S0002", 102.67, 73.33), ("S0003", 113.33, 106.67), ("S0004", 63.33, 66.67)],
    "A1": [("S0001", "Tom Martin", 4, 6), ("S0002", "Sara Porter", 6, 4)],
    "A2": [(40.0, 60.0)],
    "A3": [(0.0, 25.0, 25.0, 25.0)],
    "A4": [(50.0, 0.0)],
    "A5": [(None, 1, 25.0), ("High Insulin", 1, 25.0), ("Low Insulin", 1, 25.0), ("Normal Insulin", 1, 25.0)],
    "A6": [("Male", 1)],
    "A7": [(1, 1, 100.0)],
    "A8": [(2005, "60-70", 1)],
    "A9": [(2005, "60-70", 1)],
    "A10": [(at("2004-12-31 13:00:00"), at("2006-04-01 00:00:00"))],
    "A11": [("Diabetic", 25.0), ("Hypoglycemia", 0.0), ("Normal", 25.0), ("Prediabetic", 25.0)],
    "A13": [("Female", 113.0, 68.0, 95.0, 57.5), ("Male", 135.0, 87.5, 125.0, 80.0)],
    "A14": [("50-55", 200.0), ("61-65", 199.0), ("66-70", 241.5), ("70+", None)],
    "A15": [("S0001", "Genesis Lab"), ("S0002", "gen x lab"), ("S0003", "Cultivate Lab"), ("S0004", "Genesis Lab")],
    "A16": [("61-65", 121.0), ("66-70", 110.0), ("Above 70", None)],
    "A17": [("Female", 1), ("Male", 2)],
    "A18": [("P1", "99"), ("P2", "00"), ("P3", ".5"), ("P4", None)],
    "A19": [(4,)],
    "A20": [("Asian", 1), ("Black", 1), ("White", 3)],
    "A21": [("S0001", 0, ["Tom Martin White"]), ("S0002", 0, ["Sara Porter Black"]), ("S0003", 0, ["Bob Martin White"]),
            ("S0004", 0, [" Pohl White"]), ("S0012", 0, ["tia Anand Asian"])],
    "A22": [("S0012",)],
    "A24": [("Bob Martin", "LR3", 15.1)],
    "A26": [("55-59", 65.13), ("60-64", 102.75), ("70-74", 107.75)],
    "A27": [("Asian", 1, 20.0), ("Black", 1, 20.0), ("White", 3, 60.0)],
    "A33": [("Control", 5.7), ("DM", 6.2)],
    "A34": [("Bob Martin",), ("Sara Porter",)],
    "A35": [(6.2,)],
    "A36": [("Diabetic", 1), ("Normal", 2), ("Prediabetic", 1)],
    "A38": [("LEUKOCYTOSIS", 1), ("LEUKOPENIA", 1), ("NORMAL", 2)],
    "A41": [("Abnormal", 2), ("Normal", 2)],
    "A42": [(None, 1), ("Normal", 1), ("Obese", 1), ("Overweight", 1), ("Underweight", 1)],
    "A43": [(1,)],
    "A44": [("Female", 1), ("Male", 1)],
    "A45": [("Tom Martin",)],
    "A46": [("Black", 1), ("White", 1)],
    "A50": [("S0001", "ANEMIA"), ("S0002", "NORMAL"), ("S0003", "High Hematocrit"), ("S0004", "High Hematocrit")],
    "A51": [("ANEMIA", 1), ("High Hematocrit", 2), ("NORMAL", 1)],
    "A53": [("LOW", 1), ("NORMAL", 3)],
    "A55": [(None, 1), ("High Insulin", 1), ("Low Insulin", 1), ("Normal Insulin", 2)],
    "A61": [(None, 1), ("Normal Insulin", 1)],
    "A63": [("S0004",)],
    "A65": [(None, 1), ("AVERAGE", 1), ("IMPAIRED", 1), ("SUPERIOR", 1)],
    "A66": [("Female", 1), ("Male", 1)],
    "A67": [(2,)],
    "A69": [("Sara Porter", 55), ("Tom Martin", 61)],
    "A70": [("Abnormal Creatinine", 1), ("Normal", 2)],
    "A71": [("Abnormal Albumin", 1), ("Normal Albumin", 2)],
    "A73": [("MILD DEMENTIA", 2), ("NORMAL", 1)],
    "A75": [(None, None, None), (1.5, 18.4, 41.4), (1.6, 25.0, 64.0), (1.75, 24.9, 76.26), (1.75, 30.0, 91.88)],
    "A78": [("S0001", 1.75, "5'8\""), ("S0002", 1.6, "5'2\""), ("S0003", 1.75, "5'8\""), ("S0004", 1.5, "4'11\""), ("S0012", None, None)],
    "A82": [],
    "A83": [(1.0, 1), (2.0, 1), (3.0, 2)],
    "A86": [("Cultivate Lab",), ("Gen X Lab",), ("Genesis Lab",)],
    "A87": [("S0001", 66.83), ("S0002", 66.67), ("S0003", 58.33), ("S0004", 58.33)],
    "A91": [("Bob Martin", 5.8), ("Sara Porter", 5.7), ("Tom Martin", 6.6)],
    "A93": [("Control", 25.0), ("DM", 24.43)],
    "A94": [("Bob Martin",)],
    "A95": [("Female", 100.0), ("Male", 130.25)],
    "A96": [(None, 1), ("Borderline High", 1), ("Near Optimal", 2)],
    "A97": [("Borderline", 2), ("High", 1), ("Normal", 1)],
    "A98": [(1,)],
    "A100": [("Abnormal", 1), ("Normal", 3)],
    "A103": [("Female", "White", 1)],
    "A104": [("Male", "White", 1)],
    "A105": [("2005-02-03", 2)],
    "A106": [("2005-W05", 2)],
    "A108": [("White", "Male", 1)],
    "A109": [("50-54", 1), ("60-64", 1), ("65-69", 0)],
    "A110": [("S0002",), ("S0012",)],
    "A111": [("Male", "White", 1)],
    "A112": [(55, "S0002", 0.91)],
    "A113": [("55 - 59", 0.91), ("60 - 64", 1.08), ("70 - 74", 1.21)],
    "A114": [("S0001", 1.75, 24.9, 3), ("S0002", 1.6, 25.0, 2), ("S0003", 1.75, 30.0, 1), ("S0004", 1.5, 18.4, 4), ("S0012", None, None, 5)],
    "A115": [(1.5, 0, [72]), (1.6, 0, [55]), (1.75, 0, [61, 70])],
    "A116": [("Cultivate Lab", 0, ["S0003"]), ("Genesis Lab", 0, ["S0001", "S0004"]), ("gen x lab", 0, ["S0002"])],
    "A117": [("White", 1)],
    "A118": [("Bob Martin",), ("Sara Porter",), ("Tom Martin",)],
    # HbA1c 5.7 and 5.8 both lie in 5.7-6.4.
    "A119": [("Female", 50.0), ("Male", 50.0)],
    "A120": [(55, "Female", "Black"), (70, "Male", "White"), (72, "Female", "White")],
    "A121": [],
    "A122": [("S0002", 55, 25.0), ("S0003", 70, 30.0)],
    "A123": [("S0001", 6.6)],
    "A124": [("S0001", 2.5)],
    "A125": [(None, None, None, None), (None, None, None, 72), (None, None, 50.0, None), ("S0001", 21.0, 42.0, 61), ("S0002", 20.0, 41.0, 55),
             ("S0003", 30.0, 41.0, 70)],
}
COLUMNS = {
    "M60": ["lab_id", "alert"], "M63": ["bp_id", "alert"], "M42": ["lab_visit_id", "lab_name"], "A15": ["patient_id", "lab_name"],
}


@pytest.mark.parametrize("number", ANSWERS)
def test_answer(study, number):
    got = values(ask(study, number), *COLUMNS.get(number, []))
    assert got == sorted(ANSWERS[number], key=lambda r: [(x is not None, x) for x in r])


def test_as_of(study):
    as_of = F.lit(dt.date(2024, 6, 30))
    ranges = values(ask(study, "M4", as_of=as_of), "patient_id", "birth_year_range")
    assert ranges[0] == ("S0001", "1960-1969") and ranges[-1] == ("S0012", "unknown")
    assert values(ask(study, "M18", as_of=as_of))[:2] == [("S0001", 80), ("S0002", 73)]
    assert len(values(ask(study, "M18"))) == 5


def test_sample_page_and_names(study):
    assert ask(study, "M1", n=2).count() == 2
    assert {r.group_id for r in ask(study, "M1").collect()} == {"GRP_02"}
    assert values(ask(study, "M48", offset=1, n=2), "patient_id") == [("S0002",), ("S0003",)]
    assert values(ask(study, "M43", firstname="Tom"), "patient_id") == [("S0001",)]
    assert values(ask(study, "M22", pattern="t%MAR%"), "full_name") == [("TomMartin",)]
    assert values(ask(study, "A23"), "name_start")[0] == (None,)


def test_stored_tables(spark, study):
    assert values(ask(study, "M33", year=1944), "patient_id", "gender", "race", "birth_year") == [("S0001", "Male", "White", 1944)]
    stored = ask(study, "M50")
    assert values(stored.create_empty()) == []
    assert values(stored.refresh()) == [("Female", 3), ("Male", 2)]
    customers = ask(study, "M65", rows=[(1, "NICK", "ADDRESS2", "USA")])
    assert values(customers) == [(1, "NICK", "ADDRESS2", "USA")]
    assert spark.sql("SELECT place FROM customer_view").first()[0] == "USA"
    child = study.patients.filter("patient_id = 'S0001'").withColumn("ward", F.lit("A"))
    assert ask(study, "M59").count() == 5 and QUESTIONS["with_children"](study, child).count() == 6


def test_known_races(spark, study):
    asked = spark.createDataFrame([("White",), ("Martian",)], "race string")
    assert values(ask(study, "M56", names=asked)) == [("Martian", False), ("White", True)]


def test_reachable(spark, study):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    assert values(ask(study, "M80", seeds=spark.createDataFrame([("a",)], "node string"), edges=edges)) == [("a", 0), ("b", 1), ("c", 2)]


def test_not_in_versus_anti(spark, study):
    tables = {name: study[name] for name in SCHEMAS}
    unknown = spark.createDataFrame([("LX", None)], "lab_id string, patient_id string")
    tables["lab_test"] = study.lab_test.unionByName(unknown, allowMissingColumns=True)
    holed = Study(tables)
    assert values(ask(holed, "A22")) == []
    assert values(ask(holed, "A22", null_aware=False)) == [("S0012",)]


def test_alert_on_added_rows(spark, study):
    row = spark.createDataFrame([("LB079", None, 6.0, 120.0)], "lab_id string, patient_id string, hb_a1c double, fasting_glucose double")
    assert ask(study, "M60", rows=row).count() == 1
    base = new_path(spark, "alerts")
    study.lab_test.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(study.lab_test.schema).parquet(f"{base}/in")
    alerts = run_to_table(ask(study, "M60", rows=arriving), f"{base}/out", f"{base}/checkpoint")
    assert values(alerts, "lab_id") == [("L1",), ("L3",)]
    rates = spark.createDataFrame([("BP079", "S0612", 125.0, 105.0)], "bp_id string, patient_id string, day_hr double, night_hr double")
    assert values(ask(study, "M63", rows=rates), "alert") == [("Abnormal Heart Rate: day_hr, night_hr",)]


def test_wide_records(study):
    record = ask(study, "A62")
    rows = {r.patient_id: r for r in record.collect()}
    assert set(rows) == {"S0001", "S0002", "S0003"}
    one = rows["S0001"]
    assert (one.full_name, one.group, one["map"], one.eye_damage) == ("Tom Martin", "Diabetic", "Normal", "No")
    assert (one.cholesterol, one.insulin, one.lipid) == ("High", "Diabetic", "A.Creat")
    assert one.dementia == "GDS,RCFT_IR,TM,HVLT"
    assert (rows["S0002"].dementia, rows["S0002"].lipid, rows["S0002"].eye_damage) == ("Clock,WTAR", "A.Alb", "Diabetic_Retinopathy")
    assert (rows["S0003"].dementia, rows["S0003"].lipid, rows["S0003"].eye_damage) == ("", "A.Alb", "Macular_Edema")
    assert rows["S0003"]["map"] == "High"
    assert values(ask(study, "A64", patient_id="S0002"), "full_name", "insulin") == [("Sara Porter", "Normal")]
    numeric = values(ask(study, "A101"))
    assert [r[0] for r in numeric] == ["S0001", "S0002", "S0003"]
    assert numeric[0][2:] == (61, 24.9, "Male", "White", 120.0, 80.0, 125.0, 121.0, 199.0, 0, 15.0, 3.0, 4.0, 13.0, 401.0)


def test_filter_on_the_wide_record_reaches_the_patients(spark, study):
    base = new_path(spark, "study")
    for name in SCHEMAS:
        study[name].write.parquet(f"{base}/{name}.parquet")
    stored = Study.read(spark, base)
    text = plan(ask(stored, "A64", patient_id="S0001"))
    assert "EqualTo(patient_id,S0001)" in text
    assert "fasting_hdl" not in text and "rbc" not in text


def test_null_profile_and_dumps(study):
    nulls = dict(values(ask(study, "A57"), "column_name", "nulls"))
    assert (nulls["firstname"], nulls["age"], nulls["patient_id"]) == (1, 1, 0)
    assert ask(study, "A30").count() == 4 and ask(study, "A31").count() == 5
    assert ask(study, "A72").count() == 1


def test_gaps_in_the_limits():
    assert band_gaps(lim.LDL) == [] and band_gaps(lim.BMI) == [] and band_gaps(lim.TRIGLYCERIDES) == []
    assert (11, 12, "left") in band_gaps(lim.BADS)


def test_every_question_has_an_answer(study):
    needs_input = {"races_known", "customer_view", "reachable", "gender_snapshot"}
    for name, build in QUESTIONS.items():
        if name not in needs_input:
            assert build(study).columns, name
    assert len(numbers()) == 193


def test_incomplete_study(study):
    with pytest.raises(ValueError):
        Study({"patients": study.patients})
    with pytest.raises(AttributeError):
        study.nothing


def test_several_tests_of_a_patient_do_not_multiply(spark, folder):
    from cohortry.reports.registry import Tables
    from cohortry.study.derived import derive

    study = derive(Tables(spark, folder))
    tests = study.lipid_lab_test.groupBy("patient_id").count()
    assert tests.agg(F.max("count")).first()[0] >= 10
    record = ask(study, "numeric_record")
    tested = study.lab_test.select("patient_id").distinct().count()
    assert record.count() == record.select("patient_id").distinct().count() == tested
    scores = ask(study, "test_scores").filter("patient_id IS NOT NULL")
    assert scores.count() == tests.count()
    assert 0 < ask(study, "without_lab_test").count() == study.patients.count() - tested
    chosen = ask(study, "latest_results")
    assert chosen.count() == tested < study.lab_test.count()


def test_one_patient_with_most_tests_is_summed_up_before_the_shuffle(spark, folder):
    from cohortry.reports.registry import Tables
    from cohortry.study.derived import derive

    text = plan(derive(Tables(spark, folder)).newest("lipid_lab_test"))
    assert "partial_max_by" in text


def test_patients_meet_the_finished_link_rows(study):
    tables = ["lab_test", "lab_visit", "urine_test"]
    last, first = (study.linked(*tables, people=study.people("race"), people_last=late) for late in (True, False))
    assert sorted(last.columns) == sorted(first.columns) and values(last, *first.columns) == values(first) and first.count()
    join = ask(study, "patient_info", view=None)._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    links, people = (join.children().apply(k).output().mkString(" ") for k in (0, 1))
    assert "lastname" in people and "lastname" not in links and "wtar" in links
