"""Clinical limits and labels. These are fixed values: results are right only with exactly these."""

from __future__ import annotations

from cohortry.functions.bands import Band, at_least, below, between


def above(label: str, lo: float) -> Band:
    return at_least(label, lo, inclusive=False)


EXERTION = [
    between("Rest", 0, 0), between("EASY INTENSITY", 1, 3), between("MODERATE INTENSITY", 4, 6),
    between("HARD INTENSITY", 7, 9), between("MAX EFFORT INTENSITY", 10, 10),
]
GLUCOSE = [
    below("Hypoglycemia", 70), between("Normal", 70, 100), between("Prediabetic", 100, 120, "right"),
    above("Diabetic", 120),
]
GLUCOSE_RECORD = [
    below("Hypoglycemia", 70, inclusive=True), between("Normal", 70, 100, "right"),
    between("Pre_Diabetic", 100, 120, "right"), above("Diabetic", 120),
]
INSULIN = [below("Low Insulin", 2.6), between("Normal Insulin", 2.6, 24.9), above("High Insulin", 24.9)]
WHITE_CELLS = [below("LEUKOPENIA", 4.5), between("NORMAL", 4.5, 11), above("LEUKOCYTOSIS", 11)]
PLATELETS = [between("Normal", 150, 450)]
BMI = [
    below("Underweight", 18.5), between("Normal", 18.5, 25, "left"), between("Overweight", 25, 30, "left"),
    at_least("Obese", 30),
]
CHOLESTEROL = [below("Desirable", 200), between("Borderline", 200, 240, "left"), at_least("High Risk", 240)]
# Half-open, so that values between whole numbers and the value 100 itself have a class.
LDL = [
    below("Optimal", 100), between("Near Optimal", 100, 130, "left"), between("Borderline High", 130, 160, "left"),
    between("High", 160, 190, "left"), at_least("Very High", 190),
]
TRIGLYCERIDES = [
    below("Normal", 150), between("Borderline", 150, 200, "left"), between("High", 200, 500, "left"),
    at_least("Very High", 500),
]
# 11 belongs to no class in the published limits; band_gaps() reports it.
BADS = [
    below("IMPAIRED", 11), between("BORDERLINE", 12, 13), between("LOW AVERAGE", 14, 15), between("AVERAGE", 16, 20),
    between("HIGH AVERAGE", 21, 22), between("SUPERIOR", 23, 24),
]
HVLT = [below("DEMENTIA", 14), between("MILD DEMENTIA", 14, 19)]
ALBUMIN = [below("Normal Albumin", 30), at_least("Abnormal Albumin", 30)]
PRESSURE = [below("Low", 70), between("Normal", 70, 100)]
CHOLESTEROL_AGES = [
    below("50-55", 55, inclusive=True), below("56-60", 60, inclusive=True), below("61-65", 65, inclusive=True),
    below("66-70", 70, inclusive=True), above("70+", 70),
]
GLUCOSE_AGES = [between("51-55", 51, 55), between("56-60", 56, 60), between("61-65", 61, 65), between("66-70", 66, 70)]

HEMATOCRIT_BY_GENDER = {
    "Male": [below("ANEMIA", 41), between("NORMAL", 41, 50), above("High Hematocrit", 50)],
    "Female": [below("ANEMIA", 36), between("NORMAL", 36, 48), above("High Hematocrit", 48)],
}
GAIT_SPEED_BY_GENDER = {
    "Male": [below("LOW", 1.08), at_least("NORMAL", 1.08)], "Female": [below("LOW", 0.92), at_least("NORMAL", 0.92)],
}
CREATININE_BY_GENDER = {"Male": (65.4, 119.3), "Female": (52.2, 91.9)}
HEMOGLOBIN_BY_GENDER = {"Male": (13.2, 16.6), "Female": (11.5, 15.0)}
ANEMIA_BELOW = {"Male": 13.2, "Female": 11.6}
CREATININE_RATIO_ABOVE = {"Male": 17.0, "Female": 25.0}
ALBUMIN_RANGE = (3.4, 5.4)
FEET_PER_METRE = 3.28084
SALUTATIONS = {"Male": "Mr. ", "Female": "Ms. "}

# (column, comparison, limit) of the tests that count as impaired.
VISUAL_MOTOR_TESTS = {"RCFT": ("rcft_ir", "<=", 71), "TM": ("tm", ">=", 42), "Clock": ("clock", "<=", 2), "GDS": ("gds", ">=", 15)}
VERBAL_TESTS = {
    "DS": ("ds", "<=", 13), "HVLT": ("hvlt", "<=", 14), "VF": ("vf", "<=", 42), "WTAR": ("wtar", "<=", 20),
    "GDS": ("gds", ">=", 15),
}
DEMENTIA_TESTS = {
    "IADL": ("iadl", "<=", 14), "MMSE": ("mmse", "<=", 23), "GDS": ("gds", ">=", 15), "RCFT_IR": ("rcft_ir", "<=", 71),
    "TM": ("tm", ">=", 42), "Clock": ("clock", "<=", 2), "DS": ("ds", "<", 13), "HVLT": ("hvlt", "<", 19),
    "VF": ("vf", "<", 42), "WTAR": ("wtar", "<=", 20),
}
SUGAR_DEMENTIA_TESTS = {"RCFT_IR": ("rcft_ir", ">", 71), "TM": ("tm", ">", 42), "Clock": ("clock", "<=", 2), "GDS": ("gds", ">=", 15)}
LAB_ALERT = {"hb_a1c": 5.7, "fasting_glucose": 100}
HEART_RATE_ALERT_DAY, HEART_RATE_ALERT_NIGHT = 120, 100
