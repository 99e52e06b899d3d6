"""The fifteen tables of the study and the ways they are linked."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    pairs = [field.split(":") for field in text.split()]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "patients": _schema(
        "patient_id:string firstname:string lastname:string age:int height:double bmi:double diabetes_duration:int "
        "visit_date:timestamp group_id:string gender_id:string race_id:string bp_id:string opthal_id:string "
        "walktest_id:string link_reference_id:string"
    ),
    "group": _schema("group_id:string group:string"),
    "gender": _schema("gender_id:string gender:string"),
    "race": _schema("race_id:string race:string"),
    "blood_pressure": _schema(
        "bp_id:string patient_id:string day_sbp:double day_dbp:double night_sbp:double night_dbp:double "
        "day_hr:double night_hr:double"
    ),
    "lab_test": _schema(
        "lab_id:string patient_id:string wbc:double rbc:double hgb:double hct:double platelets:double "
        "hb_a1c:double fasting_glucose:double insulin:double"
    ),
    "lipid_lab_test": _schema(
        "lipid_id:string patient_id:string fasting_cholesterol:double fasting_triglyc:double fasting_hdl:double "
        "fasting_ldl:double"
    ),
    "urine_test": _schema("urine_id:string creatinine:double albumin:double"),
    "walking_test": _schema(
        "walktest_id:string patient_id:string rpe_start:int rpe_end:int dt_distance:double dt_speed:double"
    ),
    "opthalmology": _schema("opthal_id:string diabetic_retinopathy:int macular_edema:int"),
    "visual_motor_cog": _schema("vm_id:string patient_id:string rcft_ir:double tm:double clock:double"),
    "verbal_cognitive": _schema("vc_id:string patient_id:string ds:double hvlt:double vf:double wtar:double"),
    "memory_cognitive": _schema("mc_id:string gds:double iadl:double mmse:double bads:double"),
    "lab_visit": _schema("lab_visit_id:string lab_name:string lab_visit_date:timestamp"),
    "link_reference": _schema(
        "link_reference_id:string lipid_id:string lab_id:string lab_visit_id:string urine_id:string vm_id:string "
        "vc_id:string mc_id:string"
    ),
}

DIMENSIONS = {"group": "group_id", "gender": "gender_id", "race": "race_id"}
EXAMS = {"blood_pressure": "bp_id", "opthalmology": "opthal_id", "walking_test": "walktest_id"}
LINKED = {
    "lipid_lab_test": "lipid_id", "lab_test": "lab_id", "lab_visit": "lab_visit_id", "urine_test": "urine_id",
    "visual_motor_cog": "vm_id", "verbal_cognitive": "vc_id", "memory_cognitive": "mc_id",
}


class Study:
    """The tables by name, and joins along the keys that connect them.

    All joins are inner equi-joins without hints: the dimensions have a handful of rows and are
    broadcast by their size, everything else is shuffled on its key when it is large. A table may
    be given as a function, which is called when the table is first used.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        missing = set(SCHEMAS) - set(tables)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._tables = dict(tables)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Study:
        """The study stored as one Parquet table per name; the declared schemas are expected."""

        def stored(name: str) -> DataFrame:
            return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

        return cls({name: functools.partial(stored, name) for name in SCHEMAS})

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self[name]

    @property
    def spark(self) -> SparkSession:
        return self.patients.sparkSession

    def people(self, *dimensions: str) -> DataFrame:
        """Patients with the names of the dimensions asked for."""
        return self.described(self.patients, *dimensions)

    def described(self, people: DataFrame, *dimensions: str) -> DataFrame:
        for name in dimensions:
            people = people.join(self[name], DIMENSIONS[name])
        return people

    def examined(self, *exams: str, people: DataFrame | None = None) -> DataFrame:
        """Patients with the exams their own row points to."""
        result = self.patients if people is None else people
        for name in exams:
            result = result.join(self[name].drop("patient_id"), EXAMS[name])
        return result

    def linked(self, *tables: str, people: DataFrame | None = None, people_last: bool = False) -> DataFrame:
        """Patients with the tables reached through their link row.

        ``people_last`` is for all patients with many columns: these are then not shuffled again for each table. A
        few patients are better joined first, as they leave few link rows.
        """
        people = self.patients if people is None else people
        if people_last:
            return self.link_chain(*tables).join(people, "link_reference_id")
        result = people.join(self.link_reference, "link_reference_id")
        for name in tables:
            result = result.join(self[name].drop("patient_id"), LINKED[name])
        return result

    def tested(self, *tables: str, people: DataFrame | None = None) -> DataFrame:
        """Patients with tables that carry the patient's id themselves."""
        result = self.patients if people is None else people
        for name in tables:
            own_key = EXAMS.get(name) or LINKED[name]
            measures = self[name].drop(own_key) if own_key in result.columns else self[name]
            result = result.join(measures, "patient_id")
        return result

    def newest(self, name: str) -> DataFrame:
        """One row per patient of a table that carries the patient's id: that of the largest test number."""
        table = self[name]
        rest = [c for c in table.columns if c != "patient_id"]
        own_key = EXAMS.get(name) or LINKED[name]
        kept = table.groupBy("patient_id").agg(F.max_by(F.struct(*rest), own_key).alias("__row"))
        return kept.select("patient_id", *[F.col(f"__row.{c}").alias(c) for c in rest])

    def newest_link(self) -> DataFrame:
        """One link row per patient: that of the largest visit number."""
        rest = [c for c in self.link_reference.columns if c != "link_reference_id"]
        kept = self.link_reference.groupBy("link_reference_id").agg(F.max_by(F.struct(*rest), "lab_visit_id").alias("__row"))
        return kept.select("link_reference_id", *[F.col(f"__row.{c}").alias(c) for c in rest])

    def link_chain(self, *tables: str) -> DataFrame:
        """Tables joined through the link table alone, without the patients."""
        result = self.link_reference
        for name in tables:
            result = result.join(self[name].drop("patient_id"), LINKED[name])
        return result
