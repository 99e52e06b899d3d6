"""Questions about the patients themselves: names, ages, groups, size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import functions as fn
from cohortry.operators import aggregates as agg
from cohortry.operators import joins, ranking
from cohortry.operators.distributions import distribution_wide, share_by
from cohortry.operators.filters import distinct_values
from cohortry.operators.hierarchy import expand_hierarchy
from cohortry.operators.quality import split_valid, text_rules
from cohortry.sources import Snapshot, as_view, new_path, snapshot, union_children
from cohortry.study import limits as lim
from cohortry.study.questions import question
from cohortry.study.tables import Study

NAME = ["patient_id", "firstname", "lastname"]


def name_column() -> Column:
    return fn.full_name("firstname", "lastname")


def members(s: Study, group: str = "DM") -> DataFrame:
    """Patients of one group."""
    return joins.semi(s.patients, s.group.filter(F.col("group") == group), "group_id")


@question("M1")
def random_patients(s: Study, group: str = "DM", n: int = 10, seed: int = 0, digest: str = "xxhash64") -> DataFrame:
    return ranking.sample_n(members(s, group), "patient_id", n, seed, digest=digest)


@question("M2")
def full_names(s: Study, last_prefix: str = "Ma") -> DataFrame:
    return s.patients.filter(F.col("lastname").startswith(last_prefix)).select(name_column().alias("full_name"))


@question("M4")
def birth_year_ranges(s: Study, as_of: Column | None = None) -> DataFrame:
    at = F.current_date() if as_of is None else as_of
    born = F.year(at) - F.col("age")
    return s.patients.select(*NAME, fn.decade_label(born).alias("birth_year_range"))


@question("M7")
def long_diabetes(s: Study, years: int = 10) -> DataFrame:
    return s.people("group").filter(F.col("diabetes_duration") > years).select("patient_id", "group")


@question("M10")
def first_letters(s: Study) -> DataFrame:
    return agg.count_by(s.patients, F.left("firstname", F.lit(1)).alias("first_letter"))


@question("M12")
def user_ids(s: Study, prefix: str = "UID", factor: int = 1000) -> DataFrame:
    return s.patients.select("patient_id", fn.derived_id(fn.id_number("patient_id"), prefix, factor).alias("user_id"))


@question("M13")
def replaced_last_names(s: Study, old: str = "Po", new: str = "Be") -> DataFrame:
    kept = s.patients.filter(F.col("lastname").startswith(old))
    return kept.select(*NAME, F.replace("lastname", F.lit(old), F.lit(new)).alias("new_lastname"))


@question("M14")
def birth_years(s: Study) -> DataFrame:
    rows = s.patients.select(name_column().alias("patient_name"), fn.birth_year("visit_date", "age").alias("birth_year"))
    return rows.orderBy(F.col("birth_year").desc_nulls_first())


@question("M17")
def senior_patients(s: Study, above: int = 70, view: str = "senior_patients") -> DataFrame:
    return as_view(s.patients.filter(F.col("age") > above).select(*NAME, "age"), view)


@question("M18")
def current_ages(s: Study, as_of: Column | None = None) -> DataFrame:
    return s.patients.select("patient_id", fn.age_on("visit_date", "age", as_of).alias("current_age"))


@question("M19")
def salutations(s: Study) -> DataFrame:
    named = fn.prefixed(name_column(), "gender", lim.SALUTATIONS)
    return s.people("gender").select(named.alias("prefixed_name"))


@question("M22")
def names_like(s: Study, pattern: str = "s%r%b%") -> DataFrame:
    joined = s.patients.select(fn.concat_skip_null("firstname", "lastname").alias("full_name"))
    return joined.filter(F.col("full_name").ilike(pattern))


@question("M23")
def race_with_most_diabetics(s: Study) -> DataFrame:
    diabetic = s.patients.filter((F.col("diabetes_duration") != 0) & F.col("race_id").isNotNull())
    return joins.semi(s.race, ranking.largest_group(diabetic, "race_id"), "race_id").select("race")


@question("M27")
def first_names_starting(s: Study, letter: str = "T") -> DataFrame:
    return s.patients.filter(F.col("firstname").ilike(f"{letter}%")).select("firstname", "lastname")


@question("M28")
def tall_heavy_patients(
    s: Study, gender: str = "Male", age: int = 60, bmi: float = 18.5, height: float = 1.5
) -> DataFrame:
    kept = s.patients.filter((F.col("age") > age) & (F.col("bmi") > bmi) & (F.col("height") > height))
    return s.described(kept, "gender").filter(F.col("gender") == gender).select("firstname", "lastname")


@question("M31")
def name_checks(s: Study, columns: Sequence[str] = ("firstname", "lastname")) -> DataFrame:
    """Rows that would be refused, with the rules they break."""
    return split_valid(s.patients, text_rules(list(columns)))[1].select("patient_id", "broken_rules")


@question("M32")
def running_duration(s: Study, group_id: str = "GRP_02", **plan) -> DataFrame:
    rows = s.patients.filter(F.col("group_id") == group_id).select(*NAME, "group_id", "diabetes_duration")
    result = ranking.running_mean(rows, ["group_id"], ["patient_id"], "diabetes_duration", name="moving_average", **plan)
    return result.drop("group_id")


@question("M33")
def born_in(s: Study, year: int = 1939, path: str | None = None) -> DataFrame:
    """Stores the demographic table and returns it."""
    kept = s.people("gender", "race").withColumn("birth_year", fn.birth_year("visit_date", "age"))
    kept = kept.filter(F.col("birth_year") == year)
    rows = kept.select(*NAME, "gender", "race", "age", "height", "bmi", "birth_year")
    return snapshot(rows, path or new_path(s.spark, "patient_detail"))


@question("M43")
def patients_named(s: Study, firstname: str = "Gabriel") -> DataFrame:
    return s.patients.filter(F.col("firstname") == firstname).select(*NAME, "age")


@question("M45")
def id_parity(s: Study) -> DataFrame:
    number = fn.id_number("patient_id")
    even = number % 2 == 0
    return s.patients.select(
        number.alias("pat_id"),
        F.when(even, "true").otherwise("false").alias("even"),
        F.when(even, "false").otherwise("true").alias("odd"),
    )


@question("M47")
def name_positions(s: Study, part: str = "an") -> DataFrame:
    kept = s.patients.filter(F.col("lastname").contains(part))
    return kept.select("patient_id", "lastname", F.instr("lastname", part).alias("position"))


@question("M48")
def patient_page(s: Study, offset: int = 29, n: int = 11) -> DataFrame:
    return ranking.page(s.patients.select(*NAME), ["patient_id"], offset, n)


@question("M50")
def gender_snapshot(s: Study, path: str | None = None) -> Snapshot:
    """A stored count per gender; create_empty() first, refresh() when wanted."""
    def build() -> DataFrame:
        return s.people("gender").groupBy("gender").agg(F.count("gender").alias("n"))

    return Snapshot(s.spark, path or new_path(s.spark, "gender"), build)


@question("M53")
def leap_year_births(s: Study, gregorian: bool = True) -> DataFrame:
    born = fn.birth_year("visit_date", "age")
    return s.patients.agg(F.count_if(fn.is_leap_birth(born, gregorian=gregorian)).alias("n"))


@question("M54")
def group_over_age(s: Study, group: str = "DM", age: int = 60) -> DataFrame:
    kept = members(s, group).filter(F.col("age") > age)
    return agg.sorted_by(kept.select("patient_id", "age"), "age")


@question("M56")
def races_known(s: Study, names: DataFrame) -> DataFrame:
    """For a table with a column ``race``: whether the study has each of them."""
    return joins.membership(names, s.race, "race")


@question("M58")
def patients_per_race(s: Study) -> DataFrame:
    # Counted by key, then named: the join sees one row per race.
    counts = agg.count_by(s.patients, "race_id")
    return agg.sorted_by(counts.join(s.race, "race_id").groupBy("race").agg(F.sum("n").alias("n")), "race")


@question("M59")
def with_children(s: Study, child: DataFrame | None = None) -> DataFrame:
    """Patients together with a table that extends them; its further columns are not shown."""
    return s.patients if child is None else union_children(s.patients, child)


@question("M61", "A49", "A54")
def age_bins(s: Study) -> DataFrame:
    counts = agg.count_by(
        s.patients, fn.bucket_number("age", 0, 100, 20).alias("bucket"),
        fn.bucket_label("age", 0, 100, 20).alias("age_range"),
    )
    return agg.sorted_by(counts, "bucket").select("age_range", "n")


CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.IntegerType(), False), T.StructField("customer_name", T.StringType(), False),
    T.StructField("address", T.StringType()), T.StructField("place", T.StringType()),
])


@question("M65")
def customer_view(s: Study, rows: DataFrame | Sequence[tuple], view: str = "customer_view") -> DataFrame:
    """A table of its own schema, filled from a table or typed-in rows and named as a view."""
    from cohortry.sources import append

    path = new_path(s.spark, "customers")
    given = rows if isinstance(rows, DataFrame) else s.spark.createDataFrame(list(rows), CUSTOMERS)
    append(given.select(*[F.col(f.name).cast(f.dataType) for f in CUSTOMERS.fields]), path)
    return as_view(s.spark.read.schema(CUSTOMERS).parquet(path), view)


@question("M66")
def same_last_name(s: Study) -> DataFrame:
    found = joins.exists_other(s.patients, ["lastname"], "patient_id")
    return agg.sorted_by(found.select("firstname", "lastname"), "lastname")


@question("M67")
def total_duration(s: Study, group_id: str = "GRP_02") -> DataFrame:
    return s.patients.filter(F.col("group_id") == group_id).agg(F.sum("diabetes_duration").alias("total"))


@question("M76")
def name_lengths(s: Study) -> DataFrame:
    return s.patients.select(name_column().alias("full_name"), (F.length(name_column()) + 1).alias("length_plus"))


@question("M80")
def reachable(s: Study, seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything reached from the seeds along parent/child edges."""
    return expand_hierarchy(seeds, edges, max_depth=max_depth)


@question("A2")
def gender_percentages(s: Study) -> DataFrame:
    classes = {"male": F.col("gender") == "Male", "female": F.col("gender") == "Female"}
    return distribution_wide(s.people("gender"), classes)


@question("A17", "A32")
def group_members_per_gender(s: Study, group: str = "DM") -> DataFrame:
    return agg.count_by(s.described(members(s, group), "gender"), "gender")


@question("A20")
def distinct_patients_per_race(s: Study) -> DataFrame:
    return agg.count_distinct(s.people("race"), ["race"], "patient_id")


@question("A21")
def names_and_race(s: Study, chunk_rows: int = 100_000) -> DataFrame:
    rows = s.people("race").select("patient_id", fn.concat_null(name_column(), F.lit(" "), "race").alias("name_race"))
    result = agg.values_by(rows, ["patient_id"], "name_race", name="names", chunk_rows=chunk_rows)
    return agg.sorted_by(result, "patient_id")


@question("A23")
def name_starts(s: Study, length: int = 5) -> DataFrame:
    return s.patients.select("patient_id", F.lower(F.left("firstname", F.lit(length))).alias("name_start"))


@question("A25")
def walk_ranks(s: Study) -> DataFrame:
    rows = s.patients.select("patient_id", "group_id", "opthal_id", "walktest_id")
    return ranking.dense_rank_by(rows, ["opthal_id"], "walktest_id", name="walk_rank").drop("walktest_id")


@question("A27")
def race_percentages(s: Study) -> DataFrame:
    shares = share_by(s.patients, ["race_id"], total=s.patients, digits=2)
    return agg.sorted_by(shares.join(s.race, "race_id").select("race", "n", "percentage"), "race")


@question("A28")
def patients_per_race_key(s: Study) -> DataFrame:
    return agg.count_by(s.patients, "race_id").join(s.race, "race_id").select("race_id", "race", "n")


def _bmi_class() -> Column:
    return fn.band("bmi", lim.BMI)


@question("A42")
def bmi_classes(s: Study) -> DataFrame:
    return agg.count_by(s.patients, _bmi_class().alias("bmi_class"))


@question("A43")
def overweight_in_group(s: Study, group: str = "DM", bmi: float = 24.9) -> DataFrame:
    return members(s, group).filter(F.col("bmi") > bmi).agg(F.count(F.lit(1)).alias("n"))


@question("A44")
def overweight_per_gender(s: Study, bmi: float = 24.9) -> DataFrame:
    return agg.count_by(s.described(s.patients.filter(F.col("bmi") > bmi), "gender"), "gender")


@question("A46")
def overweight_per_race(s: Study, bmi: float = 24.9) -> DataFrame:
    return agg.count_by(s.described(s.patients.filter(F.col("bmi") > bmi), "race"), "race")


@question("A57")
def null_values(s: Study, table: str = "patients") -> DataFrame:
    return agg.null_profile(s[table])


@question("A63")
def members_without_duration(s: Study, group: str = "DM") -> DataFrame:
    return members(s, group).filter(F.col("diabetes_duration") == 0).select("patient_id")


@question("A69")
def ages_by_parity(s: Study, odd: bool = True) -> DataFrame:
    parity = F.col("age") % 2
    kept = s.patients.filter(parity != 0 if odd else parity == 0)
    return kept.select(fn.concat_null("firstname", F.lit(" "), "lastname").alias("full_name"), "age")


@question("A72")
def patients_aged(s: Study, age: int = 61) -> DataFrame:
    return s.patients.filter(F.col("age") == age)


@question("A75")
def weights(s: Study) -> DataFrame:
    return s.patients.select("height", "bmi", fn.weight_from_bmi("bmi", "height").alias("weight"))


@question("A78")
def heights_in_feet(s: Study) -> DataFrame:
    text = fn.feet_and_inches("height", lim.FEET_PER_METRE)
    return s.patients.select("patient_id", "height", text.alias("height_in_feet"))


@question("A80")
def distinct_races(s: Study) -> DataFrame:
    return agg.count_distinct(s.race, [], "race")


@question("A81")
def distinct_first_names(s: Study) -> DataFrame:
    return agg.count_distinct(s.patients, [], "firstname")


@question("A82")
def repeated_first_names(s: Study) -> DataFrame:
    return joins.shared_values(s.patients, "firstname").select("patient_id", "firstname")


@question("A84")
def distinct_last_names(s: Study) -> DataFrame:
    return agg.count_distinct(s.patients, [], "lastname")


@question("A85")
def upper_case_names(s: Study) -> DataFrame:
    return s.patients.select("patient_id", F.upper(name_column()).alias("full_name"))


@question("A93")
def mean_bmi_per_group(s: Study) -> DataFrame:
    return s.people("group").groupBy("group").agg(fn.decimal_mean("bmi").alias("mean_bmi"))


@question("A110")
def ids_containing(s: Study, text: str = "2") -> DataFrame:
    return s.patients.filter(F.col("patient_id").contains(text)).select("patient_id")


@question("A114")
def bmi_ranks(s: Study) -> DataFrame:
    rows = s.patients.select("patient_id", "height", "bmi")
    return ranking.dense_rank_global(rows, "bmi", descending=True, name="bmi_rank")


@question("A115")
def ages_per_height(s: Study, chunk_rows: int = 100_000) -> DataFrame:
    return agg.values_by(s.patients, ["height"], "age", ["age", "patient_id"], name="ages", chunk_rows=chunk_rows)


@question("A122")
def heavy_patients(s: Study, bmi: float = 24.9) -> DataFrame:
    return s.patients.filter(F.col("bmi") > bmi).select("patient_id", "age", "bmi")


def distinct_names(df: DataFrame) -> DataFrame:
    return distinct_values(df.select(name_column().alias("patient")), "patient")
