"""Choosing and classifying patients around an index diagnosis.

Records are (p_id, visit_idx, code_idx, code). Each rule needs two aggregations, visit then patient,
both of which combine on the map side before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.codes import (
    AGE_UNKNOWN,
    COHORT_AGE_PATTERN,
    FEMALE,
    INDEX_CODE,
    LEGACY_AGE_PATTERN,
    MALE,
    SEX_UNKNOWN,
    SINGLE_AGE_PATTERN,
    TARGET_CODES,
    extract_age,
    is_sex,
    is_sex_marker,
)

VISIT = ["p_id", "visit_idx"]

COMPLETE, ONLY_FUTURE, ONLY_PAST, ONE_YEAR, ERRORS = "complete", "only_future", "only_past", "one_year", "errors"
# The cohorts each family is made of.
FAMILIES = {
    "all": (COMPLETE, ONLY_FUTURE, ONLY_PAST, ONE_YEAR, ERRORS),
    "future": (ONLY_FUTURE, COMPLETE),
    "past": (ONLY_PAST, COMPLETE),
    "complete": (COMPLETE,),
    "only_future": (ONLY_FUTURE,),
    "only_past": (ONLY_PAST,),
    "one_year": (ONE_YEAR,),
    "errors": (ERRORS,),
}
KEPT = ("keep", "keep_target")


def visit_flags(
    records: DataFrame,
    index: str = INDEX_CODE,
    targets: Sequence[str] = TARGET_CODES,
    age_pattern: str = COHORT_AGE_PATTERN,
) -> DataFrame:
    """One row per visit with what the rules ask of it. Sex markers count apart from other codes."""
    return records.groupBy(*VISIT).agg(*_flags(index, targets, age_pattern))


def _flags(index: str, targets: Sequence[str], age_pattern: str) -> list[Column]:
    code = F.col("code")
    age = extract_age(code, age_pattern)
    return [
        F.count_if(~is_sex_marker(code) & (code != AGE_UNKNOWN)).alias("n"),
        F.count_if(age.isNotNull()).alias("n_age"),
        F.count_if(code.isin(*targets)).alias("n_target"),
        F.count_if(is_sex(code)).alias("n_sex"),
        F.bool_or(code == index).alias("has_index"),
        F.bool_or(code == AGE_UNKNOWN).alias("marked_unknown"),
        F.min(age).alias("min_age"),
    ]


def require_index(flags: DataFrame) -> DataFrame:
    """(p_id, has_index, has_index_with_age): index code anywhere, and together with an age."""
    return flags.groupBy("p_id").agg(
        F.bool_or("has_index").alias("has_index"),
        F.bool_or(F.col("has_index") & (F.col("n_age") > 0)).alias("has_index_with_age"),
    )


def validate_visits(flags: DataFrame) -> DataFrame:
    """Add ``status`` and ``age_unknown`` to visit flags.

    A visit with a target code always stays, without an age it is marked; any other visit needs at
    least two codes, one of them an age and one not. The unknown-age marker stands in for an age, but
    a visit that carries it never counts, whatever its other codes.
    """
    n, n_age = F.col("n"), F.col("n_age")
    has_target = F.col("n_target") > 0
    status = (
        F.when(has_target & (n_age > 0) & ~F.col("marked_unknown"), "keep_target")
        .when(has_target, "keep_age_unknown")
        .when((n == 0) & (F.col("n_sex") > 0), "sex_only")
        .when(F.col("marked_unknown") & (n > n_age), "keep_age_unknown")
        .when(n <= 1, "drop_single")
        .when(n <= n_age, "drop_only_age")
        .when(n_age == 0, "drop_no_age")
        .otherwise("keep")
    )
    return flags.withColumn("status", status).withColumn("age_unknown", F.col("status") == "keep_age_unknown")


def clean_records(
    records: DataFrame,
    index: str = INDEX_CODE,
    targets: Sequence[str] = TARGET_CODES,
    age_pattern: str = COHORT_AGE_PATTERN,
) -> DataFrame:
    """(p_id, visits): the records that the selection leaves, nested.

    The first visit holds the patient's sex code alone, the unknown one for evidence of both or none.
    Then come the kept visits in order, without sex markers; a target visit without an age ends with
    the unknown-age marker. Patients of whom no visit is kept have the sex visit only. Two
    aggregations, no join: a visit's codes and a patient's visits are the groups that the records are
    nested by.
    """
    code = F.col("code")
    coded = F.when(~is_sex_marker(code), F.struct("code_idx", "code"))
    per_visit = validate_visits(
        records.groupBy(*VISIT).agg(
            *_flags(index, targets, age_pattern),
            F.bool_or(code == MALE).alias("is_male"),
            F.bool_or(code == FEMALE).alias("is_female"),
            F.array_sort(F.collect_list(coded)).alias("coded"),
        )
    )
    codes = F.transform("coded", lambda c: c["code"])
    unmarked = (F.col("n_target") > 0) & (F.col("n_age") == 0) & ~F.col("marked_unknown")
    codes = F.when(unmarked, F.concat(codes, F.array(F.lit(AGE_UNKNOWN)))).otherwise(codes)
    visit = F.when(F.col("status").isin(*KEPT, "keep_age_unknown"), F.struct("visit_idx", codes.alias("codes")))
    per_patient = per_visit.groupBy("p_id").agg(
        F.bool_or("is_male").alias("is_male"),
        F.bool_or("is_female").alias("is_female"),
        F.array_sort(F.collect_list(visit)).alias("kept"),
    )
    sex = F.when(F.col("is_male") & ~F.col("is_female"), MALE).when(F.col("is_female") & ~F.col("is_male"), FEMALE).otherwise(SEX_UNKNOWN)
    return per_patient.select("p_id", F.concat(F.array(F.array(sex)), F.transform("kept", lambda v: v["codes"])).alias("visits"))


def require_min_visits(
    validated: DataFrame, minimum: int = 2, sex: DataFrame | None = None, strict_sex_visit: bool = False
) -> DataFrame:
    """(p_id, n_valid) of patients with at least ``minimum`` kept visits of known age.

    ``strict_sex_visit`` counts as the original rules were run: the sex visit of a patient with a
    known sex counts, so a patient of unknown sex (``sex`` = U) needs one more clinical visit.
    """
    counts = (
        validated.where(F.col("status").isin(*KEPT))
        .groupBy("p_id")
        .agg(F.count("*").alias("n_valid"))
    )
    if not strict_sex_visit:
        return counts.where(F.col("n_valid") >= minimum)
    needed = F.when(F.col("sex") == "U", minimum + 1).otherwise(minimum)
    return counts.join(sex, "p_id").where(F.col("n_valid") >= needed).select("p_id", "n_valid")


def cohort_name(index_age: Column, min_age: Column, max_age: Column) -> Column:
    """Where the visits lie around the index age."""
    return (
        F.when(index_age.isNull(), ERRORS)
        .when((max_age > index_age) & (min_age < index_age), COMPLETE)
        .when(max_age > index_age, ONLY_FUTURE)
        .when(min_age < index_age, ONLY_PAST)
        .otherwise(ONE_YEAR)
    )


def classify_cohort(
    records: DataFrame,
    index: str = INDEX_CODE,
    targets: Sequence[str] = TARGET_CODES,
    age_pattern: str = COHORT_AGE_PATTERN,
    minimum: int = 2,
) -> DataFrame:
    """The whole selection on coded records: index with age, valid visits, enough visits, class.

    Patients that fail a rule are absent. Visit flags are used three times from one aggregation.
    """
    validated = validate_visits(visit_flags(records, index, targets, age_pattern))
    valid = F.col("status").isin(*KEPT)
    per_patient = validated.groupBy("p_id").agg(
        F.bool_or(F.col("has_index") & (F.col("n_age") > 0)).alias("has_index_with_age"),
        F.count_if(valid).alias("n_valid"),
        F.min(F.when(valid & F.col("has_index"), F.col("min_age"))).alias("first_index_age"),
        F.min(F.when(valid, F.col("min_age"))).alias("min_age"),
        F.max(F.when(valid, F.col("min_age"))).alias("max_age"),
    )
    return per_patient.where(F.col("has_index_with_age") & (F.col("n_valid") >= minimum)).select(
        "p_id",
        "first_index_age",
        "min_age",
        "max_age",
        cohort_name(F.col("first_index_age"), F.col("min_age"), F.col("max_age")).alias("cohort"),
    )


def classify_diagnoses(dx: DataFrame, index: str) -> DataFrame:
    """Cohort per patient when every visit already has one age: dx is (p_id, visit_idx, age, code).

    The smallest age of a visit is its age, so one aggregation over the rows is enough.
    """
    return (
        dx.groupBy("p_id")
        .agg(
            F.min(F.when(F.col("code") == index, F.col("age"))).alias("first_index_age"),
            F.min("age").alias("min_age"),
            F.max("age").alias("max_age"),
        )
        .withColumn("cohort", cohort_name(F.col("first_index_age"), F.col("min_age"), F.col("max_age")))
    )


def classify_cohort_legacy(
    records: DataFrame,
    index: str = INDEX_CODE,
    age_pattern: str = LEGACY_AGE_PATTERN,
    zero_is_missing: bool = True,
) -> DataFrame:
    """The earlier classifier: no sex or target rules, ages below 100 only, index age 0 means none.

    Index ages count before a visit is dropped, the patient's span only after; a patient without a
    valid visit is an error.
    """
    code = F.col("code")
    age = F.when(code.rlike(age_pattern), F.substring(code, 2, 3).cast("int"))
    per_visit = records.groupBy(*VISIT).agg(
        F.count("*").alias("n"),
        F.count_if(age.isNotNull()).alias("n_age"),
        F.bool_or(code == index).alias("has_index"),
        F.min(age).alias("min_age"),
    )
    valid = (F.col("n") > 1) & (F.col("n") > F.col("n_age")) & (F.col("n_age") > 0)
    index_age = F.when(F.col("has_index") & (F.col("n") > 1), F.col("min_age"))
    per_patient = per_visit.groupBy("p_id").agg(
        F.min(index_age).alias("first_index_age"),
        F.min(F.when(valid, F.col("min_age"))).alias("min_age"),
        F.max(F.when(valid, F.col("min_age"))).alias("max_age"),
    )
    onset = F.when(F.col("min_age").isNotNull(), F.col("first_index_age"))
    if zero_is_missing:
        onset = F.nullif(onset, F.lit(0))
    return per_patient.select("p_id", cohort_name(onset, F.col("min_age"), F.col("max_age")).alias("cohort"))


def clean_records_legacy(records: DataFrame, age_pattern: str = LEGACY_AGE_PATTERN) -> DataFrame:
    """(p_id, visits): the records that the earlier classifier leaves, nested, codes as they stand.

    Visits of one code, of ages only, or without an age are gone; sex markers stay where they are. A patient
    of whom no visit is left has an empty record.
    """
    code = F.col("code")
    per_visit = records.groupBy(*VISIT).agg(
        F.count("*").alias("n"),
        F.count_if(code.rlike(age_pattern)).alias("n_age"),
        F.array_sort(F.collect_list(F.struct("code_idx", "code"))).alias("coded"),
    )
    valid = (F.col("n") > 1) & (F.col("n") > F.col("n_age")) & (F.col("n_age") > 0)
    visit = F.when(valid, F.struct("visit_idx", F.transform("coded", lambda c: c["code"]).alias("codes")))
    per_patient = per_visit.groupBy("p_id").agg(F.array_sort(F.collect_list(visit)).alias("kept"))
    return per_patient.select("p_id", F.transform("kept", lambda v: v["codes"]).alias("visits"))


def cohort_families(classified: DataFrame) -> DataFrame:
    """(p_id, family) rows: a patient is in every family its cohort belongs to."""
    families = F.array(*[F.when(F.col("cohort").isin(*members), name) for name, members in FAMILIES.items()])
    return classified.select("p_id", F.explode(F.array_compact(families)).alias("family"))


def family_sizes(classified: DataFrame) -> DataFrame:
    """Patients per family, counted per cohort first so families multiply a handful of rows only."""
    sizes = classified.groupBy("cohort").agg(F.count("*").alias("n"))
    families = F.array(*[F.when(F.col("cohort").isin(*members), name) for name, members in FAMILIES.items()])
    return (
        sizes.select(F.explode(F.array_compact(families)).alias("family"), "n")
        .groupBy("family")
        .agg(F.sum("n").cast("long").alias("n"))
    )


def _attrition(per_patient: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, n_remaining, n_dropped) for rules applied one after the other, in one aggregation."""
    passed = F.lit(True)
    counts = [F.count("*").alias("c0")]
    for i, (_, rule) in enumerate(steps, start=1):
        passed = passed & rule
        counts.append(F.count_if(passed).alias(f"c{i}"))
    rows = [F.struct(F.lit("0_initial").alias("step"), F.col("c0").alias("n_remaining"), F.lit(0).cast("long").alias("n_dropped"))]
    for i, (name, _) in enumerate(steps, start=1):
        rows.append(
            F.struct(
                F.lit(f"{i}_{name}").alias("step"),
                F.col(f"c{i}").alias("n_remaining"),
                (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("n_dropped"),
            )
        )
    return per_patient.agg(*counts).select(F.inline(F.array(*rows)))


def cohort_attrition(
    records: DataFrame,
    index: str = INDEX_CODE,
    targets: Sequence[str] = TARGET_CODES,
    age_pattern: str = COHORT_AGE_PATTERN,
    minimum: int = 2,
) -> DataFrame:
    """Patients left and dropped at each step of :func:`classify_cohort`."""
    validated = validate_visits(visit_flags(records, index, targets, age_pattern))
    per_patient = validated.groupBy("p_id").agg(
        F.bool_or("has_index").alias("has_index"),
        F.bool_or(F.col("has_index") & (F.col("n_age") > 0)).alias("has_index_with_age"),
        F.count_if(F.col("status").isin(*KEPT)).alias("n_valid"),
    )
    return _attrition(
        per_patient,
        [
            ("has_index", F.col("has_index")),
            ("has_index_with_age", F.col("has_index_with_age")),
            ("min_visits", F.col("n_valid") >= minimum),
        ],
    )


def single_age_attrition(
    records: DataFrame, index: str = INDEX_CODE, age_pattern: str = SINGLE_AGE_PATTERN
) -> DataFrame:
    """The variant that first asks for a visit with exactly one age code."""
    code = F.col("code")
    per_visit = records.groupBy(*VISIT).agg(
        F.count_if(code.rlike(age_pattern)).alias("n_age"),
        F.bool_or(code == index).alias("has_index"),
    )
    per_patient = per_visit.groupBy("p_id").agg(
        F.bool_or(F.col("n_age") == 1).alias("one_age"),
        F.bool_or("has_index").alias("has_index"),
        F.bool_or(F.col("n_age") > 0).alias("any_age"),
    )
    return _attrition(
        per_patient,
        [("one_age", F.col("one_age")), ("has_index", F.col("has_index")), ("any_age", F.col("any_age"))],
    )


def index_patients(dx: DataFrame, index: str) -> DataFrame:
    """(p_id) of patients with the index code."""
    return dx.where(F.col("code") == index).select("p_id").distinct()


def attrition_counts(dx: DataFrame, patients: DataFrame, index: str) -> DataFrame:
    """Initial patients, patients with any listed code, patients with the index code, in one row."""
    per_patient = dx.groupBy("p_id").agg(F.bool_or(F.col("code") == index).alias("has_index"))
    known = patients.select("p_id").distinct().join(per_patient, "p_id", "left")
    return known.agg(
        F.count("*").alias("n_initial"),
        F.count("has_index").alias("n_with_code"),
        F.count_if("has_index").alias("n_with_index"),
    )


def patient_summary(
    dx: DataFrame, codes: Sequence[str], index: str, positive: str = "DM", negative: str = "No DM"
) -> DataFrame:
    """One row per (p_id, sex): a 0/1 flag per code, first age, first index age and a group label."""
    code = F.col("code")
    flags = [F.max(F.when(code == c, 1).otherwise(0)).alias(c) for c in codes]
    keys = ["p_id", "sex"] if "sex" in dx.columns else ["p_id"]
    onset = F.col("age_dm")
    return (
        dx.groupBy(*keys)
        .agg(*flags, F.min("age").alias("age"), F.min(F.when(code == index, F.col("age"))).alias("age_dm"))
        .withColumn("diabetes", F.when(onset.isNotNull(), positive).otherwise(negative))
    )
