"""Sex and age resolution over coded records, with the reports that go with them.

Every rule is an aggregate first: evidence is collapsed to one row per patient or visit before
anything is joined back, so the size of a patient's history never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.codes import (
    AGE_PATTERN,
    AGE_UNKNOWN,
    FEMALE,
    MALE,
    extract_age,
    is_sex_marker,
    sex_letter,
)
from kohorta.plans.skew import spread_join
from kohorta.session import written

PATIENT = ["p_id"]
VISIT = ["p_id", "visit_idx"]


def sex_flags(records: DataFrame) -> DataFrame:
    """One row per patient: is there male evidence, is there female evidence."""
    return records.groupBy("p_id").agg(
        F.bool_or(F.col("code") == MALE).alias("is_male"),
        F.bool_or(F.col("code") == FEMALE).alias("is_female"),
    )


def resolve_sex(records: DataFrame) -> DataFrame:
    """(p_id, sex): M or F for one-sided evidence, U for both or none."""
    return sex_flags(records).select("p_id", sex_letter(F.col("is_male"), F.col("is_female")).alias("sex"))


def spread_sex_evidence(records: DataFrame) -> DataFrame:
    """Every code row with its patient's evidence flags."""
    return spread_join(records, sex_flags(records), PATIENT)


def sex_report(records: DataFrame) -> DataFrame:
    """Patients per combination of evidence."""
    return sex_flags(records).groupBy("is_male", "is_female").agg(F.count("*").alias("n"))


def sex_conflicts(records: DataFrame) -> DataFrame:
    """Patients with evidence of both sexes."""
    return sex_flags(records).where("is_male AND is_female").select("p_id")


def drop_markers(records: DataFrame) -> DataFrame:
    """Rows that are not sex markers."""
    return records.where(~is_sex_marker(F.col("code")))


def visit_ages(records: DataFrame, pattern: str = AGE_PATTERN) -> DataFrame:
    """One row per visit: its first age in code order, smallest and largest age, and row count.

    Sex markers are not visit content, so a visit made of markers only has no row here.
    """
    age = extract_age(F.col("code"), pattern)
    return (
        drop_markers(records)
        .withColumn("_age", age)
        .groupBy(*VISIT)
        .agg(
            F.min_by("_age", F.when(F.col("_age").isNotNull(), F.col("code_idx"))).alias("age"),
            F.min("_age").alias("min_age"),
            F.max("_age").alias("max_age"),
            F.count("*").alias("n_rows"),
        )
    )


def age_conflict_report(records: DataFrame, pattern: str = AGE_PATTERN) -> DataFrame:
    """Patients with two different ages in one visit, and patients with a visit of unknown age."""
    per_patient = (
        visit_ages(records, pattern)
        .groupBy("p_id")
        .agg(
            F.bool_or(F.coalesce(F.col("min_age") != F.col("max_age"), F.lit(False))).alias("conflict"),
            F.bool_or(F.col("age").isNull()).alias("unknown"),
        )
    )
    return per_patient.agg(
        F.count_if("conflict").alias("n_conflict"),
        F.count_if("unknown").alias("n_unknown"),
    )


def coded_visits(records: DataFrame, pattern: str = AGE_PATTERN) -> DataFrame:
    """(p_id, visit_idx, age, is_male, is_female, codes): all that later steps ask of the records.

    One aggregation over the records, written to the shared folder. ``age`` is the first one of the
    visit, ``codes`` its distinct diagnoses.
    """
    code = F.col("code")
    age = extract_age(code, pattern)
    dx = F.when(~is_sex_marker(code) & (code != AGE_UNKNOWN) & age.isNull(), code)
    per_visit = records.groupBy(*VISIT).agg(
        F.min_by(age, F.when(age.isNotNull(), F.col("code_idx"))).alias("age"),
        F.bool_or(code == MALE).alias("is_male"),
        F.bool_or(code == FEMALE).alias("is_female"),
        F.collect_set(dx).alias("codes"),
    )
    return written(per_visit, "coded-visits")


def clinical_visits(coded: DataFrame) -> DataFrame:
    """(p_id, visit_idx, sex, age) of the :func:`coded_visits` with a known age and a diagnosis.

    Sex comes from all visits of a patient, because a visit of markers only is evidence, too.
    """
    flags = coded.groupBy("p_id").agg(F.bool_or("is_male").alias("m"), F.bool_or("is_female").alias("f"))
    sexes = flags.select("p_id", sex_letter(F.col("m"), F.col("f")).alias("sex"))
    known = coded.where("age IS NOT NULL AND size(codes) > 0").select(*VISIT, "age")
    return spread_join(known, sexes, PATIENT).select(*VISIT, "sex", "age")


def diagnosis_rows(coded: DataFrame) -> DataFrame:
    """Distinct diagnoses (p_id, visit_idx, age, code) of the :func:`coded_visits` with a known age."""
    return coded.where("age IS NOT NULL").select(*VISIT, "age", F.explode("codes").alias("code"))
