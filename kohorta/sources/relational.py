"""Relational patient tables turned into coded records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.codes import INDEX_GROUP, sex_to_code
from kohorta.functions.scalars import age_between, date_part
from kohorta.operators.coding import classify_by_prefix, expand_code_ranges
from kohorta.sources.records import pairs_to_visits

DIAGNOSES_SCHEMA = "cx_curp STRING, catalog_key STRING, df_consulta STRING"
PATIENTS_SCHEMA = "cx_curp_original STRING, cx_curp STRING"
DEMOGRAPHICS_SCHEMA = "cx_curp STRING, df_nacimiento STRING, cs_sexo STRING"


def enrich_patients(patients: DataFrame, demographics: DataFrame) -> DataFrame:
    """Patients under their original id, with birth date and sex where known."""
    facts = demographics.select(
        F.col("cx_curp").alias("_id"), date_part(F.col("df_nacimiento")).alias("birth"), F.col("cs_sexo").alias("sex")
    )
    return patients.join(facts, F.col("cx_curp_original") == F.col("_id"), "left").select(
        F.col("cx_curp_original").alias("p_id"), "birth", "sex"
    )


def patient_diagnoses(
    diagnoses: DataFrame,
    patients: DataFrame,
    demographics: DataFrame,
    catalog: DataFrame,
    index_group: str = INDEX_GROUP,
) -> DataFrame:
    """(p_id, sex, pairs) of patients that have the index group; pairs are sorted, distinct (age, code).

    The index rule and the distinct rows come from the same aggregation, so nothing is joined back.
    A patient has at most codes x ages pairs however many source rows there are, and map tasks
    already send sets.
    """
    coded = classify_by_prefix(diagnoses, "catalog_key", expand_code_ranges(catalog)).withColumnRenamed(
        "cx_curp", "p_id"
    )
    known = enrich_patients(patients, demographics)
    age = age_between(F.col("birth"), date_part(F.col("df_consulta")))
    pair = F.struct(age.alias("age"), F.col("code_bps").cast("string").alias("code"))
    return (
        coded.join(known, "p_id")
        .groupBy("p_id", sex_to_code(F.col("sex")).alias("sex"))
        .agg(
            F.bool_or(F.col("cie_group") == index_group).alias("_has"),
            F.array_sort(F.collect_set(pair)).alias("pairs"),
        )
        .where("_has")
        .drop("_has")
    )


def relational_to_records(
    diagnoses: DataFrame,
    patients: DataFrame,
    demographics: DataFrame,
    catalog: DataFrame,
    index_group: str = INDEX_GROUP,
) -> DataFrame:
    """Nested records (p_id, visits): the sex visit, then one visit per diagnosis and age."""
    rows = patient_diagnoses(diagnoses, patients, demographics, catalog, index_group)
    return rows.select("p_id", F.concat(F.array(F.array("sex")), pairs_to_visits("pairs")).alias("visits"))


def relational_counts(
    diagnoses: DataFrame,
    patients: DataFrame,
    demographics: DataFrame,
    catalog: DataFrame,
    index_group: str = INDEX_GROUP,
) -> DataFrame:
    """Patients at the start, with any catalog diagnosis, and with the index group; one row."""
    coded = classify_by_prefix(diagnoses, "catalog_key", expand_code_ranges(catalog))
    hits = coded.groupBy(F.col("cx_curp").alias("p_id")).agg(
        F.bool_or(F.col("cie_group") == index_group).alias("has_index")
    )
    known = enrich_patients(patients, demographics).select("p_id").distinct()
    return known.join(hits, "p_id", "left").agg(
        F.count("*").alias("n_initial"),
        F.count("has_index").alias("n_with_code"),
        F.count_if("has_index").alias("n_with_index"),
    )
