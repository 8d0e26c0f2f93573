"""The given tables seen as coded longitudinal records.

* purchases: a customer is a patient, an order a visit, a part type a code;
* activity: a user in one week is a patient, a day a visit, an event a code in the record format;
* line flags: an order is a patient, its return flags are sex markers;
* notes: a conversation is a patient, a turn a visit, its words are codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.functions.codes import AGE_UNKNOWN, FEMALE, INDEX_CODE, MALE, SEX_UNKNOWN
from kohorta.sources.catalog import catalog_rows

PURCHASE_CODES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PURCHASE_INDEX = "PROMO"
PURCHASE_TARGETS = ("ECONOMY", "LARGE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dx rows (p_id, visit_idx, age, code); distinct because an order can hold a type twice."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("code"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("visit_idx"),
        F.col("o_custkey").alias("p_id"),
        (F.year("o_orderdate") - 1950).cast("int").alias("age"),
    )
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(orders, F.col("l_orderkey") == F.col("visit_idx"))
        .select("p_id", "visit_idx", "age", "code")
        .distinct()
    )


def visits_of(dx: DataFrame) -> DataFrame:
    return dx.select("p_id", "visit_idx", "age").distinct()


def activity(spark: SparkSession, sf_dir: str, error_code: Column | None = None) -> DataFrame:
    """Coded records (p_id, visit_idx, code_idx, code) with every kind of code.

    Some purchases stand for an unknown age, an unknown sex or an age of 120 to 199.
    """
    error_code = F.lit("703") if error_code is None else error_code
    day, number = F.to_date("ts"), F.col("event_id")
    week = F.trunc(day, "week").cast("date")
    kind = F.col("event_type")
    code = (
        F.when(kind == "signup", INDEX_CODE)
        .when(kind == "error", error_code)
        .when(kind == "click", MALE)
        .when(kind == "view", FEMALE)
        .when(number % 17 == 3, AGE_UNKNOWN)
        .when(number % 19 == 5, SEX_UNKNOWN)
        .when(number % 13 == 7, F.concat(F.lit("9"), (F.floor("value") % 80 + 120).cast("string")))
        .otherwise(F.concat(F.lit("9"), F.lpad((F.floor("value") % 120).cast("string"), 3, "0")))
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), week.cast("string")).alias("p_id"),
        F.date_diff(day, week).alias("visit_idx"),
        F.col("event_id").alias("code_idx"),
        code.alias("code"),
    )


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("p_id"),
        F.col("l_linenumber").alias("visit_idx"),
        F.col("l_partkey").alias("code_idx"),
        F.when(flag == "A", MALE).when(flag == "R", FEMALE).otherwise(flag).alias("code"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: one row per turn, its lines as visits, each line's words as codes."""
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("p_id"),
        F.transform(lines, lambda line: F.split(line, " ", -1)).alias("visits"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows (id, features array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label"),
    )


def coded_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`activity`, with catalog codes of every kind in place of the one target code."""
    known = F.split(F.lit(",".join(str(code) for code, *_ in catalog_rows())), ",")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return activity(spark, sf_dir, F.element_at(known, number % F.size(known) + 1))
