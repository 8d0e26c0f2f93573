"""Readers and writers of nested visit records and of the tables made from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorta.functions.codes import age_code, visit_label
from kohorta.operators.longitudinal import identifier
from kohorta.sources.one_object import object_members

NESTED_SCHEMA = "p_id STRING, visits ARRAY<ARRAY<STRING>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested records from JSON Lines, one ``{"p_id": ..., "visits": [[...], ...]}`` per line."""
    return spark.read.schema(NESTED_SCHEMA).json(path)


def read_records_object(spark: SparkSession, path: str) -> DataFrame:
    """Nested records from files that each hold one ``{"patient": [[...], ...], ...}`` object.

    A large file is read by many tasks, see :mod:`kohorta.sources.one_object`. A name that stands twice
    gives two records; members that are no lists of lists of texts become null visits.
    """
    parsed = F.from_json(F.concat(F.lit("{"), F.col("member"), F.lit("}")), "MAP<STRING, ARRAY<ARRAY<STRING>>>")
    return object_members(spark, path).select(F.explode(parsed).alias("p_id", "visits"))


def write_records(nested: DataFrame, path: str) -> None:
    nested.select("p_id", "visits").write.json(path)


def write_records_object(nested: DataFrame, path: str) -> None:
    """Nested records as files that each hold one object with a member per patient, one file per partition."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            lines = []
            for member in batch.column(0).to_pylist():
                lines.append(f"{lead} {member}")
                lead = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"])], names=["value"])

    member = F.to_json(F.create_map("p_id", "visits"))
    bare = F.substring(member, F.lit(2), F.length(member) - 2)
    nested.select(bare).mapInArrow(framed, "value STRING").write.text(path)


def flatten_visits(nested: DataFrame) -> DataFrame:
    """(p_id, visit_idx, code_idx, code); empty visits and empty codes disappear.

    Positions come from the arrays, so no window or shuffle is needed to number them.
    """
    return (
        nested.select("p_id", F.posexplode("visits").alias("visit_idx", "codes"))
        .select("p_id", "visit_idx", F.posexplode("codes").alias("code_idx", "code"))
        .where(F.col("code") != "")
    )


def pairs_to_visits(pairs: str) -> Column:
    """One visit ``[code, age code]`` per (age, code) pair."""
    return F.transform(pairs, lambda p: F.array(p["code"], age_code(p["age"])))


def build_nested(dx: DataFrame) -> DataFrame:
    """(p_id, visits) from flat (p_id, code, age) rows, one visit per distinct code and age.

    The set of a patient holds at most codes x ages pairs, whatever the number of source rows, and
    is formed on the map side first.
    """
    pairs = F.array_sort(F.collect_set(F.struct("age", "code")))
    return dx.groupBy("p_id").agg(pairs.alias("pairs")).select("p_id", pairs_to_visits("pairs").alias("visits"))


def records_json(nested: DataFrame) -> DataFrame:
    """(p_id, visits_json) with the visits as JSON text."""
    return nested.select("p_id", F.to_json("visits").alias("visits_json"))


def write_cohorts(nested: DataFrame, classified: DataFrame, path: str) -> None:
    """Nested records as JSON Lines in one folder per cohort.

    ``nested`` is what :func:`kohorta.operators.cohort.clean_records` returns, so the files hold the
    kept visits only.

    Families overlap and are unions of cohorts, so they are read with :func:`read_family` instead of
    being written again.
    """
    joined = nested.join(classified.select("p_id", "cohort"), "p_id")
    joined.select("p_id", "visits", "cohort").write.partitionBy("cohort").json(path)


def read_family(spark: SparkSession, path: str, cohorts: Sequence[str]) -> DataFrame:
    """Records of a family of cohorts; only the folders of those cohorts are read."""
    return spark.read.schema(NESTED_SCHEMA + ", cohort STRING").json(path).where(F.col("cohort").isin(*cohorts))


def rendered_wide(wide: DataFrame) -> DataFrame:
    """A wide visit table as it is stored: rendered visit id instead of a position."""
    label = visit_label(F.col("p_id"), F.col("visit_idx")).alias("v_o_id")
    return wide.select("p_id", label, *[identifier(c) for c in wide.columns if c not in ("p_id", "visit_idx")])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by default; ``csv`` writes a header."""
    writer = df.write
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_ordered(df: DataFrame, path: str, *keys: str | Column) -> None:
    """Rows in the order of ``keys``, dealt to files by ranges of them and sorted inside.

    Every row keeps the number of its range and its place there, so the order can be read back whatever order
    the files are listed in. Rows with equal keys are in one file, in any order.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.withColumns({"_range": F.spark_partition_id(), "_place": place}).write.parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_ordered` wrote, with ``position`` from 1: the row's place among all rows.

    Only the number of rows per range is gathered, one number a file.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(starts), "_range").withColumn("position", F.col("_before") + F.col("_place") + 1)
    return placed.drop("_range", "_place", "_before")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with an explicit schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
