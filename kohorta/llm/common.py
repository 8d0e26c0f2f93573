"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is crc32(doc_id as text) mod ``folds`` zero; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == 0


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts outside the held-out fold, for fitting a model on the driver.

    The rows are the first by a hash of the id, so the sample is the same on every run. Labels are
    taken once per id (the largest, if they differ); null texts and labels are left out.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    marks = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text").limit(rows)
    got = found.select("text", "_label").toArrow()
    return list(zip(got["text"].cast(pa.binary()).to_pylist(), got["_label"].to_pylist()))


def raw_texts(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty, copied out a few rows at a time."""
    for at in range(0, len(column), step):
        for raw in column.slice(at, step).cast(pa.binary()).to_pylist():
            yield raw or b""


def boxed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so an operator's own columns cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(names: list[str], **replaced: Column) -> list[Column]:
    """The columns in ``row`` by their names, some of them with a new value."""
    return [replaced[c].alias(c) if c in replaced else F.col(f"row.`{c}`").alias(c) for c in names]
