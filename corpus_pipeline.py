"""The corpus pipeline: filter, deduplicate, decontaminate and mix a table of documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of ``documents``. The stages inherit the null, tie and empty-table rules
of their operators: null texts are scored as empty, have no lines, shingles or words, and stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm.common import table
from kohorta.llm.decontamination import decontaminate
from kohorta.llm.line_dedup import drop_repeated_lines
from kohorta.llm.mixing import mix_sources
from kohorta.llm.ngram_join import one_per_component
from kohorta.llm.quality import keep_good
from kohorta.session import written


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after texts were changed; null texts keep theirs."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars").cast("bigint")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.3 go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts, and documents of which nothing is left."""
    return _recounted(drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays."""
    return one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words of benchmark passages are cut."""
    return _recounted(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the sources' target weights, in a global random order."""
    return mix_sources(docs, repetition=1.0, temper=0.5)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixture", source_mixture),
]

#: The first stage fits a model, so the rows have no SQL form; tests/llm compares the stages that follow
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
