"""Mapping raw codes to catalog codes, expanding catalog ranges, classifying by prefix.

Catalogs and prefix tables carry no broadcast hint: Catalyst knows their size (a literal table or a
small file) and broadcasts them when they are below its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def strict_code(column: str):
    """Text to long; raises on text that is not a number (ANSI cast)."""
    return F.col(column).cast("long")


def cast_codes(df: DataFrame, column: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows with ``column`` as a long, rejected rows with the text, counts of both) in one pass.

    Each row is written once under ``path``, to the folder of its kind, and counted as it passes. A null
    is no number and no reject: it stays null.
    """
    seen = Observation()
    number = F.col(column).try_cast("long")
    judged = df.withColumn("_number", number).withColumn("_rejected", number.isNull() & F.col(column).isNotNull())
    counts = [F.count_if(~F.col("_rejected")).alias("good"), F.count_if("_rejected").alias("rejected")]
    judged.observe(seen, *counts).write.partitionBy("_rejected").parquet(path)
    kept = df.sparkSession.read.schema(judged.schema).parquet(path)
    good = kept.where(~F.col("_rejected")).withColumn(column, F.col("_number")).select(*[f"`{c}`" for c in df.columns])
    return good, kept.where("_rejected").select(*[f"`{c}`" for c in df.columns]), dict(seen.get)


def map_codes(dx: DataFrame, catalog: DataFrame) -> DataFrame:
    """Replace ``code`` by the catalog's ``cie10``; a code the catalog lacks stays as it is.

    ``catalog`` has unique ``code_bps`` (text or number) and ``cie10``.
    """
    names = catalog.select(F.col("code_bps").cast("string").alias("_raw"), "cie10")
    return (
        dx.join(names, F.col("code") == F.col("_raw"), "left")
        .withColumn("code", F.coalesce("cie10", "code"))
        .drop("_raw", "cie10")
    )


def unmapped_codes(dx: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (code, p_id) of codes that the catalog lacks, sorted."""
    names = catalog.select(F.col("code_bps").cast("string").alias("code"))
    return dx.select("code", "p_id").distinct().join(names, "code", "left_anti").orderBy("code", "p_id")


def expand_code_ranges(catalog: DataFrame) -> DataFrame:
    """(cie, cie_group) pairs: ``C18-C20`` gives C18, C19 and C20; a dotted code loses its dot.

    A code that is a group of its own and also lies in a range is listed under both groups.
    """
    group = F.col("cie10")
    low = F.split_part(group, F.lit("-"), F.lit(1))
    high = F.split_part(group, F.lit("-"), F.lit(2))
    letter = F.substring(group, 1, 1)
    numbers = F.sequence(F.substring(low, 2, 9).cast("int"), F.substring(high, 2, 9).cast("int"))
    members = F.transform(numbers, lambda n: F.concat(letter, F.lpad(n.cast("string"), 2, "0")))
    single = F.array(F.replace(group, F.lit("."), F.lit("")))
    codes = F.when(group.contains("-"), members).otherwise(single)
    return catalog.select(F.explode(codes).alias("cie"), group.alias("cie_group"), "code_bps")


def longest_prefix(rows: DataFrame, key: str, prefixes: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Add ``cie``, the longest prefix of ``key`` found in ``prefixes.cie``; null when there is none.

    One equi join per prefix length instead of a test per prefix: rows are neither copied nor
    shuffled as long as the prefix table is small.
    """
    known = prefixes.select("cie").distinct()
    found = []
    for length in sorted(set(lengths), reverse=True):
        column = f"_cie{length}"
        rows = rows.join(
            known.where(F.length("cie") == length).withColumnRenamed("cie", column),
            (F.col(column) == F.substring(F.col(key), 1, length)) & (F.length(F.col(key)) >= length),
            "left",
        )
        found.append(column)
    return rows.withColumn("cie", F.coalesce(*found)).drop(*found)


def classify_by_prefix(rows: DataFrame, key: str, prefixes: DataFrame, lengths: Sequence[int] = (3, 4)) -> DataFrame:
    """Rows with a prefix, joined to its groups; a row of a prefix with two groups appears twice."""
    groups = prefixes.select("cie", "cie_group", "code_bps")
    return longest_prefix(rows, key, prefixes, lengths).where("cie IS NOT NULL").join(groups, "cie")


def prefix_counts(rows: DataFrame, key: str, prefixes: DataFrame, lengths: Sequence[int] = (3, 4)) -> DataFrame:
    """Rows matched per prefix, 0 for a prefix that matches nothing."""
    matched = (
        longest_prefix(rows, key, prefixes, lengths)
        .where("cie IS NOT NULL")
        .groupBy("cie")
        .agg(F.count("*").alias("n"))
    )
    return (
        prefixes.select("cie")
        .distinct()
        .join(matched, "cie", "left")
        .select("cie", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )
