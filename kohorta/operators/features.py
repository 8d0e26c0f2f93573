"""Turning patient rows into numeric features: encoding, filling, scaling, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohorta.functions.scalars import hash_bucket
from kohorta.operators.longitudinal import quoted


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The frame itself, or an error naming the columns that are not numbers; no job runs."""
    wanted = df.columns if columns is None else columns
    bad = sorted(set(wanted) - set(numeric_columns(df)))
    if bad:
        raise ValueError(f"columns are not numeric: {bad}")
    return df


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Replace ``column`` by a 0/1 column per level, in the given order."""
    prefix = column if prefix is None else prefix
    flags = {f"{prefix}_{v}": F.coalesce((quoted(column) == v).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(flags).drop(column)


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    """Null becomes ``value``."""
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(value)) for c in columns})


def clean_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite becomes null, then rows with a null (or NaN) feature go."""
    infinite = {c: F.when(F.abs(quoted(c)) != float("inf"), quoted(c)) for c in columns}
    return df.withColumns(infinite).dropna(subset=list(columns))


def bools_to_int(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: quoted(c).cast("int") for c in names}) if names else df


def scale_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes 0.

    The ranges are scalar subqueries: one aggregate row, no join.
    """
    bounds = df.agg(
        F.struct(
            *[F.min(quoted(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(quoted(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)],
        ).alias("b")
    ).scalar()
    df = df.withColumn("_b", bounds)
    scaled = {}
    for i, c in enumerate(columns):
        low, high = F.col(f"_b.lo{i}"), F.col(f"_b.hi{i}")
        span = F.when(high > low, (quoted(c) - low) / (high - low)).when(quoted(c).isNotNull(), 0.0)
        scaled[c] = span
    return df.withColumns(scaled).drop("_b")


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        ).alias("b")
    ).scalar()
    df = df.withColumn("_b", moments)
    scaled = {}
    for i, c in enumerate(columns):
        centred = quoted(c) - F.col(f"_b.m{i}")
        deviation = F.col(f"_b.s{i}")
        scaled[c] = F.when(deviation > 0, centred / deviation).otherwise(centred)
    return df.withColumns(scaled).drop("_b")


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A sample chosen by the key, so the same rows are taken on every run."""
    return df.where(hash_bucket(quoted(key)) < percent)


def hash_split(df: DataFrame, key: str, train_percent: int = 80, name: str = "fold") -> DataFrame:
    """Add ``fold`` (train or test) by a hash of the key; stable however the data are partitioned."""
    return df.withColumn(name, F.when(hash_bucket(quoted(key)) < train_percent, "train").otherwise("test"))


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Feature columns as one array<double>; ids and targets are simply not listed."""
    return df.withColumn(name, F.array(*[quoted(c).cast("double") for c in columns]))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, corr) of every pair of columns, from one aggregation over the rows."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    row = df.agg(*[F.corr(quoted(x), quoted(y)).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("corr"))
        for i, (x, y) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("cluster")).agg(F.count("*").alias("n"))


def cluster_overview(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of clusters and smallest label, counted over the sizes."""
    return cluster_sizes(df, label).agg(
        F.count("*").alias("n_clusters"), F.min("cluster").alias("min_cluster")
    )


def cluster_profile(df: DataFrame, flags: dict[str, Column] | Sequence[str], label: str = "label") -> DataFrame:
    """(cluster, size, col, n, pct): rows per cluster whose flag is 1, as count and percent."""
    columns = flags if isinstance(flags, dict) else {c: quoted(c) for c in flags}
    names = list(columns)
    counts = [F.count_if(columns[c] == 1).alias(f"n{i}") for i, c in enumerate(names)]
    wide = df.groupBy(F.col(label).alias("cluster")).agg(F.count("*").alias("size"), *counts)
    cells = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)]
    )
    return wide.select("cluster", "size", F.inline(cells)).withColumn("pct", F.col("n") * 100.0 / F.col("size"))
