"""Descriptive "table one" of a patient table, as tidy rows and as a display table.

The columns of a table are computed and written once. Numeric variables share one aggregation over
them and categorical ones another, however many there are. Sizes per group are the denominators, rows
with a null level included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.scalars import count_percent_text, mean_std_text
from kohorta.operators.longitudinal import quoted
from kohorta.session import written

GLOBAL = "Global"


def _grouped(df: DataFrame, group: str | None) -> DataFrame:
    label = F.lit(GLOBAL) if group is None else quoted(group).cast("string")
    return df.withColumn("grp", label).where("grp IS NOT NULL")


def header(df: DataFrame, group: str | None = None) -> DataFrame:
    """(grp, n): patients per group."""
    return _grouped(df, group).groupBy("grp").agg(F.count("*").alias("n"))


def numeric(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """(variable, grp, n, mean, std) with the sample standard deviation, nulls left out."""
    moments = []
    for i, c in enumerate(columns):
        value = quoted(c).cast("double")
        moments += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"n{i}").alias("n"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"std{i}").alias("std"),
        )
        for i, c in enumerate(columns)
    ]
    wide = _grouped(df, group).groupBy("grp").agg(*moments)
    return wide.select("grp", F.inline(F.array(*cells))).select("variable", "grp", "n", "mean", "std")


def categorical(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """(variable, level, grp, n, pct): counts per level, percent of the whole group."""
    rest = F.array(*[F.struct(F.lit(c).alias("variable"), quoted(c).cast("string").alias("level")) for c in columns])
    # Levels and sizes come from the same counts: a group's size is the sum over a variable's levels.
    counts = (
        _grouped(df, group)
        .select("grp", F.inline(rest))
        .groupBy("variable", "level", "grp")
        .agg(F.count("*").alias("n"))
    )
    sizes = counts.groupBy("variable", "grp").agg(F.sum("n").alias("size"))
    return (
        counts.where("level IS NOT NULL")
        .join(sizes, ["variable", "grp"])
        .select("variable", "level", "grp", "n", (F.col("n") * 100.0 / F.col("size")).alias("pct"))
    )



def _narrow(df: DataFrame, columns: Sequence[str], group: str | None) -> DataFrame:
    """The columns of a table, computed once: every part of the table is an aggregate of them."""
    names = dict.fromkeys([*columns, *([group] if group else [])])
    return written(df.select(*map(quoted, names)), "table-one")


def _parts(
    df: DataFrame, categorical_columns: Sequence[str], numeric_columns: Sequence[str], group: str | None
) -> DataFrame:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    top = header(df, group).select(
        F.lit("N").alias("variable"), text.alias("level"), "grp", "n",
        number.alias("pct"), number.alias("mean"), number.alias("std"),
    )
    middle = numeric(df, numeric_columns, group).select(
        "variable", text.alias("level"), "grp", "n", number.alias("pct"), "mean", "std"
    )
    bottom = categorical(df, categorical_columns, group).select(
        "variable", "level", "grp", "n", "pct", number.alias("mean"), number.alias("std")
    )
    return top.unionByName(middle).unionByName(bottom)


def table_one(
    df: DataFrame, categorical_columns: Sequence[str], numeric_columns: Sequence[str], group: str | None = None
) -> DataFrame:
    """The whole table as tidy rows (variable, level, grp, n, pct, mean, std)."""
    narrow = _narrow(df, [*categorical_columns, *numeric_columns], group)
    return _parts(narrow, categorical_columns, numeric_columns, group)


def merged(
    df: DataFrame, categorical_columns: Sequence[str], numeric_columns: Sequence[str], group: str
) -> DataFrame:
    """Overall rows beside the rows of each group, matched on variable and level."""
    narrow = _narrow(df, [*categorical_columns, *numeric_columns], group)
    whole = _parts(narrow, categorical_columns, numeric_columns, None)
    parts = _parts(narrow, categorical_columns, numeric_columns, group)
    left, right = whole.alias("w"), parts.alias("g")
    same = (F.col("w.variable") == F.col("g.variable")) & F.col("w.level").eqNullSafe(F.col("g.level"))
    return left.join(right, same, "left").select(
        F.col("w.variable").alias("variable"),
        F.col("w.level").alias("level"),
        F.col("g.grp").alias("grp"),
        F.col("w.n").alias("n_all"),
        F.col("w.pct").alias("pct_all"),
        F.col("w.mean").alias("mean_all"),
        F.col("g.n").alias("n"),
        F.col("g.pct").alias("pct"),
        F.col("g.mean").alias("mean"),
    )


def display(
    tidy: DataFrame,
    groups: Sequence[str],
    variables: Sequence[str],
    by_label: Sequence[str] = ("age_cat", "age_dm_cat"),
    precision: int = 2,
) -> DataFrame:
    """Text table: a row per variable and level, a column per group.

    Means show as ``mean (std)`` and counts as ``n (p%)``. A variable with one level is one row named
    after the variable; one with more levels has a heading row and a row per level, by count in the
    first group, or by label for ``by_label``. The input is a tidy table, so its size is variables x
    levels, not patients.
    """
    text = (
        F.when(F.col("variable") == "N", F.col("n").cast("string"))
        .when(F.col("pct").isNotNull(), count_percent_text(F.col("n"), F.col("pct")))
        .otherwise(mean_std_text(F.col("mean"), F.col("std"), precision))
    )
    first = F.max(F.when(F.col("grp") == groups[0], F.col("n")))
    cells = [F.max(F.when(F.col("grp") == g, text)).alias(g) for g in groups]
    rows = tidy.groupBy("variable", "level").agg(first.alias("_first"), *cells)
    levels = rows.groupBy("variable").agg(F.count("level").alias("_levels"))
    place = F.array_position(F.array(*[F.lit(v) for v in ["N", *variables]]), F.col("variable"))
    rows = rows.join(levels, "variable").select(
        "variable",
        F.when(F.col("_levels") <= 1, F.col("variable")).otherwise(F.col("level")).alias("row"),
        place.alias("_place"),
        F.when(F.col("_levels") <= 1, 0).otherwise(1).alias("_part"),
        F.when(F.col("variable").isin(*by_label), F.lit(0)).otherwise(-F.coalesce("_first", F.lit(0))).alias("_by_count"),
        *groups,
    )
    headings = levels.where("_levels > 1").select(
        "variable",
        F.col("variable").alias("row"),
        place.alias("_place"),
        F.lit(0).alias("_part"),
        F.lit(0).cast("long").alias("_by_count"),
        *[F.lit(None).cast("string").alias(g) for g in groups],
    )
    return rows.unionByName(headings).orderBy("_place", "_part", "_by_count", "row").select("row", *groups)
