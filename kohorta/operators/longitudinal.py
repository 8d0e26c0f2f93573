"""History, look-ahead labels, wide and yearly tables, timelines.

``dx`` is (p_id, visit_idx, age, code), ``visits`` is (p_id, visit_idx, age, ...). Visits of a patient
are ordered by (age, visit_idx). What a visit knows of its past is fully given by the first moment each
code was seen, so a patient's history is never joined to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kohorta.functions.codes import INDEX_GROUP, LABEL_PREFIX, MOMENT_BASE, MOMENT_BITS, moment
from kohorta.plans.skew import spread_join

# Codes a timeline marks.
HIGHLIGHT_CODES = ("H35", "I20-I25", "Z89", "N18", "E10-E14")


def identifier(name: str) -> str:
    """A column name for use in an expression, also when it has a dot or a dash."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(identifier(name))


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Sequence[str]) -> str:
    return "CAST(array(" + ", ".join(map(text_literal, values)) + ") AS ARRAY<STRING>)"


def label_name(code: Column) -> Column:
    return F.concat(F.lit(LABEL_PREFIX), code)


def _moment() -> Column:
    return moment(F.col("age"), F.col("visit_idx"))


def first_seen(dx: DataFrame) -> DataFrame:
    """(p_id, code, first_moment): when a patient got each code."""
    return dx.groupBy("p_id", "code").agg(F.min(_moment()).alias("first_moment"))


def carry_history(visits: DataFrame, dx: DataFrame) -> DataFrame:
    """Each visit with every code its patient had at that visit or before.

    The result holds visits x known codes by definition; :func:`wide_table` gives the same content
    without building those rows.
    """
    known = first_seen(dx)
    return (
        spread_join(visits, known, ["p_id"])
        .where(_moment() >= F.col("first_moment"))
        .drop("first_moment")
    )


def lookahead_labels(
    visits: DataFrame,
    dx: DataFrame,
    targets: Sequence[str],
    horizon: int = 1,
    onset_only: bool = False,
) -> DataFrame:
    """Visits (p_id, visit_idx, age) with a label for each target they have or will have in ``horizon`` years.

    A visit from ``horizon`` years before the first target age onwards is labelled, so labels also
    follow the onset; ``onset_only`` stops at the onset age.
    """
    onset = (
        dx.where(F.col("code").isin(*targets))
        .groupBy("p_id", "code")
        .agg(F.min("age").alias("first_age"))
    )
    age = F.col("age")
    due = age >= F.col("first_age") - horizon
    if onset_only:
        due = due & (age <= F.col("first_age"))
    return (
        spread_join(visits, onset, ["p_id"])
        .where(due)
        .select("p_id", "visit_idx", "age", label_name(F.col("code")).alias("label"))
    )


def label_union(history: DataFrame, labels: DataFrame) -> DataFrame:
    """Codes and labels as one long table."""
    return history.unionByName(labels.withColumnRenamed("label", "code"))


def shifted_targets(dx: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Distinct (p_id, age, label) of target diagnoses at their age and one year before."""
    hits = dx.where(F.col("code").isin(*targets)).select("p_id", "age", label_name(F.col("code")).alias("label"))
    # Diagnoses are read once, and are distinct before each stands for two rows.
    both = F.explode(F.array(F.col("age"), F.col("age") - 1))
    return hits.distinct().select("p_id", both.alias("age"), "label").distinct()


def wide_table(
    visits: DataFrame,
    dx: DataFrame,
    codes: Sequence[str],
    targets: Sequence[str],
    horizon: int = 1,
) -> DataFrame:
    """One row per visit: a column per code carried from the past, a label column per target.

    ``codes`` is the sorted column list; a set flag is 1, an absent one null. A patient's history
    is one array with the first moment of each column, and each visit compares its own moment to
    it: no row per visit and known code is ever built.

    The comparison is one array expression and the columns are plain element reads. Written as one
    condition per column, the generated method of a wide table would be too long for the JIT.
    """
    known = (
        first_seen(dx.where(F.col("code").isin(*set(codes) | set(targets))))
        .groupBy("p_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("code", "first_moment"))).alias("_known"))
    )
    # Text expressions: every Column object built from Python costs several calls into the JVM.
    # A label is due from the start of the year of life ``horizon`` before the onset.
    first = f"transform({text_array(codes)}, c -> try_element_at(_known, c))"
    onset = (
        f"transform({text_array(targets)}, c -> "
        f"(shiftright(try_element_at(_known, c), {MOMENT_BITS}) - {horizon}) * {MOMENT_BASE}L)"
    )
    known = known.selectExpr("p_id", f"concat({first}, {onset}) AS _from")
    joined = spread_join(visits.withColumn("_now", _moment()), known, ["p_id"], "left")
    names = [*codes, *(LABEL_PREFIX + t for t in targets)]
    return joined.withColumn("_set", F.expr("transform(_from, m -> CASE WHEN _now >= m THEN 1 END)")).selectExpr(
        *map(identifier, visits.columns), *[f"get(_set, {i}) AS {identifier(n)}" for i, n in enumerate(names)]
    )


def final_sort(visits: DataFrame) -> DataFrame:
    """Global order by patient, age and visit position, for the sink."""
    return visits.orderBy(F.col("p_id").cast("long"), F.col("age").cast("int"), F.col("visit_idx").cast("long"))


def yearly_max(wide: DataFrame, keys: Sequence[str] = ("p_id", "age")) -> DataFrame:
    """One row per patient and age: largest value of every other column, null ignored.

    The visit column is its position, a number, so position 10 is above position 9. ``keys`` may hold
    a column that is constant per patient, such as sex: text among the keys keeps the aggregation in
    a hash map, a maximum over text would not.
    """
    rest = [c for c in wide.columns if c not in keys]
    return wide.groupBy(*keys).agg(*[F.expr(f"max({identifier(c)}) AS {identifier(c)}") for c in rest])


def years_since_index(yearly: DataFrame, index: Column, name: str = "years_with_diabetes") -> DataFrame:
    """Years since the patient's first age with ``index`` true; 0 before it and without it.

    ``yearly`` has one row per (p_id, age), so a window holds at most one row per year of life.
    """
    onset = F.min(F.when(index, F.col("age"))).over(Window.partitionBy("p_id"))
    return yearly.withColumn(name, F.greatest(F.coalesce(F.col("age") - onset, F.lit(0)), F.lit(0)).cast("int"))


def yearly_summary(wide: DataFrame, index_column: str = INDEX_GROUP, name: str = "years_with_diabetes") -> DataFrame:
    """Yearly table of a wide visit table, with the years since the index column was first set."""
    keys = [c for c in ("p_id", "sex", "age") if c in wide.columns]
    return years_since_index(yearly_max(wide, keys), quoted(index_column).isNotNull(), name)


def onset_ages(dx: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One row per patient: age at the first diagnosis of each code, 0 for never."""
    code = F.col("code")
    firsts = [F.coalesce(F.min(F.when(code == c, F.col("age"))), F.lit(0)).alias(c) for c in codes]
    return dx.groupBy("p_id").agg(*firsts)


def positive_count(df: DataFrame, columns: Sequence[str], name: str = "total_data") -> DataFrame:
    """Number of columns above zero in each row."""
    flags = [F.when(quoted(c) > 0, 1).otherwise(0) for c in columns]
    total = flags[0]
    for flag in flags[1:]:
        total = total + flag
    return df.withColumn(name, total)


def timeline(
    onsets: DataFrame,
    codes: Sequence[str],
    names: DataFrame,
    highlight: Sequence[str] = HIGHLIGHT_CODES,
    key: str = "p_id",
) -> DataFrame:
    """All patients' diagnoses in order of age: (key, seq, code, age, name, is_highlight).

    ``names`` is (cie10, name). A patient has at most one row per code column, which bounds the window.
    """
    long = onsets.unpivot([key], [quoted(c) for c in codes], "code", "age").where("age > 0")
    label = F.concat(F.col("cie10"), F.lit(" - "), F.col("name"))
    order = Window.partitionBy(key).orderBy("age", "code")
    return long.join(names, F.col("code") == F.col("cie10"), "left").select(
        key,
        F.row_number().over(order).alias("seq"),
        "code",
        "age",
        label.alias("name"),
        F.col("code").isin(*highlight).alias("is_highlight"),
    )
