"""Whole flows built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from kohorta.functions.codes import AGE_PATTERN, INDEX_GROUP
from kohorta.operators.clean import clinical_visits, coded_visits, diagnosis_rows
from kohorta.operators.coding import map_codes
from kohorta.operators.longitudinal import wide_table, yearly_summary


def to_wide(
    records: DataFrame,
    catalog: DataFrame,
    codes: Sequence[str],
    targets: Sequence[str],
    age_pattern: str = AGE_PATTERN,
) -> DataFrame:
    """Coded records to the wide visit table: sex, age, mapped codes, history, look-ahead labels.

    The records are read once, for one row per visit.

    ``codes`` lists the columns; :func:`kohorta.sources.catalog.column_codes` gives the catalog's,
    to which a caller adds raw codes the catalog lacks.
    """
    coded = coded_visits(records, age_pattern)
    dx = map_codes(diagnosis_rows(coded), catalog)
    return wide_table(clinical_visits(coded), dx, codes, targets)


def to_yearly(wide: DataFrame, index_column: str = INDEX_GROUP) -> DataFrame:
    """Wide visit table to one row per patient and year of age, with years since the index."""
    return yearly_summary(wide, index_column)
