"""Column expressions over the coded strings of a visit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format.
MALE = "1111"
FEMALE = "2222"
SEX_UNKNOWN = "3333"
AGE_UNKNOWN = "9999"
INDEX_CODE = "401"
TARGET_CODES = ("703", "910", "1999", "1401")
AGE_PATTERN = "^9([01][0-9]{2})$"
COHORT_AGE_PATTERN = "^9([0-9]{3})$"
LEGACY_AGE_PATTERN = "^(?=.*90).([0-9]{3})$"
SINGLE_AGE_PATTERN = "^9(0[0-9]{2})$"
INDEX_GROUP = "E10-E14"
LABEL_PREFIX = "pred1y_"

#: Visit positions are packed below this bound, see :func:`moment`.
MOMENT_BITS = 48
MOMENT_BASE = 1 << MOMENT_BITS


def extract_age(code: Column, pattern: str = AGE_PATTERN) -> Column:
    """Age in years carried by an age code, null for any other code and for the unknown-age marker."""
    found = F.nullif(F.regexp_extract(code, pattern, 1), F.lit("")).cast("int")
    return F.when(code != AGE_UNKNOWN, found)


def is_sex(code: Column) -> Column:
    return code.isin(MALE, FEMALE)


def is_sex_marker(code: Column) -> Column:
    return code.isin(MALE, FEMALE, SEX_UNKNOWN)


def code_kind(code: Column, pattern: str = AGE_PATTERN) -> Column:
    """``sex``, ``age``, ``age_unknown`` or ``dx``."""
    return (
        F.when(is_sex_marker(code), "sex")
        .when(code == AGE_UNKNOWN, "age_unknown")
        .when(code.rlike(pattern), "age")
        .otherwise("dx")
    )


def sex_letter(is_male: Column, is_female: Column) -> Column:
    """M or F when the evidence is one-sided, U otherwise."""
    return F.when(is_male & ~is_female, "M").when(is_female & ~is_male, "F").otherwise("U")


def sex_to_code(sex: Column) -> Column:
    """M and F become marker codes; anything else stays."""
    return F.when(sex == "M", MALE).when(sex == "F", FEMALE).otherwise(sex)


def sex_to_number(sex: Column) -> Column:
    return F.when(sex == "M", 1).when(sex == "F", 2).when(sex == "U", 3)


def number_to_sex_label(number: Column) -> Column:
    return F.when(number == 1, "Male").when(number == 2, "Female").when(number == 3, "Unknow")


def visit_label(patient: Column, visit: Column) -> Column:
    """Rendered visit id, ``patient_position``."""
    return F.concat(patient.cast("string"), F.lit("_"), visit.cast("string"))


def visit_position(label: Column) -> Column:
    """Position parsed back from a rendered visit id."""
    return F.split_part(label, F.lit("_"), F.lit(-1)).cast("long")


def age_code(age: Column) -> Column:
    return (age + 9000).cast("string")


def moment(age: Column, visit: Column) -> Column:
    """One long that orders visits by (age, position).

    A long keeps ``min`` inside hash aggregation, which a struct would not. Positions outside the
    packed range raise instead of giving a wrong order.
    """
    position = visit.cast("long")
    checked = F.when(position.between(0, MOMENT_BASE - 1), position).otherwise(
        F.raise_error(F.lit("visit position out of range")).cast("long")
    )
    return age.cast("long") * F.lit(MOMENT_BASE) + checked
