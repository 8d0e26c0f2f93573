"""Small scalar rules: ages from dates, age bands, display texts, hash sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound (exclusive) and label of each age band, then the open band.
AGE_BANDS = ((18, "0-18"), (45, "18-44"), (65, "45-64"))
AGE_BAND_OPEN = "60>"
DAYS_PER_YEAR = 365.25


def date_part(text: Column) -> Column:
    """Date of a ``YYYY-MM-DD ...`` text; raises on text that is not a date."""
    return F.to_date(F.split_part(text, F.lit(" "), F.lit(1)), "yyyy-MM-dd")


def age_between(birth: Column, day: Column) -> Column:
    """Full years as floor(days / 365.25), so a visit before birth gives a negative age."""
    return F.floor(F.date_diff(day, birth) / F.lit(DAYS_PER_YEAR)).cast("long")


def age_band(age: Column, bands=AGE_BANDS, open_label: str = AGE_BAND_OPEN) -> Column:
    out = F.when(age.isNull(), F.lit(None).cast("string"))
    for bound, label in bands:
        out = out.when(age < bound, label)
    return out.otherwise(open_label)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 of a key, the same on every run and for every partitioning."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def mean_std_text(mean: Column, std: Column, precision: int = 2) -> Column:
    """``mean (std)``; what cannot be computed, such as the std of one row, shows as nan."""
    mean_text, std_text = (F.coalesce(F.bround(v, precision).cast("string"), F.lit("nan")) for v in (mean, std))
    return F.concat(mean_text, F.lit(" ("), std_text, F.lit(")"))


def count_percent_text(count: Column, percent: Column) -> Column:
    """``n (p%)``, null when there is no count."""
    return F.when(count.isNotNull(), F.format_string("%d (%.2f%%)", count, F.bround(percent, 2)))
