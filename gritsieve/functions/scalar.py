"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that a date in text may have, besides those that a cast to timestamp knows.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm")


def parse_date(c: Column) -> Column:
    """A timestamp, or null where the text is no date."""
    return F.coalesce(c.try_cast("timestamp"), *(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS))


def frac_year(c: Column) -> Column:
    """Year plus twelfths and days: rises with the calendar day, and forgets the time of day."""
    return F.year(c) + F.month(c) / 12.0 + F.dayofmonth(c) / 365.0


def null_if_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def row_key(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes that name a row by its values; nulls count as equal values."""
    nulls = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns))
    return [F.xxhash64(F.lit(1), nulls, *map(F.col, columns)).alias("_k1"), F.xxhash64(F.lit(2), nulls, *reversed(list(map(F.col, columns)))).alias("_k2")]
