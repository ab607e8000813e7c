"""Null-safe numeric and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c: str | Column, default: float | None = None) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes ``default``."""
    value = col(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def safe_timestamp(c: str | Column) -> Column:
    """Text to a zone-free timestamp; unreadable text becomes null, zones convert to UTC."""
    return col(c).try_cast("timestamp").cast("timestamp_ntz")


def floor_hour(c: str | Column) -> Column:
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def local_time(c: str | Column, zone: str) -> Column:
    """UTC wall-clock time shown in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(c).cast("timestamp_ntz"))


def half_even_int(c: str | Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(col(c)).cast("int")


def skewness_unbiased(c: str | Column) -> Column:
    """Bias-corrected sample skewness; null below three values."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
