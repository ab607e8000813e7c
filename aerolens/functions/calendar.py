"""Calendar and cyclical expressions over a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def parts(ts: str | Column) -> dict[str, Column]:
    t = col(ts)
    weekday = F.weekday(t)
    return {
        "hour_of_day": F.hour(t),
        "day_of_week": weekday,
        "month": F.month(t),
        "year": F.year(t),
        "day_of_year": F.dayofyear(t),
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
        "season": season(F.month(t)),
    }


def season(month: Column) -> Column:
    """0 December-February, 1 March-May, 2 June-September, 3 October-November."""
    return (
        F.when(month.isin(12, 1, 2), 0)
        .when(month.between(3, 5), 1)
        .when(month.between(6, 9), 2)
        .otherwise(3)
    )


def cyclical(value: str | Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * col(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
