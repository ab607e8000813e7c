"""The data-quality gate between the joined table and feature engineering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


class QualityError(ValueError):
    """Raised with the failed rules."""


def quality_rules(
    df: DataFrame, keys=("timestamp", "station_id", "city"), unique=("timestamp", "station_id"),
    non_negative=K.QUALITY_NON_NEGATIVE,
) -> DataFrame:
    """One row per rule: failing rows and whether it passed.

    Null and sign checks share the pass that counts rows per unique key.
    """
    checked = [c for c in non_negative if c in df.columns]
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    per_key = df.groupBy(*unique).agg(
        F.count("*").alias("_rows"),
        F.count(F.when(any_null, 1)).alias("_null"),
        *[F.count(F.when(F.col(c) < 0, 1)).alias(f"_{c}") for c in checked],
    )
    zero = F.lit(0)
    totals = per_key.agg(
        F.coalesce(F.sum("_null"), zero).alias("null_keys"),
        F.coalesce(F.sum(F.col("_rows") - 1), zero).alias("duplicate_station_hours"),
        *[F.coalesce(F.sum(f"_{c}"), zero).alias(f"negative_{c}") for c in checked],
    )
    names = ["null_keys", "duplicate_station_hours", *[f"negative_{c}" for c in checked]]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("failures")) for n in names])
    return totals.select(F.inline(rows)).withColumn("passed", F.col("failures") == 0)


def require_quality(df: DataFrame, **options) -> DataFrame:
    """``df`` itself, or ``QualityError`` naming the failed rules."""
    failed = quality_rules(df, **options).where(~F.col("passed")).collect()
    if failed:
        raise QualityError("; ".join(f"{r['rule']}: {r['failures']} rows" for r in failed))
    return df
