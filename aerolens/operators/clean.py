"""Row filters and reshaping between raw measurements and the station-hour table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import composite_index
from ..functions.numeric import floor_hour, half_even_int, local_time
from ..session import written
from .ordered import in_ranges


def only_city(df: DataFrame, city: str) -> DataFrame:
    return df.where(F.lower("city") == city.lower())


def between_dates(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """Inclusive range of two instants. A plain end date means its midnight, so the later
    hours of that day are outside, as in the source pipeline."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def drop_empty(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows without a key, or without any measurement, drop."""
    return df.na.drop(how="any", subset=keys).na.drop(how="all", subset=measures)


def align_columns(df: DataFrame, columns: list[str], fill: float | None = None, dtype: str = "double") -> DataFrame:
    """Exactly ``columns``, in order; absent ones are null (or ``fill``)."""
    def pick(c):
        if c not in df.columns:
            return F.lit(fill).cast(dtype).alias(c)
        return (F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill))).alias(c)
    return df.select(*[pick(c) for c in columns])


def station_hour_mean(df: DataFrame, keys: list[str], measures: list[str], ts: str = "timestamp") -> DataFrame:
    """Mean of every measure per key and hour; rows with a null key form groups of their own."""
    hourly = df.withColumn(ts, floor_hour(ts))
    return hourly.groupBy(ts, *keys).agg(*[F.avg(c).alias(c) for c in measures])


def pivot_parameters(
    measurements: DataFrame, keys: list[str], parameters=K.POLLUTANTS, time: str = "measurement_time"
) -> DataFrame:
    """Long measurements to one wide row per key and hour, with every pollutant column.

    One conditional mean per pollutant of a fixed list: a single aggregation, without the
    extra pass a data-driven pivot needs.
    """
    dated = measurements.where(F.col(time).isNotNull())
    wide = dated.groupBy(*keys, floor_hour(time).alias("timestamp")).agg(
        *[F.expr(f"avg(value) FILTER (WHERE parameter = '{p}') AS {p}") for p in parameters],
        # Hours without any value drop afterwards: a filter on the (computed) value before
        # the aggregation would be pushed to the scan and compute it twice.
        F.expr("count(CASE WHEN parameter IS NOT NULL THEN value END) AS _values"),
    )
    return wide.where("_values > 0").drop("_values")


def with_index(readings: DataFrame, strict: bool = True) -> DataFrame:
    """Add the composite index ``aqi`` of a wide table."""
    return readings.withColumn("aqi", composite_index(readings.columns, strict))


def weekly_trend(readings: DataFrame, key: str = "station_id", zone: str = "Asia/Kolkata", days: int = 7) -> DataFrame:
    """The last ``days`` local-day means per key, oldest first, half-even integers.

    Shorter histories repeat their first day at the front; a key without any index gets zeros.
    """
    daily = (
        readings.groupBy(key, F.to_date(local_time("timestamp", zone)).alias("_day"))
        .agg(half_even_int(F.avg("aqi")).alias("_aqi"))
    )
    per_key = daily.groupBy(key).agg(
        # One small struct per day of history; array sort by day, then the tail.
        F.sort_array(F.collect_list(F.when(F.col("_aqi").isNotNull(), F.struct("_day", "_aqi")))).alias("_days")
    )
    recent = F.transform(F.slice("_days", -F.greatest(F.lit(1), F.least(F.size("_days"), F.lit(days))), days), lambda d: d["_aqi"])
    padded = F.concat(F.array_repeat(F.get(recent, F.lit(0)), F.lit(days) - F.size(recent)), recent)
    return per_key.select(
        key, F.when(F.size("_days") > 0, padded).otherwise(F.array_repeat(F.lit(0), days)).alias("weekly_trend"))


def split_by_time(df: DataFrame, train_end: str = K.TRAIN_END, val_end: str = K.VALIDATION_END, ts="timestamp"):
    at = F.col(ts)
    return df.withColumn(
        "split",
        F.when(at < F.lit(train_end).cast("timestamp_ntz"), "train")
        .when(at < F.lit(val_end).cast("timestamp_ntz"), "val")
        .otherwise("test"),
    )


def hash_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """A reproducible sample: the same rows for the same seed, however data is partitioned."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(fraction * 2**32))


def display_time(ts: str, zone: str = "Asia/Kolkata", pattern: str = "dd MMM yyyy, HH:mm"):
    return F.date_format(local_time(ts, zone), pattern)


def location_key(location_id: str):
    return F.concat(F.lit("openaq"), F.col(location_id).cast("string"))


def station_label(city: str, station: str, station_id: str):
    return F.format_string("%s - %s (%s)", F.col(city), F.col(station), F.col(station_id))


def encode_labels(df: DataFrame, column: str = "city", out: str = "city_encoded", start: int = 0) -> DataFrame:
    """Dense codes of the sorted distinct values from ``start`` on, null left out: one row per value.

    The values are dealt into ranges; a code is the count of all values in the ranges before plus the rank inside its own.
    """
    values = written(df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct(), "labels")
    ranged = in_ranges(values, [column], values.count(), "label-ranges")
    before = Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_unit").agg(F.count("*").alias("_n")).select("_unit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_unit").orderBy(column)) - 1)
    return ranked.join(starts, "_unit").select(column, (F.col("_before") + F.col("_rank") + start).cast("int").alias(out))


def extend_codes(codes: DataFrame, df: DataFrame, column: str = "city", out: str = "city_encoded") -> DataFrame:
    """A stored dictionary with the values of ``df`` that it lacks: old codes stay, new values are numbered after the last one."""
    last = codes.agg(F.max(out)).first()[0]
    new = df.select(F.col(column).cast("string").alias(column)).join(codes.select(column), column, "left_anti")
    return codes.select(column, out).unionByName(encode_labels(new, column, out, 0 if last is None else last + 1))


def with_codes(df: DataFrame, codes: DataFrame, column: str = "city", out: str = "city_encoded", unseen: int = 0) -> DataFrame:
    """``df`` plus the stored code of its value; ``unseen`` for a value without one, and for null."""
    known = codes.select(F.col(column).alias("_label"), F.col(out).alias("_code"))
    joined = df.join(known, F.col(column).cast("string") == F.col("_label"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(unseen))).drop("_label", "_code")
