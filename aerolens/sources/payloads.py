"""Nested JSON payloads to flat rows: measurements, weather, sensor registry, predictions.

Each function takes a frame with a JSON text column, as landed by a fetch job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import canonical_unit, normalize_value
from ..functions.numeric import floor_hour, safe_double, safe_timestamp

WEATHER_SCHEMA = "struct<hourly: struct<time: array<string>, " + ", ".join(
    f"{c}: array<double>" for c in K.WEATHER) + ">>"
CURRENT_SCHEMA = "struct<current: struct<" + ", ".join(f"{c}: double" for c in K.WEATHER) + ">>"
FORECAST_SCHEMA, POLLUTANT_SCHEMA, TREND_SCHEMA = "array<int>", "map<string,double>", "array<int>"


def _first_of(payload: Column, *paths: str) -> Column:
    """The first path that holds a scalar, so that an object and a one-element list both read."""
    return F.coalesce(*[F.try_variant_get(payload, p, "string") for p in paths])


def _period(payload: Column, leaf: str) -> Column:
    return _first_of(
        payload,
        f"$.period.datetimeFrom.{leaf}", f"$.period[0].datetimeFrom.{leaf}",
        f"$.period.datetimeFrom[0].{leaf}", f"$.period[0].datetimeFrom[0].{leaf}",
    )


def flatten_measurements(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Hourly measurement objects to rows, keeping the other columns (sensor metadata).

    Expects ``parameter`` and ``raw_unit`` next to the payload; adds ``measurement_time``,
    ``local_time``, ``raw_value``, ``value`` and canonical ``units``.
    """
    kept = [c for c in df.columns if c != payload]
    parsed = df.select(*kept, F.try_parse_json(payload).alias("_json"))
    json = F.col("_json")
    # Produced by a generator, the fields are parsed once: filters on them stay above it
    # instead of being pushed below with a copy of the parsing.
    fields = F.struct(
        _period(json, "utc").alias("_utc"), _period(json, "local").alias("local_time"),
        F.try_variant_get(json, "$.value", "string").alias("_value"),
    )
    flat = parsed.select(*kept, F.inline(F.array(fields)))
    typed = flat.select(
        *kept, safe_timestamp("_utc").alias("measurement_time"), "local_time", safe_double("_value").alias("raw_value"))
    return typed.withColumn("value", normalize_value("parameter", "raw_value", "raw_unit")).withColumn(
        "units", canonical_unit("parameter", "raw_unit"))


def target_measurements(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows of the twelve target pollutants that have a time and a value.

    Before normalisation pass ``value="raw_value"``: a normalised value is null exactly
    where the raw one is, and a stored column can be checked by the scan.
    """
    return df.where(
        F.col("parameter").isin(*K.POLLUTANTS) & F.col("measurement_time").isNotNull() & F.col(value).isNotNull()
    )


def flatten_weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Struct-of-arrays hourly weather to one row per hour, tagged with the other columns."""
    hourly = df.withColumn("_h", F.from_json(payload, WEATHER_SCHEMA)["hourly"])
    # A variable that was not requested is an empty array, and null in every row.
    arrays = ", ".join(f"coalesce(_h.{c}, array()) AS {c}" for c in ("time", *K.WEATHER))
    rows = hourly.selectExpr(*[c for c in df.columns if c != payload], f"struct({arrays}) AS _a").selectExpr(
        *[c for c in df.columns if c != payload], "inline(arrays_zip(" + ", ".join(f"_a.{c}" for c in ("time", *K.WEATHER)) + "))")
    return (
        rows.withColumn("timestamp", safe_timestamp("time")).drop("time").where(F.col("timestamp").isNotNull())
    )


def current_weather(df: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at") -> DataFrame:
    """The current-conditions object as one row stamped with the hour it was fetched."""
    now = df.withColumn("_c", F.from_json(payload, CURRENT_SCHEMA)["current"])
    return now.select(
        *[c for c in df.columns if c not in (payload, fetched_at)],
        floor_hour(fetched_at).alias("timestamp"), *[F.col(f"_c.{c}").alias(c) for c in K.WEATHER],
    )


def explode_registry(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Station objects to one row per sensor.

    ``available_sensors`` may be a list or JSON text, ``parameter`` an object or a plain
    name. Sensors without an id or a parameter name drop.
    """
    station = df.withColumn("_s", F.try_parse_json(payload))

    def text(path: str) -> Column:
        return F.try_variant_get("_s", path, "string")

    listed = F.try_variant_get("_s", "$.available_sensors", "array<variant>")
    as_text = F.try_variant_get(F.try_parse_json(text("$.available_sensors")), "$", "array<variant>")
    sensors = station.select(
        *[c for c in df.columns if c != payload],
        text("$.station_id").alias("station_id"), text("$.city").alias("city"),
        text("$.station_name").alias("station_name"),
        F.try_variant_get("_s", "$.openaq_location_id", "bigint").alias("openaq_location_id"),
        text("$.openaq_location_name").alias("openaq_location_name"),
        F.explode(F.coalesce(listed, as_text)).alias("_e"),
    )

    def of_sensor(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("_e", path, kind)

    is_object = F.schema_of_variant(F.try_variant_get("_e", "$.parameter", "variant")).startswith("OBJECT")
    plain = F.when(~is_object, of_sensor("$.parameter"))
    return (
        sensors.withColumn("sensor_id", of_sensor("$.id", "bigint"))
        .withColumn("parameter", F.coalesce(of_sensor("$.parameter.name"), plain))
        .withColumn("units", F.coalesce(of_sensor("$.parameter.units"), of_sensor("$.units")))
        .drop("_e")
        .where(F.col("sensor_id").isNotNull() & (F.coalesce(F.col("parameter"), F.lit("")) != ""))
    )


def location_sensors(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A location payload to its sensors: id, parameter, units, display name."""
    schema = ("struct<id: bigint, sensors: array<struct<id: bigint, "
              "parameter: struct<name: string, units: string, displayName: string>>>>")
    exploded = df.select(F.from_json(payload, schema).alias("_l")).select(
        F.col("_l.id").alias("location_id"), F.explode("_l.sensors").alias("_s"))
    return exploded.select(
        "location_id", F.col("_s.id").alias("sensor_id"), F.col("_s.parameter.name").alias("parameter"),
        F.col("_s.parameter.units").alias("units"), F.col("_s.parameter.displayName").alias("display_name"),
    ).where((F.col("sensor_id") != 0) & (F.coalesce("parameter", F.lit("")) != ""))


def prediction_to_json(df: DataFrame) -> DataFrame:
    """Nested prediction columns as the three stored JSON strings."""
    return df.select(
        *[c for c in df.columns if c not in ("forecast", "pollutants", "weekly_trend")],
        F.to_json("forecast").alias("forecast_json"), F.to_json("pollutants").alias("pollutants_json"),
        F.to_json("weekly_trend").alias("weekly_trend_json"),
    )


def prediction_from_json(df: DataFrame) -> DataFrame:
    """Stored predictions back to arrays and a map."""
    return df.select(
        *[c for c in df.columns if not c.endswith("_json")],
        F.from_json("forecast_json", FORECAST_SCHEMA).alias("forecast"),
        F.from_json("pollutants_json", POLLUTANT_SCHEMA).alias("pollutants"),
        F.from_json("weekly_trend_json", TREND_SCHEMA).alias("weekly_trend"),
    )
