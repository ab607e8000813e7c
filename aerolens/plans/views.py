"""Domain views over the given tables, in Spark and as SQL.

``events`` plays the sensor log: a user is a sensor, eight sensors make a station, the event type is
the measured parameter. Every eighty customers run a station, so stations and readings grow with the
tables; ``nation`` and ``region`` give their names and cities.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import canonical_unit, category, normalize_value
from ..functions.numeric import floor_hour
from ..operators import clean

# --- fixed values: how the event log maps to the domain --------------------------------
SENSORS, CUSTOMERS = 8, 80
PARAMETER_OF = {"click": "pm25", "error": "pm10", "purchase": "no2", "signup": "so2", "view": "co"}
UNITS = ("ug/m3", "ppb", "ppm", "mg/m3")
NUDGE = 1e-9
MEASURED = ("pm25", "pm10", "no2", "so2", "co")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison. The nudge decides exact ties, which the order of a floating
    sum would otherwise flip."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), digits)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.selectExpr(*[f"round({c} + {NUDGE!r}D, {digits}) AS {c}" if c in columns else c for c in df.columns])


def scalar(df: DataFrame, expr: Column):
    """One aggregate value of a table (a reference time, a bound)."""
    return df.agg(expr).first()[0]


def now_of(events: DataFrame) -> str:
    """The reference time: the newest event, never the wall clock."""
    return str(scalar(events, F.max("ts")))


def raw_measurements(spark, sf_dir) -> DataFrame:
    kinds = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in PARAMETER_OF.items())
    units = ", ".join(f"'{u}'" for u in UNITS)
    return table(spark, sf_dir, "events").withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS INT)")).selectExpr(
        "event_id", "user_id AS sensor_id", f"concat('S', user_id DIV {SENSORS}) AS station_id",
        f"CASE event_type {kinds} END AS parameter", "value AS raw_value",
        f"element_at(array({units}), k % 4 + 1) AS raw_unit", "ts AS measurement_time", "k")


def measurements(spark, sf_dir) -> DataFrame:
    return normalized(raw_measurements(spark, sf_dir))


def normalized(raw: DataFrame) -> DataFrame:
    return raw.withColumn("value", normalize_value("parameter", "raw_value", "raw_unit")).withColumn(
        "units", canonical_unit("parameter", "raw_unit"))


def back(now: str, **span: int) -> dt.datetime:
    return dt.datetime.fromisoformat(now) - dt.timedelta(**span)


def readings(spark, sf_dir, since=None, until=None) -> DataFrame:
    """One row per station and hour: five pollutant means and the composite index.

    ``since`` and ``until`` skip events that cannot belong to an hour of that range (the
    predicate reaches the scan); hours cut by a bound still need the exact filter.
    """
    m = measurements(spark, sf_dir)
    if since is not None:
        m = m.where(F.col("measurement_time") >= F.lit(str(since)).cast("timestamp_ntz"))
    if until is not None:
        m = m.where(F.col("measurement_time") < F.lit(str(until)).cast("timestamp_ntz") + F.expr("interval 1 hour"))
    wide = clean.pivot_parameters(m, ["station_id"], MEASURED)
    return rounded(clean.with_index(rounded(wide, MEASURED)), ["aqi"])


def stations(spark, sf_dir) -> DataFrame:
    """station_id, station_name, city (the region of the station's nation) and state."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ids = table(spark, sf_dir, "customer").selectExpr(f"c_custkey DIV {CUSTOMERS} AS id").distinct()
    return ids.join(n, F.col("id") % 25 == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"),
        F.col("n_name").alias("station_name"), F.col("r_name").alias("city"),
        F.concat(F.lit("Z"), F.col("r_regionkey").cast("string")).alias("state"),
    )


def city_weather(spark, sf_dir, since=None) -> DataFrame:
    """Hourly weather per city from the numeric event property."""
    raw = raw_measurements(spark, sf_dir)
    if since is not None:  # whole hours, so that no mean is cut
        raw = raw.where(F.col("measurement_time") >= F.lit(str(since.replace(minute=0, second=0, microsecond=0))).cast("timestamp_ntz"))
    m = raw.join(stations(spark, sf_dir).select("station_id", "city"), "station_id")
    shown = {"temperature_2m": "double(k)", "relative_humidity_2m": "100.0D - k", "precipitation": "k / 10.0D",
             "pressure_msl": "1000.0D + k", "cloud_cover": "double(k)", "wind_speed_10m": "k / 4.0D",
             "wind_direction_10m": "k * 3.6D"}
    return m.groupBy("city", floor_hour("measurement_time").alias("timestamp")).agg(
        *[F.expr(f"round(avg({e}) + {NUDGE!r}D, 6) AS {c}") for c, e in shown.items()])


def requests(spark, sf_dir) -> DataFrame:
    """The event log as a request log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "ts", F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("city"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (F.col("value") / 20.0).alias("latency"),
        F.get_json_object("props", "$.k").cast("long").alias("rows_written"),
    )


# ------------------------------------------------------------------------------- as SQL

def sql_case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + " END"


def sql_round(expr: str, digits: int = 6) -> str:
    """Rounded double with the same nudge; adding zero turns a negative zero positive."""
    return f"(round({expr} + {NUDGE!r}, {digits}) + 0e0)"


def sql_sub_index(pollutant: str, v: str) -> str:
    cases = "".join(
        f" WHEN {v} BETWEEN {float(lo)!r}e0 AND {float(hi)!r}e0 THEN "
        f"{(ihi - ilo) / (hi - lo)!r}e0 * ({v} - {float(lo)!r}e0) + {float(ilo)!r}e0"
        for lo, hi, ilo, ihi in K.BREAKPOINTS[pollutant])
    top = K.BREAKPOINTS[pollutant][-1]
    return f"CASE{cases} WHEN {v} > {float(top[1])!r}e0 THEN {float(top[3])!r}e0 END"


def sql_category(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'Unknown' WHEN {v} <= 50 THEN 'Good' WHEN {v} <= 100 THEN 'Satisfactory' "
            f"WHEN {v} <= 200 THEN 'Moderate' WHEN {v} <= 300 THEN 'Poor' WHEN {v} <= 400 THEN 'Very Poor' ELSE 'Severe' END")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

RAW_CTE = f"""raw AS (
  SELECT event_id, user_id AS sensor_id, 'S' || CAST(user_id // {SENSORS} AS VARCHAR) AS station_id,
    {sql_case('event_type', PARAMETER_OF)} AS parameter, value AS raw_value,
    CASE {SQL_K} % 4 WHEN 0 THEN 'ug/m3' WHEN 1 THEN 'ppb' WHEN 2 THEN 'ppm' ELSE 'mg/m3' END AS raw_unit,
    ts AS measurement_time, {SQL_K} AS k
  FROM events)"""

MEASUREMENTS_CTE = RAW_CTE + """, measurements AS (
  SELECT *, CASE
      WHEN parameter = 'no2' AND raw_unit = 'ppb' THEN raw_value * 46.0055e0 / 24.45e0
      WHEN parameter = 'so2' AND raw_unit = 'ppb' THEN raw_value * 64.066e0 / 24.45e0
      WHEN parameter = 'co' AND raw_unit = 'ppb' THEN raw_value * 28.01e0 / 24.45e0 / 1000e0
      WHEN parameter = 'co' AND raw_unit = 'ppm' THEN raw_value * 28.01e0 / 24.45e0
      WHEN parameter = 'co' AND raw_unit = 'ug/m3' THEN raw_value / 1000e0
      ELSE raw_value END AS value,
    CASE parameter WHEN 'co' THEN 'mg/m3' ELSE 'ug/m3' END AS units
  FROM raw)"""

READINGS_CTE = MEASUREMENTS_CTE + ", wide AS (SELECT station_id, date_trunc('hour', measurement_time) AS timestamp, " + ", ".join(
    f"{sql_round(f'avg(value) FILTER (parameter = {p!r})')} AS {p}" for p in MEASURED
) + " FROM measurements GROUP BY 1, 2), readings AS (SELECT *, " + sql_round(
    "greatest(" + ", ".join(sql_sub_index(p, p) for p in MEASURED) + ")") + " AS aqi FROM wide)"

STATIONS_CTE = f"""stations AS (
  SELECT 'S' || CAST(id AS VARCHAR) AS station_id, n_name AS station_name, r_name AS city,
    'Z' || CAST(r_regionkey AS VARCHAR) AS state
  FROM (SELECT DISTINCT c_custkey // {CUSTOMERS} AS id FROM customer) JOIN nation ON n_nationkey = id % 25 JOIN region ON n_regionkey = r_regionkey)"""

WEATHER_CTE = f"""weather AS (
  SELECT city, date_trunc('hour', measurement_time) AS timestamp,
    {sql_round('avg(CAST(k AS DOUBLE))')} AS temperature_2m, {sql_round('avg(100e0 - k)')} AS relative_humidity_2m,
    {sql_round('avg(k / 10e0)')} AS precipitation, {sql_round('avg(1000e0 + k)')} AS pressure_msl,
    {sql_round('avg(CAST(k AS DOUBLE))')} AS cloud_cover, {sql_round('avg(k / 4e0)')} AS wind_speed_10m,
    {sql_round('avg(k * 3.6e0)')} AS wind_direction_10m
  FROM raw JOIN stations USING (station_id) GROUP BY 1, 2)"""

REQUESTS_CTE = f"""requests AS (
  SELECT ts, 'C' || CAST(user_id % 25 AS VARCHAR) AS city,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value / 20e0 AS latency,
    CAST({SQL_K} AS BIGINT) AS rows_written
  FROM events)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def named_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", category("aqi"))
