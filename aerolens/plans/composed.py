"""Queries: the recurring jobs, run over the whole tables as their schedules would."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..session import work_path
from . import drifts, jobs
from . import views as V
from .registry import CHECKS, query

r = V.sql_round

# The first run sees the first two thirds of the events, the second run the last half: a sixth arrives twice.
RUNS_CTE = "b AS (SELECT max(event_id) * 2 // 3 AS upper, max(event_id) // 2 AS lower FROM events), runs AS (SELECT 0 AS run UNION ALL SELECT 1)"
IN_RUN = "(run = 0 AND event_id <= upper OR run = 1 AND event_id > lower)"


def runs(spark, d, rows):
    top = V.scalar(V.table(spark, d, "events"), F.max("event_id"))
    return rows.where(F.col("event_id") <= top * 2 // 3), rows.where(F.col("event_id") > top // 2)


@query("job_training_table", V.with_sql(V.READINGS_CTE, V.STATIONS_CTE, V.WEATHER_CTE, select="""
SELECT station_id, city, state, timestamp, pm25, no2, aqi, CAST(substr(station_id, 2) AS DOUBLE) AS latitude, temperature_2m, wind_speed_10m
FROM readings JOIN stations USING (station_id) LEFT JOIN weather USING (city, timestamp) WHERE state < 'Z3'"""))
def job_training_table(spark, d):
    """The checked training table of the stations of the configured cities."""
    stations = V.stations(spark, d)
    number = F.expr("CAST(substr(station_id, 2) AS DOUBLE)")
    config = stations.where("state < 'Z3'").select("station_id", "city", number.alias("latitude"), (number + 70).alias("longitude"))
    table = jobs.training_table(V.readings(spark, d), stations, config, V.city_weather(spark, d), "2000-01-01", "2100-01-01")
    shown = ["pm25", "no2", "aqi"]
    return V.rounded(table.select("station_id", "city", "state", "timestamp", *shown, "latitude", "temperature_2m", "wind_speed_10m"), shown)


REGISTRY_CTE = """registry AS (SELECT c_custkey AS sensor_id, 'S' || CAST(c_custkey // 8 AS VARCHAR) AS station_id, c_mktsegment AS city,
  CASE c_custkey % 3 WHEN 0 THEN 'no2' WHEN 1 THEN 'co' ELSE 'pm25' END AS parameter, CASE c_custkey % 3 WHEN 2 THEN 'ug/m3' ELSE 'ppb' END AS raw_unit FROM customer)"""
LANDED_CTE = """raw AS (SELECT event_id, user_id AS sensor_id, station_id, city, parameter, value AS raw_value, raw_unit, date_trunc('second', ts) AS measurement_time
  FROM events JOIN registry ON sensor_id = user_id)"""


def sensor_registry(spark, d):
    return V.table(spark, d, "customer").selectExpr(
        "c_custkey AS sensor_id", "concat('S', c_custkey DIV 8) AS station_id", "c_mktsegment AS city", "CAST(NULL AS STRING) AS station_name",
        "CAST(c_nationkey AS INT) AS openaq_location_id", "CAST(NULL AS STRING) AS openaq_location_name",
        "CASE c_custkey % 3 WHEN 0 THEN 'no2' WHEN 1 THEN 'co' ELSE 'pm25' END AS parameter", "CASE c_custkey % 3 WHEN 2 THEN 'ug/m3' ELSE 'ppb' END AS units",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_fetched_hour", "CAST(NULL AS TIMESTAMP_NTZ) AS last_successful_sync")


@query("job_ingest", V.with_sql(REGISTRY_CTE, V.MEASUREMENTS_CTE.replace(V.RAW_CTE, LANDED_CTE), RUNS_CTE, f"""kept AS (
  SELECT * FROM measurements, b, runs WHERE {IN_RUN}
  QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY run, event_id) = 1),
  w AS (SELECT sensor_id, date_trunc('hour', max(measurement_time)) AS watermark FROM measurements GROUP BY 1)""", select=f"""
SELECT event_id, sensor_id, station_id, city, parameter, units, measurement_time, {r('value')} AS value, count(*) FILTER (run = 1) OVER () AS added_last, watermark
FROM kept JOIN w USING (sensor_id)"""))
def job_ingest(spark, d):
    """Payloads landed in two overlapping runs: the stored measurements, rows the second run added, and each sensor's hour reached."""
    document = F.to_json(F.struct(F.col("raw_value").alias("value"), F.struct(F.struct(
        F.date_format("measurement_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeFrom")).alias("period")))
    landed = V.raw_measurements(spark, d).select("event_id", "sensor_id", document.alias("payload"))
    path, registry, added = work_path(spark, "measurements"), sensor_registry(spark, d), 0
    now = V.now_of(V.table(spark, d, "events"))
    for rows in runs(spark, d, landed):
        registry, added = jobs.ingest(rows, registry, path, now, ["event_id"])
    stored = I.read_table(spark, path).select("event_id", "sensor_id", "station_id", "city", "parameter", "units", "measurement_time", V.r6("value").alias("value"))
    reached = registry.select("sensor_id", F.date_trunc("hour", "last_fetched_hour").cast("timestamp_ntz").alias("watermark"))
    return stored.join(reached, "sensor_id").withColumn("added_last", F.lit(added).cast("long"))


@query("job_refresh", V.with_sql(V.MEASUREMENTS_CTE, V.STATIONS_CTE, V.WEATHER_CTE, RUNS_CTE, "hourly AS (SELECT run, city, station_id, date_trunc('hour', measurement_time) AS timestamp, "
  + ", ".join(f"avg(value) FILTER (parameter = '{p}') AS {p}" for p in V.MEASURED)
  + f" FROM measurements JOIN stations USING (station_id), b, runs WHERE {IN_RUN} GROUP BY 1, 2, 3, 4 HAVING count(value) > 0)", select=f"""
SELECT city, station_id, timestamp, {r('pm25')} AS pm25, {r('co')} AS co, {r('greatest(' + ', '.join(V.sql_sub_index(p, p) for p in V.MEASURED) + ')')} AS aqi, temperature_2m
FROM hourly LEFT JOIN weather USING (city, timestamp) QUALIFY row_number() OVER (PARTITION BY city, station_id, timestamp ORDER BY run DESC) = 1"""))
def job_refresh(spark, d):
    """The readings table after two overlapping refreshes: hours of the second run replace those of the first."""
    cities, weather = V.stations(spark, d).select("station_id", "city"), V.city_weather(spark, d)
    path = work_path(spark, "readings")
    for rows in runs(spark, d, V.measurements(spark, d).join(cities, "station_id")):
        jobs.refresh_readings(rows, weather, path)
    stored = I.read_table(spark, path).select("city", "station_id", "timestamp", "pm25", "co", "aqi", "temperature_2m")
    return V.rounded(stored, ["pm25", "co", "aqi"])


@query("job_drift", CHECKS["drift_summary"])
def job_drift(spark, d):
    """The scheduled drift run, repeated as after a failure: its summary from the stored history."""
    now, path = V.now_of(V.table(spark, d, "events")), work_path(spark, "drift-history")
    readings = V.readings(spark, d, since=V.back(now, days=30))
    for _ in range(2):
        summary = jobs.drift_run(readings, path, now, drifts.FEATURES)
    return summary.withColumn("drifted_features", F.array_join("drifted_features", ","))
