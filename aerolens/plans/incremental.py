"""Queries: upserts, watermarks, fetch plans, retention and schema changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import floor_hour
from ..operators import incremental as I
from ..session import work_path
from ..sources import payloads
from . import views as V
from .registry import query

# The stored table holds the first two thirds of the event ids, the batch the last half.
BOUNDS = "b AS (SELECT max(event_id) * 2 // 3 AS upper, max(event_id) // 2 AS lower FROM events)"
HOURLY_CTE = V.RAW_CTE + ", " + BOUNDS + """, hourly AS (
  SELECT sensor_id, parameter, date_trunc('hour', measurement_time) AS measurement_time, event_id, raw_value FROM raw),
stored_all AS (SELECT hourly.* FROM hourly, b WHERE event_id <= upper), batch AS (SELECT hourly.* FROM hourly, b WHERE event_id > lower),
stored AS (SELECT * FROM stored_all QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY event_id) = 1)"""
KEYS = ["sensor_id", "measurement_time"]


def hourly(spark, d):
    return V.raw_measurements(spark, d).select(
        "sensor_id", "parameter", floor_hour("measurement_time").alias("measurement_time"), "event_id", "raw_value")


def stored_and_batch(spark, d):
    m = hourly(spark, d)
    top = V.scalar(V.table(spark, d, "events"), F.max("event_id"))
    stored = I.rekey(m.where(F.col("event_id") <= top * 2 // 3), KEYS, ["event_id"])
    return stored, m.where(F.col("event_id") > top // 2)


@query("insert_or_replace", V.with_sql(HOURLY_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM stored UNION ALL SELECT *, 1 FROM batch)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src DESC, event_id DESC) = 1"""))
def insert_or_replace(spark, d):
    stored, batch = stored_and_batch(spark, d)
    return I.insert_or_replace(stored, batch, KEYS, ["event_id"])


@query("insert_or_ignore", V.with_sql(HOURLY_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM stored UNION ALL SELECT *, 1 FROM batch)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src, event_id) = 1"""))
def insert_or_ignore(spark, d):
    stored, batch = stored_and_batch(spark, d)
    return I.insert_or_ignore(stored, batch, KEYS, ["event_id"])


@query("inserted_count", V.with_sql(HOURLY_CTE, select="""
SELECT count(*) AS inserted FROM (SELECT DISTINCT sensor_id, measurement_time FROM batch) x
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.sensor_id = x.sensor_id AND s.measurement_time = x.measurement_time)"""))
def inserted_count(spark, d):
    stored, batch = stored_and_batch(spark, d)
    return I.new_rows(stored, batch, KEYS, ["event_id"]).agg(F.count("*").alias("inserted"))


@query("table_upsert", V.with_sql(HOURLY_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM stored UNION ALL SELECT *, 1 FROM batch)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src DESC, event_id DESC) = 1"""))
def table_upsert(spark, d):
    stored, batch = stored_and_batch(spark, d)
    path = work_path(spark, "hourly")
    I.upsert_table(path, stored, KEYS, ["event_id"], "measurement_time")
    I.upsert_table(path, batch, KEYS, ["event_id"], "measurement_time")
    return I.read_table(spark, path).drop("date")


@query("table_insert", V.with_sql(HOURLY_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM stored UNION ALL SELECT *, 1 FROM batch)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src, event_id) = 1"""))
def table_insert(spark, d):
    stored, batch = stored_and_batch(spark, d)
    path = work_path(spark, "hourly")
    I.insert_into_table(path, stored, KEYS, ["event_id"])
    I.insert_into_table(path, batch, KEYS, ["event_id"])
    return I.read_table(spark, path).drop("date")


# Every seventh sensor's rows have lost their time.
TIMELESS = "CASE WHEN sensor_id % 7 <> 0 THEN measurement_time END"
TIMELESS_CTE = HOURLY_CTE + f""", s2 AS (SELECT * REPLACE ({TIMELESS} AS measurement_time) FROM stored_all), b2 AS (SELECT * REPLACE ({TIMELESS} AS measurement_time) FROM batch)"""


def timeless(df):
    return df.withColumn("measurement_time", F.expr(TIMELESS))


@query("table_upsert_null_time", V.with_sql(TIMELESS_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM s2 UNION ALL SELECT *, 1 FROM b2)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src DESC, event_id DESC) = 1"""))
def table_upsert_null_time(spark, d):
    """Two batches with rows without a time, the second one replayed."""
    m = hourly(spark, d)
    top = V.scalar(V.table(spark, d, "events"), F.max("event_id"))
    path = work_path(spark, "hourly")
    for batch in (m.where(F.col("event_id") <= top * 2 // 3), m.where(F.col("event_id") > top // 2), m.where(F.col("event_id") > top // 2)):
        I.upsert_table(path, timeless(batch), KEYS, ["event_id"], "measurement_time")
    return I.read_table(spark, path).drop("date")


@query("table_insert_null_time", V.with_sql(TIMELESS_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value FROM (SELECT *, 0 AS src FROM s2 UNION ALL SELECT *, 1 FROM b2)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src, event_id) = 1"""))
def table_insert_null_time(spark, d):
    m = hourly(spark, d)
    top = V.scalar(V.table(spark, d, "events"), F.max("event_id"))
    path = work_path(spark, "hourly")
    for batch in (m.where(F.col("event_id") <= top * 2 // 3), m.where(F.col("event_id") > top // 2), m.where(F.col("event_id") > top // 2)):
        I.insert_into_table(path, timeless(batch), KEYS, ["event_id"])
    return I.read_table(spark, path).drop("date")


@query("table_new_column", V.with_sql(HOURLY_CTE, select="""
SELECT sensor_id, parameter, measurement_time, event_id, raw_value, CASE WHEN src = 1 THEN event_id % 5 END AS quality
FROM (SELECT *, 0 AS src FROM stored_all UNION ALL SELECT *, 1 FROM batch)
QUALIFY row_number() OVER (PARTITION BY sensor_id, measurement_time ORDER BY src DESC, event_id DESC) = 1"""))
def table_new_column(spark, d):
    """A batch with a column that the stored days do not have."""
    m = hourly(spark, d)
    top = V.scalar(V.table(spark, d, "events"), F.max("event_id"))
    path = work_path(spark, "hourly")
    I.upsert_table(path, m.where(F.col("event_id") <= top * 2 // 3), KEYS, ["event_id"], "measurement_time")
    wider = m.where(F.col("event_id") > top // 2).withColumn("quality", F.col("event_id") % 5)
    I.upsert_table(path, wider, KEYS, ["event_id"], "measurement_time")
    return I.read_table(spark, path).drop("date")


@query("missing_time_now", """
SELECT event_id, coalesce(CASE WHEN event_id % 11 <> 0 THEN ts END, (SELECT max(ts) FROM events)) AS timestamp FROM events""")
def missing_time_now(spark, d):
    e = V.table(spark, d, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("timestamp"))
    return I.stamp_missing_time(rows, V.now_of(e))


REGISTRY_CTE = """old AS (
  SELECT c_custkey AS sensor_id, c_nationkey AS openaq_location_id, 'S' || CAST(c_nationkey AS VARCHAR) AS station_id, 'old' AS city, c_name AS station_name,
    'L' AS openaq_location_name, c_mktsegment AS parameter, 'ppb' AS units, TIMESTAMP '2024-01-01' AS last_fetched_hour, TIMESTAMP '2024-01-02' AS last_successful_sync
  FROM customer WHERE c_acctbal >= 0),
fresh AS (
  SELECT c_custkey AS sensor_id, c_nationkey AS openaq_location_id, 'S' || CAST(c_nationkey AS VARCHAR) AS station_id, 'new' AS city, c_name AS station_name,
    'L' AS openaq_location_name, lower(c_mktsegment) AS parameter, 'ug/m3' AS units FROM customer WHERE c_acctbal < 5000)"""


def registry(spark, d):
    c = V.table(spark, d, "customer")
    base = ["c_custkey AS sensor_id", "c_nationkey AS openaq_location_id", "concat('S', c_nationkey) AS station_id"]
    tail = ["c_name AS station_name", "'L' AS openaq_location_name"]
    old = c.where("c_acctbal >= 0").selectExpr(
        *base, "'old' AS city", *tail, "c_mktsegment AS parameter", "'ppb' AS units",
        "TIMESTAMP_NTZ '2024-01-01' AS last_fetched_hour", "TIMESTAMP_NTZ '2024-01-02' AS last_successful_sync")
    fresh = c.where("c_acctbal < 5000").selectExpr(
        *base, "'new' AS city", *tail, "lower(c_mktsegment) AS parameter", "'ug/m3' AS units",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_fetched_hour")
    return old, fresh


@query("registry_upsert", f"""WITH {REGISTRY_CTE}
SELECT coalesce(f.sensor_id, o.sensor_id) AS sensor_id, coalesce(f.openaq_location_id, o.openaq_location_id) AS openaq_location_id,
  coalesce(f.station_id, o.station_id) AS station_id, coalesce(f.city, o.city) AS city, coalesce(f.station_name, o.station_name) AS station_name,
  coalesce(f.openaq_location_name, o.openaq_location_name) AS openaq_location_name, coalesce(f.parameter, o.parameter) AS parameter,
  coalesce(f.units, o.units) AS units, o.last_fetched_hour,
  CASE WHEN f.sensor_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE o.last_successful_sync END AS last_successful_sync
FROM old o FULL JOIN fresh f ON o.sensor_id = f.sensor_id AND o.openaq_location_id = f.openaq_location_id""")
def registry_upsert(spark, d):
    old, fresh = registry(spark, d)
    return I.upsert_registry(old, fresh, "2024-02-01 00:00:00")


@query("registry_listing", f"WITH {REGISTRY_CTE} SELECT * FROM old ORDER BY city, station_id, parameter, sensor_id")
def registry_listing(spark, d):
    return I.ordered_registry(registry(spark, d)[0])


@query("watermarks", f"""WITH {REGISTRY_CTE}, w AS (SELECT user_id AS sensor_id, max(ts) AS m FROM events GROUP BY 1)
SELECT old.* REPLACE (coalesce(m, last_fetched_hour) AS last_fetched_hour,
  CASE WHEN m IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE last_successful_sync END AS last_successful_sync)
FROM old LEFT JOIN w USING (sensor_id)""")
def watermarks(spark, d):
    old, _ = registry(spark, d)
    return I.advance_watermarks(old, V.raw_measurements(spark, d), "2024-02-01 00:00:00")


@query("fetch_plan", """
WITH clock AS (SELECT date_trunc('hour', max(ts) - INTERVAL 2 HOUR) AS e FROM events),
w AS (SELECT user_id, max(ts) AS m FROM events GROUP BY 1),
s AS (SELECT c_custkey AS sensor_id, coalesce(m + INTERVAL 1 HOUR, e - INTERVAL 30 DAY) AS s, e FROM customer LEFT JOIN w ON c_custkey = user_id, clock)
SELECT sensor_id, date_trunc('hour', s) AS from_hour, e AS to_hour, CASE WHEN s > e THEN 'up_to_date' ELSE 'fetch' END AS status FROM s""")
def fetch_plan(spark, d):
    sensors = V.table(spark, d, "customer").select(F.col("c_custkey").alias("sensor_id"))
    return I.fetch_plan(sensors, V.raw_measurements(spark, d), V.now_of(V.table(spark, d, "events")))


@query("backfill_plan", V.with_sql(V.READINGS_CTE, """clock AS (SELECT max(ts) AS now FROM events)""", """up AS (
  SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS station_id, CASE WHEN n_nationkey % 4 <> 3 THEN date_trunc('hour', now) - (n_nationkey % 4) * INTERVAL 3 HOUR END AS latest_hour FROM nation, clock)""",
  """st AS (SELECT station_id, max(timestamp) AS m, count(*) FILTER (timestamp >= now - INTERVAL 200 HOUR) AS n FROM readings, clock GROUP BY 1)""",
  """j AS (SELECT station_id, coalesce(n, 0) AS row_count, m, latest_hour, coalesce(latest_hour, date_trunc('hour', now)) AS to_hour,
     coalesce(date_trunc('hour', m + INTERVAL 1 HOUR), coalesce(latest_hour, date_trunc('hour', now)) - INTERVAL 200 HOUR) AS from_hour FROM up LEFT JOIN st USING (station_id), clock)""", select="""
SELECT station_id, row_count, row_count < 168 OR m IS NULL OR coalesce(epoch(latest_hour - m) / 3600 > 1, false) AS need_backfill, from_hour, to_hour,
  CASE WHEN from_hour >= to_hour THEN 'cached' ELSE 'fetch' END AS status FROM j"""))
def backfill_plan(spark, d):
    now = V.now_of(V.table(spark, d, "events"))
    at = floor_hour(F.lit(now).cast("timestamp_ntz"))
    upstream = V.table(spark, d, "nation").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station_id"),
        F.when(F.col("n_nationkey") % 4 != 3, at - F.make_dt_interval(hours=F.col("n_nationkey") % 4 * 3)).alias("latest_hour"))
    return I.backfill_plan(V.readings(spark, d), upstream, now)


@query("latest_hours", V.with_sql(V.RAW_CTE, select="SELECT station_id, date_trunc('hour', max(measurement_time)) AS latest_hour FROM raw GROUP BY 1"))
def latest_hours(spark, d):
    return I.latest_hours(V.raw_measurements(spark, d), "station_id")


@query("freshness", V.with_sql(V.READINGS_CTE, select="""
SELECT station_id, max(timestamp) AS latest, round_even(CAST(floor(epoch((SELECT max(ts) FROM events) - max(timestamp))) AS BIGINT) / 3600, 2) AS age_hours
FROM readings GROUP BY 1"""))
def freshness(spark, d):
    return I.freshness(V.readings(spark, d), V.now_of(V.table(spark, d, "events")), ["station_id"])


@query("retention", V.with_sql(V.RAW_CTE, select="SELECT * FROM raw WHERE measurement_time >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"))
def retention(spark, d):
    return I.retain(V.raw_measurements(spark, d), V.now_of(V.table(spark, d, "events")), days=10, ts="measurement_time")


@query("table_retention", V.with_sql(V.RAW_CTE, select="SELECT * FROM raw WHERE measurement_time >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"))
def table_retention(spark, d):
    """A stored table after deletion of what is older than ten days: whole days, and a part of the day of the cut-off."""
    path, now = work_path(spark, "retained"), V.now_of(V.table(spark, d, "events"))
    raw = V.raw_measurements(spark, d)
    raw.withColumn("date", F.to_date("measurement_time")).hint("rebalance", "date").write.partitionBy("date").parquet(path)
    I.retain_table(spark, path, str(now), days=10, ts="measurement_time")
    return I.read_table(spark, path).select(*raw.columns)


@query("evolve_schema", V.with_sql(V.READINGS_CTE, select="""
SELECT station_id, timestamp, aqi, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS DOUBLE) AS nox, CAST(NULL AS DOUBLE) AS xylene FROM readings"""))
def evolve_schema(spark, d):
    r = V.readings(spark, d).select("station_id", "timestamp", "aqi")
    return I.evolve(r, {"state": "string", "aqi": "double", "nox": "double", "xylene": "double"})


@query("rekey", V.with_sql(V.RAW_CTE, select="""
SELECT CASE WHEN sensor_id % 9 <> 0 THEN station_id END AS station_id, date_trunc('hour', measurement_time) AS timestamp, event_id, raw_value FROM raw
QUALIFY row_number() OVER (PARTITION BY CASE WHEN sensor_id % 9 <> 0 THEN station_id END, date_trunc('hour', measurement_time) ORDER BY event_id) = 1"""))
def rekey(spark, d):
    m = V.raw_measurements(spark, d).select(
        F.when(F.col("sensor_id") % 9 != 0, F.col("station_id")).alias("station_id"),
        floor_hour("measurement_time").alias("timestamp"), "event_id", "raw_value")
    return I.rekey(m, ["station_id", "timestamp"], ["event_id"])


@query("latest_map", V.with_sql(V.MEASUREMENTS_CTE, f"""n AS (
  SELECT station_id, parameter, {V.sql_round('value')} AS value FROM measurements
  QUALIFY row_number() OVER (PARTITION BY station_id, parameter ORDER BY measurement_time DESC, event_id DESC) = 1)""", select="""
SELECT station_id, """ + ", ".join(f"max(value) FILTER (parameter = '{p}') AS {p}" for p in V.MEASURED) + ", count(*) AS n FROM n GROUP BY 1"))
def latest_map(spark, d):
    m = V.rounded(V.measurements(spark, d), ["value"])
    out = I.latest_values(m, ["station_id"], ["measurement_time", "event_id"])
    return out.selectExpr("station_id", *[f"pollutants['{p}'] AS {p}" for p in V.MEASURED], "CAST(size(pollutants) AS BIGINT) AS n")


@query("prediction_json", V.with_sql(V.READINGS_CTE, select="""
SELECT station_id, timestamp, CAST(round_even(aqi, 0) AS INTEGER) AS first_hour, coalesce(pm25, 0) AS pm25, CAST(24 AS INTEGER) AS hours FROM readings WHERE aqi IS NOT NULL"""))
def prediction_json(spark, d):
    r = V.readings(spark, d).where("aqi IS NOT NULL").selectExpr(
        "station_id", "timestamp", "array_repeat(CAST(rint(aqi) AS INT), 24) AS forecast",
        "map('PM2_5', coalesce(pm25, 0.0D), 'CO', coalesce(co, 0.0D)) AS pollutants", "array(1, 2, 3) AS weekly_trend")
    path = work_path(spark, "predictions")
    payloads.prediction_to_json(r).write.parquet(path)
    back = payloads.prediction_from_json(spark.read.parquet(path))
    return back.selectExpr("station_id", "timestamp", "forecast[0] AS first_hour", "pollutants['PM2_5'] AS pm25", "size(forecast) AS hours")
