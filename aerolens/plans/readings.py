"""Queries: sources, cleaning, unit normalisation, joins and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import advisory, category, primary_pollutant, sub_index_of
from ..functions.numeric import floor_hour, safe_double, safe_timestamp
from ..operators import clean, joins, quality
from ..operators.ordered import latest_by
from ..session import work_path
from ..sources import files, payloads
from . import views as V
from .registry import query

R, M, S, W = V.READINGS_CTE, V.MEASUREMENTS_CTE, V.STATIONS_CTE, V.WEATHER_CTE


@query("aqi_station_hour", V.with_sql(R, select=f"""
SELECT *, {V.sql_category('aqi')} AS category FROM readings"""))
def aqi_station_hour(spark, d):
    return V.readings(spark, d).withColumn("category", category("aqi"))


ADVICE_SQL = "CASE WHEN aqi IS NULL THEN NULL " + " ".join(
    f"WHEN aqi <= {b} THEN '{t}'" for b, t in K.ADVISORIES if b) + f" ELSE '{K.ADVISORIES[-1][1]}' END"


@query("advisory", V.with_sql(R, select=f"SELECT station_id, timestamp, aqi, {ADVICE_SQL} AS advisory FROM readings"))
def advisory_query(spark, d):
    return V.readings(spark, d).select("station_id", "timestamp", "aqi", advisory("aqi").alias("advisory"))


def _closed(pollutant, v):
    """Sub-index without gaps: the first range whose upper end reaches the value."""
    cases = " ".join(
        f"WHEN {v} <= {float(hi)!r}e0 THEN {(ihi - ilo) / (hi - lo)!r}e0 * ({v} - {float(lo)!r}e0) + {float(ilo)!r}e0"
        for lo, hi, ilo, ihi in K.BREAKPOINTS[pollutant])
    return f"CASE WHEN {v} < 0 THEN NULL {cases} ELSE 500e0 END"


@query("sub_index_long", V.with_sql(M, select="SELECT event_id, parameter, " + ", ".join(
    V.sql_round("CASE parameter " + " ".join(f"WHEN '{p}' THEN {make(p, 'raw_value')}" for p in V.MEASURED) + " END") + f" AS {name}"
    for name, make in (("sub_index", V.sql_sub_index), ("gapless", _closed))) + " FROM measurements"))
def sub_index_long(spark, d):
    m = V.raw_measurements(spark, d)
    return m.select("event_id", "parameter", V.r6(sub_index_of("parameter", "raw_value")).alias("sub_index"),
                    V.r6(sub_index_of("parameter", "raw_value", strict=False)).alias("gapless"))


@query("weekly_trend", V.with_sql(R, """daily AS (
  SELECT station_id, CAST(timestamp + INTERVAL 330 MINUTE AS DATE) AS day, CAST(round_even(avg(aqi), 0) AS INTEGER) AS a
  FROM readings WHERE aqi IS NOT NULL GROUP BY 1, 2)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS rn FROM daily)""", """lists AS (
  SELECT station_id, list(a ORDER BY day) AS l FROM ranked WHERE rn <= 7 GROUP BY 1)""", select="""
SELECT station_id, CASE WHEN l IS NULL THEN '0,0,0,0,0,0,0'
  ELSE array_to_string(list_concat(list_transform(range(7 - len(l)), lambda x: l[1]), l), ',') END AS weekly_trend
FROM (SELECT DISTINCT station_id FROM readings) LEFT JOIN lists USING (station_id)"""))
def weekly_trend(spark, d):
    return clean.weekly_trend(V.readings(spark, d)).select(
        "station_id", F.concat_ws(",", "weekly_trend").alias("weekly_trend"))


@query("unit_normalize", V.with_sql(M, select=f"""
SELECT event_id, parameter, raw_unit, units, {V.sql_round('value')} AS value FROM measurements
WHERE parameter IN ('pm25', 'pm10', 'no2', 'so2', 'co') AND value IS NOT NULL"""))
def unit_normalize(spark, d):
    m = V.normalized(payloads.target_measurements(V.raw_measurements(spark, d), "raw_value"))
    return m.select("event_id", "parameter", "raw_unit", "units", V.r6("value").alias("value"))


@query("station_hour_mean", V.with_sql(V.RAW_CTE, select=f"""
SELECT date_trunc('hour', measurement_time) AS timestamp, station_id,
  CASE WHEN sensor_id % 7 = 0 THEN NULL ELSE 'Z' || CAST(sensor_id % 3 AS VARCHAR) END AS state,
  {V.sql_round('avg(raw_value)')} AS value, {V.sql_round('avg(CAST(k AS DOUBLE))')} AS k
FROM raw GROUP BY 1, 2, 3"""))
def station_hour_mean(spark, d):
    m = V.raw_measurements(spark, d)
    wide = m.select(
        F.col("measurement_time").alias("timestamp"), "station_id",
        F.when(F.col("sensor_id") % 7 != 0, F.concat(F.lit("Z"), (F.col("sensor_id") % 3).cast("string"))).alias("state"),
        F.col("raw_value").alias("value"), F.col("k").cast("double").alias("k"))
    return V.rounded(clean.station_hour_mean(wide, ["station_id", "state"], ["value", "k"]), ["value", "k"])


@query("pivot_parameters", V.with_sql(R, select="SELECT * EXCLUDE (aqi), CAST(NULL AS DOUBLE) AS o3 FROM readings"))
def pivot_parameters(spark, d):
    wide = clean.pivot_parameters(V.measurements(spark, d), ["station_id"], (*V.MEASURED, "o3"))
    return V.rounded(wide, V.MEASURED)


@query("readings_enriched", V.with_sql(R, S, select="""
SELECT timestamp, station_id, pm25, aqi, station_name, city, state FROM readings LEFT JOIN stations USING (station_id)
WHERE lower(city) = 'asia' AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'"""))
def readings_enriched(spark, d):
    r = V.readings(spark, d, "2024-01-03", "2024-01-20").transform(clean.between_dates, "2024-01-03", "2024-01-20")
    joined = joins.with_station(r, V.stations(spark, d)).transform(clean.only_city, "ASIA")
    return joined.select("timestamp", "station_id", "pm25", "aqi", "station_name", "city", "state")


@query("city_semi", V.with_sql(R, S, select="""
SELECT timestamp, station_id, city, aqi FROM readings JOIN stations USING (station_id)
WHERE lower(city) IN (SELECT lower(r_name) FROM region WHERE r_regionkey < 3)"""))
def city_semi(spark, d):
    config = V.table(spark, d, "region").where("r_regionkey < 3").select(F.initcap("r_name").alias("city"))
    r = V.readings(spark, d).join(V.stations(spark, d), "station_id")
    return joins.keep_known_cities(r, config).select("timestamp", "station_id", "city", "aqi")


@query("coords_default", V.with_sql(R, """config AS (
  SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS station_id, n_nationkey * 1.5e0 AS latitude, n_nationkey + 70e0 AS longitude
  FROM nation WHERE n_regionkey <> 1)""", select="""
SELECT timestamp, station_id, aqi, coalesce(latitude, 13.0827e0) AS latitude, coalesce(longitude, 80.2707e0) AS longitude
FROM readings LEFT JOIN config USING (station_id)"""))
def coords_default(spark, d):
    config = V.table(spark, d, "nation").where("n_regionkey <> 1").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station_id"),
        (F.col("n_nationkey") * F.lit(1.5)).alias("latitude"), (F.col("n_nationkey") + F.lit(70.0)).alias("longitude"))
    r = V.readings(spark, d).select("timestamp", "station_id", "aqi")
    return joins.with_coordinates(r, config, K.DEFAULT_COORDINATES)


@query("weather_join", V.with_sql(R, S, W, select="""
SELECT timestamp, station_id, city, pm25, aqi, temperature_2m, wind_speed_10m, wind_direction_10m
FROM readings JOIN stations USING (station_id) LEFT JOIN weather USING (timestamp, city)"""))
def weather_join(spark, d):
    s = V.stations(spark, d)
    r = joins.with_station(V.readings(spark, d), s.select("station_id", "city"))
    return joins.with_city_weather(r, V.city_weather(spark, d)).select(
        "timestamp", "station_id", "city", "pm25", "aqi", "temperature_2m", "wind_speed_10m", "wind_direction_10m")


def weather_payloads(spark, d):
    """Hourly weather as struct-of-arrays JSON, one object per city and day."""
    w = V.city_weather(spark, d)
    hour = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *K.WEATHER)
    per_day = w.groupBy("city", F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(hour)).alias("h"))
    arrays = F.struct(*[F.col(f"h.{c}").alias(c) for c in ("time", *K.WEATHER)])
    return per_day.select("city", F.to_json(F.struct(arrays.alias("hourly"))).alias("payload"))


@query("weather_fanout", V.with_sql(V.RAW_CTE, S, W, select="""
SELECT station_id, city, timestamp, temperature_2m, precipitation, wind_direction_10m
FROM weather JOIN stations USING (city)"""))
def weather_fanout(spark, d):
    weather = payloads.flatten_weather(weather_payloads(spark, d))
    return joins.weather_to_stations(V.stations(spark, d), weather).select(
        "station_id", "city", "timestamp", "temperature_2m", "precipitation", "wind_direction_10m")


@query("current_weather", V.with_sql(V.RAW_CTE, S, W, select="""
SELECT city, timestamp, temperature_2m, relative_humidity_2m, cloud_cover FROM weather"""))
def current_weather(spark, d):
    w = V.city_weather(spark, d)
    current = w.select(
        "city", (F.col("timestamp") + F.expr("interval 17 minutes")).alias("fetched_at"),
        F.to_json(F.struct(F.struct(*K.WEATHER).alias("current"))).alias("payload"))
    return payloads.current_weather(current).select(
        "city", "timestamp", "temperature_2m", "relative_humidity_2m", "cloud_cover")


@query("live_merge", V.with_sql(M, S, W, """keyed AS (
  SELECT city, station_id, date_trunc('hour', measurement_time) AS timestamp, event_id, value FROM measurements JOIN stations USING (station_id))""",
  """newest AS (SELECT *, row_number() OVER (PARTITION BY city, station_id, timestamp ORDER BY event_id DESC) AS rn FROM keyed)""",
  select=f"""
SELECT city, station_id, timestamp, event_id, {V.sql_round('value')} AS value, temperature_2m
FROM newest LEFT JOIN weather USING (city, timestamp) WHERE rn = 1"""))
def live_merge(spark, d):
    s = V.stations(spark, d).select("station_id", "city")
    m = V.measurements(spark, d).join(s, "station_id").select(
        "city", "station_id", floor_hour("measurement_time").alias("timestamp"), "event_id", V.r6("value").alias("value"))
    weather = V.city_weather(spark, d).select("city", "timestamp", "temperature_2m")
    return joins.merge_live(m, weather, ["event_id"]).select(
        "city", "station_id", "timestamp", "event_id", "value", "temperature_2m")


@query("stations_without_metadata", V.with_sql(S, select="""
SELECT DISTINCT 'S' || CAST(user_id % 40 AS VARCHAR) AS station_id FROM events
WHERE 'S' || CAST(user_id % 40 AS VARCHAR) NOT IN (SELECT station_id FROM stations)"""))
def stations_without_metadata(spark, d):
    ids = V.table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("station_id"))
    return joins.without_metadata(ids, V.stations(spark, d))


@query("fetch_todo", """
SELECT r_name AS city, min(n_nationkey) * 1.5e0 AS latitude, min(n_nationkey) + 70e0 AS longitude
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY 1""")
def fetch_todo(spark, d):
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = n.select(F.col("r_name").alias("city"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("station_id"),
                 (F.col("n_nationkey") * F.lit(1.5)).alias("latitude"), (F.col("n_nationkey") + F.lit(70.0)).alias("longitude"))
    fetched = V.table(spark, d, "region").where("r_regionkey = 2").select(F.col("r_name").alias("city"))
    return joins.cities_to_fetch(s, fetched)


def registry_payloads(spark, d):
    """One registry object per sensor owner; its (at most five) sensors as a list or as JSON text."""
    m = V.raw_measurements(spark, d)
    owned = m.groupBy("sensor_id", "station_id").agg(F.sort_array(F.collect_set("parameter")).alias("ps"))
    owner = F.col("sensor_id")
    sensor = F.transform("ps", lambda p, i: F.struct(
        F.when(i != 4, owner * 10 + i).alias("id"),
        F.struct(p.alias("name"), F.lit("ug/m3").alias("units")).alias("parameter")))
    plain = F.transform("ps", lambda p, i: F.struct(
        (owner * 10 + i).alias("id"), p.alias("parameter"), F.lit("ppb").alias("units")))
    head = [F.col("station_id"), F.concat(F.lit("City"), (owner % 5).cast("string")).alias("city"),
            F.concat(F.lit("Name"), owner.cast("string")).alias("station_name"),
            owner.alias("openaq_location_id"), F.concat(F.lit("Loc"), owner.cast("string")).alias("openaq_location_name")]
    return owned.select(
        F.when(owner % 3 == 0, F.to_json(F.struct(*head, sensor.alias("available_sensors"))))
        .when(owner % 3 == 1, F.to_json(F.struct(*head, F.to_json(sensor).alias("available_sensors"))))
        .otherwise(F.to_json(F.struct(*head, plain.alias("available_sensors")))).alias("payload"))


REGISTRY_CTE = """owned AS (
  SELECT sensor_id AS owner, station_id, parameter,
    row_number() OVER (PARTITION BY sensor_id ORDER BY parameter) - 1 AS i
  FROM (SELECT DISTINCT sensor_id, station_id, parameter FROM raw)), registry AS (
  SELECT station_id, 'City' || CAST(owner % 5 AS VARCHAR) AS city, 'Name' || CAST(owner AS VARCHAR) AS station_name,
    owner AS openaq_location_id, 'Loc' || CAST(owner AS VARCHAR) AS openaq_location_name,
    owner * 10 + i AS sensor_id, parameter, CASE WHEN owner % 3 = 2 THEN 'ppb' ELSE 'ug/m3' END AS units
  FROM owned WHERE owner % 3 = 2 OR i <> 4)"""


@query("sensor_registry_explode", V.with_sql(V.RAW_CTE, REGISTRY_CTE, select="SELECT * FROM registry"))
def sensor_registry_explode(spark, d):
    return payloads.explode_registry(registry_payloads(spark, d))


@query("location_sensors", V.with_sql(V.RAW_CTE, select="""
, owned AS (SELECT sensor_id AS owner, parameter, row_number() OVER (PARTITION BY sensor_id ORDER BY parameter) - 1 AS i
  FROM (SELECT DISTINCT sensor_id, parameter FROM raw))
SELECT owner AS location_id, owner * 10 + i AS sensor_id, parameter, 'ug/m3' AS units, upper(parameter) AS display_name
FROM owned WHERE owner * 10 + i <> 0"""))
def location_sensors(spark, d):
    m = V.raw_measurements(spark, d)
    owned = m.groupBy("sensor_id").agg(F.sort_array(F.collect_set("parameter")).alias("ps"))
    sensors = F.transform("ps", lambda p, i: F.struct(
        (F.col("sensor_id") * 10 + i).alias("id"),
        F.struct(p.alias("name"), F.lit("ug/m3").alias("units"), F.upper(p).alias("displayName")).alias("parameter")))
    doc = owned.select(F.to_json(F.struct(F.col("sensor_id").alias("id"), sensors.alias("sensors"))).alias("payload"))
    return payloads.location_sensors(doc)


@query("measurement_json", V.with_sql(M, select=f"""
SELECT event_id, sensor_id, date_trunc('second', measurement_time) AS measurement_time, parameter, raw_value, raw_unit, units,
  {V.sql_round('value')} AS value FROM measurements"""))
def measurement_json(spark, d):
    m = V.raw_measurements(spark, d)
    at = F.struct(F.date_format("measurement_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))
    value = F.col("raw_value").alias("value")

    def doc(period):
        return F.to_json(F.struct(value, period.alias("period")))

    # The four shapes a period comes in, by turns.
    shape = F.col("event_id") % 4
    landed = m.select("event_id", "sensor_id", "parameter", "raw_unit", (
        F.when(shape == 0, doc(F.struct(at.alias("datetimeFrom"))))
        .when(shape == 1, doc(F.array(F.struct(at.alias("datetimeFrom")))))
        .when(shape == 2, doc(F.struct(F.array(at).alias("datetimeFrom"))))
        .otherwise(doc(F.array(F.struct(F.array(at).alias("datetimeFrom"))))).alias("payload")))
    rows = payloads.target_measurements(payloads.flatten_measurements(landed), "raw_value")
    return rows.select("event_id", "sensor_id", "measurement_time", "parameter", "raw_value", "raw_unit", "units",
                       V.r6("value").alias("value"))


@query("measurement_registry", V.with_sql(V.RAW_CTE, """registry AS (
  SELECT c_custkey AS sensor_id, c_name AS location_name, c_nationkey AS location_id FROM customer)""", select="""
SELECT event_id, sensor_id, location_name, location_id, parameter, raw_value FROM raw JOIN registry USING (sensor_id)"""))
def measurement_registry(spark, d):
    registry = V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("sensor_id"), F.col("c_name").alias("location_name"), F.col("c_nationkey").alias("location_id"))
    return joins.with_registry(V.raw_measurements(spark, d), registry).select(
        "event_id", "sensor_id", "location_name", "location_id", "parameter", "raw_value")


@query("location_choice", """
WITH loc AS (
  SELECT s_nationkey AS city, s_name AS name, s_suppkey AS position,
    CASE WHEN s_acctbal >= 0 THEN TIMESTAMP '2024-01-01' + CAST(floor(s_acctbal) AS INTEGER) * INTERVAL 1 HOUR END AS last_seen
  FROM supplier),
hints AS (
  SELECT n_nationkey AS city, 0 AS hint_order, CAST(n_nationkey AS VARCHAR) || '1' AS hint FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 1, 'SUPPLIER#00000000' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0),
m AS (
  SELECT loc.city, name, position, last_seen, min(hint_order) AS hint_order
  FROM loc LEFT JOIN hints ON loc.city = hints.city AND contains(lower(name), lower(hint)) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY hint_order NULLS LAST,
    CASE WHEN hint_order IS NULL THEN last_seen END DESC NULLS LAST, position) AS rn FROM m)
SELECT city, name, position, last_seen, hint_order FROM r WHERE rn = 1""")
def location_choice(spark, d):
    seen = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor("s_acctbal").cast("int"))
    locations = V.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("city"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("position"),
        F.when(F.col("s_acctbal") >= 0, seen).alias("last_seen"))
    n = V.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("city"))
    code = F.col("city").cast("string")
    hints = n.select("city", F.inline(F.array(
        F.struct(F.lit(0).alias("hint_order"), F.concat(code, F.lit("1")).alias("hint")),
        F.struct(F.lit(1).alias("hint_order"), F.concat(F.lit("SUPPLIER#00000000"), code).alias("hint")))))
    return joins.choose_location(locations, hints, ["city"]).select("city", "name", "position", "last_seen", "hint_order")


@query("quality_report", V.with_sql(R, S, """t AS (
  SELECT timestamp, station_id, CASE WHEN aqi > 450 THEN NULL ELSE city END AS city, pm25 - 0.5e0 AS pm25, no2, aqi
  FROM readings JOIN stations USING (station_id)
  UNION ALL SELECT timestamp, station_id, 'again', pm25, no2, aqi FROM readings WHERE aqi > 300)""", select="""
SELECT 'null_keys' AS rule, count(*) AS failures, count(*) = 0 AS passed FROM t WHERE timestamp IS NULL OR station_id IS NULL OR city IS NULL
UNION ALL SELECT 'duplicate_station_hours', CAST(coalesce(sum(n - 1), 0) AS BIGINT), coalesce(sum(n - 1), 0) = 0 FROM (SELECT count(*) n FROM t GROUP BY timestamp, station_id)
UNION ALL SELECT 'negative_pm25', count(*), count(*) = 0 FROM t WHERE pm25 < 0
UNION ALL SELECT 'negative_no2', count(*), count(*) = 0 FROM t WHERE no2 < 0
UNION ALL SELECT 'negative_aqi', count(*), count(*) = 0 FROM t WHERE aqi < 0"""))
def quality_report(spark, d):
    r = V.readings(spark, d)
    base = joins.with_station(r, V.stations(spark, d).select("station_id", "city")).select(
        "timestamp", "station_id", F.when(F.coalesce(F.col("aqi") <= 450, F.lit(True)), F.col("city")).alias("city"),
        (F.col("pm25") - 0.5).alias("pm25"), "no2", "aqi")
    again = r.where("aqi > 300").select("timestamp", "station_id", F.lit("again").alias("city"), "pm25", "no2", "aqi")
    return quality.quality_rules(base.unionByName(again))


@query("station_label", V.with_sql(S, V.RAW_CTE, select="""
SELECT DISTINCT sensor_id, 'openaq' || CAST(sensor_id AS VARCHAR) AS location_key,
  city || ' - ' || station_name || ' (' || station_id || ')' AS label
FROM raw JOIN stations USING (station_id)"""))
def station_label(spark, d):
    ids = V.raw_measurements(spark, d).select("sensor_id", "station_id").distinct()
    return ids.join(V.stations(spark, d), "station_id").select(
        "sensor_id", clean.location_key("sensor_id").alias("location_key"),
        clean.station_label("city", "station_name", "station_id").alias("label"))


@query("display_time", """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %H:%M') AS shown FROM events""")
def display_time(spark, d):
    return V.table(spark, d, "events").select("event_id", clean.display_time("ts").alias("shown"))


@query("union_batches", V.with_sql(R, select="""
SELECT station_id, timestamp, aqi, CAST(NULL AS VARCHAR) AS source FROM readings WHERE aqi <= 100
UNION ALL SELECT station_id, timestamp, aqi, 'high' FROM readings WHERE aqi > 100"""))
def union_batches(spark, d):
    r = V.readings(spark, d).select("station_id", "timestamp", "aqi")
    high = r.where("aqi > 100").withColumn("source", F.lit("high"))
    return r.where("aqi <= 100").unionByName(high, allowMissingColumns=True)


@query("coerce_clean", """
WITH t AS (
  SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v,
    TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS timestamp
  FROM events)
SELECT event_id, timestamp, CASE WHEN isnan(v) THEN NULL ELSE v END AS value FROM t
WHERE timestamp IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)""")
def coerce_clean(spark, d):
    e = V.table(spark, d, "events")
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "N/A").when(kind == 1, "NaN").when(kind == 2, "").otherwise(F.col("value").cast("string"))
    when = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    typed = e.select("event_id", safe_timestamp(when).alias("timestamp"), safe_double(text).alias("value"))
    return clean.drop_empty(typed, ["timestamp"], ["value"])


@query("align_columns", V.with_sql(R, select="""
SELECT coalesce(pm25, 0) AS pm25, 0e0 AS xylene, coalesce(aqi, 0) AS aqi FROM readings"""))
def align_columns(spark, d):
    return clean.align_columns(V.readings(spark, d), ["pm25", "xylene", "aqi"], fill=0.0)


@query("primary_pollutant", V.with_sql(R, select="""
, z AS (SELECT station_id, timestamp, coalesce(pm25, 0) a, coalesce(pm10, 0) b, coalesce(no2, 0) c, coalesce(so2, 0) d, coalesce(co, 0) e FROM readings),
g AS (SELECT *, greatest(a, b, c, d, e) AS m FROM z)
SELECT station_id, timestamp, CASE m WHEN a THEN 'PM2.5' WHEN b THEN 'PM10' WHEN c THEN 'NO2' WHEN d THEN 'SO2' ELSE 'CO' END AS primary_pollutant FROM g"""))
def primary_pollutant_query(spark, d):
    return V.readings(spark, d).select(
        "station_id", "timestamp", primary_pollutant(V.MEASURED).alias("primary_pollutant"))


@query("csv_roundtrip", V.with_sql(R, select="SELECT station_id, timestamp, pm25, no2, aqi FROM readings"))
def csv_roundtrip(spark, d):
    header = ["StationId", "Datetime", "PM2.5", "NO2", "AQI"]
    path = work_path(spark, "csv")
    r = V.readings(spark, d).select("station_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("t"), "pm25", "no2", "aqi")
    files.write_report(r.toDF(*header), path, "csv")
    return files.read_readings_csv(spark, path)


@query("parquet_roundtrip", V.with_sql(R, select="SELECT station_id, timestamp, aqi FROM readings WHERE station_id IN ('S1', 'S7')"))
def parquet_roundtrip(spark, d):
    path = work_path(spark, "readings")
    files.write_readings(V.readings(spark, d), path)
    return files.read_readings(spark, path, ["station_id", "timestamp", "aqi"], ["S1", "S7"])


@query("json_report", V.with_sql(R, select=f"SELECT station_id, count(*) AS n, {V.sql_round('avg(aqi)')} AS mean FROM readings GROUP BY 1"))
def json_report(spark, d):
    path = work_path(spark, "report")
    r = V.readings(spark, d).groupBy("station_id").agg(F.count("*").alias("n"), V.r6(F.avg("aqi")).alias("mean"))
    files.write_report(r, path)
    return spark.read.schema(r.schema).json(path)


@query("float32_table", V.with_sql(R, select="SELECT station_id, timestamp, CAST(CAST(pm25 AS FLOAT) AS DOUBLE) AS pm25, CAST(CAST(aqi AS FLOAT) AS DOUBLE) AS aqi FROM readings"))
def float32_table(spark, d):
    path = work_path(spark, "float32")
    files.to_float32(V.readings(spark, d).select("station_id", "timestamp", "pm25", "aqi")).write.parquet(path)
    return spark.read.parquet(path).selectExpr("station_id", "timestamp", "double(pm25) AS pm25", "double(aqi) AS aqi")


@query("latest_row", V.with_sql(R, select="""
SELECT station_id, timestamp, pm25, aqi FROM readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1"""))
def latest_row(spark, d):
    return latest_by(V.readings(spark, d), ["station_id"], ["timestamp"]).select("station_id", "timestamp", "pm25", "aqi")
