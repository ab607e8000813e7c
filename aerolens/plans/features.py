"""Queries: fills, window features, targets, feature tables and feature selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.numeric import floor_hour
from ..operators import clean, joins, selection, series
from ..operators.incremental import recent
from ..operators.ordered import first_n, last_n, latest_by
from ..session import written
from . import jobs
from . import views as V
from .registry import query

R, S, W = V.READINGS_CTE, V.STATIONS_CTE, V.WEATHER_CTE
r = V.sql_round
COLUMNS = [*V.MEASURED, "aqi"]
WIN = "OVER (PARTITION BY station_id ORDER BY timestamp)"


def ffill_sql(c, source="readings"):
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def bfill_sql(c):
    return f"first_value({c} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


FILL_CTE = ("ff AS (SELECT station_id, timestamp, " + ", ".join(f"{ffill_sql(c)} AS {c}" for c in COLUMNS) + " FROM readings), "
            "med AS (SELECT station_id, " + ", ".join(f"median({c}) AS m_{c}" for c in COLUMNS) + " FROM ff GROUP BY 1), "
            "filled AS (SELECT station_id, timestamp, " + ", ".join(f"{r(f'coalesce({c}, m_{c}, 0)')} AS {c}" for c in COLUMNS)
            + " FROM ff JOIN med USING (station_id))")


def filled(spark, d):
    out = series.fill_offline(V.readings(spark, d), COLUMNS)
    return V.rounded(out, COLUMNS)


@query("fill_offline", V.with_sql(R, FILL_CTE, select="""
SELECT f.*, CAST(r.pm25 IS NULL AS INTEGER) AS pm25_was_missing, CAST(r.no2 IS NULL AS INTEGER) AS no2_was_missing
FROM filled f JOIN readings r USING (station_id, timestamp)"""))
def fill_offline(spark, d):
    flagged = series.add_missing_flags(V.readings(spark, d), ["pm25", "no2"])
    return V.rounded(series.fill_offline(flagged, COLUMNS), COLUMNS)


@query("fill_live", V.with_sql(R, """recent AS (
  SELECT * FROM readings WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 220 HOUR)""", select=
  "SELECT station_id, timestamp, " + ", ".join(f"coalesce({ffill_sql(c)}, {bfill_sql(c)}, 0) AS {c}" for c in COLUMNS) + " FROM recent"))
def fill_live(spark, d):
    now = V.now_of(V.table(spark, d, "events"))
    return series.fill_live(recent(V.readings(spark, d, since=V.back(now, hours=220)), now, 220), COLUMNS)


LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168)


@query("lag_features", V.with_sql(R, FILL_CTE, select="SELECT station_id, timestamp, " + ", ".join(
    f"lag({c}, {k}) {WIN} AS {c}_lag{k}" for c in ("pm25", "aqi") for k in LAGS) + " FROM filled"))
def lag_features(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "pm25", "aqi")
    return series.add_lags(f, ["pm25", "aqi"], LAGS).drop("pm25", "aqi")


def roll_sql(c, w, fn):
    return f"{fn}({c}) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


@query("rolling_features", V.with_sql(R, FILL_CTE, select="SELECT station_id, timestamp, " + ", ".join(
    f"{r(roll_sql('aqi', w, 'avg'), 4)} AS aqi_roll{w}_mean, {r(roll_sql('aqi', w, 'stddev_samp'), 4)} AS aqi_roll{w}_std" for w in (6, 24, 48, 168))
    + ", " + ", ".join(f"{roll_sql('aqi', w, fn)} AS aqi_roll{w}_{fn}" for w in (24, 168) for fn in ("max", "min")) + " FROM filled"))
def rolling_features(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    out = series.add_rolling(f, ["aqi"], (6, 24, 48, 168), extremes=(24, 168)).drop("aqi")
    return V.rounded(out, [c for c in out.columns if c.endswith(("_mean", "_std"))], 4)


@query("diff_features", V.with_sql(R, FILL_CTE, select="SELECT station_id, timestamp, " + ", ".join(
    f"{r(f'aqi - lag(aqi, {k}) {WIN}')} AS aqi_diff{k}" for k in (1, 3, 24)) + " FROM filled"))
def diff_features(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    out = series.add_diffs(f, "aqi", (1, 3, 24)).drop("aqi")
    return V.rounded(out, ["aqi_diff1", "aqi_diff3", "aqi_diff24"])


def cycle_sql(expr, period, name):
    return (f"{r(f'sin(2e0 * pi() * {expr} / {period}e0)')} AS {name}_sin, "
            f"{r(f'cos(2e0 * pi() * {expr} / {period}e0)')} AS {name}_cos")


@query("calendar_features", f"""
SELECT event_id, CAST(hour(t) AS INTEGER) AS hour_of_day, CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, CAST(month(t) AS INTEGER) AS month,
  CAST(year(t) AS INTEGER) AS year, CAST(dayofyear(t) AS INTEGER) AS day_of_year, CAST(isodow(t) >= 6 AS INTEGER) AS is_weekend,
  CASE WHEN month(t) IN (12, 1, 2) THEN 0 WHEN month(t) <= 5 THEN 1 WHEN month(t) <= 9 THEN 2 ELSE 3 END AS season,
  {cycle_sql('hour(t)', 24, 'hour')}, {cycle_sql('month(t)', 12, 'month')}, {cycle_sql('dayofyear(t)', 365, 'day_of_year')}
FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)""")
def calendar_features(spark, d):
    spec = replace(series.LIVE, zone="Asia/Kolkata")
    out = series.add_calendar(V.table(spark, d, "events").select("event_id", "ts"), spec, "ts").drop("ts")
    return V.rounded(out, [c for c in out.columns if c.endswith(("_sin", "_cos"))])


@query("lead_targets", V.with_sql(R, FILL_CTE, "t AS (SELECT station_id, timestamp, " + ", ".join(
    f"lead(aqi, {h}) {WIN} AS aqi_t{h}" for h in range(1, 25)) + " FROM filled)", select="SELECT * FROM t WHERE aqi_t24 IS NOT NULL"))
def lead_targets(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    return series.add_targets(f, "aqi", range(1, 25)).drop("aqi")


def feature_table(spark, d, spec=series.OFFLINE):
    """Readings with weather, filled and engineered: the training table."""
    s = V.stations(spark, d).select("station_id", "city")
    joined = joins.with_station(V.readings(spark, d), s).join(V.city_weather(spark, d), ["city", "timestamp"], "left")
    weather = [c for c in ("temperature_2m", "wind_speed_10m", "relative_humidity_2m", "wind_direction_10m") if c in joined.columns]
    kept = joined.select("station_id", "city", "timestamp", *COLUMNS, *weather)
    ready = V.rounded(series.fill_offline(kept, [*COLUMNS, *weather]), [*COLUMNS, *weather])
    return series.engineer(ready, spec)


JOINED_CTE = """joined AS (
  SELECT station_id, city, timestamp, pm25, pm10, no2, so2, co, aqi, temperature_2m, wind_speed_10m, relative_humidity_2m, wind_direction_10m
  FROM readings LEFT JOIN stations USING (station_id) LEFT JOIN weather USING (city, timestamp))"""
ALL = [*COLUMNS, "temperature_2m", "wind_speed_10m", "relative_humidity_2m", "wind_direction_10m"]
READY_CTE = ("ff AS (SELECT station_id, timestamp, " + ", ".join(f"{ffill_sql(c)} AS {c}" for c in ALL) + " FROM joined), "
             "med AS (SELECT station_id, " + ", ".join(f"median({c}) AS m_{c}" for c in ALL) + " FROM ff GROUP BY 1), "
             "ready AS (SELECT station_id, timestamp, " + ", ".join(f"{r(f'coalesce({c}, m_{c}, 0)')} AS {c}" for c in ALL)
             + " FROM ff JOIN med USING (station_id))")
SHOWN = {
    "pm25_lag168": f"lag(pm25, 168) {WIN}", "so2_lag3": f"lag(so2, 3) {WIN}", "no2_roll48_mean": roll_sql("no2", 48, "avg"),
    "co_roll6_std": roll_sql("co", 6, "stddev_samp"), "temperature_2m_lag24": f"lag(temperature_2m, 24) {WIN}",
    "wind_speed_10m_roll24_mean": roll_sql("wind_speed_10m", 24, "avg"), "aqi_diff24": f"aqi - lag(aqi, 24) {WIN}",
    "wind_dir_sin": "sin(2e0 * pi() * wind_direction_10m / 360e0)", "day_of_week_cos": "cos(2e0 * pi() * (isodow(timestamp) - 1) / 7e0)",
    "pm25_x_no2": "pm25 * no2",
}


@query("feature_table_offline", V.with_sql(R, S, W, JOINED_CTE, READY_CTE, "t AS (SELECT station_id, timestamp, aqi, " + ", ".join(
    f"{r(f'coalesce({e}, 0)', 4)} AS {n}" for n, e in SHOWN.items()) + ", " + ", ".join(
    f"lead(aqi, {h}) {WIN} AS aqi_t{h}" for h in (1, 24)) + " FROM ready)", select="SELECT * FROM t WHERE aqi_t24 IS NOT NULL"))
def feature_table_offline(spark, d):
    out = feature_table(spark, d).select("station_id", "timestamp", "aqi", *SHOWN, "aqi_t1", "aqi_t24")
    return V.rounded(out, list(SHOWN), 4)


LIVE_SHOWN = {
    "pm25_lag168": f"lag(pm25, 168) {WIN}", "aqi_roll168_max": roll_sql("aqi", 168, "max"), "aqi_roll24_min": roll_sql("aqi", 24, "min"),
    "so2_roll3_mean": roll_sql("so2", 3, "avg"), "no2_roll24_std": roll_sql("no2", 24, "stddev_samp"), "aqi_diff3": f"aqi - lag(aqi, 3) {WIN}",
    "precipitation_roll6_std": roll_sql("precipitation", 6, "stddev_samp"), "day_of_year_sin": "sin(2e0 * pi() * dayofyear(timestamp) / 365e0)",
    "season": "CASE WHEN month(timestamp) IN (12, 1, 2) THEN 0 WHEN month(timestamp) <= 5 THEN 1 WHEN month(timestamp) <= 9 THEN 2 ELSE 3 END",
    "pm25_x_wind": "pm25 * wind_speed_10m", "no2_x_temp": "no2 * temperature_2m", "benzene_lag1": "0e0",
    "wind_dir_sin": "sin(2e0 * pi() * wind_direction_10m / 360e0)", "wind_dir_cos": "cos(2e0 * pi() * wind_direction_10m / 360e0)",
}
LIVE_ALL = [*COLUMNS, "temperature_2m", "wind_speed_10m", "relative_humidity_2m", "precipitation"]


# The test stations report every second hour, so that enough rows lie in twice the usual 200 hours.
LIVE_HOURS = 400


def live_features(spark, d, spec=series.LIVE, flagged=()):
    """The newest feature row of every station with enough recent history; ``flagged`` columns get missingness flags."""
    now = V.now_of(V.table(spark, d, "events"))
    since = V.back(now, hours=LIVE_HOURS)
    s = V.stations(spark, d).select("station_id", "city")
    history = recent(V.readings(spark, d, since=since), now, LIVE_HOURS)
    joined = joins.with_station(history, s).join(V.city_weather(spark, d, since), ["city", "timestamp"], "left")
    # The wind direction is unknown every third hour, and not filled.
    wind = F.when(F.hour("timestamp") % 3 != 0, F.col("wind_direction_10m")).alias("wind_direction_10m")
    kept = series.enough_history(joined).select("station_id", "timestamp", *LIVE_ALL, wind)
    kept = series.add_missing_flags(kept, list(flagged)) if flagged else kept
    return series.engineer(series.fill_live(kept, LIVE_ALL), spec, last_only=True)


LIVE_CTE = ("h AS (SELECT station_id, timestamp, " + ", ".join(LIVE_ALL) + """, CASE WHEN hour(timestamp) % 3 <> 0 THEN wind_direction_10m END AS wind_direction_10m FROM readings LEFT JOIN stations USING (station_id)
  LEFT JOIN weather USING (city, timestamp) WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 400 HOUR), """
  "e AS (SELECT * FROM h WHERE station_id IN (SELECT station_id FROM h GROUP BY 1 HAVING count(*) >= 168)), "
  "live AS (SELECT station_id, timestamp, " + ", ".join(f"coalesce({ffill_sql(c)}, {bfill_sql(c)}, 0) AS {c}" for c in LIVE_ALL) + ", wind_direction_10m FROM e)")


@query("feature_table_live", V.with_sql(R, S, W, LIVE_CTE, "t AS (SELECT station_id, timestamp, " + ", ".join(
    f"{r(f'coalesce({e}, 0)', 4)} AS {n}" for n, e in LIVE_SHOWN.items()) + " FROM live)", select="""
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1"""))
def feature_table_live(spark, d):
    newest = live_features(spark, d)
    full = newest.withColumns({c: F.lit(0.0) for c in LIVE_SHOWN if c not in newest.columns})
    out = full.select("station_id", "timestamp", *LIVE_SHOWN).withColumn("season", F.col("season").cast("double"))
    return V.rounded(out, list(LIVE_SHOWN), 4)


@query("densified_lags", V.with_sql(R, """grid AS (
  SELECT station_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp
  FROM (SELECT station_id, min(timestamp) AS a, max(timestamp) AS b FROM readings GROUP BY 1))""", select=f"""
SELECT station_id, timestamp, aqi, lag(aqi, 24) {WIN} AS aqi_lag24 FROM grid LEFT JOIN readings USING (station_id, timestamp)"""))
def densified_lags(spark, d):
    grid = series.densify(V.readings(spark, d).select("station_id", "timestamp", "aqi"))
    return series.add_lags(grid, ["aqi"], (24,))


@query("sequence_windows", V.with_sql(R, FILL_CTE, f"""t AS (
  SELECT station_id, timestamp, list(aqi) OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l FROM filled)""", select=f"""
SELECT station_id, timestamp, CAST(len(l) AS INTEGER) AS steps, l[1] AS first_value, l[24] AS last_value, {r('list_sum(l)')} AS total FROM t WHERE len(l) = 24"""))
def sequence_windows(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    out = series.sequence_windows(f, ["aqi"], 24)
    total = F.aggregate("aqi_seq", F.lit(0.0), lambda a, x: a + x)
    return out.select("station_id", "timestamp", F.size("aqi_seq").alias("steps"), F.get("aqi_seq", F.lit(0)).alias("first_value"),
                      F.get("aqi_seq", F.lit(23)).alias("last_value"), V.r6(total).alias("total"))


@query("near_constant", """
WITH t AS (SELECT 'l_linestatus' AS feature, CAST(l_linestatus AS VARCHAR) AS v FROM lineitem UNION ALL SELECT 'l_tax', CAST(l_tax AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem),
c AS (SELECT feature, v, count(*) AS n FROM t GROUP BY 1, 2)
SELECT feature, count(*) AS n_values, (round(max(n) * 1e0 / sum(n) + 1e-9, 6) + 0e0) AS modal_share FROM c GROUP BY 1""")
def near_constant(spark, d):
    shares = selection.modal_share(V.table(spark, d, "lineitem"), ["l_linestatus", "l_tax", "l_linenumber"])
    return V.rounded(shares, ["modal_share"])


@query("missing_flags", V.with_sql(R, f"""rates AS (SELECT unnest({[*V.MEASURED]!r}) AS c, unnest([{', '.join(f'count(*) - count({c})' for c in V.MEASURED)}]) AS n,
  unnest([{', '.join(str(i) for i in range(len(V.MEASURED)))}]) AS i FROM readings)""", "top AS (SELECT c FROM rates ORDER BY n DESC, i LIMIT 2)",
  "flags AS (" + " UNION ALL ".join(f"SELECT station_id, timestamp, '{c}' AS feature, CAST({c} IS NULL AS INTEGER) AS was_missing FROM readings" for c in V.MEASURED) + ")",
  select="SELECT * FROM flags WHERE feature IN (SELECT c FROM top)"))
def missing_flags(spark, d):
    """Flags of the two columns of five that are missing most often."""
    table = V.readings(spark, d)
    top = selection.most_missing(table, list(V.MEASURED), 2)
    flagged = series.add_missing_flags(table, top).select(
        "station_id", "timestamp", *[F.col(f"{c}_was_missing").alias(c) for c in top])
    return flagged.unpivot(["station_id", "timestamp"], top, "feature", "was_missing")


@query("correlated_columns", f"""
WITH m AS (SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice * (1 - l_discount) AS c, l_tax AS d FROM lineitem),
p AS (SELECT 'b' AS feature, abs(corr(a, b)) AS x FROM m UNION ALL SELECT 'c', abs(corr(a, c)) FROM m UNION ALL SELECT 'c', abs(corr(b, c)) FROM m
  UNION ALL SELECT 'd', abs(corr(a, d)) FROM m UNION ALL SELECT 'd', abs(corr(b, d)) FROM m UNION ALL SELECT 'd', abs(corr(c, d)) FROM m)
SELECT DISTINCT feature FROM p WHERE x > 0.98""")
def correlated_columns(spark, d):
    m = V.table(spark, d, "lineitem").selectExpr(
        "l_quantity AS a", "l_extendedprice AS b", "l_extendedprice * (1 - l_discount) AS c", "l_tax AS d")
    found = selection.correlated_columns(m, ["a", "b", "c", "d"], 0.98)
    return spark.createDataFrame([(c,) for c in found], "feature string")


@query("duplicate_columns")
def duplicate_columns(spark, d):
    m = V.table(spark, d, "lineitem").selectExpr("l_quantity AS a", "l_tax AS b", "l_quantity + 0 AS c", "l_discount AS d")
    return selection.content_hashes(m, ["a", "b", "c", "d"])


def _same(a, b):
    return f"NOT EXISTS (SELECT {a} FROM m EXCEPT ALL SELECT {b} FROM m)"


@query("repeated_columns", f"""
WITH m AS (SELECT l_quantity AS a, l_tax AS b, l_quantity + 0 AS c, l_discount AS d FROM lineitem)
SELECT 'b' AS feature WHERE {_same('a', 'b')}
UNION ALL SELECT 'c' WHERE {_same('a', 'c')} OR {_same('b', 'c')}
UNION ALL SELECT 'd' WHERE {_same('a', 'd')} OR {_same('b', 'd')} OR {_same('c', 'd')}""")
def repeated_columns(spark, d):
    m = V.table(spark, d, "lineitem").selectExpr("l_quantity AS a", "l_tax AS b", "l_quantity + 0 AS c", "l_discount AS d")
    return spark.createDataFrame([(c,) for c in selection.duplicate_columns(m, ["a", "b", "c", "d"])], "feature string")


@query("drop_columns", V.with_sql(R, select="""
SELECT column_name FROM (SELECT unnest(['pm25', 'pm10', 'no2', 'so2', 'co', 'aqi']) AS column_name, unnest([
  avg(CAST(pm25 IS NULL AS INTEGER)), avg(CAST(pm10 IS NULL AS INTEGER)), avg(CAST(no2 IS NULL AS INTEGER)),
  avg(CAST(so2 IS NULL AS INTEGER)), avg(CAST(co IS NULL AS INTEGER)), 0]) AS rate FROM readings) WHERE rate > 0.73"""))
def drop_columns(spark, d):
    sparse = selection.sparse_columns(V.readings(spark, d), COLUMNS, 0.73)
    return spark.createDataFrame([(c,) for c in sparse], "column_name string")


TRAINING_ALL = [*COLUMNS, "temperature_2m", "wind_speed_10m", "relative_humidity_2m", "wind_direction_10m"]
TRAINING_CTE = V.with_sql(R, S, W, JOINED_CTE, READY_CTE, """st AS (
  SELECT station_id, coalesce(avg(aqi), 0) AS station_aqi_mean, coalesce(median(aqi), 0) AS station_aqi_median FROM joined GROUP BY 1)""", """ct AS (
  SELECT city, coalesce(avg(aqi), 0) AS city_aqi_mean, coalesce(median(aqi), 0) AS city_aqi_median, dense_rank() OVER (ORDER BY city) - 1 AS city_encoded
  FROM joined GROUP BY city)""", f"""t AS (SELECT r.station_id, j.city, r.timestamp, city_encoded, station_aqi_mean, station_aqi_median, city_aqi_mean, city_aqi_median, r.aqi,
  lead(r.aqi, 24) OVER (PARTITION BY r.station_id ORDER BY r.timestamp) AS aqi_t24
  FROM ready r JOIN joined j USING (station_id, timestamp) JOIN st USING (station_id) JOIN ct ON j.city = ct.city)""", select=f"""
SELECT station_id, city, timestamp, CAST(city_encoded AS INTEGER) AS city_encoded, {r('station_aqi_mean')} AS station_aqi_mean, {r('station_aqi_median')} AS station_aqi_median,
  {r('city_aqi_mean')} AS city_aqi_mean, {r('city_aqi_median')} AS city_aqi_median, aqi_t24,
  {{columns}} AS columns_kept FROM t WHERE aqi_t24 IS NOT NULL""")


def training_input(spark, d):
    s = V.stations(spark, d).select("station_id", "city")
    joined = joins.with_station(V.readings(spark, d), s).join(V.city_weather(spark, d), ["city", "timestamp"], "left")
    kept = joined.select("station_id", "city", "timestamp", *TRAINING_ALL)
    # Two columns that the job must drop: one constant, one that is nearly always missing.
    return kept.withColumns({"o3": F.lit(1.0), "nh3": F.when(F.hour("timestamp") == 3, 1.0 * F.dayofmonth("timestamp"))})


# Columns with over 65 % nulls, or one value (null is one) in 99.9 % of the rows.
DROPPED_SQL = """(SELECT coalesce(string_agg(feature || ' dropped', ', ' ORDER BY feature), '') FROM (
  SELECT feature FROM (SELECT feature, v, count(*) AS n FROM (
    SELECT 'o3' AS feature, 1e0 AS v FROM joined UNION ALL SELECT 'nh3', CASE WHEN hour(timestamp) = 3 THEN 1e0 * day(timestamp) END FROM joined) GROUP BY 1, 2)
  GROUP BY 1 HAVING coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n) > 0.65 OR max(n) / sum(n) >= 0.999))"""


@query("training_features", TRAINING_CTE.replace("{columns}", DROPPED_SQL))
def training_features(spark, d):
    """The composed training job: pruned, flagged, filled, engineered and encoded."""
    table, meta = jobs.engineered_training(training_input(spark, d))
    dropped = ", ".join(f"{c} dropped" for c in ("nh3", "o3") if c in meta["dropped"] and c not in table.columns)
    shown = ["station_aqi_mean", "station_aqi_median", "city_aqi_mean", "city_aqi_median", "aqi_t24"]
    return V.rounded(table.select("station_id", "city", "timestamp", "city_encoded", *shown), shown).withColumn("columns_kept", F.lit(dropped))


@query("selected_features")
def selected_features(spark, d):
    """The columns that the training job keeps, in order."""
    _, meta = jobs.training_features(training_input(spark, d))
    return spark.createDataFrame(list(enumerate(meta["selected"])), "position int, feature string")


CHOICE = {"a": "l_quantity", "b": "l_tax", "c": "l_quantity + 0", "d": "l_extendedprice", "e": "l_extendedprice * (1 - l_discount)", "f": "l_discount"}


def _close(name):
    """A column's largest absolute correlation with the unrepeated ones before it."""
    before = [x for x in CHOICE if x < name and x != "c"]
    return "greatest(" + ", ".join(f"coalesce(abs(corr({x}, {name})), 0)" for x in before) + ")" if before else "max(0)"


@query("chosen_features", f"""
WITH m AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CHOICE.items())} FROM lineitem),
repeated AS (""" + " UNION ALL ".join(
  f"SELECT '{c}' AS feature, {' OR '.join(f'NOT EXISTS (SELECT {x} FROM m EXCEPT ALL SELECT {c} FROM m)' for x in CHOICE if x < c) or 'false'} AS yes" for c in CHOICE) + """),
close AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_close(c)} > 0.98 AS yes FROM m" for c in CHOICE if c != "c") + """)
SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS position, feature FROM repeated JOIN close USING (feature)
WHERE NOT repeated.yes AND NOT close.yes ORDER BY 1 LIMIT 3""")
def chosen_features(spark, d):
    """The first three columns that neither repeat an earlier one nor correlate with one."""
    m = V.table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in CHOICE.items()])
    chosen = selection.select_features(m, list(CHOICE), 0.98, 3)
    return spark.createDataFrame(list(enumerate(chosen)), "position int, feature string")


@query("dedup_last", V.with_sql(V.RAW_CTE, select="""
SELECT station_id, parameter, date_trunc('hour', measurement_time) AS timestamp, event_id, raw_value FROM raw
QUALIFY row_number() OVER (PARTITION BY station_id, parameter, date_trunc('hour', measurement_time) ORDER BY event_id DESC) = 1"""))
def dedup_last(spark, d):
    m = V.raw_measurements(spark, d).select(
        "station_id", "parameter", floor_hour("measurement_time").alias("timestamp"), "event_id", "raw_value")
    return latest_by(m, ["station_id", "parameter", "timestamp"], ["event_id"])


@query("tail_n", V.with_sql(R, select="""
SELECT station_id, timestamp, aqi FROM readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) <= 224"""))
def tail_n(spark, d):
    return last_n(V.readings(spark, d).select("station_id", "timestamp", "aqi"), ["station_id"], ["timestamp"], "timestamp", 224)


@query("recent_window", V.with_sql(V.RAW_CTE, select="""
SELECT * FROM raw WHERE station_id = 'S5' AND measurement_time >= (SELECT max(ts) FROM events) - INTERVAL 200 HOUR ORDER BY measurement_time"""))
def recent_window(spark, d):
    now = V.now_of(V.table(spark, d, "events"))
    rows = recent(V.raw_measurements(spark, d), now, 200, "measurement_time")
    return rows.where("station_id = 'S5'").orderBy("measurement_time")


@query("first_n_cap", """
WITH t AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-06-01' THEN 'val' ELSE 'test' END AS split FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_orderdate, o_orderkey) AS rn FROM t)
SELECT o_orderkey, o_orderdate, split FROM n WHERE (split = 'train' AND rn <= 777) OR (split = 'val' AND rn <= 333) OR split = 'test'""")
def first_n_cap(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    t = clean.split_by_time(o, "1998-01-01", "1999-06-01", "o_orderdate")
    return first_n(t, ["split"], ["o_orderdate", "o_orderkey"], "o_orderdate", {"train": 777, "val": 333})
