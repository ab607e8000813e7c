"""Queries: alert rules over the request log, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import monitor
from ..session import work_path
from ..streaming import jobs
from . import views as V
from .registry import query

Q = V.REQUESTS_CTE
r = V.sql_round
# Every sliding window [start, start + n minutes) that holds at least one request.
MINUTES_CTE = Q + ", per_minute AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS total, count(*) FILTER (status = 'error') AS errors, " + ", ".join(
    f"count(*) FILTER (latency <= {b!r}) AS le_{i}" for i, b in enumerate(K.LATENCY_BUCKETS)) + " FROM requests GROUP BY 1)"


def window_cte(minutes):
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["total", "errors", *[f"le_{i}" for i in range(len(K.LATENCY_BUCKETS))]])
    return (f"win AS (SELECT minute - x * INTERVAL 1 MINUTE AS window_start, {sums} FROM per_minute, range({minutes}) AS s(x) GROUP BY 1)")


@query("error_rate", V.with_sql(MINUTES_CTE, window_cte(5), select=f"""
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, total, errors, {r('errors / total')} AS error_rate, errors / total > 0.05 AS breach FROM win"""))
def error_rate(spark, d):
    return V.rounded(monitor.error_rate(V.requests(spark, d)), ["error_rate"])


def quantile_sql():
    rank, parts, low, below = "0.95e0 * total", [], "0e0", "0"
    for i, b in enumerate(K.LATENCY_BUCKETS):
        parts.append(f"WHEN le_{i} >= {rank} THEN {low} + ({b!r}e0 - {low}) * ({rank} - {below}) / nullif(le_{i} - {below}, 0)")
        low, below = f"{b!r}e0", f"le_{i}"
    return f"CASE {' '.join(parts)} ELSE {K.LATENCY_BUCKETS[-1]!r}e0 END"


@query("latency_p95", V.with_sql(MINUTES_CTE, window_cte(5), f"p AS (SELECT window_start, total, {quantile_sql()} AS p95 FROM win)", select=f"""
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, total, {r('p95')} AS p95, p95 > 10 AS breach FROM p"""))
def latency_p95(spark, d):
    return V.rounded(monitor.latency_p95(V.requests(spark, d)), ["p95"])


@query("failed_fetches", V.with_sql(MINUTES_CTE, window_cte(10), select="""
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, errors AS failed, errors > 0 AS breach FROM win"""))
def failed_fetches(spark, d):
    fetches = V.requests(spark, d).replace({"error": "failed"}, subset=["status"])  # as a fetch log writes it
    return monitor.failed_fetches(fetches)


def _silent_sql(minutes):
    return f"""
WITH a AS (SELECT DISTINCT time_bucket(INTERVAL {minutes} MINUTE, ts) AS w FROM events),
g AS (SELECT unnest(generate_series((SELECT min(w) FROM a), (SELECT max(w) FROM a), INTERVAL {minutes} MINUTE)) AS w)
SELECT w AS window_start FROM g WHERE w NOT IN (SELECT w FROM a)"""


@query("silent_windows", _silent_sql(10))
def silent_windows(spark, d):
    return monitor.silent_windows(V.requests(spark, d), 10)


@query("no_rows_ingested", _silent_sql(30))
def no_rows_ingested(spark, d):
    return monitor.silent_windows(V.requests(spark, d), 30)


@query("stale_data", V.with_sql(V.READINGS_CTE, """m AS (SELECT station_id, max(timestamp) AS latest FROM readings GROUP BY 1)""",
  """a AS (SELECT *, round_even(CAST(floor(epoch((SELECT max(ts) FROM events) - latest)) AS BIGINT) / 3600, 2) AS age_hours FROM m)""",
  select="SELECT station_id, latest, age_hours, age_hours > 3 AS breach FROM a"))
def stale_data(spark, d):
    return monitor.stale(V.readings(spark, d), V.now_of(V.table(spark, d, "events")))


@query("alert_hold", V.with_sql(MINUTES_CTE, window_cte(5), """b AS (
  SELECT 'HighPredictionErrorRate' AS alert, window_start + INTERVAL 5 MINUTE AS t FROM win WHERE errors / total > 0.05)""", """i AS (
  SELECT *, t - row_number() OVER (PARTITION BY alert ORDER BY t) * INTERVAL 1 MINUTE AS island FROM b)""", select="""
SELECT alert, min(t) AS active_since, min(t) + INTERVAL 2 MINUTE AS firing_since, max(t) AS last_breach, count(*) AS evaluations
FROM i GROUP BY alert, island HAVING max(t) - min(t) >= INTERVAL 2 MINUTE"""))
def alert_hold(spark, d):
    rates = monitor.error_rate(V.requests(spark, d)).withColumn("alert", F.lit("HighPredictionErrorRate"))
    return monitor.held(rates, "2 minutes")


@query("request_counts", V.with_sql(Q, select="""
SELECT city, status, count(*) AS requests, CAST(sum(rows_written) AS BIGINT) AS rows_written FROM requests GROUP BY 1, 2"""))
def request_counts(spark, d):
    return monitor.request_counts(V.requests(spark, d))


# ------------------------------------------------------------------------------- streams

def event_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    # The pattern matches a single file as well as a folder of files.
    return jobs.file_stream(spark, f"{d}/events.parquet*", schema)


def measurement_stream(spark, d):
    kinds = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in V.PARAMETER_OF.items())
    return event_stream(spark, d).selectExpr(
        "event_id", "user_id AS sensor_id", f"concat('S', user_id DIV {V.SENSORS}) AS station_id",
        f"CASE event_type {kinds} END AS parameter", "value", "ts AS measurement_time")


@query("stream_hourly", V.with_sql(V.RAW_CTE, select=f"""
SELECT station_id, parameter, date_trunc('hour', measurement_time) AS timestamp, {r('avg(raw_value)')} AS value, count(*) AS n FROM raw GROUP BY 1, 2, 3"""))
def stream_hourly(spark, d):
    """Hourly means as updates, merged into a keyed table by every micro-batch."""
    path, keys = work_path(spark, "hourly-means"), ["station_id", "parameter", "timestamp"]
    means = jobs.hourly_means(measurement_stream(spark, d), ["station_id", "parameter"])
    jobs.run(means, jobs.checkpoint_path(spark, "hourly"), each=jobs.upsert_sink(path, keys), mode="update")
    return V.rounded(spark.read.parquet(path).drop("date"), ["value"])


@query("stream_dedup", "SELECT DISTINCT user_id AS sensor_id, date_trunc('hour', ts) AS measurement_time FROM events")
def stream_dedup(spark, d):
    """One row per sensor and hour out of a stream that repeats them."""
    hourly = measurement_stream(spark, d).withColumn("measurement_time", F.date_trunc("hour", "measurement_time").cast("timestamp_ntz"))
    path = work_path(spark, "dedup")
    unique = jobs.deduplicated(hourly, ["sensor_id", "measurement_time"]).select(
        "sensor_id", F.col("measurement_time").cast("timestamp_ntz").alias("measurement_time"))
    jobs.run(unique, jobs.checkpoint_path(spark, "dedup"), path)
    return spark.read.parquet(path)


@query("stream_sliding", V.with_sql(MINUTES_CTE, window_cte(5), select="SELECT window_start, total, errors FROM win"))
def stream_sliding(spark, d):
    """Error counts of every window: those the watermark has closed, then those still open at the end of the log."""
    log = event_stream(spark, d).selectExpr("ts", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status")
    path, checkpoint = work_path(spark, "sliding"), jobs.checkpoint_path(spark, "sliding")
    jobs.run(jobs.sliding_errors(log), checkpoint, path)
    return spark.read.parquet(path).union(jobs.open_errors(spark, checkpoint))


@query("stream_last_seen", "SELECT user_id AS sensor_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def stream_last_seen(spark, d):
    """Newest measurement per sensor, as the query's state holds it."""
    checkpoint = jobs.checkpoint_path(spark, "seen")
    jobs.run(jobs.last_seen(measurement_stream(spark, d)), checkpoint, mode="update")
    return jobs.current_last_seen(spark, checkpoint)


@query("stream_insert", """
SELECT user_id AS sensor_id, date_trunc('hour', ts) AS measurement_time, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def stream_insert(spark, d):
    """Insert-or-ignore of every micro-batch into the measurement table."""
    path = work_path(spark, "measurements")
    hourly = measurement_stream(spark, d).select(
        "sensor_id", F.date_trunc("hour", "measurement_time").cast("timestamp_ntz").alias("measurement_time"), "event_id")
    jobs.run(hourly, jobs.checkpoint_path(spark, "insert"), each=jobs.insert_sink(path, ["sensor_id", "measurement_time"], ["event_id"]))
    return spark.read.parquet(path).drop("date")
