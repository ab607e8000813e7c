"""Queries: profiles, histograms, counts, medians, box plots and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.air import profile_category
from ..operators import clean, joins, profile, series
from ..session import written
from . import views as V
from .registry import query

R, S = V.READINGS_CTE, V.STATIONS_CTE
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CTE = "t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in LINE) + ")"
READ_CTE = "t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM readings" for c in (*V.MEASURED, "aqi")) + ")"
r = V.sql_round


def _profile_sql(*ctes):
    return V.with_sql(*ctes, select=f"""
SELECT feature, count(v) AS count, {r('avg(v)', 4)} AS mean, {r('stddev_samp(v)', 4)} AS std,
  {r('min(v)', 4)} AS min, {r('max(v)', 4)} AS max, {r('avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END) * 100', 2)} AS null_pct,
  {r('skewness(v)', 4)} AS skewness, {r('kurtosis(v)', 4)} AS kurtosis,
  {r('quantile_cont(v, 0.25)', 4)} AS p25, {r('quantile_cont(v, 0.5)', 4)} AS p50,
  {r('quantile_cont(v, 0.75)', 4)} AS p75, {r('quantile_cont(v, 0.95)', 4)} AS p95
FROM t GROUP BY feature HAVING count(v) > 0""")


def _rounded_profile(df, columns):
    out = profile.column_profile(df, columns)
    names = ["mean", "std", "min", "max", "skewness", "kurtosis", "p25", "p50", "p75", "p95"]
    return V.rounded(V.rounded(out, names, 4), ["null_pct"], 2)


@query("profile_stats", _profile_sql(LINE_CTE))
def profile_stats(spark, d):
    return _rounded_profile(V.table(spark, d, "lineitem"), LINE)


@query("profile_readings", _profile_sql(R, READ_CTE))
def profile_readings(spark, d):
    return _rounded_profile(V.readings(spark, d), [*V.MEASURED, "aqi"])


def _bin_sql(bins):
    g = f"least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})"
    return f"""b AS (SELECT feature, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM (SELECT feature, min(v) AS lo, max(v) AS hi FROM t GROUP BY feature)),
g AS (SELECT feature, v, lo, (hi - lo) / {bins} AS w, {g} AS i FROM t JOIN b USING (feature) WHERE v IS NOT NULL),
n AS (SELECT feature, CAST(i - CASE WHEN v < lo + i * w THEN 1 ELSE 0 END
    + CASE WHEN v >= lo + (i + 1) * w AND i < {bins - 1} THEN 1 ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY 1, 2)"""


def _histogram_sql(*ctes, bins, digits=4):
    return V.with_sql(*ctes, _bin_sql(bins), select=f"""
SELECT feature, CAST(x AS INTEGER) AS bin, {r(f'lo + x * (hi - lo) / {bins}', digits)} AS edge_lo,
  {r(f'lo + (x + 1) * (hi - lo) / {bins}', digits)} AS edge_hi, coalesce(n, 0) AS n
FROM b CROSS JOIN range({bins}) AS s(x) LEFT JOIN n ON n.feature = b.feature AND n.bin = x""".replace("SELECT feature,", "SELECT b.feature,"))


@query("histogram", _histogram_sql(LINE_CTE, bins=50))
def histogram(spark, d):
    return V.rounded(profile.histogram(V.table(spark, d, "lineitem"), LINE, 50), ["edge_lo", "edge_hi"], 4)


@query("index_histogram", _histogram_sql(R, "t AS (SELECT 'aqi' AS feature, aqi AS v FROM readings)", bins=80, digits=10))
def index_histogram(spark, d):
    return V.rounded(profile.histogram(V.readings(spark, d), ["aqi"], 80), ["edge_lo", "edge_hi"], 10)


@query("baseline_profile", V.with_sql(LINE_CTE, _bin_sql(50), select=f"""
SELECT feature, count, mean, bars FROM
  (SELECT feature, count(v) AS count, {r('avg(v)', 4)} AS mean FROM t GROUP BY feature)
  JOIN (SELECT feature, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bin) AS bars FROM n GROUP BY feature) USING (feature)"""))
def baseline_profile(spark, d):
    out = profile.baseline_profile(V.table(spark, d, "lineitem"), LINE, 50)
    bars = F.filter("histogram", lambda b: b["n"] > 0)
    return out.select("feature", "count", V.r6("mean", 4).alias("mean"),
                      F.array_join(F.transform(bars, lambda b: b["n"].cast("string")), ",").alias("bars"))


@query("null_report", V.with_sql(R, READ_CTE, select=f"""
SELECT feature, count(v) AS present, count(*) - count(v) AS missing, {r('(count(*) - count(v)) * 100e0 / count(*)')} AS null_pct
FROM t GROUP BY feature"""))
def null_report(spark, d):
    return V.rounded(profile.null_report(V.readings(spark, d), [*V.MEASURED, "aqi"]), ["null_pct"])


@query("category_counts", V.with_sql(S, select="SELECT city, count(*) AS n FROM stations GROUP BY city ORDER BY n DESC, city LIMIT 15"))
def category_counts(spark, d):
    return profile.category_counts(V.stations(spark, d), "city", 15)


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return profile.category_counts(V.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("records_topk", V.with_sql(S, """c AS (
  SELECT 'S' || CAST(c_nationkey AS VARCHAR) AS station_id, count(*) AS n_records
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""", """j AS (SELECT * FROM c LEFT JOIN stations USING (station_id))""", select="""
SELECT * FROM (SELECT *, 'top' AS side FROM j ORDER BY n_records DESC, station_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM j ORDER BY n_records, station_id LIMIT 10)"""))
def records_topk(spark, d):
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.selectExpr("concat('S', c_nationkey) AS station_id")
    return profile.both_ends(profile.records_per_station(rows, V.stations(spark, d)), "n_records", "station_id", 10)


@query("records_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def records_by_year(spark, d):
    return profile.records_per_year(V.table(spark, d, "orders"), "o_orderdate")


@query("active_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS stations FROM orders GROUP BY 1")
def active_by_year(spark, d):
    return profile.active_per_year(V.table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("time_span", """
SELECT *, span_hours // 24 AS span_days FROM (
  SELECT count(*) AS row_count, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type,
    min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor(epoch(max(ts) - min(ts)) / 3600) AS BIGINT) AS span_hours FROM events)""")
def time_span(spark, d):
    return profile.time_span(V.table(spark, d, "events"), ["user_id", "event_type"], "ts")


@query("sorted_cities", V.with_sql(S, select="SELECT DISTINCT city FROM stations ORDER BY city"))
def sorted_cities(spark, d):
    return V.stations(spark, d).select("city").distinct().orderBy("city")


@query("stations_per_city", V.with_sql(R, S, select="""
SELECT city, count(DISTINCT station_id) AS stations FROM readings JOIN stations USING (station_id) GROUP BY city"""))
def stations_per_city(spark, d):
    ids = V.readings(spark, d).select("station_id").distinct()
    return ids.join(V.stations(spark, d), "station_id").groupBy("city").agg(F.count("*").alias("stations"))


@query("monthly_median", f"""
SELECT date_trunc('month', o_orderdate) AS month, {r('median(o_totalprice)')} AS median FROM orders GROUP BY 1""")
def monthly_median(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return V.rounded(profile.median_by(V.table(spark, d, "orders"), {"month": month}, "o_totalprice"), ["median"])


@query("hourly_median", V.with_sql(R, select=f"""
SELECT CAST(hour(timestamp) AS INTEGER) AS hour, {r('median(aqi)')} AS median FROM readings WHERE aqi IS NOT NULL GROUP BY 1"""))
def hourly_median(spark, d):
    # Twenty-four keys, fixed by the clock.
    return V.rounded(profile.median_by(V.readings(spark, d), {"hour": F.hour("timestamp")}, "aqi"), ["median"])


@query("year_month_matrix", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, " + ", ".join(
    f"{r(f'median(o_totalprice) FILTER (month(o_orderdate) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def year_month_matrix(spark, d):
    out = profile.year_month_matrix(V.table(spark, d, "orders"), "o_totalprice", "o_orderdate")
    return V.rounded(out, [f"m{m}" for m in range(1, 13)])


@query("group_boxplot", f"""
WITH t AS (SELECT n_name AS state, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT state, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY state)
SELECT state, count(*) AS n, {r('any_value(q1)', 4)} AS q1, {r('any_value(median)', 4)} AS median, {r('any_value(q3)', 4)} AS q3,
  min(v) FILTER (v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1)) AS whisker_lo,
  max(v) FILTER (v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1)) AS whisker_hi,
  count(*) FILTER (NOT (v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1))) AS outliers
FROM t JOIN q USING (state) GROUP BY state ORDER BY any_value(q.median) DESC, state LIMIT 20""")
def group_boxplot(spark, d):
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_name AS state", "o_totalprice AS v")
    return V.rounded(profile.top_boxes(t, "state", "v", 20), ["q1", "median", "q3"], 4)


@query("capped_distribution", V.with_sql(LINE_CTE, select=f"""
, c AS (SELECT feature, quantile_cont(v, 0.99) AS cap FROM t GROUP BY feature),
k AS (SELECT feature, v, cap FROM t JOIN c USING (feature) WHERE v <= cap)
SELECT feature, {r('any_value(cap)', 4)} AS cap, count(*) AS n, min(v) AS lo, max(v) AS hi, {r('quantile_cont(v, 0.25)', 4)} AS q1,
  {r('quantile_cont(v, 0.5)', 4)} AS median, {r('quantile_cont(v, 0.75)', 4)} AS q3 FROM k GROUP BY feature"""))
def capped_distribution(spark, d):
    return V.rounded(profile.capped_distribution(V.table(spark, d, "lineitem"), LINE), ["cap", "q1", "median", "q3"], 4)


PROFILE_CASE = ("CASE WHEN aqi > 0 AND aqi <= 50 THEN 'Good' WHEN aqi > 50 AND aqi <= 100 THEN 'Satisfactory' "
                "WHEN aqi > 100 AND aqi <= 150 THEN 'Moderate' WHEN aqi > 150 AND aqi <= 200 THEN 'Poor' "
                "WHEN aqi > 200 AND aqi <= 300 THEN 'Very Poor' WHEN aqi > 300 AND aqi <= 500 THEN 'Severe' END")


@query("category_share", V.with_sql(R, f"c AS (SELECT {PROFILE_CASE} AS category FROM readings)", select=f"""
SELECT category, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()')} AS pct FROM c WHERE category IS NOT NULL GROUP BY 1"""))
def category_share(spark, d):
    return V.rounded(profile.category_share(V.readings(spark, d), profile_category("aqi")), ["pct"])


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM lineitem"
    for i, a in enumerate(LINE) for b in LINE[i + 1:]))
def correlation_matrix(spark, d):
    return V.rounded(profile.correlations(V.table(spark, d, "lineitem"), LINE), ["corr"])


@query("top_correlations", V.with_sql(R, select="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'corr({c}, aqi)')} AS corr FROM readings" for c in V.MEASURED)
    + ") ORDER BY abs(corr) DESC NULLS LAST, feature LIMIT 3"))
def top_correlations(spark, d):
    return V.rounded(profile.top_correlated(V.readings(spark, d), list(V.MEASURED), "aqi", 3), ["corr"])


@query("target_encoding", V.with_sql(R, S, """t AS (SELECT station_id, city, timestamp, aqi FROM readings JOIN stations USING (station_id))""",
  """s AS (SELECT station_id, coalesce(avg(aqi), 0) AS station_aqi_mean, coalesce(median(aqi), 0) AS station_aqi_median FROM t WHERE station_id <> 'S3' GROUP BY 1)""",
  """c AS (SELECT city, coalesce(avg(aqi), 0) AS city_aqi_mean, coalesce(median(aqi), 0) AS city_aqi_median FROM t GROUP BY 1)""", select=f"""
SELECT station_id, city, timestamp, {r('coalesce(station_aqi_mean, 0)')} AS station_aqi_mean, {r('coalesce(station_aqi_median, 0)')} AS station_aqi_median,
  {r('coalesce(city_aqi_mean, 0)')} AS city_aqi_mean, {r('coalesce(city_aqi_median, 0)')} AS city_aqi_median
FROM t LEFT JOIN s USING (station_id) LEFT JOIN c USING (city)"""))
def target_encoding(spark, d):
    t = joins.with_station(V.readings(spark, d), V.stations(spark, d).select("station_id", "city")).select(
        "station_id", "city", "timestamp", "aqi")
    per_station = profile.target_statistics(
        t.where("station_id <> 'S3'"), "station_id")
    per_city = profile.target_statistics(t, "city")
    out = joins.lookup_statistics(joins.lookup_statistics(t, per_station, "station_id"), per_city, "city").drop("aqi")
    return V.rounded(out, [c for c in out.columns if "_aqi_" in c])


@query("city_codes", V.with_sql(R, S, select="""
SELECT station_id, timestamp, CAST(coalesce(code, 0) AS INTEGER) AS city_encoded FROM readings JOIN stations USING (station_id)
LEFT JOIN (SELECT r_name AS city, dense_rank() OVER (ORDER BY r_name) - 1 AS code FROM region WHERE r_regionkey > 0) USING (city)"""))
def city_codes(spark, d):
    known = V.table(spark, d, "region").where("r_regionkey > 0").selectExpr("r_name AS city")
    t = V.readings(spark, d).join(V.stations(spark, d), "station_id").select("station_id", "timestamp", "city")
    return t.join(clean.encode_labels(known), "city", "left").na.fill(0, ["city_encoded"]).drop("city")


@query("city_codes_live", V.with_sql(R, S, select="""
SELECT station_id, timestamp, CAST(CASE WHEN r_regionkey > 1 THEN code WHEN r_regionkey = 1 THEN (SELECT count(*) FROM region WHERE r_regionkey > 1) ELSE 0 END AS INTEGER) AS city_encoded
FROM readings JOIN stations USING (station_id) LEFT JOIN (SELECT r_name AS city, r_regionkey,
  row_number() OVER (PARTITION BY r_regionkey > 1 ORDER BY r_name) - 1 AS code FROM region) USING (city)"""))
def city_codes_live(spark, d):
    """Live rows under a stored dictionary: its first cities keep their codes, one came later, one was never seen."""
    regions = V.table(spark, d, "region").selectExpr("r_regionkey", "r_name AS city")
    stored = written(clean.encode_labels(regions.where("r_regionkey > 1")), "codes")
    codes = clean.extend_codes(stored, regions.where("r_regionkey > 0"))
    t = V.readings(spark, d).join(V.stations(spark, d), "station_id").select("station_id", "timestamp", "city")
    return clean.with_codes(t, codes).drop("city")
