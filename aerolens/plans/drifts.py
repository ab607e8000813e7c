"""Queries: drift between the baseline and the recent window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift
from ..session import work_path
from . import views as V
from .registry import query

FEATURES = list(V.MEASURED)
r = V.sql_round

SIDED_CTE = V.READINGS_CTE + """, clock AS (SELECT max(ts) AS now FROM events),
sided AS (
  SELECT readings.*, CASE WHEN timestamp BETWEEN now - INTERVAL 7 DAY AND now THEN 1 ELSE 0 END AS side FROM readings, clock
  WHERE timestamp BETWEEN now - INTERVAL 7 DAY AND now OR timestamp BETWEEN now - INTERVAL 30 DAY AND now - INTERVAL 8 DAY),
t AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, side, {c} AS v FROM sided WHERE {c} IS NOT NULL" for c in FEATURES) + """),
c AS (SELECT feature, v, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM t GROUP BY 1, 2),
tot AS (SELECT feature, min(v) AS lo, max(v) AS hi, sum(n0) AS t0, sum(n1) AS t1 FROM c GROUP BY 1),
g AS (SELECT feature, v, n0, n1, lo, (hi - lo) / 10 AS w, least(floor((v - lo) / (hi - lo) * 10), 9) AS i FROM c JOIN tot USING (feature) WHERE lo < hi),
bins AS (SELECT feature, CAST(i - CASE WHEN v < lo + i * w THEN 1 ELSE 0 END + CASE WHEN v >= lo + (i + 1) * w AND i < 9 THEN 1 ELSE 0 END AS INTEGER) AS bin,
  sum(n0) AS n0, sum(n1) AS n1 FROM g GROUP BY 1, 2),
grid AS (SELECT tot.feature, lo, hi, greatest(coalesce(n0, 0) / (t0 + 1e-6), 1e-6) AS e, greatest(coalesce(n1, 0) / (t1 + 1e-6), 1e-6) AS a
  FROM tot CROSS JOIN range(10) AS s(x) LEFT JOIN bins ON bins.feature = tot.feature AND bin = x),
psi AS (SELECT feature, sum(CASE WHEN lo = hi THEN 0e0 ELSE (a - e) * ln(a / e) END) AS psi FROM grid GROUP BY 1),
run AS (SELECT feature, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT feature, max(abs(c0 * 1e0 / t0 - c1 * 1e0 / t1)) AS d, any_value(t0) * 1e0 AS n, any_value(t1) * 1e0 AS m FROM run JOIN tot USING (feature) WHERE t0 > 0 AND t1 > 0 GROUP BY 1),
ksl AS (SELECT feature, d, d * sqrt(n * m / (n + m)) AS l FROM ks),
ksp AS (SELECT feature, d AS ks_stat, CASE WHEN l < 0.2 THEN 1e0 ELSE greatest(0e0, least(1e0, 2e0 * list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0 * k * k * l * l))))) END AS p FROM ksl),
mom AS (SELECT feature, count(*) FILTER (side = 0) AS rows0, count(*) FILTER (side = 1) AS rows1, avg(v) FILTER (side = 0) AS mean0,
  avg(v) FILTER (side = 1) AS mean1, stddev_pop(v) FILTER (side = 0) AS std0, stddev_pop(v) FILTER (side = 1) AS std1 FROM t GROUP BY 1),
rep AS (SELECT *, abs(mean1 - mean0) / (std0 + 1e-6) AS z FROM mom JOIN psi USING (feature) JOIN ksp USING (feature) WHERE rows0 >= 10 AND rows1 >= 10),
report AS (SELECT feature, """ + ", ".join(f"round_even({e}, {n}) + 0e0 AS {c}" for c, e, n in [
    ("psi", "psi", 4), ("ks_stat", "ks_stat", 4), ("ks_p_value", "p", 6), ("z_score", "z", 4), ("mean_shift", "mean1 - mean0", 4),
    ("std_ratio", "std1 / (std0 + 1e-6)", 4), ("baseline_mean", "mean0", 4), ("live_mean", "mean1", 4)]) + """,
  rows0 AS baseline_rows, rows1 AS live_rows,
  CASE WHEN psi > 0.25 THEN 'HIGH' WHEN psi > 0.12 AND p < 0.05 THEN 'MODERATE' WHEN psi > 0.05 THEN 'LOW' ELSE 'NONE' END AS severity,
  psi > 0.12 AND (p < 0.05 OR z > 1.5) AS drift, CAST(7 AS INTEGER) AS window_days, feature AS baseline_col FROM rep)"""


def sided(spark, d, now=None):
    """Readings of both windows; only the events of that range are read."""
    now = now or V.now_of(V.table(spark, d, "events"))
    return drift.windows(V.readings(spark, d, since=V.back(now, days=30)), now)


def report(spark, d):
    return drift.drift_report(sided(spark, d), FEATURES)


@query("drift_windows", V.with_sql(SIDED_CTE, select="SELECT station_id, timestamp, CAST(side AS INTEGER) AS side FROM sided"))
def drift_windows(spark, d):
    return sided(spark, d).select("station_id", "timestamp", "side")


@query("drift_psi", V.with_sql(SIDED_CTE, select=f"SELECT feature, {r('psi')} AS psi FROM psi"))
def drift_psi(spark, d):
    rows = sided(spark, d)
    return V.rounded(drift.stability(drift.side_counts(rows, FEATURES), drift.moments(rows, FEATURES)), ["psi"])


@query("drift_ks", V.with_sql(SIDED_CTE, select=f"SELECT feature, {r('ks_stat')} AS ks_stat, {r('p')} AS ks_p_value FROM ksp"))
def drift_ks(spark, d):
    out = drift.largest_gap(drift.side_counts(sided(spark, d), FEATURES)).where("ks_stat IS NOT NULL")
    return V.rounded(out, ["ks_stat", "ks_p_value"])


@query("drift_report", V.with_sql(SIDED_CTE, select="SELECT * FROM report"))
def drift_report(spark, d):
    return report(spark, d)


@query("drift_summary", V.with_sql(SIDED_CTE, select="""
SELECT count(*) AS features_checked, count(*) FILTER (drift) AS features_with_drift,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drift), '') AS drifted_features,
  round_even(count(*) FILTER (drift) / count(*), 3) AS drift_fraction, round_even(count(*) FILTER (drift) / count(*), 3) > 0.4 AS retrain_recommended
FROM report"""))
def drift_summary(spark, d):
    out = drift.drift_summary(report(spark, d))
    return out.withColumn("drifted_features", F.array_join("drifted_features", ","))


def history(spark, d):
    """Two stored runs: yesterday's view of the windows, then the current one."""
    events = V.table(spark, d, "events")
    now = V.now_of(events)
    day_before = str(V.scalar(events, F.max("ts") - F.expr("interval 1 day")))
    path = work_path(spark, "drift-history")
    for at in (day_before, now, now):  # the last run is repeated, as after a failure
        drift.append_history(drift.drift_report(sided(spark, d, at), FEATURES), path, at)
    return drift.read_history(spark, path)


@query("drift_latest", V.with_sql(SIDED_CTE, select="SELECT feature, psi, CAST(drift AS INTEGER) AS drift FROM report"))
def drift_latest(spark, d):
    return drift.latest_drift(history(spark, d))


@query("drift_alerts", V.with_sql(SIDED_CTE, select="""
SELECT 'DataDriftDetected' AS alert, CAST(max(CAST(drift AS INTEGER)) AS DOUBLE) AS value, bool_or(drift) AS firing FROM report
UNION ALL SELECT 'HighDriftPSI', max(psi), max(psi) > 0.25 FROM report
UNION ALL SELECT 'ManyFeaturesDrifted', CAST(count(*) FILTER (drift) AS DOUBLE), count(*) FILTER (drift) >= 3 FROM report"""))
def drift_alerts(spark, d):
    return drift.drift_alerts(history(spark, d))
