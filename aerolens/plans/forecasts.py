"""Queries: splits, imputation, error metrics, model training and prediction records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import category, forecast_array
from ..operators import boosting, clean, forecast, incremental, series
from ..operators.ordered import latest_by
from ..session import work_path, written
from . import jobs
from . import views as V
from .features import COLUMNS, FILL_CTE, WIN, filled, live_features, training_input
from .registry import query

R = V.READINGS_CTE
r = V.sql_round
HORIZONS = tuple(range(1, K.N_AHEAD + 1))
# Readings cover one month: train on its first part, validate and test on the rest.
TRAIN_END, VAL_END = "2024-01-19", "2024-01-25"


@query("split_counts", """
SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '1999-06-01' THEN 'val' ELSE 'test' END AS split,
  count(*) AS n FROM lineitem GROUP BY 1""")
def split_counts(spark, d):
    t = clean.split_by_time(V.table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "timestamp"),
                            "1998-01-01", "1999-06-01")
    return t.groupBy("split").agg(F.count("*").alias("n"))


@query("hash_sample", f"""
SELECT * FROM lineitem WHERE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8))::BIGINT < {int(0.1 * 2**32)}""")
def hash_sample(spark, d):
    return clean.hash_sample(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], 0.1)


@query("median_impute", V.with_sql(R, f"""t AS (SELECT station_id, timestamp, pm25, no2,
    CASE WHEN timestamp < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp < TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split FROM readings)""",
  "m AS (SELECT median(pm25) AS a, median(no2) AS b FROM t WHERE split = 'train')", select=f"""
SELECT station_id, timestamp, split, {r('coalesce(pm25, a, 0)')} AS pm25, {r('coalesce(no2, b, 0)')} AS no2 FROM t, m"""))
def median_impute(spark, d):
    t = clean.split_by_time(V.readings(spark, d), TRAIN_END, VAL_END).select("station_id", "timestamp", "pm25", "no2", "split")
    return V.rounded(forecast.impute_medians(t, ["pm25", "no2"]), ["pm25", "no2"])


ERRORS_CTE = ", ".join([R, FILL_CTE, "tt AS (SELECT station_id, timestamp, aqi, " + ", ".join(
    f"lead(aqi, {h}) {WIN} AS aqi_t{h}" for h in HORIZONS) + " FROM filled)",
    f"""sp AS (SELECT *, CASE WHEN timestamp < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp < TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split
  FROM tt WHERE aqi_t24 IS NOT NULL)""",
    "y AS (" + " UNION ALL ".join(f"SELECT split, {h} AS horizon, aqi_t{h} AS y, aqi AS p FROM sp" for h in HORIZONS) + ")",
    """per AS (SELECT split, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, sum(abs(y - p)) AS abs_sum, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst FROM y GROUP BY 1, 2)""",
    "met AS (SELECT split, horizon, n, abs_sum / n AS mae, sqrt(sse / n) AS rmse, 1 - sse / sst AS r2 FROM per)"])


def sums(spark, d):
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    t = series.add_targets(f, "aqi", HORIZONS)
    return forecast.error_sums(clean.split_by_time(forecast.persistence(t, HORIZONS), TRAIN_END, VAL_END), HORIZONS)


METRICS = ["mae", "rmse", "r2"]
SHOW = ", ".join(f"{r(c, 4)} AS {c}" for c in METRICS)


@query("metrics_by_horizon", V.with_sql(ERRORS_CTE, select=f"SELECT split, horizon, n, {SHOW} FROM met"))
def metrics_by_horizon(spark, d):
    return V.rounded(forecast.horizon_metrics(sums(spark, d)), METRICS, 4)


@query("metrics_pooled", V.with_sql(ERRORS_CTE, select=f"""
SELECT split, {r('sum(abs_sum) / sum(n)', 4)} AS mae, {r('sqrt(sum(sse) / sum(n))', 4)} AS rmse, {r('1 - sum(sse) / sum(sst)', 4)} AS r2 FROM per GROUP BY split"""))
def metrics_pooled(spark, d):
    return V.rounded(forecast.pooled_metrics(sums(spark, d)), METRICS, 4)


@query("metrics_average", V.with_sql(ERRORS_CTE, select=f"""
SELECT split, {r('avg(mae)', 4)} AS mae, {r('sqrt(avg(rmse * rmse))', 4)} AS rmse, {r('avg(r2)', 4)} AS r2 FROM met GROUP BY split"""))
def metrics_average(spark, d):
    return V.rounded(forecast.averaged_metrics(sums(spark, d)), METRICS, 4)


@query("score_table", V.with_sql(ERRORS_CTE, select=f"""
SELECT split, 'persistence' AS model, {r('avg(mae)', 4)} AS mae, {r('sqrt(avg(rmse * rmse))', 4)} AS rmse, {r('avg(r2)', 4)} AS r2, """ + ", ".join(
    f"{r(f'max({m}) FILTER (horizon = {h})', 4)} AS {m}_t{h}" for h in K.REPORTED_HORIZONS for m in METRICS) + " FROM met GROUP BY split"))
def score_table(spark, d):
    out = forecast.score_table(sums(spark, d), "persistence")
    return V.rounded(out, [c for c in out.columns if c not in ("split", "model")], 4)


def training_table(spark, d):
    """(table, features, medians): the training job's table and the columns it selects, nulls filled with the training
    medians; written once, as training and scoring read it again."""
    made, meta = jobs.training_features(training_input(spark, d))
    t = written(clean.split_by_time(made, TRAIN_END, VAL_END), "training")
    medians = forecast.training_medians(t, meta["selected"])
    return written(forecast.impute_medians(t, meta["selected"], medians), "training-filled"), meta["selected"], medians


@query("gbt_forecast")
def gbt_forecast(spark, d):
    """Boosted trees against persistence on the held-out splits."""
    t, features, _ = training_table(spark, d)
    models = forecast.train_horizons(t.where("split = 'train'"), features, HORIZONS)
    held = t.where("split <> 'train'")
    trees = forecast.score_table(
        forecast.error_sums(forecast.score(held, models), HORIZONS), "gbt", HORIZONS)
    naive = forecast.score_table(
        forecast.error_sums(forecast.persistence(held, HORIZONS), HORIZONS), "persistence", HORIZONS)
    return trees.unionByName(naive)


@query("best_model")
def best_model(spark, d):
    """The better of the candidates by validation error."""
    return forecast.best_model(written(gbt_forecast(spark, d), "scores"))


@query("best_naive_forecast", V.with_sql(ERRORS_CTE, "tt2 AS (SELECT *, " + ", ".join(
    f"coalesce(lag(aqi, {24 - h}) {WIN}, 0) AS p{h}" for h in range(1, 24)) + ", aqi AS p24 FROM tt)", f"""sp2 AS (
  SELECT *, CASE WHEN timestamp < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp < TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split
  FROM tt2 WHERE aqi_t24 IS NOT NULL)""", "y2 AS (" + " UNION ALL ".join(f"SELECT split, {h} AS horizon, aqi_t{h} AS y, p{h} AS p FROM sp2" for h in HORIZONS) + ")",
  """scores AS (SELECT 'persistence' AS model, split, avg(mae) AS mae FROM met GROUP BY split UNION ALL
  SELECT 'yesterday', split, avg(m) FROM (SELECT split, horizon, avg(abs(y - p)) AS m FROM y2 GROUP BY 1, 2) GROUP BY split)""", select=f"""
SELECT model, {r('mae', 4)} AS mae FROM scores WHERE split = 'val' ORDER BY mae, model LIMIT 1"""))
def best_naive_forecast(spark, d):
    """The better of two forecasts without a model: the current value, the same hour yesterday."""
    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    lagged = series.add_lags(series.add_targets(f, "aqi", HORIZONS, complete_only=False), ["aqi"], range(1, 24)).na.fill(0.0, [f"aqi_lag{k}" for k in range(1, 24)])
    t = written(clean.split_by_time(lagged.where("aqi_t24 IS NOT NULL"), TRAIN_END, VAL_END), "naive")
    candidates = {"persistence": forecast.persistence(t, HORIZONS), "yesterday": forecast.daily_naive(t, HORIZONS)}
    tables = [forecast.score_table(forecast.error_sums(df, HORIZONS), name) for name, df in candidates.items()]
    return V.rounded(forecast.best_model(tables[0].unionByName(tables[1])), ["mae"], 4)


@query("gbt_search")
def gbt_search(spark, d):
    """Trial table of ten seeded points on the first target, scored on the validation weeks."""
    t, features, _ = training_table(spark, d)
    _, trials = forecast.search_parameters(t, features, "aqi_t1")
    return trials


@query("gbt_first_split", V.with_sql(R, FILL_CTE, "tt AS (SELECT *, row_number() OVER () AS id, " + ", ".join(
    f"lead(aqi, {h}) {WIN} AS y{h}" for h in HORIZONS) + " FROM filled)",
  f"tr AS (SELECT * FROM tt WHERE y24 IS NOT NULL AND timestamp < TIMESTAMP '{TRAIN_END}')",
  "x AS (" + " UNION ALL ".join(f"SELECT id, {i} AS f, '{c}' AS feature, {c} AS x FROM tr" for i, c in enumerate(COLUMNS)) + ")",
  "e AS (SELECT f, q AS edge, row_number() OVER (PARTITION BY f ORDER BY q) AS bin FROM (SELECT DISTINCT f, unnest(quantile_disc(x, ["
  + ", ".join(f"{i}e0 / 63" for i in range(1, 63)) + "])) AS q FROM x GROUP BY f))",
  "b AS (SELECT x.id, x.f, x.feature, 1 + count(edge) AS bin FROM x LEFT JOIN e ON e.f = x.f AND e.edge < x.x GROUP BY ALL)",
  "y AS (" + " UNION ALL ".join(f"SELECT id, {h} AS horizon, y{h} - avg(y{h}) OVER () AS y FROM tr" for h in HORIZONS) + ")",
  "s AS (SELECT horizon, f, feature, bin, sum(y) AS s, count(*) AS c FROM b JOIN y USING (id) GROUP BY ALL)",
  """l AS (SELECT horizon, f, feature, bin, sum(s) OVER w AS sl, sum(c) OVER w AS cl, sum(s) OVER p - sum(s) OVER w AS sr, sum(c) OVER p - sum(c) OVER w AS cr
    FROM s WINDOW w AS (PARTITION BY horizon, f ORDER BY bin), p AS (PARTITION BY horizon, f))""",
  "v AS (SELECT horizon, sum(y * y) AS sst FROM y GROUP BY 1)", select=f"""
SELECT CAST(horizon AS INTEGER) AS horizon, feature, CAST(bin AS INTEGER) AS bin, {r('edge')} AS cut, round(100 * (sl * sl / cl + sr * sr / cr) / sst, 2) AS share
FROM l JOIN e USING (f, bin) JOIN v USING (horizon) WHERE cl >= 50 AND cr >= 50
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(sl * sl / cl + sr * sr / cr, 2) DESC, f, bin) = 1"""))
def gbt_first_split(spark, d):
    """The first split of every horizon's first tree, and the share of the variance that it explains."""
    t = clean.split_by_time(series.add_targets(filled(spark, d), "aqi", HORIZONS), TRAIN_END, VAL_END).where("split = 'train'")
    train = written(t.select(*COLUMNS, *[f"aqi_t{h}" for h in HORIZONS]), "first-split")
    stump = {"trees": 1, "rate": 1.0, "depth": 1, "leaves": 2, "rows": 1.0, "columns": 1.0}
    models = forecast.train_horizons(train, COLUMNS, HORIZONS, **stump)
    splits = boosting.first_splits({str(h): m for h, m in models.items()}, spark)
    shares = boosting.staged_errors(train, list(models.values())).select((F.col("model") + 1).alias("horizon"), (100 * (1 - F.col("sse") / F.col("sst"))).alias("share"))
    out = splits.withColumn("horizon", F.col("model").cast("int")).join(shares, "horizon")
    return V.rounded(out.select("horizon", "feature", "bin", "cut", F.round("share", 2).alias("share")), ["cut"])


@query("prediction_records", V.with_sql(R, """daily AS (
  SELECT station_id, CAST(timestamp + INTERVAL 330 MINUTE AS DATE) AS day, CAST(round_even(avg(aqi), 0) AS INTEGER) AS a
  FROM readings WHERE aqi IS NOT NULL GROUP BY 1, 2)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS rn FROM daily)""", """lists AS (
  SELECT station_id, list(a ORDER BY day) AS l FROM ranked WHERE rn <= 7 GROUP BY 1)""", """newest AS (
  SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) = 1)""", """n AS (
  SELECT *, CAST(round_even(coalesce(aqi, 0), 0) AS INTEGER) AS now_aqi, greatest(coalesce(pm25, 0), coalesce(pm10, 0), coalesce(no2, 0), coalesce(so2, 0), coalesce(co, 0)) AS m FROM newest)""", select=f"""
SELECT station_id, timestamp, now_aqi AS current_aqi,
  CASE m WHEN coalesce(pm25, 0) THEN 'PM2.5' WHEN coalesce(pm10, 0) THEN 'PM10' WHEN coalesce(no2, 0) THEN 'NO2' WHEN coalesce(so2, 0) THEN 'SO2' ELSE 'CO' END AS primary_pollutant,
  array_to_string(list_transform(range(1, 25), lambda x: now_aqi + 3 * x), ',') AS forecast, coalesce(pm25, 0) AS pm25, 0e0 AS o3, CAST(6 AS INTEGER) AS n_pollutants,
  CASE WHEN l IS NULL THEN '0,0,0,0,0,0,0' ELSE array_to_string(list_concat(list_transform(range(7 - len(l)), lambda x: l[1]), l), ',') END AS weekly_trend,
  CASE WHEN now_aqi <= 50 THEN '{K.ADVISORIES[0][1]}' WHEN now_aqi <= 100 THEN '{K.ADVISORIES[1][1]}' WHEN now_aqi <= 200 THEN '{K.ADVISORIES[2][1]}'
    WHEN now_aqi <= 300 THEN '{K.ADVISORIES[3][1]}' WHEN now_aqi <= 400 THEN '{K.ADVISORIES[4][1]}' ELSE '{K.ADVISORIES[5][1]}' END AS advisory
FROM n LEFT JOIN lists USING (station_id)"""))
def prediction_records(spark, d):
    """Records of every station's newest row, with a forecast that differs from hour to hour."""
    table = V.readings(spark, d)
    newest = latest_by(table, ["station_id"], ["timestamp"])
    now = F.rint(F.coalesce("aqi", F.lit(0.0)))
    scored = newest.withColumns({f"pred_t{h}": now + 3.0 * h for h in HORIZONS})
    records = forecast.prediction_records(scored, HORIZONS, clean.weekly_trend(table), ["station_id", "timestamp"])
    return records.selectExpr(
        "station_id", "timestamp", "current_aqi", "primary_pollutant", "array_join(transform(forecast, x -> string(x)), ',') AS forecast",
        "pollutants['PM2_5'] AS pm25", "pollutants['O3'] AS o3", "size(pollutants) AS n_pollutants", "array_join(transform(weekly_trend, x -> string(x)), ',') AS weekly_trend", "advisory")


@query("gbt_predictions")
def gbt_predictions(spark, d):
    """The newest live row of every station scored by the models of all hours, as prediction records."""
    t, features, medians = training_table(spark, d)
    models = forecast.train_horizons(t.where("split = 'train'"), features, HORIZONS)
    flag = "_was_missing"
    flagged = [c.removesuffix(flag) for c in features if c.endswith(flag)]
    newest = live_features(spark, d, replace(series.OFFLINE, horizons=0), flagged)
    # What is left are the city's code and the target statistics: one value a station.
    fixed = [c for c in features if c not in newest.columns]
    known = t.groupBy("station_id").agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in fixed]).drop("_n")
    scored = forecast.score(forecast.impute_medians(newest.join(known, "station_id", "left"), features, medians), models)
    trends = clean.weekly_trend(V.readings(spark, d))
    return forecast.prediction_records(scored, HORIZONS, trends, ["station_id", "timestamp"]).selectExpr(
        "station_id", "timestamp", "current_aqi", "primary_pollutant", "forecast", "pollutants", "advisory")


STORED_CTE = """c AS (SELECT city, timestamp AS computed_at, CAST(round_even(max(aqi), 0) AS INTEGER) AS a, round(max(coalesce(pm25, 0)), 3) AS p FROM readings
  JOIN stations USING (station_id) WHERE aqi IS NOT NULL AND hour(timestamp) % 6 = 0 GROUP BY 1, 2), b AS (SELECT max(ts) - INTERVAL 36 HOUR AS since FROM events)"""


@query("latest_prediction", V.with_sql(R, V.STATIONS_CTE, STORED_CTE, select="""
SELECT city, computed_at, a + CASE WHEN computed_at >= since AND hour(computed_at) > 0 THEN 100 ELSE 0 END AS current_aqi,
  a + CASE WHEN computed_at >= since AND hour(computed_at) > 0 THEN 105 ELSE 5 END AS fifth_hour, p AS pm25,
  (SELECT count(*) FROM c) AS stored FROM c, b QUALIFY row_number() OVER (PARTITION BY city ORDER BY computed_at DESC) = 1"""))
def latest_prediction(spark, d):
    """Predictions of each city every six hours; the last ones are computed a second time and replace the first."""
    now = V.now_of(V.table(spark, d, "events"))
    named = V.readings(spark, d).join(V.stations(spark, d), "station_id").where("aqi IS NOT NULL AND hour(timestamp) % 6 = 0")
    rows = named.groupBy("city", F.col("timestamp").alias("computed_at")).agg(
        F.rint(F.max("aqi")).cast("int").alias("current_aqi"), F.round(F.max(F.coalesce("pm25", F.lit(0.0))), 3).alias("_pm25"))
    records = rows.select("city", "computed_at", "current_aqi", F.transform(F.sequence(F.lit(1), F.lit(24)), lambda h: F.col("current_aqi") + h).alias("forecast"),
                          F.create_map(F.lit("PM2_5"), "_pm25").alias("pollutants"), F.array_repeat("current_aqi", 7).alias("weekly_trend"))
    again = records.where((F.col("computed_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 36 hours")) & (F.hour("computed_at") > 0))
    again = again.withColumns({"current_aqi": F.col("current_aqi") + 100, "forecast": F.transform("forecast", lambda v: v + 100)})
    path = work_path(spark, "predictions")
    for batch in (records, again):
        forecast.store_predictions(path, batch)
    stored = incremental.read_table(spark, path)
    total = stored.agg(F.count("*").alias("stored"))
    return forecast.latest_predictions(stored).crossJoin(total).selectExpr(
        "city", "computed_at", "current_aqi", "forecast[4] AS fifth_hour", "pollutants['PM2_5'] AS pm25", "stored")


@query("forecast_summary", V.with_sql(R, FILL_CTE, "p AS (SELECT station_id, timestamp, " + ", ".join(
    f"CAST(greatest(0, round_even(lead(aqi, {h}) {WIN}, 0)) AS INTEGER) AS f{h}" for h in HORIZONS)
    + f", lead(aqi, 24) {WIN} IS NOT NULL AS complete FROM filled)", select=f"""
SELECT station_id, timestamp, greatest({', '.join(f'f{h}' for h in HORIZONS)}) AS peak,
  CAST(round_even(({' + '.join(f'f{h}' for h in HORIZONS)}) / 24e0, 0) AS INTEGER) AS mean_aqi,
  {V.sql_category('greatest(' + ', '.join(f'f{h}' for h in HORIZONS) + ')')} AS peak_category
FROM p WHERE complete"""))
def forecast_summary(spark, d):

    f = filled(spark, d).select("station_id", "timestamp", "aqi")
    t = series.add_targets(f, "aqi", HORIZONS)
    records = t.withColumn("forecast", forecast_array([f"aqi_t{h}" for h in HORIZONS]))
    out = forecast.forecast_summary(records, ["station_id", "timestamp"])
    return out.withColumn("peak_category", category("peak"))
