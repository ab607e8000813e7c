import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import forecast, monitor


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    rows = []
    for split, n in (("train", 60), ("val", 30), ("test", 10)):
        for _ in range(n):
            y1, y2 = rng.normal(100, 30, 2)
            rows.append((split, float(y1), float(y2), float(y1 + rng.normal(0, 5)), float(y2 + rng.normal(3, 9))))
    return rows, spark.createDataFrame(rows, "split string, aqi_t1 double, aqi_t2 double, pred_t1 double, pred_t2 double")


def arrays(rows, split):
    a = np.array([r[1:] for r in rows if r[0] == split])
    return {1: (a[:, 0], a[:, 2]), 2: (a[:, 1], a[:, 3])}


def brute(y, p):
    e = y - p
    return np.abs(e).mean(), np.sqrt((e ** 2).mean()), 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_metrics(scored):
    rows, df = scored
    sums = forecast.error_sums(df, (1, 2))
    per = {(r["split"], r["horizon"]): r for r in forecast.horizon_metrics(sums).collect()}
    pooled = {r["split"]: r for r in forecast.pooled_metrics(sums).collect()}
    averaged = {r["split"]: r for r in forecast.averaged_metrics(sums).collect()}
    for split in ("train", "val", "test"):
        data = arrays(rows, split)
        each = {h: brute(*data[h]) for h in data}
        for h, (mae, rmse, r2) in each.items():
            got = per[(split, h)]
            assert (got["mae"], got["rmse"], got["r2"]) == pytest.approx((mae, rmse, r2))
        e = np.concatenate([y - p for y, p in data.values()])
        sst = sum(((y - y.mean()) ** 2).sum() for y, _ in data.values())
        assert (pooled[split]["mae"], pooled[split]["rmse"], pooled[split]["r2"]) == pytest.approx(
            (np.abs(e).mean(), np.sqrt((e ** 2).mean()), 1 - (e ** 2).sum() / sst))
        assert averaged[split]["r2"] == pytest.approx(np.mean([x[2] for x in each.values()]))
        assert averaged[split]["rmse"] == pytest.approx(np.sqrt(np.mean([x[1] ** 2 for x in each.values()])))
    table = forecast.score_table(sums, "m", (1, 2)).where("split = 'val'").first()
    assert table["mae_t2"] == pytest.approx(per[("val", 2)]["mae"]) and table["model"] == "m"


def test_missing_predictions_do_not_count(spark):
    df = spark.createDataFrame([("val", 1.0, 2.0), ("val", 5.0, None), ("val", None, 3.0), ("test", None, None)], "split string, aqi_t1 double, pred_t1 double")
    rows = forecast.horizon_metrics(forecast.error_sums(df, (1,))).collect()
    assert [(r["split"], r["n"], r["mae"], r["r2"]) for r in rows] == [("val", 1, 1.0, None)]


def test_imputation_uses_training_medians(spark):
    df = spark.createDataFrame([("train", 1.0, None), ("train", 3.0, None), ("train", None, None), ("test", None, 9.0), ("test", 100.0, None)], "split string, a double, b double")
    out = [(r["split"], r["a"], r["b"]) for r in forecast.impute_medians(df, ["a", "b"]).orderBy("split", "a").collect()]
    assert out == [("test", 2.0, 9.0), ("test", 100.0, 0.0), ("train", 1.0, 0.0), ("train", 2.0, 0.0), ("train", 3.0, 0.0)]


def test_training_beats_a_constant_and_scores(spark):
    df = spark.range(400).selectExpr("double(id % 20) AS x", "double((id * 7) % 13) AS z", "double(id % 20) * 3 AS aqi_t1", "double(id % 20) * 3 AS aqi",
                                     "CASE WHEN id < 300 THEN 'train' ELSE 'val' END AS split")
    models = forecast.train_horizons(df.where("split = 'train'"), ["x", "z"], (1,), trees=9, depth=3, least=1, rate=0.5, columns=1.0)
    out = forecast.score(df.where("split = 'val'"), models)
    assert forecast.horizon_metrics(forecast.error_sums(out, (1,))).first()["r2"] > 0.9
    ranges = {"depth": (1, 3), "trees": (2, 9), "rate": (0.1, 0.9), "least": (1, 1)}
    best, trials = forecast.search_parameters(df, ["x", "z"], "aqi_t1", ranges, 5)
    unseen = df.withColumn("aqi_t1", F.when(F.col("split") == "test", -1e6).otherwise(F.col("aqi_t1")))
    assert forecast.search_parameters(unseen, ["x", "z"], "aqi_t1", ranges, 5)[1].collect() == trials.collect()
    rows = trials.collect()
    top = max(rows, key=lambda r: r["r2"])
    assert len(rows) == 5 and (best.spec.depth, best.spec.trees, best.spec.rate) == (top["depth"], top["trees"], top["rate"])
    assert all(1 <= r["depth"] <= 3 and 2 <= r["trees"] <= 9 and 0.1 <= r["rate"] <= 0.9 and r["best_r2"] >= r["r2"] for r in rows)
    naive = forecast.persistence(df, (1,))
    assert naive.where("pred_t1 <> aqi").count() == 0


def test_best_model(spark):
    df = spark.createDataFrame([("a", "val", 5.0), ("b", "val", 4.0), ("c", "test", 1.0)], "model string, split string, mae double")
    assert tuple(forecast.best_model(df).first()) == ("b", 4.0)
    assert tuple(forecast.best_model(df, smaller=False).first()) == ("a", 5.0)


def test_prediction_records(spark):
    df = spark.createDataFrame([("S1", None, 7.0, 9.0, 50.4, -3.0), ("S2", 120.5, None, None, 1.0, 2.0)], "station_id string, aqi double, pm25 double, co double, pred_t1 double, pred_t2 double")
    trends = spark.createDataFrame([("S1", [1] * 7)], "station_id string, weekly_trend array<int>")
    out = {r["station_id"]: r for r in forecast.prediction_records(df, (1, 2), trends, ["station_id"]).collect()}
    one, two = out["S1"], out["S2"]
    assert one["forecast"] == [50] + [0] * 23 and one["current_aqi"] == 50 and one["primary_pollutant"] == "CO" and one["weekly_trend"] == [1] * 7
    assert two["current_aqi"] == 120 and two["pollutants"] == dict.fromkeys(["PM2_5", "PM10", "NO2", "SO2", "CO", "O3"], 0.0) and two["weekly_trend"] == [1] + [2] * 6
    assert "good" in one["advisory"] and "Moderate" in two["advisory"]
    with pytest.raises(ValueError):
        forecast.prediction_records(df.withColumn("pred_t24", F.lit(1.0)), (1, 24), trends, ["station_id"])
    summary = {r["station_id"]: (r["peak"], r["mean_aqi"]) for r in forecast.forecast_summary(spark.createDataFrame(list(out.values())), ["station_id"]).collect()}
    assert summary == {"S1": (50, 2), "S2": (2, 2)}


START = dt.datetime(2024, 1, 1)


def log(spark, rows):
    data = [(START + dt.timedelta(seconds=s), "C1", status, latency, 1) for s, status, latency in rows]
    return spark.createDataFrame(data, "ts timestamp_ntz, city string, status string, latency double, rows_written int")


def test_error_rate_equals_sliding_window_over_the_log(spark):
    requests = log(spark, [(s, "error" if s % 70 == 0 else "ok", 0.2) for s in range(0, 1500, 35)])
    got = {r["window_start"]: (r["total"], r["errors"], r["breach"]) for r in monitor.error_rate(requests).collect()}
    direct = requests.groupBy(F.window("ts", "5 minutes", "1 minute")).agg(F.count("*").alias("t"), F.count(F.when(F.col("status") == "error", 1)).alias("e"))
    assert got == {r[0]["start"]: (r["t"], r["e"], r["e"] / r["t"] > 0.05) for r in direct.collect()}


def test_latency_quantile_interpolates_in_its_bucket(spark):
    # 90 requests below 0.1 s and 10 between 2 and 5 s: the 95th is half way through that bucket.
    requests = log(spark, [(i, "ok", 0.05) for i in range(45)] * 2 + [(i, "ok", 3.0) for i in range(10)])
    row = monitor.latency_p95(requests).orderBy("window_start").first()
    assert row["total"] == 100 and row["p95"] == pytest.approx(3.5) and not row["breach"]
    slow = monitor.latency_p95(log(spark, [(0, "ok", 99.0)])).first()
    assert slow["p95"] == 30.0 and slow["breach"]


def test_failed_and_silent(spark):
    requests = log(spark, [(0, "ok", 1.0), (60 * 25, "error", 1.0), (86400 + 60 * 5, "ok", 1.0)])
    failed = monitor.failed_fetches(requests, status="error").where("breach")
    assert failed.count() == 10 and monitor.failed_fetches(requests).where("breach").count() == 0
    assert monitor.failed_fetches(requests.replace({"error": "failed"}, subset=["status"])).where("breach").count() == 10
    silent = [r[0] for r in monitor.silent_windows(requests, 10).orderBy("window_start").collect()]
    assert len(silent) == 144 - 2 and silent[0] == START + dt.timedelta(minutes=10) and START + dt.timedelta(minutes=20) not in silent


def test_a_run_over_midnight_is_one(spark):
    df = spark.createDataFrame([("a", START + dt.timedelta(minutes=m), True) for m in range(1435, 1446)] + [("b", START + dt.timedelta(minutes=1440), True)],
                               "alert string, window_end timestamp_ntz, breach boolean")
    out = monitor.held(df, "2 minutes").collect()
    assert [(r["alert"], r["active_since"], r["evaluations"]) for r in out] == [("a", START + dt.timedelta(minutes=1435), 11)]


def test_hold_needs_an_unbroken_run(spark):
    minutes = [0, 1, 2, 3, 10, 11, 20, 21, 22, 24]
    df = spark.createDataFrame([("a", START + dt.timedelta(minutes=m), True) for m in minutes] + [("a", START + dt.timedelta(minutes=23), False)],
                               "alert string, window_end timestamp_ntz, breach boolean")
    out = [(r["active_since"].minute, r["firing_since"].minute, r["last_breach"].minute, r["evaluations"]) for r in monitor.held(df, "2 minutes").orderBy("active_since").collect()]
    assert out == [(0, 2, 3, 4), (20, 22, 22, 3)]


def test_stale_and_counts(spark):
    df = spark.createDataFrame([("S1", START), ("S2", START + dt.timedelta(hours=3))], "station_id string, timestamp timestamp_ntz")
    assert {r["station_id"]: r["breach"] for r in monitor.stale(df, "2024-01-01 04:00:00").collect()} == {"S1": True, "S2": False}
    counts = monitor.request_counts(log(spark, [(0, "ok", 1.0), (1, "ok", 1.0), (2, "error", 1.0)])).collect()
    assert {r["status"]: (r["requests"], r["rows_written"]) for r in counts} == {"ok": (2, 2), "error": (1, 1)}
