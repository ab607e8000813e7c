import datetime as dt
import json

import pytest

from aerolens.operators import forecast, quality
from aerolens.plans import jobs
from aerolens.sources import files

NOW = "2024-02-10 00:00:00"


@pytest.fixture
def readings(spark):
    """Forty days of hourly readings of two stations; the last week of one is higher."""
    return spark.range(960 * 2).selectExpr(
        "concat('S', id % 2) AS station_id", "'Delhi' AS city",
        "TIMESTAMP_NTZ '2024-02-10' - make_dt_interval(0, CAST(id DIV 2 AS INT)) AS timestamp",
        "20.0D + id % 24 + CASE WHEN id < 336 THEN 40 ELSE 0 END AS pm25", "double(id % 7) AS no2",
        "30.0D + id % 24 + CASE WHEN id < 336 THEN 40 ELSE 0 END AS aqi", "double(id % 9) AS temperature_2m")


def test_training_and_features(spark, tmp_path):
    raw = spark.range(400).selectExpr(
        "concat('S', id % 2) AS station_id", "TIMESTAMP_NTZ '2019-01-01 00:20:00' + make_dt_interval(0, CAST(id DIV 2 AS INT)) AS timestamp",
        "double(id % 50) AS pm25", "CASE WHEN id % 3 = 0 THEN double(id % 30) END AS no2", "double(id % 90) AS aqi")
    stations = spark.createDataFrame([("S0", "North", "Delhi", "DL"), ("S1", "South", "Pune", "MH")], "station_id string, station_name string, city string, state string")
    places = spark.createDataFrame([("Delhi", 28.6, 77.2)], "city string, latitude double, longitude double")
    jobs.station_config(stations, places, str(tmp_path / "config"))
    config = files.read_station_config(spark, str(tmp_path / "config"))
    assert [r["station_id"] for r in config.collect()] == ["S0"]
    weather = spark.range(250).selectExpr("'Delhi' AS city", "TIMESTAMP_NTZ '2019-01-01' + make_dt_interval(0, CAST(id AS INT)) AS timestamp", "double(id) AS temperature_2m")
    table = jobs.training_table(raw, stations, config, weather, "2019-01-01", "2019-12-31")
    assert table.count() == 200 and table.where("temperature_2m IS NULL OR latitude <> 28.6").count() == 0
    assert jobs.training_table(raw, stations, config, weather, "2019-01-01", "2019-01-02", city="pune").select("city").distinct().first()[0] == "Pune"
    features = jobs.feature_table(table)
    assert features.count() == 200 - 24
    assert {"no2_was_missing", "pm25_lag168", "aqi_t24", "temperature_2m_roll24_mean", "pm25_x_no2"} <= set(features.columns)
    with pytest.raises(quality.QualityError):
        jobs.training_table(raw.withColumn("pm25", -raw["pm25"]), stations, config, weather, "2019-01-01", "2019-12-31")


def test_ingest_and_refresh(spark, tmp_path):
    registry = spark.createDataFrame([("S1", "Delhi", "n", 1, "l", 7, "pm25", "ug/m3", None, None)],
                                     "station_id string, city string, station_name string, openaq_location_id int, openaq_location_name string, sensor_id int, "
                                     "parameter string, units string, last_fetched_hour timestamp_ntz, last_successful_sync timestamp_ntz")

    def landed(hours):
        docs = [(i, 7, json.dumps({"value": 15.0 + h, "period": {"datetimeFrom": {"utc": f"2024-01-01T{h:02d}:00:00Z"}}})) for i, h in enumerate(hours)]
        return spark.createDataFrame(docs + [(99, 7, "{}")], "seq int, sensor_id int, payload string")

    path = str(tmp_path / "m")
    registry, added = jobs.ingest(landed([0, 1, 1]), registry, path, NOW, ["seq"])
    assert added == 2 and registry.first()["last_fetched_hour"] == dt.datetime(2024, 1, 1, 1)
    registry, added = jobs.ingest(landed([1, 2]), registry, path, NOW, ["seq"])
    assert added == 1 and registry.first()["last_fetched_hour"] == dt.datetime(2024, 1, 1, 2)
    weather = spark.sql("SELECT 'Delhi' AS city, TIMESTAMP_NTZ '2024-01-01' AS timestamp, 5.0D AS temperature_2m")
    for _ in range(2):
        jobs.refresh_readings(spark.read.parquet(path), weather, str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy("timestamp").collect()
    assert [(r["pm25"], r["aqi"], r["temperature_2m"]) for r in rows] == [(15.0, 25.0, 5.0), (16.0, pytest.approx(50 / 30 * 16), None), (17.0, pytest.approx(50 / 30 * 17), None)]


def test_predictions_and_drift(spark, readings, tmp_path):
    train = readings.selectExpr("aqi", "pm25", "double(0) AS benzene_lag1", "aqi AS aqi_t1", "aqi + 1 AS aqi_t2")
    features = ["aqi", "pm25", "benzene_lag1"]
    models = forecast.train_horizons(train, features, (1, 2), trees=2, depth=2, least=1)
    short = readings.where("station_id = 'S0' OR timestamp > TIMESTAMP_NTZ '2024-02-05'")
    out = jobs.predictions(short, models, features, NOW).collect()
    assert [(r["station_id"], r["timestamp"], len(r["forecast"]), len(r["weekly_trend"])) for r in out] == [("S0", dt.datetime(2024, 2, 10), 24, 7)]
    summary = jobs.drift_run(readings, str(tmp_path / "h"), NOW).first()
    assert summary["features_checked"] == 2 and summary["drifted_features"] == ["pm25"] and summary["retrain_recommended"]
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
