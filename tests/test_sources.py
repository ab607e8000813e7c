import json

import pytest
from pyspark.sql import functions as F

from aerolens.functions import constants as K
from aerolens.sources import files, payloads


def test_readings_csv_coerces_and_renames(spark, tmp_path):
    path = tmp_path / "station_hour.csv"
    path.write_text("StationId, Datetime,PM2.5 ,CO,AQI,AQI_Bucket\n"
                    "S1,2020-01-01 01:10:00, 12.5,0.4,88,Good\nS1,not a date,x,,NaN,\nS2,2020-01-02,1e2,NA,-,Poor\n")
    rows = files.read_readings_csv(spark, str(path)).collect()
    assert [r["station_id"] for r in rows] == ["S1", "S1", "S2"]
    assert [str(r["timestamp"]) for r in rows] == ["2020-01-01 01:10:00", "None", "2020-01-02 00:00:00"]
    assert [r["pm25"] for r in rows] == [12.5, None, 100.0]
    assert [r["co"] for r in rows] == [0.4, None, None] and [r["aqi"] for r in rows] == [88.0, None, None]
    assert rows[0]["aqi_bucket"] == "Good"


def test_stations_csv_and_config(spark, tmp_path):
    (tmp_path / "s.csv").write_text(" StationId,StationName ,City,State,Status\nS1,North,Delhi,DL,Active\n")
    row = files.read_stations_csv(spark, str(tmp_path / "s.csv")).first().asDict()
    assert row == {"station_id": "S1", "station_name": "North", "city": "Delhi", "state": "DL", "status": "Active"}
    (tmp_path / "c.csv").write_text("station_id,city,latitude,longitude\nS1,Delhi,28.6,77.2\n")
    assert files.read_station_config(spark, str(tmp_path / "c.csv")).first()["latitude"] == 28.6


def test_parquet_prunes_columns_and_pushes_stations(make_series, spark, tmp_path):
    files.write_readings(make_series({"A": 30, "B": 5}), str(tmp_path / "r"))
    out = files.read_readings(spark, str(tmp_path / "r"), ["station_id", "aqi"], ["B"])
    assert out.count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(station_id), EqualTo(station_id,B)]" in plan or "In(station_id, [B])" in plan
    assert "pm25" not in plan


def test_float32_sink(spark):
    df = files.to_float32(spark.sql("SELECT 1.5D AS a, 2 AS b, 'x' AS c"))
    assert df.dtypes == [("a", "float"), ("b", "int"), ("c", "string")]


def test_reports(spark, tmp_path):
    df = spark.sql("SELECT 'pm25' AS feature, 1.5D AS mean")
    files.write_report(df, str(tmp_path / "j"))
    files.write_report(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).first()["mean"] == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["feature"] == "pm25"


START = {"utc": "2024-01-01T05:00:00Z", "local": "2024-01-01T10:30:00+05:30"}


@pytest.mark.parametrize("period", [
    {"datetimeFrom": START}, [{"datetimeFrom": START}], {"datetimeFrom": [START]}, [{"datetimeFrom": [START]}],
])
def test_measurement_shapes(spark, period):
    df = spark.createDataFrame([(1, "co", "ppb", json.dumps({"value": 1000.0, "period": period}))],
                               "sensor_id int, parameter string, raw_unit string, payload string")
    row = payloads.target_measurements(payloads.flatten_measurements(df)).first()
    assert str(row["measurement_time"]) == "2024-01-01 05:00:00" and row["local_time"] == START["local"]
    assert row["raw_value"] == 1000.0 and row["value"] == pytest.approx(28.01 / 24.45) and row["units"] == "mg/m3"


@pytest.mark.parametrize("payload", ['{"value": 1}', '{"period": [], "value": 1}', "{broken", '{"period": {"datetimeFrom": {}}, "value": "x"}'])
def test_unusable_measurements_drop(spark, payload):
    df = spark.createDataFrame([("pm25", "ug/m3", payload)], "parameter string, raw_unit string, payload string")
    flat = payloads.flatten_measurements(df)
    assert flat.count() == 1 and payloads.target_measurements(flat).count() == 0


def test_payload_is_parsed_once(spark):
    df = spark.createDataFrame([("pm25", "ug/m3", "{}")], "parameter string, raw_unit string, payload string")
    plan = payloads.target_measurements(payloads.flatten_measurements(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_only_target_parameters_stay(spark):
    df = spark.sql("SELECT 'humidity' AS parameter, TIMESTAMP_NTZ '2024-01-01' AS measurement_time, 1.0D AS value")
    assert payloads.target_measurements(df).count() == 0


def test_weather_arrays_become_rows(spark):
    body = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "bad"], "temperature_2m": [1.0, None, 3.0], "cloud_cover": [5.0]}}
    df = spark.createDataFrame([("Delhi", json.dumps(body))], "city string, payload string")
    rows = payloads.flatten_weather(df).orderBy("timestamp").collect()
    assert [(str(r["timestamp"]), r["city"], r["temperature_2m"], r["cloud_cover"], r["precipitation"]) for r in rows] == [
        ("2024-01-01 00:00:00", "Delhi", 1.0, 5.0, None), ("2024-01-01 01:00:00", "Delhi", None, None, None)]


def test_current_weather_is_stamped_with_the_hour(spark):
    df = spark.sql("""SELECT 'Delhi' AS city, TIMESTAMP_NTZ '2024-01-01 07:45:12' AS fetched_at, '{"current": {"temperature_2m": 21.5}}' AS payload""")
    row = payloads.current_weather(df).first()
    assert str(row["timestamp"]) == "2024-01-01 07:00:00" and row["temperature_2m"] == 21.5 and row["precipitation"] is None


def test_registry_shapes(spark):
    sensors = [{"id": 1, "parameter": {"name": "pm25", "units": "ug/m3"}}, {"id": 2, "parameter": "no2", "units": "ppb"},
               {"id": 3, "parameter": {"name": "co"}, "units": "ppm"}, {"parameter": "so2"}, {"id": 5}, {"id": 6, "parameter": {}}]
    head = {"station_id": "S1", "city": "Delhi", "station_name": "North", "openaq_location_id": 17, "openaq_location_name": "N"}
    docs = [{**head, "available_sensors": sensors}, {**head, "available_sensors": json.dumps(sensors)},
            {**head, "available_sensors": "broken"}, {**head, "available_sensors": None}, head]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc int, payload string")
    out = payloads.explode_registry(df)
    for doc in (0, 1):
        got = sorted((r["sensor_id"], r["parameter"], r["units"], r["openaq_location_id"]) for r in out.where(F.col("doc") == doc).collect())
        assert got == [(1, "pm25", "ug/m3", 17), (2, "no2", "ppb", 17), (3, "co", "ppm", 17)]
    assert out.where("doc > 1").count() == 0


def test_location_sensors(spark):
    doc = {"id": 9, "sensors": [{"id": 1, "parameter": {"name": "pm25", "units": "u", "displayName": "PM2.5"}}, {"id": 2, "parameter": {}}, {"parameter": {"name": "co"}}]}
    rows = payloads.location_sensors(spark.createDataFrame([(json.dumps(doc),)], "payload string")).collect()
    assert [tuple(r) for r in rows] == [(9, 1, "pm25", "u", "PM2.5")]


def test_prediction_round_trip(spark):
    df = spark.sql("SELECT 'Delhi' AS city, array(1, 2) AS forecast, map('PM10', 1.5D) AS pollutants, array(7) AS weekly_trend")
    stored = payloads.prediction_to_json(df)
    assert stored.first()["forecast_json"] == "[1,2]"
    assert payloads.prediction_from_json(stored).select(*df.columns).collect() == df.collect()


def test_fixed_tables_are_complete():
    assert len(K.POLLUTANTS) == 12 and len(K.BREAKPOINTS) == 7 and sum(map(len, K.BREAKPOINTS.values())) == 42
    assert K.CANONICAL_UNIT["co"] == "mg/m3" and set(K.CANONICAL_UNIT) == set(K.POLLUTANTS)
