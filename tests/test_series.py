import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolens.operators import series

SIZES = {"A": 700, "B": 60, "C": 1}


def frame(df, *order):
    return df.toPandas().sort_values(["station_id", "timestamp"]).reset_index(drop=True)


def close(a, b):
    assert np.allclose(a.astype(float), b.astype(float), equal_nan=True)


@pytest.fixture
def table(make_series):
    return make_series(SIZES)


@pytest.fixture(params=[None, 170], ids=["one_segment", "many_segments"])
def rows(request, monkeypatch):
    """Rows of a segment."""
    if request.param:
        monkeypatch.setattr(series, "SEGMENT_ROWS", request.param)


def test_lags_and_rolling_equal_pandas(table, rows):
    filled = table.na.fill(0.0)
    out = frame(series.add_rolling(series.add_lags(filled, ["aqi"], (1, 6, 168)), ["aqi"], (3, 24), extremes=(24,)))
    by = out.groupby("station_id")["aqi"]
    for k in (1, 6, 168):
        close(out[f"aqi_lag{k}"], by.shift(k))
    for w in (3, 24):
        roll = by.transform(lambda s: s.shift(1).rolling(w, min_periods=1).mean())
        close(out[f"aqi_roll{w}_mean"], roll)
        close(out[f"aqi_roll{w}_std"], by.transform(lambda s: s.shift(1).rolling(w, min_periods=1).std()))
    close(out["aqi_roll24_max"], by.transform(lambda s: s.shift(1).rolling(24, min_periods=1).max()))
    close(out["aqi_roll24_min"], by.transform(lambda s: s.shift(1).rolling(24, min_periods=1).min()))


def test_diffs_and_targets(table, rows):
    filled = table.na.fill(0.0)
    out = frame(series.add_diffs(filled, "aqi", (1, 24)))
    close(out["aqi_diff24"], out.groupby("station_id")["aqi"].diff(24))
    targets = series.add_targets(filled, "aqi", range(1, 25))
    # Exactly the last 24 rows of each series drop.
    assert {r["station_id"]: r["count"] for r in targets.groupBy("station_id").count().collect()} == {"A": 676, "B": 36}
    every = frame(series.add_targets(filled, "aqi", (24,), complete_only=False))
    close(every["aqi_t24"], every.groupby("station_id")["aqi"].shift(-24))


def test_fill_forward(table, rows):
    got = frame(series.fill_forward(table, ["aqi", "pm25"]))
    want = frame(table)
    for c in ("aqi", "pm25"):
        close(got[c], want.groupby("station_id")[c].ffill())


def test_fill_offline_uses_the_median_of_the_filled_series(table, rows):
    got = frame(series.fill_offline(table, ["aqi", "pm25"]))
    want = frame(table)
    for c in ("aqi", "pm25"):
        filled = want.groupby("station_id")[c].ffill()
        median = filled.groupby(want["station_id"]).transform("median")
        close(got[c], filled.fillna(median).fillna(0.0))


def test_fill_offline_of_a_column_without_values(spark, rows):
    df = spark.sql("SELECT 'A' AS station_id, TIMESTAMP_NTZ '2024-01-01' AS timestamp, CAST(NULL AS DOUBLE) AS aqi")
    assert series.fill_offline(df, ["aqi"]).first()["aqi"] == 0.0


def test_fill_live(table):
    got, want = frame(series.fill_live(table, ["aqi"])), frame(table)
    close(got["aqi"], want.groupby("station_id")["aqi"].transform(lambda s: s.ffill().bfill().fillna(0.0)))


def test_engineer_is_the_same_in_segments(table, monkeypatch):
    filled = table.na.fill(1.0).withColumn("wind_direction_10m", F.lit(90.0))
    spec = series.FeatureSpec(pollutants=("aqi", "pm25"), lags=(1, 48), rolling=(6, 24), extremes=(24,), diffs=(1, 24), horizons=24,
                              interactions=(("x", "aqi", "pm25"),), calendar_parts=("hour_of_day", "month"),
                              cycles=(("hour_of_day", 24, "hour"), ("wind_direction_10m", 360, "wind_dir")))
    a = frame(series.engineer(filled, spec))
    monkeypatch.setattr(series, "SEGMENT_ROWS", 60)
    b = frame(series.engineer(filled, spec))
    assert list(a.columns) == list(b.columns) and len(a) == 676 + 36
    for c in a.columns[2:]:
        close(a[c], b[c])
    assert a["wind_dir_sin"].iloc[0] == pytest.approx(1.0)
    assert not a.isnull().any().any()


def test_engineered_last_row(table, rows):
    filled = table.na.fill(1.0)
    spec = series.FeatureSpec(pollutants=("aqi",), lags=(1, 24), rolling=(6,))
    every = frame(series.engineer(filled, spec)).groupby("station_id").tail(1).reset_index(drop=True)
    pd.testing.assert_frame_equal(every, frame(series.engineer(filled, spec, last_only=True)))


def test_filling_many_columns_plans_quickly(table):
    import time
    wide = table.withColumns({f"c{i}": F.col("pm25") + i for i in range(17)})
    columns = ["aqi", "pm25", *[f"c{i}" for i in range(17)]]
    start = time.perf_counter()
    out = series.fill_offline(wide, columns)
    out._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - start < 10
    assert out.where(" OR ".join(f"{c} IS NULL" for c in columns)).count() == 0


def test_specs_name_the_live_and_training_features(spark):
    columns = [*series.LIVE.pollutants, *series.LIVE.weather, "wind_direction_10m"]
    df = spark.range(3).selectExpr(
        "'A' AS station_id", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS timestamp", *[f"double(id) AS {c}" for c in columns])
    live = series.engineer(df, series.LIVE).columns
    for name in ("pm25_lag168", "xylene_roll168_min", "precipitation_roll48_std", "aqi_diff3", "season", "day_of_year_cos",
                 "pm25_x_wind", "no2_x_temp", "wind_dir_cos"):
        assert name in live
    assert "pm25_lag2" not in live and "aqi_t1" not in live
    offline = series.engineer(df, series.OFFLINE).columns
    for name in ("pm25_lag72", "aqi_roll48_std", "wind_speed_10m_roll24_mean", "aqi_t24", "pm25_x_no2", "day_of_week_sin"):
        assert name in offline
    assert "wind_speed_10m_roll24_std" not in offline and "aqi_diff3" not in offline


def test_calendar_zone_changes_the_clock(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 20:00:00' AS timestamp")
    from dataclasses import replace
    utc = series.add_calendar(df, series.OFFLINE).first()
    local = series.add_calendar(df, replace(series.OFFLINE, zone="Asia/Kolkata")).first()
    assert (utc["hour_of_day"], utc["month"]) == (20, 1) and (local["hour_of_day"], local["month"]) == (1, 2)


def test_missing_flags(table):
    out = series.add_missing_flags(table, ["pm25"])
    assert out.where("(pm25 IS NULL) <> (pm25_was_missing = 1)").count() == 0


def test_enough_history(table):
    assert {r[0] for r in series.enough_history(table, rows=60).select("station_id").distinct().collect()} == {"A", "B"}


def test_densify_adds_exactly_the_missing_hours(table):
    out = frame(series.densify(table))
    raw = frame(table)
    for station, rows in raw.groupby("station_id"):
        grid = pd.date_range(rows["timestamp"].min(), rows["timestamp"].max(), freq="h")
        assert list(out[out["station_id"] == station]["timestamp"]) == list(grid)
    assert out["aqi"].notna().sum() == raw["aqi"].notna().sum()


def test_sequences(table, rows):
    out = frame(series.sequence_windows(table.na.fill(0.0), ["aqi"], 24))
    raw = frame(table.na.fill(0.0))
    a = raw[raw["station_id"] == "A"]["aqi"].tolist()
    got = out[out["station_id"] == "A"]["aqi_seq"].tolist()
    assert len(got) == 700 - 23 and list(got[0]) == a[:24] and list(got[-1]) == a[-24:]
