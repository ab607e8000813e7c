"""Registered queries against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import rows_of

DATA = "/root/testdata/sf0.001"
SAMPLE = [
    "aqi_station_hour", "weekly_trend", "unit_normalize", "weather_fanout", "live_merge", "sensor_registry_explode", "measurement_json",
    "location_choice", "quality_report", "profile_stats", "histogram", "group_boxplot", "target_encoding", "fill_offline", "rolling_features",
    "lead_targets", "first_n_cap", "drift_report", "insert_or_replace", "table_upsert", "registry_upsert", "fetch_plan", "backfill_plan",
    "metrics_pooled", "prediction_records", "error_rate", "latency_p95", "alert_hold", "stream_hourly",
    "chosen_features", "job_training_table", "job_ingest", "job_refresh", "job_drift",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    df = contract.queries()[name](spark, DATA)
    result = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and {"station_id", "timestamp", "aqi", "category"} <= set(df.columns)
