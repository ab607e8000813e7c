import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolens.operators import incremental as I

SCHEMA = "city string, station_id string, timestamp timestamp_ntz, aqi double, seq int"
KEYS = ["city", "station_id", "timestamp"]


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("D", "S1", at(0), 1.0, 0), ("D", None, at(0), 2.0, 0), ("D", "S1", at(5), 3.0, 0)], SCHEMA)


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([("D", "S1", at(0), 10.0, 1), ("D", "S1", at(0), 11.0, 2), ("D", None, at(0), 12.0, 1), ("D", "S2", at(0), 13.0, 1)], SCHEMA)


def values(df):
    return sorted((r["station_id"] or "", r["timestamp"].hour, r["aqi"]) for r in df.collect())


def test_replace_keeps_the_last(stored, batch):
    assert values(I.insert_or_replace(stored, batch, KEYS, ["seq"])) == [("", 0, 12.0), ("S1", 0, 11.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]


def test_ignore_keeps_the_first(stored, batch):
    assert values(I.insert_or_ignore(stored, batch, KEYS, ["seq"])) == [("", 0, 2.0), ("S1", 0, 1.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]
    assert I.new_rows(stored, batch, KEYS, ["seq"]).count() == 1


def test_table_upsert_touches_only_its_days(spark, tmp_path, stored, batch):
    path = str(tmp_path / "t")
    later = spark.createDataFrame([("D", "S1", at(0, 2), 50.0, 0)], SCHEMA)
    I.upsert_table(path, stored.unionByName(later), KEYS, ["seq"])
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "date=2024-01-02").iterdir()}
    for _ in range(2):  # a repeated batch changes nothing
        I.upsert_table(path, batch, KEYS, ["seq"])
        assert values(spark.read.parquet(path)) == [("", 0, 12.0), ("S1", 0, 11.0), ("S1", 0, 50.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "date=2024-01-02").iterdir()} == untouched
    I.upsert_table(path, batch.where("false"), KEYS, ["seq"])
    assert spark.read.parquet(path).count() == 5


def test_table_insert_counts_new_rows(spark, tmp_path, stored, batch):
    path = str(tmp_path / "t")
    counts = [I.insert_into_table(path, b, KEYS, ["seq"], "timestamp") for b in (stored, batch, batch)]
    assert counts == [3, 1, 0]
    assert values(spark.read.parquet(path)) == [("", 0, 2.0), ("S1", 0, 1.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]


def test_rows_without_a_time_are_kept_and_replayed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [[("D", "S1", None, 1.0, 0)], [("D", "S2", None, 2.0, 0), ("D", "S1", at(3), 3.0, 0)], [("D", "S2", None, 4.0, 1)]]
    for batch in rows:
        for _ in range(2):
            I.upsert_table(path, spark.createDataFrame(batch, SCHEMA), KEYS, ["seq"])
    got = sorted((r["station_id"], r["timestamp"] is None, r["aqi"]) for r in I.read_table(spark, path).collect())
    assert got == [("S1", False, 3.0), ("S1", True, 1.0), ("S2", True, 4.0)]


def test_insert_of_rows_without_a_time_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("D", "S1", None, 1.0, 0), ("D", None, None, 2.0, 0)], SCHEMA)
    assert [I.insert_into_table(path, batch, KEYS, ["seq"], "timestamp") for _ in range(2)] == [2, 0]
    assert I.read_table(spark, path).count() == 2


def test_new_columns_widen_the_table(spark, tmp_path, stored):
    path = str(tmp_path / "t")
    I.upsert_table(path, stored, KEYS, ["seq"])
    wider = spark.createDataFrame([("D", "S1", at(0, 2), 5.0, 0, 7.0)], SCHEMA + ", w double")
    I.upsert_table(path, wider, KEYS, ["seq"])
    assert sorted((r["aqi"], r["w"]) for r in I.read_table(spark, path).collect()) == [(1.0, None), (2.0, None), (3.0, None), (5.0, 7.0)]


def tree(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*"))


def test_a_replacement_that_broke_off_is_read_where_it_is_and_repeated_by_a_writer(spark, tmp_path, stored, batch):
    path = str(tmp_path / "t")
    I.upsert_table(path, stored, KEYS, ["seq"])
    merged = I.insert_or_replace(I.read_table(spark, path), batch.withColumn("date", F.to_date("timestamp")), KEYS, ["seq"])
    merged.write.partitionBy("date").parquet(path + "_pending")  # staged, but not yet moved into the table
    before, expected = tree(tmp_path), [("", 0, 12.0), ("S1", 0, 11.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]
    assert values(I.read_table(spark, path)) == values(I.read_table(spark, path)) == expected
    assert tree(tmp_path) == before  # readers leave everything in its place
    I.upsert_table(path, batch, KEYS, ["seq"])
    assert values(I.read_table(spark, path)) == expected and not (tmp_path / "t_pending").exists()
    (tmp_path / "t_pending").mkdir()  # staging itself broke off
    assert I.read_table(spark, path).count() == 4


def test_a_reader_between_staging_and_replacement_disturbs_no_writer(spark, tmp_path, stored, batch, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    I.upsert_table(path, stored, KEYS, ["seq"])
    recover = I._recover

    def watched(spark, where):
        if (tmp_path / "t_pending").exists():
            seen.append(values(I.read_table(spark, path)))
        recover(spark, where)
    monkeypatch.setattr(I, "_recover", watched)
    I.upsert_table(path, batch, KEYS, ["seq"])
    assert seen == [values(I.read_table(spark, path))] == [[("", 0, 12.0), ("S1", 0, 11.0), ("S1", 5, 3.0), ("S2", 0, 13.0)]]


def test_retention_drops_whole_days_and_rewrites_only_the_cut_day(spark, tmp_path):
    path, start = str(tmp_path / "t"), dt.datetime(2024, 1, 1)
    hours = [start + dt.timedelta(hours=h) for h in range(96)] + [None]
    rows = spark.createDataFrame([("S", h, 1.0, 1) for h in hours], "station_id string, timestamp timestamp_ntz, value double, seq int")
    I.upsert_table(path, rows, ["station_id", "timestamp"], ["seq"])
    later = {p.name: tree(p) for p in (tmp_path / "t").iterdir() if p.name.startswith("date=2024-01-04")}
    for _ in range(2):  # a repeated run changes nothing
        I.retain_table(spark, path, "2024-01-05 06:00:00", days=2)
        left = {r["timestamp"] for r in I.read_table(spark, path).collect()}
        assert left == {h for h in hours if h is None or h >= dt.datetime(2024, 1, 3, 6)}
    names = {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert names == {"date=2024-01-03", "date=2024-01-04", "date=__HIVE_DEFAULT_PARTITION__"}
    assert later == {"date=2024-01-04": tree(tmp_path / "t" / "date=2024-01-04")}
    I.retain_table(spark, path, "2024-01-06 00:00:00", days=2)  # at midnight no day is read
    assert I.read_table(spark, path).where("timestamp IS NOT NULL").agg(F.min("timestamp")).first()[0] == dt.datetime(2024, 1, 4)
    I.retain_table(spark, path, "2024-01-04 23:59:00", hours=0)  # nothing of the cut day is left
    assert [r["timestamp"] for r in I.read_table(spark, path).collect()] == [None]
    I.retain_table(spark, str(tmp_path / "none"), "2024-01-06 00:00:00", days=2)


def test_keys_must_hold_the_time(tmp_path, stored):
    with pytest.raises(ValueError):
        I.upsert_table(str(tmp_path / "t"), stored, ["city", "station_id"], ["seq"])


def test_missing_time_becomes_now(spark):
    df = spark.createDataFrame([(None,), (at(3),)], "timestamp timestamp_ntz")
    assert [r[0] for r in I.stamp_missing_time(df, "2024-01-01 09:00:00").collect()] == [at(9), at(3)]


REGISTRY = ("station_id string, city string, station_name string, openaq_location_id int, openaq_location_name string, sensor_id int, "
            "parameter string, units string, last_fetched_hour timestamp_ntz, last_successful_sync timestamp_ntz")


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([("S1", "D", "n", 1, "l", 10, "pm25", "u", at(3), at(4)), ("S1", "D", "n", 1, "l", 11, "co", "u", at(3), at(4))], REGISTRY)


def test_registry_upsert_keeps_the_watermark(spark, registry):
    fresh = spark.createDataFrame([("S9", "E", None, 1, "L", 10, "pm10", None, None, None), ("S2", "D", "n", 2, "l", 10, "so2", "u", None, None)], REGISTRY)
    out = {(r["openaq_location_id"], r["sensor_id"]): r for r in I.upsert_registry(registry, fresh, "2024-02-01 00:00:00").collect()}
    assert len(out) == 3
    changed = out[(1, 10)]
    assert (changed["station_id"], changed["station_name"], changed["parameter"], changed["units"], changed["last_fetched_hour"]) == ("S9", None, "pm10", None, at(3))
    assert changed["last_successful_sync"] == dt.datetime(2024, 2, 1)
    assert out[(1, 11)]["last_successful_sync"] == at(4) and out[(2, 10)]["last_fetched_hour"] is None
    assert [r["parameter"] for r in I.ordered_registry(registry).collect()] == ["co", "pm25"]


def test_watermarks_advance(spark, registry):
    m = spark.createDataFrame([(10, at(7)), (10, at(9)), (99, at(9))], "sensor_id int, measurement_time timestamp_ntz")
    out = {r["sensor_id"]: (r["last_fetched_hour"], r["last_successful_sync"]) for r in I.advance_watermarks(registry, m, "2024-02-01 00:00:00").collect()}
    assert out == {10: (at(9), dt.datetime(2024, 2, 1)), 11: (at(3), at(4))}


def test_fetch_plan(spark):
    sensors = spark.createDataFrame([(1,), (2,), (3,), (4,)], "sensor_id int")
    m = spark.createDataFrame([(1, at(4)), (2, at(9)), (3, at(10))], "sensor_id int, measurement_time timestamp_ntz")
    out = {r["sensor_id"]: (r["status"], r["from_hour"], r["to_hour"]) for r in I.fetch_plan(sensors, m, "2024-01-01 12:34:00").collect()}
    assert out[1] == ("fetch", at(5), at(10)) and out[2] == ("fetch", at(10), at(10)) and out[3][0] == "up_to_date"
    assert out[4] == ("fetch", dt.datetime(2023, 12, 2, 10), at(10))


def test_backfill_plan(spark):
    now = "2024-01-20 00:30:00"
    full = spark.range(200).selectExpr("explode(array('ok', 'late', 'unknown')) AS station_id", "TIMESTAMP_NTZ '2024-01-20' - make_dt_interval(0, CAST(id AS INT)) AS timestamp")
    few = spark.range(5).selectExpr("'few' AS station_id", "TIMESTAMP_NTZ '2024-01-20' - make_dt_interval(0, CAST(id AS INT)) AS timestamp")
    upstream = spark.createDataFrame([("ok", at(1, 20)), ("late", at(2, 20)), ("unknown", None), ("few", at(0, 20)), ("new", at(0, 20))],
                                     "station_id string, latest_hour timestamp_ntz")
    out = {r["station_id"]: r for r in I.backfill_plan(full.unionByName(few), upstream, now).collect()}
    assert {k: r["need_backfill"] for k, r in out.items()} == {"ok": False, "late": True, "unknown": False, "few": True, "new": True}
    assert out["few"]["status"] == "cached" and out["late"]["status"] == "fetch" and out["late"]["from_hour"] == at(1, 20)
    assert out["new"]["row_count"] == 0 and out["new"]["from_hour"] == dt.datetime(2024, 1, 11, 16)


def test_retention_and_freshness(spark):
    df = spark.createDataFrame([("S", at(0)), ("S", at(5, 9))], "station_id string, timestamp timestamp_ntz")
    assert I.retain(df, "2024-01-11 00:00:00", days=10).count() == 2  # the cut-off itself stays
    assert I.retain(df, "2024-01-11 00:01:00", days=10).count() == 1
    assert I.retain(df, "2024-01-09 06:00:00", hours=1).count() == 1
    assert I.freshness(df, "2024-01-09 06:20:00", ["station_id"]).first()["age_hours"] == 1.33


def test_recent_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("S", at(0))], "station_id string, timestamp timestamp_ntz").write.parquet(str(tmp_path / "p"))
    plan = I.recent(spark.read.parquet(str(tmp_path / "p")), "2024-01-09 00:00:00", 24)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp," in plan


def test_evolve_and_rekey(spark):
    df = spark.createDataFrame([("D", None, 1), ("D", None, 2), ("D", "S", 3)], "city string, station_id string, seq int")
    assert I.evolve(df, {"nox": "double", "seq": "int"}).dtypes[-1] == ("nox", "double")
    assert sorted(r["seq"] for r in I.rekey(df, ["city", "station_id"], ["seq"]).collect()) == [1, 3]


def test_latest_values(spark):
    df = spark.createDataFrame([("S", "pm25", 1, 5.0), ("S", "pm25", 2, 6.0), ("S", "co", 1, 7.0)], "station_id string, parameter string, t int, value double")
    assert I.latest_values(df, ["station_id"], ["t"]).first()["pollutants"] == {"co": 7.0, "pm25": 6.0}
    assert I.latest_hours(df.withColumn("measurement_time", F.lit(at(3))), "station_id").first()["latest_hour"] == at(3)
