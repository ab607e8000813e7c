import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolens.streaming import jobs

SCHEMA = "event_id int, sensor_id int, station_id string, parameter string, value double, measurement_time timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def landing(spark, tmp_path):
    """A folder that batches of (minute, sensor, value) land in, one file each."""
    folder, counter = str(tmp_path / "in"), iter(range(1000))

    def land(rows):
        data = [(next(counter), s, "S1", "pm25", v, T0 + dt.timedelta(minutes=m)) for m, s, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return jobs.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return land, stream, folder


FIRST = [(0, 1, 10.0), (10, 1, 20.0), (70, 2, 30.0), (10, 1, 20.0)]
SECOND = [(20, 1, 60.0), (75, 2, 50.0), (400, 1, 5.0)]


def run_twice(landing, make, checkpoint, **options):
    land, stream, _ = landing
    for rows in (FIRST, SECOND):  # the second run resumes from the checkpoint
        land(rows)
        jobs.run(make(stream()), checkpoint, **options)


def test_hourly_means_equal_the_batch(spark, landing, tmp_path):
    path = str(tmp_path / "out")
    keys = ["station_id", "parameter", "timestamp"]
    run_twice(landing, lambda s: jobs.hourly_means(s, ["station_id", "parameter"]), str(tmp_path / "c"), each=jobs.upsert_sink(path, keys), mode="update")
    got = {r["timestamp"]: (r["value"], r["n"]) for r in spark.read.parquet(path).collect()}
    batch = spark.read.parquet(landing[2]).groupBy(F.date_trunc("hour", "measurement_time").alias("h")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    assert got == {r["h"]: (r["v"], r["n"]) for r in batch.collect()}
    assert len(got) == 3


def test_duplicates_drop_across_batches(spark, landing, tmp_path):
    path = str(tmp_path / "out")
    run_twice(landing, lambda s: jobs.deduplicated(s, ["sensor_id", "measurement_time"]), str(tmp_path / "c"), path=path)
    landing[0](SECOND[-1:])  # delivered again
    jobs.run(jobs.deduplicated(landing[1](), ["sensor_id", "measurement_time"]), str(tmp_path / "c"), path)
    out = spark.read.parquet(path)
    assert out.count() == 6 and out.select("sensor_id", "measurement_time").distinct().count() == 6


def test_rows_behind_the_watermark_are_dropped(spark, landing, tmp_path):
    land, stream, _ = landing
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for rows in ([(600, 1, 1.0)], [(0, 1, 99.0)], [(599, 1, 2.0)]):
        land(rows)
        jobs.run(jobs.deduplicated(stream(), ["sensor_id", "measurement_time"]), checkpoint, path)
    assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_last_seen_is_read_from_the_state_alone(spark, landing, tmp_path):
    land, stream, folder = landing
    made = [(7 * i % 400, i % 5, 1.0) for i in range(40)]
    checkpoint = str(tmp_path / "c")
    for half in (made[:20], made[20:]):  # ten micro-batches of a file each, a restart, ten more
        for at in range(0, 20, 2):
            land(half[at:at + 2])
        jobs.run(jobs.last_seen(stream()), checkpoint, mode="update")
    got = {r["sensor_id"]: (r["last_seen"], r["n"]) for r in jobs.current_last_seen(spark, checkpoint).collect()}
    assert got == {s: (T0 + dt.timedelta(minutes=max(m for m, x, _ in made if x == s)), 8) for s in range(5)}
    assert len([f for f in (tmp_path / "c" / "commits").iterdir() if f.name.isdigit()]) == 20
    assert {p.name for p in tmp_path.iterdir()} == {"in", "c"}


def test_replayed_batches_add_nothing(spark, landing, tmp_path):
    path = str(tmp_path / "out")
    landing[0](FIRST)
    sink = jobs.insert_sink(path, ["sensor_id", "measurement_time"], ["event_id"])
    for checkpoint in ("a", "b"):  # a lost checkpoint replays everything
        jobs.run(landing[1](), str(tmp_path / checkpoint), each=sink)
    assert spark.read.parquet(path).count() == 3


def test_sliding_windows_close_with_the_watermark_and_the_rest_stays_in_the_state(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "c", "out"))
    minutes = [0, 1, 2, 2, 170, 300, 303, 303]
    for some in (minutes[:4], minutes[4:]):  # the second run starts from the checkpoint
        rows = [(T0 + dt.timedelta(minutes=m, seconds=7), "error" if m in (1, 303) else "ok") for m in some]
        spark.createDataFrame(rows, "ts timestamp_ntz, status string").coalesce(1).write.mode("append").parquet(folder)
        jobs.run(jobs.sliding_errors(jobs.file_stream(spark, folder, spark.read.parquet(folder).schema)), checkpoint, out)
    closed = {r["window_start"]: (r["total"], r["errors"]) for r in spark.read.parquet(out).collect()}
    still_open = {r["window_start"]: (r["total"], r["errors"]) for r in jobs.open_errors(spark, checkpoint).collect()}
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
    expected = {r["start"]: (r["total"], r["errors"]) for r in batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "total", "errors").collect()}
    assert closed and still_open and not set(closed) & set(still_open) and closed | still_open == expected
