import pytest
from pyspark.sql import functions as F

from aerolens.functions import constants as K
from aerolens.operators import clean, joins, quality


def test_date_range_ends_at_midnight(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2020-12-31 00:00:00', TIMESTAMP_NTZ '2020-12-31 01:00:00', TIMESTAMP_NTZ '2014-12-31 23:00:00')) AS timestamp")
    assert [str(r[0]) for r in clean.between_dates(df, "2015-01-01", "2020-12-31").collect()] == ["2020-12-31 00:00:00"]


def test_drop_empty(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), (None, 1.0, 1.0)], "k string, x double, y double")
    assert clean.drop_empty(df, ["k"], ["x", "y"]).count() == 1


def test_align_columns(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 2.0D AS b, 'x' AS extra")
    assert clean.align_columns(df, ["b", "c"]).first().asDict() == {"b": 2.0, "c": None}
    assert clean.align_columns(df, ["a", "b", "c"], fill=0.0).first().asDict() == {"a": 0.0, "b": 2.0, "c": 0.0}


def test_station_hour_mean_keeps_null_groups(spark):
    df = spark.createDataFrame([("S1", None, "2020-01-01 01:05:00", 1.0), ("S1", None, "2020-01-01 01:55:00", 3.0), ("S1", "Z", "2020-01-01 01:00:00", None)],
                               "station_id string, state string, t string, x double").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    rows = {r["state"]: r["x"] for r in clean.station_hour_mean(df, ["station_id", "state"], ["x"]).collect()}
    assert rows == {None: 2.0, "Z": None}


def test_pivot_and_index(spark):
    df = spark.createDataFrame([("S1", "2020-01-01 01:05:00", "pm25", 10.0), ("S1", "2020-01-01 01:45:00", "pm25", 20.0), ("S1", "2020-01-01 01:00:00", "co", 2.0),
                                ("S1", "2020-01-01 02:00:00", "no", 5.0), ("S1", "2020-01-01 02:00:00", "no2", None), ("S1", None, "no2", 1.0)],
                               "station_id string, t string, parameter string, value double").withColumn("measurement_time", F.col("t").cast("timestamp_ntz"))
    out = clean.with_index(clean.pivot_parameters(df, ["station_id"])).orderBy("timestamp").collect()
    assert len(out) == 2 and set(K.POLLUTANTS) <= set(out[0].asDict())
    assert out[0]["pm25"] == 15.0 and out[0]["aqi"] == 100.0 and out[1]["aqi"] is None and out[1]["no"] == 5.0


def trend(spark, days):
    rows = [("S1", f"2024-01-{i + 1:02d} 20:00:00", v) for i, v in enumerate(days)]
    df = spark.createDataFrame(rows, "station_id string, t string, aqi double").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    return clean.weekly_trend(df).first()["weekly_trend"]


def test_weekly_trend(spark):
    assert trend(spark, [10.0, 20.0, 30.0]) == [10, 10, 10, 10, 10, 20, 30]
    assert trend(spark, [float(i) for i in range(9)]) == [2, 3, 4, 5, 6, 7, 8]
    assert trend(spark, [None, None]) == [0] * 7
    assert trend(spark, [0.5, 1.5, None, 2.5]) == [0, 0, 0, 0, 0, 2, 2]


def test_weekly_trend_groups_by_local_day(spark):
    df = spark.createDataFrame([("S", "2024-01-01 18:00:00", 10.0), ("S", "2024-01-01 19:00:00", 30.0)], "station_id string, t string, aqi double")
    df = df.withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    assert clean.weekly_trend(df).first()["weekly_trend"] == [10] * 6 + [30]  # 19:00 UTC is the next day in India
    assert clean.weekly_trend(df, zone="UTC").first()["weekly_trend"] == [20] * 7


def test_split_and_sample(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2017-12-31 23:00:00', TIMESTAMP_NTZ '2018-01-01', TIMESTAMP_NTZ '2019-06-01')) AS timestamp")
    assert [r["split"] for r in clean.split_by_time(df).orderBy("timestamp").collect()] == ["train", "val", "test"]
    ids = spark.range(20000)
    a, b = clean.hash_sample(ids, ["id"], 0.2), clean.hash_sample(ids.repartition(7), ["id"], 0.2)
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()} and 3700 < a.count() < 4300
    assert clean.hash_sample(ids, ["id"], 0.2, seed=7).count() != 0


def test_labels_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "city string")
    assert {r["city"]: r["city_encoded"] for r in clean.encode_labels(df).collect()} == {"a": 0, "b": 1, "c": 2}
    row = spark.sql("SELECT 'Delhi' AS city, 'North' AS name, 'S1' AS sid, 17 AS id").select(clean.station_label("city", "name", "sid"), clean.location_key("id")).first()
    assert list(row) == ["Delhi - North (S1)", "openaq17"]
    shown = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 20:00:00' AS t").select(clean.display_time("t")).first()[0]
    assert shown == "01 Feb 2024, 01:30"


def test_stored_codes_stay_and_unseen_labels_are_zero(spark):
    stored = clean.encode_labels(spark.createDataFrame([("m",), ("c",), (None,)], "city string"))
    later = clean.extend_codes(stored, spark.createDataFrame([("a",), ("m",), ("z",), (None,)], "city string"))
    assert {r["city"]: r["city_encoded"] for r in later.collect()} == {"c": 0, "m": 1, "a": 2, "z": 3}
    live = clean.with_codes(spark.createDataFrame([("z", 1), ("new", 2), (None, 3), ("c", 4)], "city string, n int"), later)
    assert live.columns == ["city", "n", "city_encoded"] and {r["n"]: r["city_encoded"] for r in live.collect()} == {1: 3, 2: 0, 3: 0, 4: 0}
    empty = clean.extend_codes(stored.limit(0), spark.createDataFrame([("b",), ("a",)], "city string"))
    assert {r["city"]: r["city_encoded"] for r in empty.collect()} == {"a": 0, "b": 1}


def test_codes_of_many_labels_with_one_beginning(spark):
    many = spark.range(30_000).selectExpr("concat('st', lpad(string(id * 7919 % 30000), 5, '0')) AS city")
    wrong = clean.encode_labels(many).where("city_encoded <> int(substring(city, 3, 5))")
    assert wrong.count() == 0


def test_left_joins_and_defaults(spark):
    r = spark.createDataFrame([("S1", 1.0), ("S9", 2.0)], "station_id string, aqi double")
    s = spark.createDataFrame([("S1", "Delhi")], "station_id string, city string")
    assert {x["station_id"]: x["city"] for x in joins.with_station(r, s).collect()} == {"S1": "Delhi", "S9": None}
    c = spark.createDataFrame([("S1", 1.0, None)], "station_id string, latitude double, longitude double")
    got = {x["station_id"]: (x["latitude"], x["longitude"]) for x in joins.with_coordinates(r, c, K.DEFAULT_COORDINATES).collect()}
    assert got == {"S1": (1.0, 80.2707), "S9": (13.0827, 80.2707)}
    assert joins.with_coordinates(r, c).where("station_id = 'S9'").first()["latitude"] is None
    assert [x[0] for x in joins.without_metadata(r, s).collect()] == ["S9"]


def test_city_semi_join_ignores_case(spark):
    df = spark.createDataFrame([("DELHI",), ("Pune",), (None,)], "city string")
    config = spark.createDataFrame([("delhi",), ("delhi",)], "city string")
    assert [r[0] for r in joins.keep_known_cities(df, config).collect()] == ["DELHI"]
    assert joins.keep_known_cities(df, config, ignore_case=False).count() == 0


def test_weather_fans_out_and_merges(spark):
    w = spark.sql("SELECT 'Delhi' AS city, TIMESTAMP_NTZ '2024-01-01' AS timestamp, 5.0D AS temperature_2m")
    s = spark.createDataFrame([("S1", "Delhi"), ("S2", "Delhi"), ("S3", "Pune")], "station_id string, city string")
    assert sorted(r["station_id"] for r in joins.weather_to_stations(s, w).collect()) == ["S1", "S2"]
    r = spark.sql("SELECT 'Delhi' AS city, 'S1' AS station_id, TIMESTAMP_NTZ '2024-01-01' AS timestamp, explode(array(1, 2)) AS seq")
    row = joins.merge_live(r, w, ["seq"]).collect()
    assert len(row) == 1 and row[0]["seq"] == 2 and row[0]["temperature_2m"] == 5.0


def test_cities_to_fetch(spark):
    s = spark.createDataFrame([("Delhi", "S2", 2.0, 2.0), ("Delhi", "S1", 1.0, 1.0), ("Pune", "S3", 3.0, 3.0)],
                              "city string, station_id string, latitude double, longitude double")
    out = joins.cities_to_fetch(s, spark.createDataFrame([("Pune",)], "city string")).collect()
    assert [tuple(r) for r in out] == [("Delhi", 1.0, 1.0)]


LOCATIONS = [("Delhi", "Somewhere", "2024-01-09", 0), ("Delhi", "Civil Lines old", "2020-01-01", 1), ("Delhi", "xx R K PURAM xx", None, 2),
             ("Pune", "a", "2024-01-01", 0), ("Pune", "b", "2024-02-01", 1), ("Pune", "c", "2024-02-01", 2), ("Agra", "first", None, 0), ("Agra", "second", None, 1)]


def test_choose_location(spark):
    loc = spark.createDataFrame(LOCATIONS, "city string, name string, t string, position int").withColumn("last_seen", F.col("t").cast("timestamp_ntz"))
    hints = spark.createDataFrame([(c, i, h) for c, i, h in joins.HINT_ROWS], "city string, hint_order int, hint string")
    got = {r["city"]: r["name"] for r in joins.choose_location(loc, hints, ["city"]).collect()}
    assert got == {"Delhi": "xx R K PURAM xx", "Pune": "b", "Agra": "first"}


def test_latest_run(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "computed_at int, f string")
    assert sorted(r["f"] for r in joins.latest_run(df).collect()) == ["b", "c"]


def test_no_forced_broadcast_of_dimensions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = spark.range(10).selectExpr("string(id) AS station_id")
        plan = joins.with_station(r, r.withColumn("city", F.lit("x")))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bad_table(spark):
    return spark.createDataFrame([("2024-01-01", "S1", "Delhi", 1.0, 5.0), ("2024-01-01", "S1", "Delhi", -1.0, 5.0), (None, "S2", "Delhi", 1.0, None), ("2024-01-02", "S3", None, None, 0.0)],
                                 "timestamp string, station_id string, city string, pm25 double, aqi double")


def test_quality_rules(spark):
    got = {r["rule"]: (r["failures"], r["passed"]) for r in quality.quality_rules(bad_table(spark)).collect()}
    assert got == {"null_keys": (2, False), "duplicate_station_hours": (1, False), "negative_pm25": (1, False), "negative_aqi": (0, True)}


def test_quality_gate(spark):
    with pytest.raises(quality.QualityError, match="null_keys: 2"):
        quality.require_quality(bad_table(spark))
    good = bad_table(spark).where("station_id = 'S1' AND pm25 > 0")
    assert quality.require_quality(good) is good
    assert quality.quality_rules(good.where("false")).where("NOT passed").count() == 0
