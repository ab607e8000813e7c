import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolens.functions import air, calendar, numeric


def value(one_row, column, **cells):
    df = one_row.select(*[F.lit(v).cast(t).alias(n) for n, (v, t) in cells.items()]) if cells else one_row
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pollutant,raw,unit,expected", [
    ("no2", 1.0, "ppb", 46.0055 / 24.45),
    ("NO2", 1.0, "PPB", 46.0055 / 24.45),
    ("nox", 2.0, "ppb", 2 * 46.0055 / 24.45),
    ("no2", 7.0, "µg/m³", 7.0),
    ("no2", None, "ppb", None),
    ("xenon", 10.0, "ppb", 10.0),
    ("pm25", 45.0, "ug/m3", 45.0),
    ("pm25", 45.0, None, 45.0),
    ("co", 1000.0, "ug/m3", 1.0),
    ("co", 1000.0, "µg/m³", 1.0),
    ("co", 3.0, "mg/m3", 3.0),
    ("co", 2.0, "p p m", 2 * 28.01 / 24.45),
    ("co", 1000.0, "ppb", 28.01 / 24.45),
    ("co", 5.0, "", 5.0),
    ("o3", float("nan"), "ppb", None),
])
def test_normalize_value(one_row, pollutant, raw, unit, expected):
    got = value(one_row, air.normalize_value("p", "v", "u"), p=(pollutant, "string"), v=(raw, "double"), u=(unit, "string"))
    assert got is None if expected is None else got == pytest.approx(expected)


def test_by_molar_mass(one_row):
    df = dict(v=(10.0, "double"))
    assert value(one_row, air.by_molar_mass("v", "p"), p=("so2", "string"), **df) == pytest.approx(10 * 64.066 / 24.45)
    assert value(one_row, air.by_molar_mass("v", "p"), p=("pm25", "string"), **df) is None


@pytest.mark.parametrize("v,strict,loose", [
    (0, 0, 0), (15, 25, 25), (30, 50, 50), (30.5, None, 51 + 49 / 29 * -0.5), (31, 51, 51), (60, 100, 100), (-1, None, None),
    (250, 400, 400), (1000, 500, 500), (5000, 500, 500), (float("nan"), None, None), (None, None, None),
])
def test_sub_index_edges(one_row, v, strict, loose):
    for flag, expected in ((True, strict), (False, loose)):
        got = value(one_row, air.sub_index("pm25", "v", flag), v=(v, "double"))
        assert got is None if expected is None else got == pytest.approx(expected)


def test_composite_index_skips_nulls(spark):
    df = spark.createDataFrame([(15.0, None, 0.5), (None, None, None), (15.0, 400.0, None)], "pm25 double, no2 double, co double")
    got = [r[0] for r in df.select(air.composite_index(df.columns)).collect()]
    assert got == [25.0, None, 400.0]


def test_sub_index_of_follows_the_parameter(spark):
    df = spark.createDataFrame([("pm25", 15.0), ("co", 0.5), ("benzene", 3.0)], "p string, v double")
    assert [r[0] for r in df.select(air.sub_index_of("p", "v")).collect()] == [25.0, 25.0, None]


@pytest.mark.parametrize("index,word,label", [
    (0, "good", "Good"), (25, "good", "Good"), (50, "good", "Good"), (51, "satisfactory", "Satisfactory"), (100, "satisfactory", "Satisfactory"),
    (101, "moderate", "Moderate"), (200, "moderate", "Moderate"), (201, "poor", "Poor"), (300, "poor", "Poor"),
    (301, "very poor", "Very Poor"), (400, "very poor", "Very Poor"), (401, "severe", "Severe"), (999, "severe", "Severe"),
])
def test_bands(one_row, index, word, label):
    assert word in value(one_row, air.advisory("i"), i=(index, "int")).lower()
    assert value(one_row, air.category("i"), i=(index, "int")) == label


def test_band_of_missing_index(one_row):
    assert value(one_row, air.category("i"), i=(None, "int")) == "Unknown"
    assert value(one_row, air.advisory("i"), i=(None, "int")) is None


@pytest.mark.parametrize("v,label", [(0, None), (0.1, "Good"), (50, "Good"), (50.1, "Satisfactory"), (150, "Moderate"),
                                     (200, "Poor"), (300, "Very Poor"), (500, "Severe"), (500.1, None), (None, None)])
def test_profile_category_is_right_closed(one_row, v, label):
    assert value(one_row, air.profile_category("v"), v=(v, "double")) == label


def test_primary_pollutant_first_wins_ties(spark):
    df = spark.createDataFrame([(5.0, 5.0, 1.0), (None, None, None), (1.0, 2.0, float("nan")), (0.0, 0.0, 9.0)], "pm25 double, pm10 double, co double")
    assert [r[0] for r in df.select(air.primary_pollutant(df.columns)).collect()] == ["PM2.5", "PM2.5", "PM10", "CO"]


@pytest.mark.parametrize("raw,expected", [
    ([85.0] * 24, [85] * 24), ([-100.0] * 24, [0] * 24), ([1.5, 2.5, 3.2], [2, 2] + [3] * 22), ([float(i) for i in range(30)], list(range(24))),
])
def test_forecast_array(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "f array<double>")
    assert df.select(air.forecast_array(F.col("f"))).first()[0] == expected


def test_forecast_of_nothing_is_no_error(spark):
    assert spark.createDataFrame([([],)], "f array<double>").select(air.forecast_array(F.col("f"))).first()[0] == [None] * 24


def test_safe_parsing(spark):
    df = spark.createDataFrame([("88",), ("N/A",), ("NaN",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(numeric.safe_double("t")).collect()] == [88.0, None, None, None, None]
    assert [r[0] for r in df.select(numeric.safe_double("t", 0)).collect()] == [88.0, 0.0, 0.0, 0.0, 0.0]
    stamps = spark.createDataFrame([("2024-01-01T05:30:00+05:30",), ("2024-01-01 00:00:00",), ("nonsense",)], "t string")
    got = [str(r[0]) for r in stamps.select(numeric.safe_timestamp("t")).collect()]
    assert got == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", "None"]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(numeric.half_even_int("v")).collect()] == [0, 2, 2, 0]


def test_corrected_shape_equals_pandas(spark):
    data = [1.0, 2.0, 2.5, 9.0, 4.0, 4.5, 30.0]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    row = df.agg(numeric.skewness_unbiased("v"), numeric.kurtosis_unbiased("v")).first()
    s = pd.Series(data)
    assert row[0] == pytest.approx(s.skew()) and row[1] == pytest.approx(s.kurt())
    few = df.limit(2).agg(numeric.skewness_unbiased("v"), numeric.kurtosis_unbiased("v")).first()
    assert few[0] is None and few[1] is None


def test_calendar_parts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-02 13:45:00' AS t")  # a Saturday
    row = df.select(*[c.alias(n) for n, c in calendar.parts("t").items()]).first().asDict()
    assert row == {"hour_of_day": 13, "day_of_week": 5, "month": 3, "year": 2024, "day_of_year": 62, "is_weekend": 1, "season": 1}


def test_seasons(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    assert [r[0] for r in df.select(calendar.season(F.col("m"))).collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 0]


def test_cyclical(spark):
    df = spark.createDataFrame([(6,)], "h int")
    s, c = df.select(*calendar.cyclical("h", 24)).first()
    assert s == pytest.approx(math.sin(math.pi / 2)) and c == pytest.approx(0, abs=1e-12)
