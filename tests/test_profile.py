import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolens.functions.air import profile_category
from aerolens.operators import profile, selection


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ABC"), round(rng.gauss(50, 20), 1), rng.choice([None, 3.0, 4.0, 900.0]), None) for _ in range(800)]
    return pd.DataFrame(rows, columns=["k", "x", "y", "z"]), spark.createDataFrame(rows, "k string, x double, y double, z double")


def test_profile_equals_pandas(data):
    pdf, df = data
    out = {r["feature"]: r for r in profile.column_profile(df, ["x", "y", "z"]).collect()}
    assert set(out) == {"x", "y"}
    for c in ("x", "y"):
        s = pdf[c].dropna()
        want = {"count": len(s), "mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max(), "p25": s.quantile(.25), "p50": s.median(),
                "p75": s.quantile(.75), "p95": s.quantile(.95), "skewness": s.skew(), "kurtosis": s.kurt(), "null_pct": pdf[c].isna().mean() * 100}
        for name, v in want.items():
            assert out[c][name] == pytest.approx(v), (c, name)


@pytest.mark.parametrize("bins", [10, 50])
def test_histogram_equals_numpy(data, bins):
    pdf, df = data
    out = profile.histogram(df, ["x", "y"], bins).toPandas().sort_values(["feature", "bin"])
    for c in ("x", "y"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=bins)
        got = out[out["feature"] == c]
        assert got["n"].tolist() == counts.tolist()
        assert np.allclose(got["edge_lo"], edges[:-1]) and np.allclose(got["edge_hi"], edges[1:])


def test_histogram_of_one_value(spark):
    out = profile.histogram(spark.sql("SELECT 5.0D AS x"), ["x"], 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == np.histogram([5.0], bins=4)[0].tolist() and out[0]["edge_lo"] == 4.5


def test_baseline_profile(data):
    row = {r["feature"]: r for r in profile.baseline_profile(data[1], ["x"], 5).collect()}["x"]
    assert len(row["histogram"]) == 5 and sum(b["n"] for b in row["histogram"]) == row["count"]


def test_null_report(data):
    out = {r["feature"]: (r["present"], r["missing"], r["null_pct"]) for r in profile.null_report(data[1], ["x", "z"]).collect()}
    assert out == {"x": (800, 0, 0.0), "z": (0, 800, 100.0)}


def test_box_numbers(data):
    pdf, df = data
    out = {r["k"]: r for r in profile.box_numbers(df, ["k"], "x").collect()}
    for k, s in pdf.groupby("k")["x"]:
        q1, q3 = s.quantile(.25), s.quantile(.75)
        inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
        assert (out[k]["whisker_lo"], out[k]["whisker_hi"], out[k]["outliers"]) == (inside.min(), inside.max(), len(s) - len(inside))
        assert out[k]["median"] == pytest.approx(s.median()) and out[k]["n"] == len(s)
    assert [r["k"] for r in profile.top_boxes(df, "k", "x", 2).collect()] == list(pdf.groupby("k")["x"].median().sort_values(ascending=False).index[:2])


def test_capped_distribution(data):
    pdf, df = data
    row = {r["feature"]: r for r in profile.capped_distribution(df, ["x", "y"], 0.9).collect()}["x"]
    cap = pdf["x"].quantile(0.9)
    kept = pdf["x"][pdf["x"] <= cap]
    assert row["cap"] == pytest.approx(cap) and row["n"] == len(kept) and row["median"] == pytest.approx(kept.median())


def test_shares_and_counts(spark):
    df = spark.createDataFrame([(10.0,), (60.0,), (50.0,), (None,), (0.0,), (501.0,)], "aqi double")
    out = {r["category"]: (r["n"], round(r["pct"], 3)) for r in profile.category_share(df, profile_category("aqi")).collect()}
    assert out == {"Good": (2, 66.667), "Satisfactory": (1, 33.333)}
    counts = profile.category_counts(spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "s string"), "s", 2).collect()
    assert [tuple(r) for r in counts] == [("b", 2), ("a", 1)]


def test_stations_and_years(spark):
    df = spark.createDataFrame([("S1", "2019-05-01"), ("S1", "2019-06-01"), ("S2", "2020-01-01"), ("S3", "2020-01-01")], "station_id string, t string")
    df = df.withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    assert {r["year"]: r["n"] for r in profile.records_per_year(df).collect()} == {2019: 2, 2020: 2}
    for approximate in (False, True):
        assert {r["year"]: r["stations"] for r in profile.active_per_year(df, approximate=approximate).collect()} == {2019: 1, 2020: 2}
    names = spark.createDataFrame([("S1", "Delhi")], "station_id string, city string")
    recs = profile.records_per_station(df, names)
    ends = profile.both_ends(recs, "n_records", "station_id", 1).collect()
    assert [(r["side"], r["station_id"], r["city"]) for r in ends] == [("top", "S1", "Delhi"), ("bottom", "S2", None)]
    span = profile.time_span(df, ["station_id"]).first()
    assert (span["row_count"], span["distinct_station_id"], span["span_hours"], span["span_days"]) == (4, 3, 5880, 245)


def test_medians(data):
    pdf, df = data
    out = {r["k"]: r["median"] for r in profile.median_by(df, {"k": F.col("k")}, "x").collect()}
    assert out == pytest.approx(pdf.groupby("k")["x"].median().to_dict())


def test_correlations(data):
    pdf, df = data
    row = profile.correlations(df, ["x", "y"]).first()
    assert row["corr"] == pytest.approx(pdf["x"].corr(pdf["y"]))
    top = profile.top_correlated(df.withColumn("t", -F.col("x")), ["y", "x", "z"], "t", 2).collect()
    assert [r["feature"] for r in top] == ["x", "y"] and top[0]["corr"] == pytest.approx(-1)


def test_target_statistics(spark):
    df = spark.createDataFrame([("S1", 1.0), ("S1", 2.0), ("S1", 9.0), ("S1", None), ("S2", None)], "station_id string, aqi double")
    out = {r["station_id"]: (r["station_aqi_mean"], r["station_aqi_median"]) for r in profile.target_statistics(df, "station_id").collect()}
    assert out == {"S1": (4.0, 2.0), "S2": (0.0, 0.0)}


def test_column_selection(spark):
    df = spark.range(1000).selectExpr(
        "double(id) AS a", "double(id) AS b", "double(id) * 2 + 1 AS c", "double(id % 7) AS d", "CASE WHEN id < 999 THEN 1.0D ELSE 2.0D END AS flat",
        "CASE WHEN id < 200 THEN 1.0D END AS sparse", "CAST(NULL AS DOUBLE) AS aqi")
    every = ["a", "b", "c", "d", "flat", "sparse", "aqi"]
    assert selection.sparse_columns(df, every, 0.65) == ["sparse"]
    assert selection.near_constant_columns(df, ["a", "d", "flat", "aqi"]) == ["flat", "aqi"]
    assert selection.duplicate_columns(df, ["a", "b", "c", "d"]) == ["b"]
    assert selection.correlated_columns(df, ["a", "c", "d"]) == ["c"]
    assert selection.select_features(df, ["a", "b", "c", "d"]) == ["a", "d"]
    assert selection.select_features(df, ["a", "b", "c", "d"], limit=1) == ["a"]
    assert selection.most_missing(df, ["a", "sparse", "d"], 2) == ["sparse", "a"]


def test_prune_counts_dropped_columns_too(spark):
    # b follows a, c follows b but not a: c still drops because of b.
    df = spark.range(500).selectExpr("double(id) AS a", "double(id) + 18 * sin(id) AS b", "double(id) + 45 * sin(id) AS c")
    pdf = df.toPandas().corr().abs()
    threshold = (pdf.loc["a", "c"] + min(pdf.loc["a", "b"], pdf.loc["b", "c"])) / 2
    assert pdf.loc["a", "c"] < threshold
    assert selection.correlated_columns(df, ["a", "b", "c"], threshold) == ["b", "c"]


def test_pair_correlations_equal_pairwise_corr(spark):
    df = spark.range(3000).selectExpr(
        "double(id % 97) AS a", "if(id % 3 = 0, null, double(id % 97) * 2 + id % 5) AS b", "if(id % 7 = 0, null, 1000 + id % 11) AS c",
        "if(id % 2 = 0, null, 5.1D) AS constant", "if(id % 2 = 0, double(id), null) AS even", "CAST(null AS double) AS none",
        "if(id = 5, double('NaN'), -double(id % 97)) AS `d d`").repartition(5)
    names, found, pdf = df.columns, {(r["i"], r["j"]): r for r in selection.pair_correlations(df, df.columns).collect()}, df.toPandas()
    for i, x in enumerate(names):
        for j in range(i + 1, len(names)):
            both = pdf[[x, names[j]]].dropna()
            n, corr = len(both), both[x].corr(both[names[j]]) if len(both) else None
            got = found.get((i, j))
            assert (got["n"] if got else 0) == n
            if "constant" in (x, names[j]) or not n:
                assert got is None or got["corr"] is None
            else:
                assert got["corr"] == pytest.approx(corr, abs=1e-9)
    assert selection.correlated_columns(df, names) == ["b", "d d"] and selection.correlated_columns(df, ["a"]) == []
    assert selection.correlated_columns(df.limit(0), names) == []
