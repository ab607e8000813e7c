import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolens.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most of the rows, heavy tails, ties, nulls and a null key."""
    rng = random.Random(3)
    rows = [("hot", round(rng.lognormvariate(0, 3), 1)) for _ in range(4000)]
    rows += [("tied", 7.0)] * 50 + [("one", 1.5)] + [("empty", None)] * 3 + [(None, float(i)) for i in range(10)]
    rows += [("hot", None)] * 20
    return rows, spark.createDataFrame(rows, "k string, v double")


def by_key(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return groups


def test_quantiles_equal_numpy(skewed):
    rows, df = skewed
    spots = {"a": 0.0, "q": 0.25, "m": 0.5, "p": 0.95, "z": 1.0}
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", spots).collect()}
    want = by_key(rows)
    assert set(got) == set(want)
    for k, values in want.items():
        for name, p in spots.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p))


def test_brackets_hold_few_values_of_a_large_key(spark):
    n = 200_003
    df = spark.range(n).selectExpr("'k' AS k", "double((id * 7919) % 200003) AS v").repartition(6)
    spots = {"a": 0.0, "q": 0.25, "m": 0.5, "p": 0.999, "z": 1.0}
    out = ordered.quantiles(df, ["k"], "v", spots)
    assert [out.first()[name] for name in spots] == pytest.approx(list(np.quantile(np.arange(n), list(spots.values()))))
    # the largest group that is put in order: the inside of a bracket
    inside = df.agg(F.percentile_approx("v", [0.5 - ordered.SLACK, 0.5 + ordered.SLACK], ordered.SKETCH)).first()[0]
    assert inside[1] - inside[0] < n / 1000


def test_cumulative_counts_equal_brute_force(skewed):
    rows, df = skewed
    counts = ordered.value_counts(df, ["k"], "v")
    got = ordered.cumulative_counts(counts, ["k"], "v", ["n"]).collect()
    want = by_key(rows)
    assert len(got) == sum(len(set(v)) for v in want.values())
    for r in got:
        assert r["n_cum"] == sum(x <= r["v"] for x in want[r["k"]])
        assert r["n_total"] == len(want[r["k"]])


@pytest.fixture(scope="module")
def stamped(spark):
    rng, rows = random.Random(5), []
    for key, n in (("a", 900), ("b", 40), ("c", 1)):
        at = dt.datetime(2023, 1, 1)
        for i in range(n):
            at += dt.timedelta(hours=rng.choice([1, 2, 100]))
            rows.append((key, at, i, rng.random()))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int, x double").repartition(7)


def test_row_index(stamped):
    out = ordered.row_index(stamped, ["k"], ["ts"], "ts")
    assert out.where("_row <> i").count() == 0 and out.count() == 941


def test_segments_reproduce_whole_windows(stamped):
    frame = Window.partitionBy("k").orderBy("ts")
    whole = stamped.select("k", "i", F.lag("x", 5).over(frame).alias("l"), F.lead("x", 3).over(frame).alias("f"),
                           F.sum("x").over(frame.rowsBetween(-7, -1)).alias("s"))
    parts = ordered.segmented(stamped, ["k"], ["ts"], "ts", before=7, after=3, rows=64)
    over = Window.partitionBy("k", "_segment").orderBy("_row")
    cut = parts.select("k", "i", "_own", "_segment", F.lag("x", 5).over(over).alias("l"), F.lead("x", 3).over(over).alias("f"),
                       F.sum("x").over(over.rowsBetween(-7, -1)).alias("s")).where("_own").drop("_own")
    assert cut.groupBy("k", "_segment").count().agg(F.max("count")).first()[0] == 64
    a = {(r["k"], r["i"]): (r["l"], r["f"], r["s"]) for r in whole.collect()}
    b = {(r["k"], r["i"]): (r["l"], r["f"], r["s"]) for r in cut.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_segments_must_cover_the_reach(stamped):
    with pytest.raises(ValueError):
        ordered.segmented(stamped, ["k"], ["ts"], "ts", before=100, after=0, rows=64)


@pytest.mark.parametrize("n", [0, 1, 17, 300, 5000])
def test_first_n_equals_ranking(stamped, n):
    got = ordered.first_n(stamped, ["k"], ["ts"], "ts", n)
    assert sorted((r["k"], r["i"]) for r in got.collect()) == sorted(
        (r["k"], r["i"]) for r in stamped.where(F.col("i") < n).collect())


def test_first_n_by_key_limits(stamped):
    got = ordered.first_n(stamped, ["k"], ["ts"], "ts", {"a": 10, "b": 100})
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 10, "b": 40, "c": 1}


def test_latest_and_earliest(stamped):
    assert {r["k"]: r["i"] for r in ordered.latest_by(stamped, ["k"], ["ts"]).collect()} == {"a": 899, "b": 39, "c": 0}
    assert {r["k"]: r["i"] for r in ordered.earliest_by(stamped, ["k"], ["ts"]).collect()} == {"a": 0, "b": 0, "c": 0}
    assert ordered.latest_by(stamped, ["k"], ["ts"]).columns == stamped.columns


@pytest.mark.parametrize("n", [0, 5, 300, 5000])
def test_last_n_for_any_number(stamped, n):
    sizes = {"a": 900, "b": 40, "c": 1}
    got = ordered.last_n(stamped, ["k"], ["ts"], "ts", n)
    assert sorted((r["k"], r["i"]) for r in got.collect()) == sorted((r["k"], r["i"]) for r in stamped.collect() if r["i"] >= sizes[r["k"]] - n)


@pytest.mark.parametrize("pick,n", [("first_n", 33_333), ("last_n", 33_333), ("first_n", 1), ("last_n", 59_999)])
def test_a_day_that_holds_all_rows_of_a_key_is_ranked_in_ranges(spark, monkeypatch, pick, n):
    rows = spark.range(60_000).selectExpr("if(id < 60000, 'a', 'b') AS k", "TIMESTAMP_NTZ '2024-01-01' AS ts", "(id * 7919) % 60000 AS i", "'x' AS _rank")
    sizes, write = [], ordered.written

    def watched(df, label):
        out = write(df, label)
        if label == "cut-off":
            sizes.extend(r["count"] for r in out.groupBy("k", "_unit").count().collect())
        return out
    monkeypatch.setattr(ordered, "written", watched)
    got = getattr(ordered, pick)(rows.drop("_rank"), ["k"], ["ts", "i"], "ts", n).agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i")).first()
    assert tuple(got) == ((n, 0, n - 1, n) if pick == "first_n" else (n, 60_000 - n, 59_999, n))
    assert sum(sizes) == 60_000 and max(sizes) < 10_000


def test_quantiles_shuffle_no_row_by_its_key(spark):
    df = spark.range(2_000_000).selectExpr("IF(id % 10 = 0, NULL, 'one') AS k", "double(id % 1000) AS v")
    out = ordered.quantiles(df, ["k"], "v", {"half": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["k"]: r["half"] for r in out.collect()} == {None: 495.0, "one": 500.0}
