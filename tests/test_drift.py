
import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.functions import constants as K
from aerolens.operators import drift


def sided(spark, base, recent, name="pm25"):
    rows = [(0, v) for v in base] + [(1, v) for v in recent]
    return spark.createDataFrame([(s, None if v is None else float(v)) for s, v in rows], f"side int, {name} double")


def psi_of(spark, base, recent):
    df = sided(spark, base, recent)
    return measured(df)["psi"]


def measured(df):
    return drift.distances(drift.side_counts(df, ["pm25"]), drift.moments(df, ["pm25"])).first()


def normal(n, shift=0.0, scale=1.0, seed=0):
    return np.random.default_rng(seed).normal(50 + shift, 10 * scale, n).round(3).tolist()


def brute_psi(base, recent, bins=10, eps=1e-6):
    edges = np.linspace(min(base + recent), max(base + recent), bins + 1)
    e, a = (np.maximum(np.histogram(x, edges)[0] / (len(x) + eps), eps) for x in (base, recent))
    return float(((a - e) * np.log(a / e)).sum())


def test_psi_equals_brute_force(spark):
    base, recent = normal(300, seed=1), normal(400, 5, seed=2)
    assert psi_of(spark, base, recent) == pytest.approx(brute_psi(base, recent))


def test_psi_properties(spark):
    base = normal(500)
    assert psi_of(spark, base, base) == pytest.approx(0, abs=1e-9)
    assert psi_of(spark, base, normal(500, 0.5, seed=3)) < 0.1
    assert psi_of(spark, base, normal(500, 30, seed=4)) > K.PSI_HIGH
    assert psi_of(spark, [5.0] * 20, [5.0] * 20) == 0.0
    forth, back = psi_of(spark, base, normal(500, 5, seed=5)), psi_of(spark, normal(500, 5, seed=5), base)
    assert forth == pytest.approx(back, rel=0.01)
    for seed in range(3):
        assert psi_of(spark, normal(60, seed=seed), normal(80, seed=seed + 50)) >= 0


def brute_ks(a, b):
    grid = sorted(set(a + b))
    return max(abs(np.mean([x <= g for x in a]) - np.mean([x <= g for x in b])) for g in grid)


@pytest.mark.parametrize("shift", [0, 3, 40])
def test_ks_statistic(spark, shift):
    a = [round(x) for x in normal(200, seed=7)]  # many ties
    b = [round(x) for x in normal(150, shift, seed=8)]
    row = measured(sided(spark, a, b))
    assert row["ks_stat"] == pytest.approx(brute_ks(a, b))
    assert 0 <= row["ks_p_value"] <= 1


def test_ks_probability_known_values(spark):
    # Critical values of the limiting distribution: 1.3581 at 5 %, 1.6276 at 1 %.
    def p(scaled):
        return spark.range(1).select(drift.ks_probability(F.lit(scaled / np.sqrt(50.0)), F.lit(100.0), F.lit(100.0))).first()[0]
    assert p(1.3581) == pytest.approx(0.05, abs=1e-4) and p(1.6276) == pytest.approx(0.01, abs=1e-4)
    assert p(0.0) == 1.0 and p(20.0) == pytest.approx(0, abs=1e-12)


def report(spark, frames):
    out = None
    for name, (base, recent) in frames.items():
        df = sided(spark, base, recent, name).withColumn("i", F.monotonically_increasing_id())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return {r["feature"]: r for r in drift.drift_report(out, list(frames)).collect()}


def test_report(spark):
    base = normal(300)
    got = report(spark, {"pm25": (base, base), "no2": (base, normal(300, 30, seed=9)), "co": (normal(5), normal(5)), "o3": ([None] * 20, base)})
    assert set(got) == {"pm25", "no2"}
    same, moved = got["pm25"], got["no2"]
    assert (same["psi"], same["severity"], same["drift"], same["ks_p_value"], same["z_score"]) == (0.0, "NONE", False, 1.0, 0.0)
    assert moved["severity"] == "HIGH" and moved["drift"] and moved["z_score"] > 1.5
    recent = normal(300, 30, seed=9)
    assert moved["mean_shift"] == pytest.approx(np.mean(recent) - np.mean(base), abs=1e-4)
    assert moved["std_ratio"] == pytest.approx(np.std(recent) / (np.std(base) + 1e-6), abs=1e-4)
    assert (moved["baseline_rows"], moved["live_rows"], moved["window_days"]) == (300, 300, 7)


@pytest.mark.parametrize("psi,p,z,flag,severity", [
    (0.30, 0.01, 0.0, True, "HIGH"), (0.30, 0.50, 2.0, True, "HIGH"), (0.30, 0.50, 0.1, False, "HIGH"), (0.1722, 0.0101, 0.1, True, "MODERATE"),
    (0.20, 0.50, 0.1, False, "LOW"), (0.12, 0.01, 9.0, False, "LOW"), (0.06, 0.01, 9.0, False, "LOW"), (0.05, 0.01, 9.0, False, "NONE"),
])
def test_rule_and_severity(spark, psi, p, z, flag, severity):
    row = spark.range(1).select(drift.flag(F.lit(psi), F.lit(p), F.lit(z)), drift.severity(F.lit(psi), F.lit(p))).first()
    assert tuple(row) == (flag, severity)


@pytest.mark.parametrize("flags,fraction,retrain", [([True, False], 0.5, True), ([True] * 2 + [False] * 3, 0.4, False), ([False] * 3, 0.0, False), ([], 0.0, False)])
def test_summary(spark, flags, fraction, retrain):
    df = spark.createDataFrame([(f"f{i}", f) for i, f in enumerate(flags)], "feature string, drift boolean")
    row = drift.drift_summary(df).first()
    assert (row["drift_fraction"], row["retrain_recommended"]) == (fraction, retrain)
    assert row["drifted_features"] == [f"f{i}" for i, f in enumerate(flags) if f]


def test_windows(spark):
    days = spark.range(40).selectExpr("TIMESTAMP_NTZ '2024-02-10' - make_dt_interval(CAST(id AS INT)) AS timestamp", "id")
    out = drift.windows(days, "2024-02-10 00:00:00")
    assert sorted(r["id"] for r in out.where("side = 1").collect()) == list(range(0, 8))
    assert sorted(r["id"] for r in out.where("side = 0").collect()) == list(range(8, 31))
    # With equal window lengths the baseline is empty, and no feature is reported.
    none = drift.windows(days, "2024-02-10 00:00:00", baseline_from=7)
    assert none.where("side = 0").count() == 0
    assert drift.drift_report(none.withColumn("pm25", F.col("id").cast("double")), ["pm25"]).count() == 0


def test_history_and_alerts(spark, tmp_path):
    path = str(tmp_path / "h")
    old = spark.createDataFrame([("pm25", 0.9, True)], "feature string, psi double, drift boolean")
    new = spark.createDataFrame([("pm25", 0.2, True), ("no2", 0.01, False), ("co", None, None)], "feature string, psi double, drift boolean")
    drift.append_history(old, path, "2024-01-01 00:00:00")
    drift.append_history(new, path, "2024-01-02 00:00:00")
    drift.append_history(new, path, "2024-01-02 00:00:00")  # a repeated run takes its own place
    history = drift.read_history(spark, path)
    assert history.count() == 4
    assert {r["feature"]: (r["psi"], r["drift"]) for r in drift.latest_drift(history).collect()} == {"pm25": (0.2, 1), "no2": (0.01, 0), "co": (0.0, 0)}
    assert {r["alert"]: r["firing"] for r in drift.drift_alerts(history).collect()} == {"DataDriftDetected": True, "HighDriftPSI": False, "ManyFeaturesDrifted": False}




def test_a_report_computes_its_windows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value
    sided = spark.range(200).select((F.col("id") % 2).cast("int").alias("side"), counted(F.col("id") * 1.0).alias("pm25"))
    assert drift.drift_report(sided, ["pm25"]).first()["live_rows"] == 100 and seen.value == 200
