"""Drift between a baseline window and the recent window of each feature.

Everything derives from one pre-aggregated table: rows per (feature, distinct value) and
side. Bins, cumulative distributions and moments read it, not the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import written
from .joins import latest_run
from .ordered import cumulative_counts
from .profile import bin_of, long_form

EPS = 1e-6


def windows(
    df: DataFrame, now: str, ts: str = "timestamp", recent_days: int = 7, baseline_from: int = 30, baseline_to: int = 8
) -> DataFrame:
    """Rows of both windows, marked ``side``: 0 baseline, 1 recent. Bounds are inclusive."""
    at = F.lit(now).cast("timestamp_ntz")

    def back(days: int) -> Column:
        return at - F.expr(f"interval {days} days")

    in_recent = F.col(ts).between(back(recent_days), at)
    in_baseline = F.col(ts).between(back(baseline_from), back(baseline_to))
    return df.withColumn("side", F.when(in_recent, 1).when(in_baseline, 0)).where(in_recent | in_baseline)


def side_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows per feature and distinct value on each side."""
    values = long_form(df, features, ["side"])
    return values.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))


def moments(sided: DataFrame, features: list[str]) -> DataFrame:
    """Rows, mean and population deviation per side, and the common value range.

    One wide aggregate over the rows; its single row is turned into one row per feature.
    """
    facts = []
    for s, name in ((0, "0"), (1, "1")):
        facts += [f"count({{c}}) FILTER (WHERE side = {s}) AS rows{name}",
                  f"avg({{c}}) FILTER (WHERE side = {s}) AS mean{name}",
                  f"stddev_pop({{c}}) FILTER (WHERE side = {s}) AS std{name}"]
    facts += ["double(min({c})) AS lo", "double(max({c})) AS hi"]
    names = [f.rsplit(" AS ", 1)[1] for f in facts]
    wide = sided.agg(*[
        F.expr("named_struct(" + ", ".join(f"'{n}', {f.rsplit(' AS ', 1)[0]}" for n, f in zip(names, facts)).format(c=c) + f") AS {c}")
        for c in features])
    rows = ", ".join(f"named_struct('feature', '{c}', 'facts', {c})" for c in features)
    return wide.selectExpr(f"inline(array({rows}))").select("feature", "facts.*")


def ks_probability(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided p-value of the two-sample statistic from the limiting distribution."""
    scaled = statistic * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    # Below 0.2 the series does not converge, and the probability is 1 to twelve digits.
    return F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def stability(counts: DataFrame, facts: DataFrame, bins: int = 10) -> DataFrame:
    """Stability index per feature over ``bins`` equal-width bins of the common range.

    A bin empty on both sides adds nothing, so only bins with rows are formed; a constant feature
    scores 0. Sums of counts per bin, no order.
    """
    ranged = counts.join(F.broadcast(facts.select("feature", "lo", "hi", "rows0", "rows1")), "feature")  # a row per feature
    bin_number = F.when(F.col("lo") < F.col("hi"), bin_of("value", "lo", "hi", bins)).otherwise(0)
    binned = ranged.groupBy("feature", bin_number.alias("bin")).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.first("rows0").alias("t0"), F.first("rows1").alias("t1"),
        F.first(F.col("lo") < F.col("hi")).alias("spread"))

    def share(n: str, total: str) -> Column:
        return F.greatest(F.col(n) / (F.col(total) + EPS), F.lit(EPS))

    e, a = share("n0", "t0"), share("n1", "t1")
    return binned.groupBy("feature").agg(F.sum(F.when(F.col("spread"), (a - e) * F.ln(a / e)).otherwise(0.0)).alias("psi"))


def largest_gap(counts: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov statistic and p-value per feature: the largest distance of the two
    cumulative distributions, from one ordered pass over the distinct values."""
    running = cumulative_counts(counts, ["feature"], "value", ["n0", "n1"])
    gap = F.abs(F.expr("n0_cum / nullif(n0_total, 0) - n1_cum / nullif(n1_total, 0)"))
    merged = running.groupBy("feature").agg(
        F.max(gap).alias("ks_stat"), F.max("n0_total").cast("double").alias("_n0"), F.max("n1_total").cast("double").alias("_n1"))
    p = F.when(F.col("ks_stat").isNotNull(), ks_probability(F.col("ks_stat"), F.col("_n0"), F.col("_n1")))
    return merged.select("feature", "ks_stat", p.alias("ks_p_value"))


def distances(counts: DataFrame, facts: DataFrame, bins: int = 10) -> DataFrame:
    """Stability index, Kolmogorov-Smirnov statistic and p-value, a row per feature."""
    return stability(counts, facts, bins).join(F.broadcast(largest_gap(counts)), "feature")


def flag(psi: Column, p: Column, z: Column) -> Column:
    """Shape drift confirmed by either the distribution test or the mean shift."""
    return (psi > K.PSI_MODERATE) & ((p < K.KS_P_THRESHOLD) | (z > K.Z_THRESHOLD))


def severity(psi: Column, p: Column) -> Column:
    return (
        F.when(psi > K.PSI_HIGH, "HIGH")
        .when((psi > K.PSI_MODERATE) & (p < K.KS_P_THRESHOLD), "MODERATE")
        .when(psi > K.PSI_LOW, "LOW")
        .otherwise("NONE")
    )


def drift_report(sided: DataFrame, features: list[str], window_days: int = 7, rule=flag) -> DataFrame:
    """One row per feature with at least ten values in each window."""
    # Both are written: the moments, the bins and the ordered pass read them again.
    sided = written(sided.select("side", *features), "drift-windows")
    counts = written(side_counts(sided, features), "drift-counts")
    facts = moments(sided, features)
    enough = facts.where((F.col("rows0") >= K.MIN_DRIFT_VALUES) & (F.col("rows1") >= K.MIN_DRIFT_VALUES))
    # Both tables hold one row per feature.
    joined = enough.join(F.broadcast(distances(counts, facts)), "feature")
    shift = F.col("mean1") - F.col("mean0")
    z = F.abs(shift) / (F.col("std0") + EPS)
    psi, p = F.col("psi"), F.col("ks_p_value")
    return joined.select(
        "feature", F.col("feature").alias("baseline_col"),
        F.bround(psi, 4).alias("psi"), F.bround("ks_stat", 4).alias("ks_stat"), F.bround(p, 6).alias("ks_p_value"),
        F.bround(z, 4).alias("z_score"), F.bround(shift, 4).alias("mean_shift"),
        F.bround(F.col("std1") / (F.col("std0") + EPS), 4).alias("std_ratio"),
        F.bround("mean0", 4).alias("baseline_mean"), F.bround("mean1", 4).alias("live_mean"),
        F.col("rows0").alias("baseline_rows"), F.col("rows1").alias("live_rows"),
        severity(psi, p).alias("severity"), rule(psi, p, z).alias("drift"),
        F.lit(window_days).alias("window_days"),
    )


def drift_summary(report: DataFrame) -> DataFrame:
    """Counts, drifted features and the retraining advice of one run (a row per feature)."""
    out = report.agg(
        F.count("*").alias("features_checked"),
        F.count(F.when(F.col("drift"), 1)).alias("features_with_drift"),
        F.sort_array(F.collect_list(F.when(F.col("drift"), F.col("feature")))).alias("drifted_features"),
    )
    fraction = F.when(F.col("features_checked") > 0,
                      F.bround(F.col("features_with_drift") / F.col("features_checked"), 3)).otherwise(0.0)
    return out.withColumn("drift_fraction", fraction).withColumn(
        "retrain_recommended", F.col("drift_fraction") > K.RETRAIN_FRACTION)


def append_history(report: DataFrame, path: str, computed_at: str) -> None:
    """Add a run to the history table; a repeated run takes the place of the first.

    Each run is a folder named by its time, overwritten as a whole.
    """
    stamped = report.withColumn("computed_at", F.lit(computed_at).cast("timestamp_ntz"))
    stamped.write.mode("overwrite").parquet(f"{path}/run={computed_at.replace(':', '-').replace(' ', 'T')}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a history table."""
    return spark.read.parquet(path).drop("run")


def latest_drift(history: DataFrame) -> DataFrame:
    """Index and flag of the newest run, as exposed to monitoring."""
    return latest_run(history).select(
        "feature", F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce(F.col("drift").cast("int"), F.lit(0)).alias("drift"))


def drift_alerts(history: DataFrame) -> DataFrame:
    """The three drift rules over the newest run."""
    facts = latest_drift(history).agg(
        F.max("drift").alias("any"), F.max("psi").alias("psi"), F.sum("drift").alias("n"))
    rules = [
        ("DataDriftDetected", F.col("any").cast("double"), F.col("any") > 0),
        ("HighDriftPSI", F.col("psi"), F.col("psi") > K.PSI_HIGH),
        ("ManyFeaturesDrifted", F.col("n").cast("double"), F.col("n") >= 3),
    ]
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("alert"), value.alias("value"), firing.alias("firing")) for name, value, firing in rules])))
