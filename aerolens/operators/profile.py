"""Column profiles, histograms, counts, medians and correlations.

Wide aggregates read a table once and return one row, which is then turned on its side;
rows are only unpivoted where a distribution (distinct values) is needed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import kurtosis_unbiased, skewness_unbiased
from .ordered import null_safe, quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def long_form(df: DataFrame, columns: list[str], keep: list[str] = (), value: str = "value") -> DataFrame:
    """Named numeric columns as (feature, value) rows."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), columns, "feature", value)


def per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column from a single wide aggregate: ``measures`` maps names to builders."""
    wide = df.agg(*[F.struct(*[make(F.col(c)).alias(n) for n, make in measures.items()]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("m")) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.feature", "r.m.*")


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present and missing counts and the missing percentage per column."""
    out = per_column(df, columns, {
        "present": lambda c: F.count(c),
        "missing": lambda c: F.count(F.when(c.isNull(), 1)),
    })
    total = F.col("present") + F.col("missing")
    return out.withColumn("null_pct", F.when(total > 0, F.col("missing") * 100.0 / total))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread, exact quartiles, shape and missing share of every column."""
    moments = per_column(df, columns, {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "null_pct": lambda c: F.avg(c.isNull().cast("int")) * 100,
        "skewness": skewness_unbiased,
        "kurtosis": kurtosis_unbiased,
    })
    spots = quantiles(long_form(df, columns), ["feature"], "value", QUARTILES)
    return moments.where("count > 0").join(F.broadcast(spots), "feature")


def value_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds per column, widened by half a unit each side when all values are equal."""
    out = per_column(df, columns, {"lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")})
    flat = F.col("lo") == F.col("hi")
    return out.select(
        "feature",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def bin_of(value: str, lo: str, hi: str, bins: int) -> Column:
    """Equal-width bin number; a value on an edge opens the next bin, the last bin is closed."""
    v, low, high = F.col(value), F.col(lo), F.col(hi)
    width = (high - low) / bins
    guess = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))

    def edge(i: Column) -> Column:
        return low + i * width

    return (
        guess
        - F.when(v < edge(guess), 1).otherwise(0)
        + F.when((v >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    ).cast("int")


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Counts of ``bins`` equal-width bins per column, empty bins included."""
    bounds = value_range(df, columns).where(F.col("lo").isNotNull())  # one row per named column
    binned = (
        long_form(df, columns).where(F.col("value").isNotNull())
        .join(F.broadcast(bounds), "feature")
        .groupBy("feature", bin_of("value", "lo", "hi", bins).alias("bin")).agg(F.count("*").alias("n"))
    )
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(F.broadcast(binned), ["feature", "bin"], "left").select(  # at most bins rows per column
        "feature", "bin",
        (F.col("lo") + F.col("bin") * width).alias("edge_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("edge_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def baseline_profile(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Profile and histogram of each column as one nested record, for the baseline report."""
    bars = histogram(df, columns, bins).groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("bin", "edge_lo", "edge_hi", "n"))).alias("histogram"))
    return column_profile(df, columns).join(F.broadcast(bars), "feature")


def category_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(top) if top else counted


def records_per_station(df: DataFrame, stations: DataFrame) -> DataFrame:
    return df.groupBy("station_id").agg(F.count("*").alias("n_records")).join(stations, "station_id", "left")


def both_ends(df: DataFrame, order: str, tie: str, k: int) -> DataFrame:
    """The ``k`` largest and ``k`` smallest rows, marked by ``side``."""
    top = df.orderBy(F.desc(order), tie).limit(k).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.asc(order), tie).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def records_per_year(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n"))


def active_per_year(df: DataFrame, key: str = "station_id", ts: str = "timestamp", approximate: bool = False):
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.groupBy(F.year(ts).alias("year")).agg(distinct.alias("stations"))


def time_span(df: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """Rows, distinct keys, first and last timestamp and the span in hours and days."""
    out = df.agg(
        F.count("*").alias("row_count"), *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys],
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    hours = F.floor(F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")) / 3600)
    return out.withColumn("span_hours", hours).withColumn("span_days", F.floor(F.col("span_hours") / 24))


def median_by(df: DataFrame, keys: dict[str, Column], value: str, name: str = "median"):
    """Exact median per (computed) key."""
    keyed = df.select(*[c.alias(n) for n, c in keys.items()], F.col(value).cast("double").alias("_v"))
    return quantiles(keyed, list(keys), "_v", {name: 0.5})


def year_month_matrix(df: DataFrame, value: str, ts: str = "timestamp") -> DataFrame:
    """Medians as one row per year and one column per month (m1..m12)."""
    medians = median_by(df, {"year": F.year(ts), "month": F.month(ts)}, value)
    return medians.groupBy("year").agg(
        *[F.max(F.when(F.col("month") == m, F.col("median"))).alias(f"m{m}") for m in range(1, 13)])


def box_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outlier count per key."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    box = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = rows.alias("l").join(box.alias("r"), null_safe("l", "r", keys)).select("l.*", "r.q1", "r.median", "r.q3")
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def top_boxes(df: DataFrame, key: str, value: str, k: int = 20) -> DataFrame:
    """Box-plot numbers of the ``k`` keys with the largest median."""
    return box_numbers(df, [key], value).orderBy(F.desc("median"), key).limit(k)


def capped_distribution(df: DataFrame, columns: list[str], cap: float = 0.99) -> DataFrame:
    """Box numbers of the values up to each column's ``cap`` quantile."""
    values = long_form(df, columns)
    caps = quantiles(values, ["feature"], "value", {"cap": cap})
    kept = values.join(F.broadcast(caps), "feature").where(F.col("value") <= F.col("cap"))  # one row per column
    spots = quantiles(kept, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    summary = kept.groupBy("feature").agg(
        F.max("cap").alias("cap"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return summary.join(F.broadcast(spots), "feature")


def category_share(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    """Rows per category and percent of the categorised rows."""
    counted = df.select(category.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    # The window runs over one row per category.
    return counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def correlation(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both values; null if either does not vary there."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlation of every pair of a short column list, in one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def top_correlated(df: DataFrame, columns: list[str], target: str, k: int = 6) -> DataFrame:
    """The ``k`` columns most correlated with ``target``, by absolute value."""
    wide = df.agg(*[correlation(F.col(c), F.col(target)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])
    return wide.select(F.inline(rows)).orderBy(F.desc_nulls_last(F.abs("corr")), "feature").limit(k)


def target_statistics(
    df: DataFrame, key: str, target: str = "aqi", prefix: str | None = None
) -> DataFrame:
    """Mean and exact median of the target per key; 0 where a key has no target at all."""
    prefix = prefix or key.removesuffix("_id")
    mean, median = f"{prefix}_{target}_mean", f"{prefix}_{target}_median"
    means = df.groupBy(key).agg(F.avg(target).alias(mean))
    stats = means.join(quantiles(df, [key], target, {median: 0.5}), key, "left")
    return stats.na.fill(0.0, subset=[mean, median])
