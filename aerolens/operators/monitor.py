"""Alert rules as windowed queries over a request log.

Rules look at sliding windows. The log is first counted per minute (map-side combine) and
only these counts are copied into the windows that cover them, never the log rows.
Requests have ``ts``, ``city``, ``status`` and ``latency``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .incremental import freshness


def ntz(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def minute_counts(df: DataFrame, measures: dict[str, Column], keys: list[str] = (), ts: str = "ts") -> DataFrame:
    """Additive counts per minute."""
    return df.groupBy(*keys, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(
        *[F.count(F.when(c, 1)).alias(n) for n, c in measures.items()])


def sliding(counts: DataFrame, names: list[str], keys: list[str] = (), length="5 minutes", step="1 minute") -> DataFrame:
    """Sums over sliding windows of per-minute counts."""
    return counts.groupBy(*keys, F.window("minute", length, step).alias("_w")).agg(
        *[F.sum(n).alias(n) for n in names]).select(
        *keys, ntz("_w.start").alias("window_start"), ntz("_w.end").alias("window_end"), *names)


def error_rate(requests: DataFrame, threshold: float = 0.05) -> DataFrame:
    counts = minute_counts(requests, {"total": F.lit(True), "errors": F.col("status") == "error"})
    out = sliding(counts, ["total", "errors"])
    return out.withColumn("error_rate", F.col("errors") / F.col("total")).withColumn(
        "breach", F.col("error_rate") > threshold)


def histogram_quantile(q: float, buckets: list[float], names: list[str], total: str) -> Column:
    """Quantile from cumulative bucket counts, linear inside the bucket it falls in."""
    rank = F.lit(q) * F.col(total)
    expr, lower, below = None, F.lit(0.0), F.lit(0)
    for bound, name in zip(buckets, names):
        upto = F.col(name)
        inside = lower + (F.lit(bound) - lower) * (rank - below) / F.nullif(upto - below, F.lit(0))
        expr = F.when(upto >= rank, inside) if expr is None else expr.when(upto >= rank, inside)
        lower, below = F.lit(bound), upto
    return F.when(F.col(total) > 0, expr.otherwise(F.lit(buckets[-1])))


def latency_p95(requests: DataFrame, threshold: float = 10.0, buckets=K.LATENCY_BUCKETS) -> DataFrame:
    """95th latency percentile per 5-minute window, from the latency histogram."""
    names = [f"le_{i}" for i in range(len(buckets))]
    measures = {"total": F.col("latency").isNotNull()}
    measures |= {n: F.col("latency") <= b for n, b in zip(names, buckets)}
    out = sliding(minute_counts(requests, measures), ["total", *names])
    return out.select(
        "window_start", "window_end", "total", histogram_quantile(0.95, list(buckets), names, "total").alias("p95")
    ).withColumn("breach", F.col("p95") > threshold)


def failed_fetches(fetches: DataFrame, length: str = "10 minutes", status: str = "failed") -> DataFrame:
    """Windows with fetches of the given status; a fetch log writes ``failed``."""
    counts = minute_counts(fetches, {"failed": F.col("status") == status})
    return sliding(counts, ["failed"], length=length).withColumn("breach", F.col("failed") > 0)


def silent_windows(requests: DataFrame, minutes: int = 10) -> DataFrame:
    """Tumbling windows of ``minutes`` between the first and last request without any.

    The window spine grows day by day, so no single row holds it all.
    """
    size = f"{minutes} minutes"
    active = requests.groupBy(F.window("ts", size)["start"].alias("window_start")).agg(F.count("*").alias("n"))
    span = active.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    days = span.select("a", "b", F.explode(F.sequence(
        F.date_trunc("day", "a"), F.date_trunc("day", "b"), F.expr("interval 1 day"))).alias("d"))
    spine = days.select("a", "b", F.explode(F.sequence(
        F.col("d"), F.col("d") + F.expr(f"interval 1 day - interval {size}"), F.expr(f"interval {size}"))).alias("window_start")
    ).where("window_start between a and b").select("window_start")
    return spine.join(active, "window_start", "left_anti").select(ntz("window_start").alias("window_start"))


def stale(readings: DataFrame, now: str, hours: float = 3.0, key: str = "station_id") -> DataFrame:
    return freshness(readings, now, [key]).withColumn("breach", F.col("age_hours") > hours)


def held(windows: DataFrame, hold: str, step: str = "1 minute", at: str = "window_end", alert: str = "alert") -> DataFrame:
    """Alerts whose breach lasted at least ``hold``: one row per unbroken run of breaches.

    Consecutive evaluations at most one ``step`` apart form a run; a missing or clean
    evaluation ends it. Runs are first formed inside each day of an alert; runs that meet at
    midnight are then joined over the few runs a day has, so no task holds an alert's history.
    """
    day = windows.where("breach").withColumn("_day", F.to_date(at))
    inside = Window.partitionBy(alert, "_day").orderBy(at)
    reach = F.expr(f"interval {step}")

    def number(df: DataFrame, w, start: str, last: str) -> DataFrame:
        """Number the runs: a gap of more than a step before a row begins one."""
        before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.when(before.isNull() | (F.col(start) > before + reach), 1).otherwise(0)
        return df.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    daily = number(day, inside, at, at).groupBy(alert, "_day", "_run").agg(
        F.min(at).alias("active_since"), F.max(at).alias("last_breach"), F.count("*").alias("evaluations"))
    over = Window.partitionBy(alert).orderBy("active_since")
    runs = number(daily.drop("_run"), over, "active_since", "last_breach").groupBy(alert, "_run").agg(
        F.min("active_since").alias("active_since"), F.max("last_breach").alias("last_breach"), F.sum("evaluations").alias("evaluations"))
    return runs.where(F.col("last_breach") - F.col("active_since") >= F.expr(f"interval {hold}")).select(
        alert, "active_since", (F.col("active_since") + F.expr(f"interval {hold}")).alias("firing_since"),
        "last_breach", "evaluations")


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by city and status, and rows written by city (value summed where present)."""
    return requests.groupBy("city", "status").agg(F.count("*").alias("requests"), F.sum("rows_written").alias("rows_written"))
