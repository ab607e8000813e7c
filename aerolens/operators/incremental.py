"""Incremental maintenance of keyed tables: upserts, watermarks, fetch plans, retention.

The functions without a path are plain frame-to-frame operators. ``upsert_table`` and
``insert_into_table`` apply them to a parquet table partitioned by ``date`` and only read
and rewrite the days a batch touches; rows without a time are a day of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numeric import floor_hour
from ..session import exists, remove, scratch, subfolders, written
from .ordered import earliest_by, latest_by, null_safe


def _without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (null keys equal null keys)."""
    return df.alias("l").join(other.select(*keys).alias("r"), null_safe("l", "r", keys), "left_anti")


def insert_or_replace(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after a batch: the last row per key wins, batch rows over stored ones.

    Stored rows are only filtered against the batch's keys, so a small batch is broadcast
    by its measured size and the table is not shuffled.
    """
    newest = latest_by(batch, keys, order)
    return _without(table, newest, keys).unionByName(newest, allowMissingColumns=True)


def stamp_missing_time(batch: DataFrame, now: str, ts: str = "timestamp") -> DataFrame:
    return batch.withColumn(ts, F.coalesce(F.col(ts), F.lit(now).cast("timestamp_ntz")))


def new_rows(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch to append: the first per key, unless the key is stored already."""
    return _without(earliest_by(batch, keys, order), table, keys)


def insert_or_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return table.unionByName(new_rows(table, batch, keys, order), allowMissingColumns=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with every column that any of its days has; ``date`` is the day. Reading writes nothing: days that a
    writer has staged completely, but not yet put in their place, are read where they are staged."""
    def days(where: str) -> DataFrame:
        return spark.read.option("mergeSchema", "true").parquet(where).withColumn("date", F.col("date").cast("date"))

    pending = _pending(path)
    if not exists(spark, f"{pending}/_SUCCESS"):
        return days(path)
    staged = days(pending)
    if not exists(spark, path):
        return staged
    moved = [r[0] for r in staged.select("date").distinct().collect()]  # one value per staged day
    left = ~F.col("date").isin([d for d in moved if d is not None])
    kept = F.col("date").isNotNull() & left if None in moved else F.col("date").isNull() | left
    return days(path).where(kept).unionByName(staged, allowMissingColumns=True)


def upsert_table(path: str, batch: DataFrame, keys: list[str], order: list[str], ts: str = "timestamp") -> None:
    """Insert-or-replace into a date-partitioned parquet table; new columns widen it.

    ``keys`` must hold ``ts``, so that a key belongs to one day.
    """
    with scratch(batch.sparkSession):
        newest = written(_dated(batch, keys, ts).transform(latest_by, keys, order), "upsert")
        stored = _stored_days(path, newest)
        if stored is None:
            merged = newest
        else:
            merged = _without(stored, newest, keys).unionByName(newest, allowMissingColumns=True)
        _replace_days(path, merged)


def insert_into_table(path: str, batch: DataFrame, keys: list[str], order: list[str], ts: str = "measurement_time") -> int:
    """Insert-or-ignore into a date-partitioned parquet table; returns the rows added."""
    with scratch(batch.sparkSession):
        first = written(_dated(batch, keys, ts).transform(earliest_by, keys, order), "insert")
        stored = _stored_days(path, first)
        if stored is None:
            fresh = merged = first
        else:
            fresh = written(_without(first, stored, keys), "insert-fresh")
            merged = stored.unionByName(fresh, allowMissingColumns=True)
        added = fresh.count()
        if added:
            _replace_days(path, merged)
        return added


def _dated(batch: DataFrame, keys: list[str], ts: str) -> DataFrame:
    if ts not in keys:
        raise ValueError(f"the keys must hold {ts}: a key would be looked for in one day and stored in another")
    return batch.withColumn("date", F.to_date(ts))


def _stored_days(path: str, batch: DataFrame) -> DataFrame | None:
    """The stored rows of the batch's days, null for a day where it has rows without a time; None without a table."""
    spark = batch.sparkSession
    if not (exists(spark, path) or exists(spark, _pending(path))):
        return None
    _recover(spark, path)
    days = [r[0] for r in batch.select("date").distinct().collect()]  # one value per day of the batch
    touched = F.col("date").isin([d for d in days if d is not None])
    return read_table(spark, path).where(touched | F.col("date").isNull() if None in days else touched)


def _pending(path: str) -> str:
    return path.rstrip("/") + "_pending"


def _replace_days(path: str, days: DataFrame) -> None:
    """Put ``days`` in place of the table's days of these dates.

    They are first written beside the table. If the replacement breaks off, the next writer of the table finds
    them complete there and repeats it (``_recover``); readers only read them.
    """
    spark = days.sparkSession
    _by_day(days).write.mode("overwrite").parquet(_pending(path))
    _recover(spark, path)


def _recover(spark: SparkSession, path: str) -> None:
    pending = _pending(path)
    if not exists(spark, pending):
        return
    if exists(spark, f"{pending}/_SUCCESS"):
        staged = spark.read.parquet(pending)
        if staged.head(1):
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    remove(spark, pending)  # without _SUCCESS nothing of the table has been touched yet


def _by_day(df: DataFrame) -> DataFrame:
    """Rows grouped by day, so that a write makes few files per day; adaptive execution
    splits a day that is too large for one task and merges small ones."""
    return df.hint("rebalance", F.col("date"))


def upsert_registry(registry: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """Sensor registry after a batch: new values win, the stored fetch watermark stays."""
    keys = ["openaq_location_id", "sensor_id"]
    fresh = latest_by(batch, keys, ["_order"] if "_order" in batch.columns else ["station_id", "parameter"])
    joined = registry.alias("o").join(
        fresh.alias("n"), null_safe("o", "n", keys), "full_outer")
    is_new = F.col("n.sensor_id").isNotNull()

    def newer(c: str) -> Column:
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    plain = ["station_id", "city", "station_name", "openaq_location_name", "parameter", "units"]
    return joined.select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[newer(c) for c in plain],
        F.when(F.col("o.sensor_id").isNotNull(), F.col("o.last_fetched_hour"))
        .otherwise(F.col("n.last_fetched_hour")).alias("last_fetched_hour"),
        F.when(is_new, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("o.last_successful_sync")).alias("last_successful_sync"),
    )


def ordered_registry(registry: DataFrame) -> DataFrame:
    return registry.orderBy("city", "station_id", "parameter", "sensor_id")


def watermarks(measurements: DataFrame) -> DataFrame:
    """Newest measurement per sensor."""
    return measurements.groupBy("sensor_id").agg(F.max("measurement_time").alias("last_fetched_hour"))


def advance_watermarks(registry: DataFrame, measurements: DataFrame, now: str) -> DataFrame:
    """Registry with the watermark and sync time of every sensor that delivered rows."""
    newest = watermarks(measurements).withColumnRenamed("last_fetched_hour", "_newest")
    joined = registry.join(newest, "sensor_id", "left")
    delivered = F.col("_newest").isNotNull()
    return joined.select(*[
        F.when(delivered, F.col("_newest")).otherwise(F.col(c)).alias(c) if c == "last_fetched_hour"
        else F.when(delivered, F.lit(now).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c) if c == "last_successful_sync"
        else F.col(c)
        for c in registry.columns
    ])


def fetch_plan(
    registry: DataFrame, measurements: DataFrame, now: str,
    lag_hours: int = K.SAFETY_LAG_HOURS, backfill_days: int = K.BACKFILL_DAYS,
) -> DataFrame:
    """What to fetch for every sensor: from the hour after its newest row to the safe end."""
    end = floor_hour(F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {lag_hours} hours"))
    newest = watermarks(measurements).withColumnRenamed("last_fetched_hour", "_newest")
    start = F.coalesce(F.col("_newest") + F.expr("interval 1 hour"), end - F.expr(f"interval {backfill_days} days"))
    # The whole-hour bounds are what a request carries; the comparison uses the exact start.
    return registry.select("sensor_id").distinct().join(newest, "sensor_id", "left").select(
        "sensor_id", floor_hour(start).alias("from_hour"), end.alias("to_hour"),
        F.when(start > end, "up_to_date").otherwise("fetch").alias("status"),
    )


def backfill_plan(
    readings: DataFrame, upstream: DataFrame, now: str, key: str = "station_id",
    hours: int = K.BACKFILL_HOURS, min_rows: int = K.MIN_HISTORY_ROWS,
) -> DataFrame:
    """Whether each location needs a backfill, and the history range to fetch.

    ``upstream`` holds the latest upstream hour (``latest_hour``) per key.
    """
    at = F.lit(now).cast("timestamp_ntz")
    recent = F.col("timestamp") >= at - F.expr(f"interval {hours} hours")
    stored = readings.groupBy(key).agg(
        F.max("timestamp").alias("stored_latest"), F.count(F.when(recent, 1)).alias("row_count"))
    joined = upstream.join(stored, key, "left")
    rows = F.coalesce("row_count", F.lit(0))
    lag = F.timestamp_diff("SECOND", F.col("stored_latest"), F.col("latest_hour")) / 3600.0
    need = (rows < min_rows) | F.col("stored_latest").isNull() | F.coalesce(lag > 1.0, F.lit(False))
    end = F.coalesce(F.col("latest_hour"), floor_hour(at))
    start = F.coalesce(floor_hour(F.col("stored_latest") + F.expr("interval 1 hour")),
                       end - F.expr(f"interval {hours} hours"))
    return joined.select(
        key, rows.alias("row_count"), need.alias("need_backfill"), start.alias("from_hour"), end.alias("to_hour"),
        F.when(start >= end, "cached").otherwise("fetch").alias("status"),
    )


def latest_hours(measurements: DataFrame, key: str, ts: str = "measurement_time") -> DataFrame:
    return measurements.groupBy(key).agg(F.max(floor_hour(ts)).alias("latest_hour"))


def freshness(readings: DataFrame, now: str, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """Age of the newest row per key in hours, two decimals."""
    newest = readings.groupBy(*keys).agg(F.max(ts).alias("latest"))
    seconds = F.timestamp_diff("SECOND", F.col("latest"), F.lit(now).cast("timestamp_ntz"))
    return newest.withColumn("age_hours", F.bround(seconds / 3600.0, 2))


def recent(df: DataFrame, now: str, hours: int, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours``; a plain range predicate that reaches the scan."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))


def retain(df: DataFrame, now: str, days: int | None = None, hours: int | None = None, ts: str = "timestamp"):
    """Rows young enough to keep."""
    return recent(df, now, hours if hours is not None else 24 * days, ts)


def retain_table(spark: SparkSession, path: str, now: str, days: int | None = None, hours: int | None = None, ts: str = "timestamp") -> None:
    """Delete the rows of a stored table that are older than ``days`` or ``hours``; rows without a time stay.

    Days before that of the cut-off go as folders, unread. Only the cut-off's own day is read and put in its place again, and that
    only if it holds rows before the cut-off. Each step can be repeated after a failure.
    """
    cutoff = dt.datetime.fromisoformat(now) - dt.timedelta(hours=hours if hours is not None else 24 * days)
    _recover(spark, path)
    cut_day = f"date={cutoff.date().isoformat()}"
    own = spark.read.parquet(f"{path}/{cut_day}").withColumn("date", F.lit(cutoff.date())) if exists(spark, f"{path}/{cut_day}") else None
    if own is not None and own.where(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz")).head(1):
        kept = own.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))
        if kept.head(1):
            _replace_days(path, kept)
        else:
            remove(spark, f"{path}/{cut_day}")
    for name in subfolders(spark, path):
        if name.startswith("date=") and name[5:6].isdigit() and name < cut_day:
            remove(spark, f"{path}/{name}")


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the missing ones of ``columns`` (name to type) as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def rekey(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table under a new unique key; the first row of each key stays. Rows with a null
    in the key form one group, unlike in a SQL unique index."""
    return earliest_by(df, keys, order)


def latest_values(measurements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest normalised value of every parameter, as one map per key."""
    newest = measurements.groupBy(*keys, "parameter").agg(F.max_by("value", F.struct(*order)).alias("value"))
    return newest.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("parameter", "value")))).alias("pollutants"))
