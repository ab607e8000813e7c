"""Structured Streaming forms of ingestion, hourly means, alerts and last-seen state.

Every job is started with ``run``: a checkpointed query that processes what is available
and stops, which is how an hourly schedule drives it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.incremental import insert_into_table, upsert_table
from ..operators.monitor import ntz
from ..session import work_path

LATENESS = f"{K.SAFETY_LAG_HOURS} hours"


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000):
    """A stream over parquet files landing in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).parquet(path)
    )


def run(stream: DataFrame, checkpoint: str, path: str | None = None, each: Callable | None = None, mode: str = "append"):
    """Process all available input once, into a parquet folder or a batch function; with neither only the state is kept."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path) if path else writer.format("noop").start()
    query.awaitTermination()


def state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state of one stateful operator as its query's checkpoint holds it: columns ``key`` and ``value``.

    Operators are numbered from the last one of the query backwards.
    """
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def watermarked(stream: DataFrame, ts: str = "measurement_time", lateness: str = LATENESS) -> DataFrame:
    """Event time with the safety lag as lateness bound (watermarks need a zoned type)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "measurement_time", lateness: str = LATENESS) -> DataFrame:
    """Idempotent insert: the first row per key, with state bounded by the watermark."""
    return watermarked(stream, ts, lateness).dropDuplicatesWithinWatermark(keys)


def hourly_means(stream: DataFrame, keys: list[str], ts: str = "measurement_time", lateness: str = LATENESS) -> DataFrame:
    """Mean per tumbling hour and key. Sum and count stay in state, never the rows."""
    return (
        watermarked(stream, ts, lateness).groupBy(F.window(ts, "1 hour").alias("_w"), *keys)
        .agg(F.avg("value").alias("value"), F.count("*").alias("n"))
        .select(*keys, ntz("_w.start").alias("timestamp"), "value", "n")
    )


def sliding_errors(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Error share per 5-minute window sliding by a minute, in two steps: a log row counts in one minute, and only a
    minute's counts go into the windows around it. Windows come out when the watermark closes them."""
    minutes = (
        watermarked(stream, "ts", lateness).groupBy(F.window("ts", "1 minute").alias("_m"))
        .agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
    )
    return (
        minutes.groupBy(F.window("_m", "5 minutes", "1 minute").alias("_w"))
        .agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
        .select(ntz("_w.start").alias("window_start"), "total", "errors")
    )


def open_errors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows of ``sliding_errors`` that the watermark has not closed, with what they hold so far, from the
    query's state: the sums of its windows and the minutes not yet passed on to them."""
    # Fields of a state row are named after their aggregates, twice the same here: they are taken by place.
    window, counts = "struct<start:timestamp,end:timestamp>", "struct<total:bigint,errors:bigint>"
    held, waiting = (state(spark, checkpoint, i).select(F.col("key").cast(f"struct<w:{window}>").alias("k"), F.col("value").cast(counts).alias("v"))
                     .select(F.col("k.w.start").alias("at"), "v.*") for i in (0, 1))
    totals = [F.sum(c).alias(c) for c in ("total", "errors")]
    spread = waiting.groupBy(F.window("at", "5 minutes", "1 minute").alias("_w")).agg(*totals).select(F.col("_w.start").alias("at"), "total", "errors")
    return held.union(spread).groupBy(ntz("at").alias("window_start")).agg(*totals)


def upsert_sink(path: str, keys: list[str], ts: str = "timestamp") -> Callable[[DataFrame, int], None]:
    """A batch function that merges updates into a date-partitioned table. Replaying a
    batch writes the same rows, so the result is exact after a restart."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read twice: the days it touches, then its rows
        try:
            upsert_table(path, batch, keys, ["n"], ts)
        finally:
            batch.unpersist()
    return merge


def insert_sink(path: str, keys: list[str], order: list[str], ts: str = "measurement_time") -> Callable[[DataFrame, int], None]:
    """A batch function that appends rows with new keys; replaying a batch adds none."""
    def insert(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            insert_into_table(path, batch, keys, order, ts)
        finally:
            batch.unpersist()
    return insert


def last_seen(stream: DataFrame) -> DataFrame:
    """Newest measurement and row count per sensor: one small state row each."""
    return stream.groupBy("sensor_id").agg(
        F.max("measurement_time").alias("last_seen"), F.count("*").alias("n"))


def current_last_seen(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``last_seen`` knows now, read from the state of its query: nothing is written but the checkpoint."""
    kept = state(spark, checkpoint)
    newest, n = kept.schema["value"].dataType.names[:2]
    return kept.select("key.sensor_id", F.col(f"value.{newest}").alias("last_seen"), F.col(f"value.{n}").alias("n"))


def checkpoint_path(spark: SparkSession, label: str) -> str:
    return work_path(spark, f"stream-{label}")
