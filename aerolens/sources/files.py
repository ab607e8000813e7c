"""CSV, JSON-report and parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.numeric import safe_double, safe_timestamp

NUMERIC_READINGS = (*K.POLLUTANTS, "aqi")


def typed_readings(raw: DataFrame) -> DataFrame:
    """Rename raw header names (blanks stripped) and coerce values; bad text becomes null."""
    named = raw.withColumnsRenamed({
        c: K.RAW_READING_NAMES[c.strip()] for c in raw.columns if c.strip() in K.RAW_READING_NAMES
    })
    made = {c: safe_double(F.trim(c)) for c in NUMERIC_READINGS if c in named.columns}
    made["timestamp"] = safe_timestamp(F.trim("timestamp"))
    return named.withColumns(made)


def _read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with every column as text: only the header line is read ahead, and no
    type inference passes over the data."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def read_readings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide station-hour CSV, typed."""
    return typed_readings(_read_text_csv(spark, path))


def read_stations_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_text_csv(spark, path)
    return raw.withColumnsRenamed({
        c: K.RAW_STATION_NAMES[c.strip()] for c in raw.columns if c.strip() in K.RAW_STATION_NAMES})


def read_station_config(spark: SparkSession, path: str) -> DataFrame:
    schema = "station_id string, city string, latitude double, longitude double"
    return spark.read.option("header", True).schema(schema).csv(path)


def read_readings(spark: SparkSession, path: str, columns: list[str] | None = None, stations: list[str] | None = None):
    """Parquet readings with column pruning and a pushed-down station predicate."""
    df = spark.read.parquet(path)
    if stations is not None:
        df = df.where(F.col("station_id").isin(*stations))
    return df.select(*columns) if columns else df


def write_readings(df: DataFrame, path: str) -> None:
    """Station-hour table partitioned by day; files are sorted by station. Adaptive
    execution splits large days and merges small ones."""
    daily = df.withColumn("date", F.to_date("timestamp")).hint("rebalance", F.col("date"))
    daily.sortWithinPartitions("date", "station_id", "timestamp").write.partitionBy("date").mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A report table as JSON lines or headed CSV."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def to_float32(df: DataFrame) -> DataFrame:
    """Doubles as 32-bit floats, for the stored feature table."""
    doubles = [f.name for f in df.schema.fields if f.dataType == T.DoubleType()]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles})
