"""Joins of readings with stations, coordinates, weather and registry.

No broadcast hints here: dimension tables are broadcast by their measured size
(``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution at run time), and larger
ones fall back to a sort-merge join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .ordered import earliest_by, latest_by


def with_station(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return readings.join(stations, "station_id", "left")


def keep_known_cities(df: DataFrame, config: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Rows whose city occurs in ``config``."""
    form = F.lower if ignore_case else F.col
    known = config.select(form("city").alias("_city")).distinct()
    return df.join(known, form("city") == F.col("_city"), "left_semi")


def with_coordinates(df: DataFrame, config: DataFrame, default=None, key: str = "station_id") -> DataFrame:
    """Add latitude and longitude by key; ``default`` replaces missing ones."""
    out = df.join(config.select(key, "latitude", "longitude"), key, "left")
    if default is None:
        return out
    return out.withColumns({
        "latitude": F.coalesce("latitude", F.lit(default[0])),
        "longitude": F.coalesce("longitude", F.lit(default[1])),
    })


def with_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    return readings.join(weather, ["timestamp", "station_id", "city"], "left")


def with_city_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather has one row per city and hour; it is not repeated for the stations of a city."""
    return readings.join(weather, ["city", "timestamp"], "left")


def merge_live(readings: DataFrame, weather: DataFrame, order: list[str]) -> DataFrame:
    """Readings with city weather of the hour; one row (the last in ``order``) per key."""
    joined = with_city_weather(readings, weather)
    return latest_by(joined, ["city", "station_id", "timestamp"], order)


def weather_to_stations(stations: DataFrame, weather: DataFrame) -> DataFrame:
    """City weather repeated for every station of the city."""
    return weather.join(stations.select("station_id", "city"), "city")


def without_metadata(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Station ids that occur in the data but not in the dimension."""
    return readings.select("station_id").distinct().join(stations, "station_id", "left_anti")


def cities_to_fetch(stations: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per city (its first station's coordinates) that is not fetched yet."""
    first = earliest_by(stations.select("city", "station_id", "latitude", "longitude"), ["city"], ["station_id"])
    return first.drop("station_id").join(fetched, "city", "left_anti")


def with_registry(measurements: DataFrame, registry: DataFrame) -> DataFrame:
    return measurements.join(registry, "sensor_id")


def lookup_statistics(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Add the statistics of each row's key; unknown keys get 0."""
    names = [c for c in stats.columns if c != key]
    return df.join(stats, key, "left").na.fill(0.0, subset=names)


def choose_location(
    locations: DataFrame, hints: DataFrame, keys: list[str], name: str = "name",
    last_seen: str = "last_seen", position: str = "position",
) -> DataFrame:
    """One location per city.

    The first hint (by ``hint_order``) contained in a location name wins; without a match
    the most recently seen location, and without any the first listed. ``hints`` holds
    ``keys``, ``hint`` and ``hint_order``, a handful of rows per city.
    """
    listed = hints.groupBy(*keys).agg(F.collect_list(F.struct("hint_order", "hint")).alias("_hints"))
    joined = locations.join(listed, keys, "left")
    matched = F.array_min(F.transform(
        F.filter("_hints", lambda h: F.contains(F.lower(F.col(name)), F.lower(h["hint"]))),
        lambda h: h["hint_order"],
    ))
    ranked = joined.withColumn("hint_order", matched).drop("_hints")
    preference = [
        F.coalesce(F.col("hint_order"), F.lit(2**31 - 1)).alias("_a"),
        # Later is better: negate, unseen last.
        F.when(F.col("hint_order").isNull(), F.coalesce(-F.unix_micros(F.col(last_seen).cast("timestamp")), F.lit(2**62)))
        .otherwise(F.lit(0)).alias("_b"),
        F.col(position).alias("_c"),
    ]
    keep = [c for c in ranked.columns if c not in keys]
    return ranked.groupBy(*keys).agg(
        F.min_by(F.struct(*keep), F.struct(*preference)).alias("_best")
    ).select(*keys, "_best.*")


def latest_run(df: DataFrame, run: str = "computed_at") -> DataFrame:
    """Rows of the most recent run: the maximum, a single row, joined back."""
    newest = df.agg(F.max(run).alias("_newest"))  # one row
    return df.join(F.broadcast(newest), F.col(run) == F.col("_newest")).drop("_newest")


HINT_ROWS = [(city, i, hint) for city, hints in K.LOCATION_HINTS.items() for i, hint in enumerate(hints)]
