"""The recurring jobs, composed from the operators.

Each function reads and writes parquet tables below the paths it is given, and can be run
again after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import clean, drift, forecast, incremental, joins, profile, quality, selection, series
from ..session import written
from ..sources import files, payloads


def station_config(stations: DataFrame, coordinates: DataFrame, path: str) -> None:
    """Station coordinates by city, as headed CSV; cities without coordinates drop."""
    located = stations.select("station_id", "city").join(coordinates, "city")
    files.write_report(located.select("station_id", "city", "latitude", "longitude"), path, "csv")


def training_table(
    raw: DataFrame, stations: DataFrame, config: DataFrame, weather: DataFrame, start: str, end: str, city: str | None = None
) -> DataFrame:
    """Raw readings to the validated station-hour table with city weather.

    ``weather`` has one row per city and hour. A single ``city`` or all configured cities.
    """
    named = joins.with_station(raw, stations.select("station_id", "station_name", "city", "state"))
    kept = clean.only_city(named, city) if city else joins.keep_known_cities(named, config)
    ranged = kept.where(F.col("timestamp").isNotNull()).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    placed = joins.with_coordinates(ranged.transform(clean.between_dates, start, end), config)
    measures = [c for c in (*K.POLLUTANTS, "aqi") if c in placed.columns]
    keys = ["station_id", "city", "state", "station_name", "latitude", "longitude"]
    hourly = clean.station_hour_mean(placed, keys, measures)
    known = joins.keep_known_cities(weather, config, ignore_case=False)
    joined = joins.with_city_weather(hourly, known)
    return quality.require_quality(written(joined, "training"))


def feature_table(table: DataFrame, spec: series.FeatureSpec = series.OFFLINE) -> DataFrame:
    """The training table with filled columns, missingness flags and all window features."""
    measures = [c for c in spec.pollutants if c in table.columns]
    weather = [c for c in K.WEATHER if c in table.columns]
    flags = selection.most_missing(table, [c for c in [*measures, *weather] if c != spec.target])
    filled = series.fill_offline(series.add_missing_flags(table, flags), [*measures, *weather])
    return series.engineer(filled, spec)


def engineered_training(table: DataFrame, spec: series.FeatureSpec = series.OFFLINE, sparse: float = 0.65) -> tuple[DataFrame, dict]:
    """The training table before column selection, and what was decided on the way.

    Sparse and near-constant columns go (never the target), the rest is flagged, filled and
    engineered; the city's code and the target statistics of station and city are added. All
    decisions are made on the whole table, which is written first: each of them reads it again.
    """
    table = written(table, "training-input")
    columns = [c for c in [*spec.pollutants, *K.WEATHER] if c in table.columns]
    inputs = [c for c in columns if c != spec.target]
    dropped = selection.sparse_columns(table, inputs, sparse, spec.target)
    dropped += selection.near_constant_columns(table, [c for c in inputs if c not in dropped])
    stations = profile.target_statistics(table, "station_id", spec.target)
    cities = profile.target_statistics(table, "city", spec.target)
    made = feature_table(table.drop(*dropped), spec)
    coded = made.join(clean.encode_labels(table), "city", "left")
    known = joins.lookup_statistics(joins.lookup_statistics(coded, stations, "station_id"), cities, "city")
    return written(known, "training-features"), {"dropped": dropped}


def training_features(
    table: DataFrame, spec: series.FeatureSpec = series.OFFLINE, sparse: float = 0.65, correlated: float = 0.98, most: int | None = None
) -> tuple[DataFrame, dict]:
    """The table that models are trained on: keys, selected features (the first ``most`` if given), targets."""
    made, meta = engineered_training(table, spec, sparse)
    targets = [c for c in made.columns if c in {f"{spec.target}_t{h}" for h in range(1, spec.horizons + 1)}]
    keys = [c for c in ("station_id", "city", "state", "station_name", "latitude", "longitude", "timestamp") if c in made.columns]
    candidates = [c for c in made.columns if c not in keys and c not in targets]
    chosen = selection.select_features(made, candidates, correlated, most)
    return made.select(*keys, *chosen, *targets), meta | {"selected": chosen}


def ingest(landed: DataFrame, registry: DataFrame, table_path: str, now: str, order: list[str]) -> tuple[DataFrame, int]:
    """Landed measurement payloads (``sensor_id``, ``payload``) into the measurement table.

    Returns the registry with advanced watermarks and the number of rows added.
    """
    meta = registry.select("sensor_id", "station_id", "city", "openaq_location_id", "parameter", F.col("units").alias("raw_unit"))
    rows = payloads.flatten_measurements(joins.with_registry(landed, meta)).where("measurement_time IS NOT NULL")
    batch = written(rows.withColumn("ingested_at", F.lit(now).cast("timestamp_ntz")), "ingest")
    added = incremental.insert_into_table(table_path, batch, ["sensor_id", "measurement_time"], order)
    return incremental.advance_watermarks(registry, batch, now), added


def refresh_readings(measurements: DataFrame, weather: DataFrame, readings_path: str) -> None:
    """Station-hour readings with index and weather, upserted into the readings table."""
    wide = clean.with_index(clean.pivot_parameters(measurements, ["station_id", "city"]))
    joined = wide.join(weather, ["city", "timestamp"], "left")
    incremental.upsert_table(readings_path, joined, ["city", "station_id", "timestamp"], ["timestamp"])


def predictions(
    readings: DataFrame, models: dict, features: list[str], now: str, hours: int = K.BACKFILL_HOURS, codes: DataFrame | None = None
) -> DataFrame:
    """Prediction records of every station with enough recent history, in one plan. ``codes``: the training's city codes;
    cities without one have code 0, as have absent feature columns."""
    history = series.enough_history(incremental.recent(readings, now, hours))
    columns = [c for c in (*series.LIVE.pollutants, "pm10", *series.LIVE.weather) if c in history.columns]
    live = series.engineer(series.fill_live(history, columns), series.LIVE, last_only=True)
    if codes is not None and "city" in live.columns:
        live = clean.with_codes(live, codes)
    aligned = live.withColumns({c: F.lit(0.0) for c in features if c not in live.columns})
    scored = forecast.score(aligned, models)
    trends = clean.weekly_trend(history)
    keep = [c for c in ("city", "station_id", "station_name", "location_id", "timestamp") if c in scored.columns]
    return forecast.prediction_records(scored, sorted(models), trends, keep)


def drift_run(readings: DataFrame, history_path: str, now: str, features=K.DRIFT_FEATURES) -> DataFrame:
    """Compare the windows, append the run to the history and return its summary."""
    present = [c for c in features if c in readings.columns]
    drift.append_history(drift.drift_report(drift.windows(readings, now), present), history_path, now)
    run = drift.read_history(readings.sparkSession, history_path)
    return drift.drift_summary(run.where(F.col("computed_at") == F.lit(now).cast("timestamp_ntz")))
