"""Per-station time-series operators: fills, lags, rolling windows, differences, targets.

Frames are counted in rows, as in the source data, never in hours. All operators expect
one row per station and timestamp. No series goes to one task as a whole: row windows run in
segments that carry the rows their windows reach (``ordered.segmented``), fills carry
their state over calendar spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, constants as K
from .ordered import UP_TO, BEFORE, null_safe, quantiles, segmented
from .profile import long_form

# Rows of a segment; windows may reach as far.
SEGMENT_ROWS = 8192


@dataclass(frozen=True)
class FeatureSpec:
    """Which engineered columns to build. Two instances cover training and live scoring."""

    pollutants: tuple[str, ...]
    lags: tuple[int, ...]
    rolling: tuple[int, ...]
    extremes: tuple[int, ...] = ()
    weather: tuple[str, ...] = ()
    weather_lags: tuple[int, ...] = ()
    weather_rolling: tuple[int, ...] = ()
    weather_std: bool = False
    target: str = "aqi"
    diffs: tuple[int, ...] = ()
    horizons: int = 0
    interactions: tuple[tuple[str, str, str], ...] = ()
    calendar_parts: tuple[str, ...] = ()
    cycles: tuple[tuple[str, float, str], ...] = field(default=())
    zone: str = "UTC"

    @property
    def reach_back(self) -> int:
        return max([0, *self.lags, *self.rolling, *self.extremes, *self.weather_lags,
                    *self.weather_rolling, *self.diffs])


# --- fixed values: feature windows of the training and the live feature table ----------
OFFLINE = FeatureSpec(
    pollutants=("pm25", "no", "no2", "nox", "nh3", "co", "so2", "o3", "benzene", "toluene", "xylene", "aqi"),
    lags=(1, 2, 3, 6, 12, 24, 48, 72, 168),
    rolling=(6, 24, 48),
    weather=("temperature_2m", "wind_speed_10m", "relative_humidity_2m"),
    weather_lags=(1, 6, 24),
    weather_rolling=(24,),
    diffs=(1, 24),
    horizons=24,
    interactions=(("pm25_x_no2", "pm25", "no2"),),
    calendar_parts=("hour_of_day", "day_of_week", "month", "is_weekend"),
    cycles=(("hour_of_day", 24, "hour"), ("day_of_week", 7, "day_of_week"), ("month", 12, "month"),
            ("wind_direction_10m", 360, "wind_dir")),
)
LIVE = FeatureSpec(
    pollutants=("pm25", "no", "no2", "nox", "nh3", "co", "so2", "o3", "benzene", "toluene", "xylene", "aqi"),
    lags=(1, 3, 6, 12, 24, 48, 168),
    rolling=(3, 6, 24, 48, 168),
    extremes=(24, 168),
    weather=("temperature_2m", "wind_speed_10m", "relative_humidity_2m", "precipitation"),
    weather_lags=(1, 3, 6, 24, 48),
    weather_rolling=(6, 24, 48),
    weather_std=True,
    diffs=(1, 3, 24),
    interactions=(("pm25_x_no2", "pm25", "no2"), ("pm25_x_wind", "pm25", "wind_speed_10m"),
                  ("no2_x_temp", "no2", "temperature_2m")),
    calendar_parts=("hour_of_day", "day_of_week", "month", "year", "is_weekend", "season", "day_of_year"),
    cycles=(("hour_of_day", 24, "hour"), ("month", 12, "month"), ("day_of_year", 365, "day_of_year"),
            ("wind_direction_10m", 360, "wind_dir")),
)


def _windowed(df, key, ts, before, after, make) -> DataFrame:
    """The rows with the columns ``make(window)``, for windows of ``before`` and ``after`` rows.

    ``make`` returns SQL column texts; ``window`` is the partition and order clause, so all
    columns share one sort.
    """
    parts = segmented(df, [key], [ts], ts, before, after, SEGMENT_ROWS)
    out = parts.selectExpr("*", *make(f"PARTITION BY {key}, _segment ORDER BY _row"))
    return out.where("_own").drop("_row", "_segment", "_own")


def lag_columns(w: str, columns, lags) -> list[str]:
    return [f"lag({c}, {k}) OVER ({w}) AS {c}_lag{k}" for c in columns for k in lags]


def rolling_columns(w: str, columns, sizes, std: bool = True, extremes=()) -> list[str]:
    """Statistics of the ``size`` rows before the current one."""
    out = []
    for c in columns:
        for size in sizes:
            over = f"({c}) OVER ({w} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) AS {c}_roll{size}"
            out.append(f"avg{over}_mean")
            if std:
                out.append(f"stddev_samp{over}_std")
            if size in extremes:
                out += [f"max{over}_max", f"min{over}_min"]
    return out


def diff_columns(w: str, column, steps) -> list[str]:
    return [f"{column} - lag({column}, {k}) OVER ({w}) AS {column}_diff{k}" for k in steps]


def lead_columns(w: str, column, horizons) -> list[str]:
    return [f"lead({column}, {h}) OVER ({w}) AS {column}_t{h}" for h in horizons]


def add_lags(df, columns, lags, key="station_id", ts="timestamp"):
    return _windowed(df, key, ts, max(lags), 0, lambda w: lag_columns(w, columns, lags))


def add_rolling(df, columns, sizes, key="station_id", ts="timestamp", std=True, extremes=()):
    return _windowed(df, key, ts, max(sizes), 0,
                     lambda w: rolling_columns(w, columns, sizes, std, extremes))


def add_diffs(df, column, steps, key="station_id", ts="timestamp"):
    return _windowed(df, key, ts, max(steps), 0, lambda w: diff_columns(w, column, steps))


def add_targets(df, column, horizons, key="station_id", ts="timestamp", complete_only=True):
    """The value at each of the next ``horizons`` rows; rows without all of them drop."""
    names = [f"{column}_t{h}" for h in horizons]
    out = _windowed(df, key, ts, 0, max(horizons), lambda w: lead_columns(w, column, horizons))
    return out.na.drop(subset=names) if complete_only else out


def fill_forward(df, columns, key="station_id", ts="timestamp") -> DataFrame:
    """Last known value at or before each row."""
    spanned = df.withColumn("_span", F.date_trunc("month", F.col(ts)))
    # Last known value of each span, carried over the (few) spans of a series.
    carried = Window.partitionBy(key).orderBy("_span").rowsBetween(*BEFORE)
    known = (
        spanned.groupBy(key, "_span")
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns])
        .select(key, "_span", *[F.last(c, ignorenulls=True).over(carried).alias(f"_{c}_in") for c in columns])
    )
    inside = Window.partitionBy(key, "_span").orderBy(ts).rowsBetween(*UP_TO)
    joined = spanned.alias("l").join(known.alias("r"), null_safe("l", "r", [key, "_span"])).select(
        "l.*", *[f"r._{c}_in" for c in columns]
    )
    return joined.select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_{c}_in")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def fill_offline(df, columns, key="station_id", ts="timestamp") -> DataFrame:
    """Forward fill, then the station median of the filled series, then 0.

    The medians of all columns come from one count of (station, column, value) and are joined
    once, a row a station, so the plan does not grow with the number of columns.
    """
    filled = fill_forward(df, columns, key, ts)
    medians = quantiles(long_form(filled, columns, [key]), [key, "feature"], "value", {"median": 0.5})
    wide = medians.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_{c}_median") for c in columns])
    joined = filled.alias("l").join(wide.alias("r"), null_safe("l", "r", [key]), "left")
    return joined.select(*[
        F.coalesce(F.col(f"l.{c}"), F.col(f"r._{c}_median"), F.lit(0.0)).alias(c) if c in columns else F.col(f"l.{c}") for c in df.columns])


def fill_live(df, columns, key="station_id", ts="timestamp") -> DataFrame:
    """Forward, then backward fill, then 0. For the bounded recent history of each station."""
    w = Window.partitionBy(key).orderBy(ts)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(*UP_TO)),
                      F.first(c, ignorenulls=True).over(ahead), F.lit(0.0))
        for c in columns
    })


def add_missing_flags(df, columns) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})


def add_calendar(df, spec: FeatureSpec, ts="timestamp") -> DataFrame:
    """Calendar parts in the zone of ``spec`` and their cyclical encodings."""
    at = F.col(ts) if spec.zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(spec.zone), F.col(ts))
    every = calendar.parts(at)
    with_parts = df.withColumns({name: every[name] for name in spec.calendar_parts})
    cycles = {}
    for source, period, prefix in spec.cycles:
        if source in with_parts.columns:
            cycles[f"{prefix}_sin"], cycles[f"{prefix}_cos"] = calendar.cyclical(source, period)
    return with_parts.withColumns(cycles)


def add_interactions(df, spec: FeatureSpec) -> DataFrame:
    made = {name: F.col(a) * F.col(b) for name, a, b in spec.interactions
            if a in df.columns and b in df.columns}
    return df.withColumns(made) if made else df


def engineer(
    df: DataFrame, spec: FeatureSpec, key="station_id", ts="timestamp", last_only=False
) -> DataFrame:
    """All window features of ``spec`` over one sort of an already filled table.

    Engineered values that cannot be computed are 0; rows without every target drop. ``last_only`` keeps
    the newest row per series, found in the same window pass.
    """
    pollutants = [c for c in spec.pollutants if c in df.columns]
    weather = [c for c in spec.weather if c in df.columns]
    target = spec.target if spec.target in df.columns else None

    def make(w: str) -> list[str]:
        extremes = [s for s in spec.extremes if s in spec.rolling]
        made = lag_columns(w, pollutants, spec.lags)
        made += rolling_columns(w, pollutants, spec.rolling, True, extremes)
        made += lag_columns(w, weather, spec.weather_lags)
        made += rolling_columns(w, weather, spec.weather_rolling, spec.weather_std)
        if target:
            made += diff_columns(w, target, spec.diffs)
            made += lead_columns(w, target, range(1, spec.horizons + 1))
        if last_only:
            made.append(f"lead({ts}, 1) OVER ({w}) IS NULL AS _last")
        return made

    out = _windowed(df, key, ts, spec.reach_back, max(spec.horizons, int(last_only)), make)
    if last_only:
        out = out.where("_last").drop("_last")
    targets = [f"{spec.target}_t{h}" for h in range(1, spec.horizons + 1)] if target else []
    out = add_interactions(add_calendar(out, spec, ts), spec)
    # The finished vector is filled: an unknown wind direction has no sine either.
    created = [c for c in out.columns if c not in df.columns and c not in targets]
    out = out.na.fill(0.0, subset=created) if created else out
    return out.na.drop(subset=targets) if targets else out


def enough_history(df, key="station_id", rows=K.MIN_HISTORY_ROWS) -> DataFrame:
    """Rows of stations that have at least ``rows`` of them."""
    known = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= rows).select(key)
    return df.join(known, key, "left_semi")


def densify(df, key="station_id", ts="timestamp", step="1 hour") -> DataFrame:
    """Add the missing grid rows between the first and last timestamp of each station."""
    span = df.groupBy(key).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    # One array per month, so that no row holds the grid of a whole series.
    months = span.select(key, "_from", "_to", F.explode(F.sequence(
        F.date_trunc("month", "_from"), F.col("_to").cast("timestamp"), F.expr("interval 1 month"))).alias("_month"))
    start = F.greatest(F.col("_from").cast("timestamp"), F.col("_month"))
    end = F.least(F.col("_to").cast("timestamp"), F.col("_month") + F.expr("interval 1 month") - F.expr(f"interval {step}"))
    grid = months.where(start <= end).select(
        key, F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias(ts))
    return grid.withColumn(ts, F.col(ts).cast("timestamp_ntz")).join(df, [key, ts], "left")


def sequence_windows(df, columns, length=24, key="station_id", ts="timestamp") -> DataFrame:
    """Fixed-length sequences: one array per column of the last ``length`` rows."""
    def make(w):
        return [f"collect_list({c}) OVER ({w} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS {c}_seq"
                for c in columns]

    out = _windowed(df, key, ts, length - 1, 0, make)
    return out.where(F.size(f"{columns[0]}_seq") == length)
