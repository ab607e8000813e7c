"""Multi-horizon forecasting with boosted trees, scoring records and error metrics."""

from __future__ import annotations

import math
import random
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.air import advisory, forecast_array, primary_pollutant
from ..functions.numeric import half_even_int, safe_double
from ..sources.payloads import prediction_from_json, prediction_to_json
from . import boosting
from .incremental import upsert_table
from .ordered import latest_by, quantiles
from .profile import long_form


def training_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each column over the training split (0 without any value): the
    fitted state of the imputation, one number per column."""
    long = long_form(df.where("split = 'train'"), columns)
    found = quantiles(long, ["feature"], "value", {"median": 0.5}).collect()
    return {**dict.fromkeys(columns, 0.0), **{r["feature"]: r["median"] for r in found}}


def impute_medians(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Fill nulls of every split with the training medians."""
    return df.na.fill(training_medians(df, columns) if medians is None else medians)


def train_horizons(
    train: DataFrame, features: list[str], horizons=range(1, K.N_AHEAD + 1), target: str = "aqi", **params
) -> dict[int, boosting.Model]:
    """One boosted-tree model per horizon, all grown in the same passes; ``params`` are those of ``boosting.Spec``."""
    specs = [boosting.Spec(f"{target}_t{h}", **params) for h in horizons]
    return dict(zip(horizons, boosting.fit(train, features, specs)))


def sample_points(label: str, ranges: dict[str, tuple], points: int, seed: int) -> list[boosting.Spec]:
    """Seeded points over ``ranges``: (least, most) of whole numbers, or of the rate, whose logarithm is uniform."""
    rng, base = random.Random(seed), boosting.Spec(label, seed=seed)

    def draw(least, most):
        return rng.randint(least, most) if isinstance(least, int) else math.exp(rng.uniform(math.log(least), math.log(most)))

    return [replace(base, **{name: draw(*ends) for name, ends in ranges.items()}) for _ in range(points)]


def search_parameters(df: DataFrame, features: list[str], label: str, ranges: dict[str, tuple] = K.SEARCH_RANGES, points: int = 10, seed: int = 42):
    """Fits ``points`` side by side on the ``train`` rows and scores R2 on the later ``val`` rows, as hours that overlap in
    their windows must not be on both sides. Returns (best model, trial table).

    Each point is fitted once and scored after every tree: the table gives the R2 at its own number of trees, by which
    the best is chosen, and where it was highest on the way.
    """
    specs = sample_points(label, ranges, points, seed)
    models = boosting.fit(df.where("split = 'train'"), features, specs)
    stages = boosting.staged_errors(df.where("split = 'val'"), models).select("model", "trees", (1 - F.col("sse") / F.col("sst")).alias("r2"))
    found = {r["model"]: r for r in stages.groupBy("model").agg(
        F.max_by("r2", "trees").alias("r2"), F.max_by("trees", F.struct("r2", -F.col("trees"))).alias("best_trees"), F.max("r2").alias("best_r2")).collect()}
    names = sorted(ranges)
    rows = [(i, *(getattr(s, n) for n in names), *(found[i][1:] if i in found else (None, None, None))) for i, s in enumerate(specs)]
    schema = "trial int, " + ", ".join(f"{n} {'int' if isinstance(ranges[n][0], int) else 'double'}" for n in names) + ", r2 double, best_trees int, best_r2 double"
    scored = [i for i in found if found[i]["r2"] is not None and not math.isnan(found[i]["r2"])]
    best = max(scored, key=lambda i: (found[i]["r2"], -i), default=0)
    return models[best], df.sparkSession.createDataFrame(rows, schema)


def score(df: DataFrame, models: dict[int, boosting.Model]) -> DataFrame:
    """Add ``pred_t<h>`` for every model."""
    return boosting.score(df, {f"pred_t{h}": m for h, m in models.items()})


def persistence(df: DataFrame, horizons, current: str = "aqi") -> DataFrame:
    """The naive forecast: the current value for every horizon."""
    return df.withColumns({f"pred_t{h}": F.col(current) for h in horizons})


def daily_naive(df: DataFrame, horizons, lags: str = "aqi_lag{}") -> DataFrame:
    """The value of the same hour one day before the forecast hour, from columns of lagged values."""
    return df.withColumns({f"pred_t{h}": F.col(lags.format(24 - h)) if h < 24 else F.col("aqi") for h in horizons})


def prediction_records(scored: DataFrame, horizons, trends: DataFrame, keep: list[str]) -> DataFrame:
    """Prediction records of scored rows: forecast, pollutants, trend, advice.

    ``horizons`` are the hours 1, 2, .. without a gap: the forecast's n-th place is hour n (after the
    last one its value is repeated). ``trends`` has one ``weekly_trend`` array per station. All six
    headline pollutants are named; absent or missing ones are 0.
    """
    if list(horizons) != list(range(1, len(horizons) + 1)):
        raise ValueError(f"forecast hours must be 1, 2, ... without a gap, not {list(horizons)}")
    full = scored.withColumns({p: F.lit(0.0) for p, _ in K.HEADLINE_POLLUTANTS if p not in scored.columns})
    joined = full.withColumn("forecast", forecast_array([f"pred_t{h}" for h in horizons])).join(trends, "station_id", "left")
    current = half_even_int(F.coalesce(safe_double("aqi"), F.get("forecast", F.lit(0)).cast("double")))
    pollutants = ", ".join(f"'{label.replace('.', '_')}', coalesce(nullif({p}, double('NaN')), 0.0D)" for p, label in K.HEADLINE_POLLUTANTS)
    return joined.select(
        *keep, current.alias("current_aqi"), primary_pollutant([p for p, _ in K.HEADLINE_POLLUTANTS]).alias("primary_pollutant"), "forecast",
        F.expr(f"map({pollutants})").alias("pollutants"),
        F.coalesce("weekly_trend", F.slice("forecast", 1, 7)).alias("weekly_trend"),
    ).withColumn("advisory", advisory("current_aqi"))


def store_predictions(path: str, records: DataFrame, keys=("city", "computed_at")) -> None:
    """Insert-or-replace prediction records, as stored JSON, by city and time of computation."""
    upsert_table(path, prediction_to_json(records), list(keys), [keys[-1]], keys[-1])


def latest_predictions(stored: DataFrame, key: str = "city", at: str = "computed_at") -> DataFrame:
    """The newest stored record of each city, read back from JSON."""
    return prediction_from_json(latest_by(stored, [key], [at]))


def forecast_summary(records: DataFrame, keep: list[str]) -> DataFrame:
    """Peak and half-even mean of each forecast."""
    total = F.aggregate("forecast", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return records.select(
        *keep, F.array_max("forecast").alias("peak"), half_even_int(total / F.size("forecast")).alias("mean_aqi"))


def error_sums(df: DataFrame, horizons, target: str = "aqi", by: str = "split") -> DataFrame:
    """Per split and horizon: rows, absolute and squared error sums, total sum of squares.

    One aggregate row per split holds all horizons; rows are never multiplied by horizon.
    """
    structs = []
    for h in horizons:
        y, p = F.col(f"{target}_t{h}"), F.col(f"pred_t{h}")
        e = y - p
        seen = F.when(e.isNotNull(), y)
        structs.append(F.struct(
            F.lit(h).alias("horizon"), F.count(e).alias("n"), F.sum(F.abs(e)).alias("abs_sum"),
            F.sum(e * e).alias("sse"), (F.var_pop(seen) * F.count(e)).alias("sst")).alias(f"h{h}"))
    wide = df.groupBy(by).agg(*structs)
    return wide.select(by, F.inline(F.array(*[F.col(f"h{h}") for h in horizons])))


def horizon_metrics(sums: DataFrame) -> DataFrame:
    n, sse, sst = F.col("n"), F.col("sse"), F.col("sst")
    return sums.where(n > 0).select(
        "split", "horizon", "n", (F.col("abs_sum") / n).alias("mae"), F.sqrt(sse / n).alias("rmse"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"))


def pooled_metrics(sums: DataFrame) -> DataFrame:
    """Errors pooled over all rows and horizons."""
    total = sums.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("n", "abs_sum", "sse", "sst")])
    n, sse, sst = F.col("n"), F.col("sse"), F.col("sst")
    return total.where(n > 0).select(
        "split", (F.col("abs_sum") / n).alias("mae"), F.sqrt(sse / n).alias("rmse"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"))


_AVERAGED = ("avg(mae) AS mae", "sqrt(avg(rmse * rmse)) AS rmse", "avg(r2) AS r2")


def averaged_metrics(sums: DataFrame) -> DataFrame:
    """Uniform average over horizons; the error root is taken of the mean square."""
    return horizon_metrics(sums).groupBy("split").agg(*[F.expr(e) for e in _AVERAGED])


def score_table(sums: DataFrame, model: str, reported=K.REPORTED_HORIZONS) -> DataFrame:
    """Averaged metrics and the reported horizons of one model, one row per split."""
    at = [F.expr(f"max({m}) FILTER (WHERE horizon = {h}) AS {m}_t{h}") for h in reported for m in ("mae", "rmse", "r2")]
    return horizon_metrics(sums).groupBy("split").agg(*[F.expr(e) for e in _AVERAGED], *at).withColumn("model", F.lit(model))


def best_model(scores: DataFrame, metric: str = "mae", split: str = "val", smaller: bool = True) -> DataFrame:
    """The candidate with the best primary metric."""
    pick = F.min_by if smaller else F.max_by
    kept = scores.where(F.col("split") == split)
    return kept.agg(pick("model", F.struct(metric, "model")).alias("model"),
                    (F.min(metric) if smaller else F.max(metric)).alias(metric))
