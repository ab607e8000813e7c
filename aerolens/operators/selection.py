"""Feature selection: aggregates over the table decide which columns stay.

Every decision reads one bounded aggregate (a row per column) to the driver; the table
itself is only selected from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .profile import null_report


def null_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {r["feature"]: (r["null_pct"] or 0.0) / 100 for r in null_report(df, columns).collect()}


def sparse_columns(df: DataFrame, columns: list[str], threshold: float = 0.65, target: str = "aqi") -> list[str]:
    """Columns missing more often than ``threshold``; never the target."""
    rates = null_rates(df, columns)
    return [c for c in columns if rates[c] > threshold and c != target]


def modal_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the most frequent value (null counts as one) and number of values per column."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    per_value = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("feature").agg(
        F.count("*").alias("n_values"), (F.max("n") / F.sum("n")).alias("modal_share"))


def near_constant_columns(df: DataFrame, columns: list[str], threshold: float = 0.999) -> list[str]:
    shares = {r["feature"]: r for r in modal_share(df, columns).collect()}
    return [c for c in columns
            if c not in shares or shares[c]["n_values"] <= 1 or shares[c]["modal_share"] >= threshold]


def content_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-free content hash per numeric column (null hashes as -999999)."""
    wide = df.agg(*[
        F.sum(F.xxhash64(F.coalesce(F.col(c).cast("double"), F.lit(-999999.0))).cast("decimal(38,0)"))
        .cast("string").alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("content"))
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def duplicate_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose values equal those of an earlier column."""
    seen, repeated = set(), []
    for row in content_hashes(df, columns).orderBy("position").collect():
        if row["content"] in seen:
            repeated.append(row["feature"])
        seen.add(row["content"])
    return repeated


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, corr) of each pair of columns, by place, over the rows that have both values; NaN counts as missing.

    One pass for all pairs: a task multiplies its masked rows block by block (counts, sums, squares and products of every
    pair at once, around the columns' means) and gives a row a pair, which are then added. ``corr`` is null where a
    column does not vary in those rows.
    """
    importable(df.sparkSession)
    clean = [F.when(~F.isnan(x), x) for x in (F.col(f"`{c}`").cast("double") for c in columns)]
    means = np.array([m or 0.0 for m in df.agg(*[F.avg(c) for c in clean]).first()])
    first, second = np.triu_indices(len(columns), 1)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) - means
                there = ~np.isnan(x)
                x, mask = np.where(there, x, 0.0), there.astype(np.float64)
                sums, squares = x.T @ mask, (x * x).T @ mask
                now = np.stack([(mask.T @ mask)[first, second], sums[first, second], sums[second, first],
                                squares[first, second], squares[second, first], (x.T @ x)[first, second]])
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (first, second)] + [pa.array(v) for v in total], names)

    names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]
    parts = df.select(*[c.alias(f"c{k}") for k, c in enumerate(clean)]).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names[2:]))
    summed = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])
    n = F.col("n")

    def varies(square, mean):  # what rounding leaves of a constant is none
        spread = F.col(square) / n - (F.col(mean) / n) ** 2
        return F.when((n > 0) & (spread > 1e-12 * F.col(square) / n), spread)

    cov = F.col("xy") / n - F.col("x") / n * F.col("y") / n
    return summed.where(n > 0).select("i", "j", n.cast("long").alias("n"), (cov / F.sqrt(varies("xx", "x") * varies("yy", "y"))).alias("corr"))


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.98) -> list[str]:
    """Columns whose absolute correlation with any earlier column exceeds ``threshold``.

    An earlier column counts even if it is dropped itself. A pair is judged by the rows that have both
    values (``pair_correlations``). Only the columns found come to the driver.
    """
    if len(columns) < 2:
        return []
    close = {r["j"] for r in pair_correlations(df, columns).where(F.abs("corr") > threshold).select("j").distinct().collect()}
    return [c for i, c in enumerate(columns) if i in close]


def most_missing(df: DataFrame, columns: list[str], k: int = 5) -> list[str]:
    """The ``k`` columns missing most often; ties keep the given order."""
    rates = null_rates(df, columns)
    return sorted(columns, key=lambda c: -rates[c])[:k]


def select_features(df: DataFrame, candidates: list[str], threshold: float = 0.98, limit: int | None = None) -> list[str]:
    """Candidates without duplicates and near copies; the first ``limit`` of them if one is given."""
    repeated = set(duplicate_columns(df, candidates))
    unique = [c for c in candidates if c not in repeated]
    close = set(correlated_columns(df, unique, threshold))
    return [c for c in unique if c not in close][:limit]
