"""Exact order statistics, ranks and row windows that never hold a whole key in one task.

One key (a station, a split, a feature) may own a large share of the rows, so nothing
here sorts or collects a key as a unit. Values are first counted (map-side combine);
the distinct values are then dealt into ranges of a few thousand rows, and an ordered
window runs inside one range, on top of the totals of the ranges before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    """Join condition matching null keys to null keys, between two aliases."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def value_counts(df: DataFrame, keys: list[str], value: str, side: str | None = None) -> DataFrame:
    """Rows per distinct non-null value; with ``side`` (0/1) one count per side."""
    kept = df.where(F.col(value).isNotNull())
    if side is None:
        return kept.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return kept.groupBy(*keys, value).agg(
        F.count(F.when(F.col(side) == 0, 1)).alias("n0"),
        F.count(F.when(F.col(side) == 1, 1)).alias("n1"),
    )


#: Rows of a range, on average, inside which rows are ordered.
RANGE = 4096


def in_ranges(df: DataFrame, order: list, rows: int, label: str) -> DataFrame:
    """``df``, written in ranges of ``order`` of a few thousand rows each, as many as ``rows`` needs; ``_unit`` is the number of the range."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))
    return written(df.repartitionByRange(parts, *order).withColumn("_unit", F.spark_partition_id()), label)


def cumulative_counts(
    counts: DataFrame, keys: list[str], value: str, weights: list[str],
) -> DataFrame:
    """Running totals of ``weights`` in value order within each key.

    Adds ``<w>_cum`` (up to and including the value) and ``<w>_total``. The distinct values are dealt into ranges; a
    window runs inside one range of a key, on top of the sums of its ranges before.
    """
    stored = written(counts, "value-counts")
    ranged = in_ranges(stored, [*keys, value], stored.count(), "value-ranges")
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_unit").rowsBetween(*BEFORE)
    sums = ranged.groupBy(*keys, "_unit").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = sums.select(*keys, "_unit", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_{w}_before") for w in weights],
                          *[F.sum(w).over(of_key).alias(f"{w}_total") for w in weights])
    joined = ranged.alias("l").join(offsets.alias("r"), null_safe("l", "r", [*keys, "_unit"])).select(
        "l.*", *[f"r._{w}_before" for w in weights], *[f"r.{w}_total" for w in weights])
    upto = Window.partitionBy(*keys, "_unit").orderBy(value).rowsBetween(*UP_TO)
    return joined.select(*counts.columns, *[(F.sum(w).over(upto) + F.col(f"_{w}_before")).alias(f"{w}_cum") for w in weights],
                         *[f"{w}_total" for w in weights])


# Rank error of the sketch that brackets a quantile, and the bracket's half width (twice that).
SKETCH, SLACK = 10_000, 2e-4


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of a column per key, for keys of any size.

    A mergeable sketch brackets each quantile. A second pass only counts the rows below and above a
    bracket, with map-side combine, and ships the values inside it, some 0.04 % of a key's rows; the
    smallest value above it is kept as well, for an interpolation that reaches over its edge.
    The sketch, a row a key, is written, so that its size is known when the join is planned: it is broadcast up to
    ``autoBroadcastJoinThreshold``, and no row is shuffled or sorted by its key.
    """
    names = list(probabilities)
    edges = [min(1.0, max(0.0, p + d)) for p in probabilities.values() for d in (-SLACK, SLACK)]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = written(rows.groupBy(*keys).agg(F.percentile_approx("_v", edges, SKETCH).alias("_edges")), "quantile-sketch")
    sides = F.array(*[
        F.expr(f"named_struct('spot', {i}, 'side', CASE WHEN _v < _edges[{2 * i}] THEN 0 WHEN _v > _edges[{2 * i + 1}] THEN 2 ELSE 1 END)")
        for i in range(len(names))])
    placed = rows.alias("l").join(sketch.alias("r"), null_safe("l", "r", keys)).select("l.*", F.explode(sides).alias("_s"))
    counted = placed.groupBy(*keys, "_s", F.expr("CASE WHEN _s.side = 1 THEN _v END").alias("_inside")).agg(
        F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    spot = "PARTITION BY " + ", ".join([*keys, "_s.spot"])
    ranked = counted.selectExpr(
        *keys, "_s.spot AS _spot", "n", "CASE _s.side WHEN 0 THEN _high WHEN 1 THEN _inside ELSE _low END AS _v",
        f"sum(n) OVER ({spot} ORDER BY _s.side, _inside ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto", f"sum(n) OVER ({spot}) AS _total")
    picks = []
    for i, (name, p) in enumerate(probabilities.items()):
        rank = f"{p}D * (_total - 1)"
        for end in ("floor", "ceil"):
            picks.append(f"max(CASE WHEN _spot = {i} AND _upto - n <= {end}({rank}) AND {end}({rank}) < _upto THEN _v END) AS _{name}_{end}")
        picks.append(f"max(CASE WHEN _spot = {i} THEN {rank} - floor({rank}) END) AS _{name}_part")
    return ranked.groupBy(*keys).agg(*[F.expr(p) for p in picks]).selectExpr(
        *keys, *[f"_{n}_floor + _{n}_part * (_{n}_ceil - _{n}_floor) AS {n}" for n in names])


def row_index(df: DataFrame, keys: list[str], order: list[str], ts: str, span: str = "month") -> DataFrame:
    """Add ``_row``: the 0-based position of each row within its key, in ``order``.

    ``order`` must start with ``ts`` and be total. Rows are numbered inside one calendar
    ``span`` of a key and shifted by the count of the spans before it.
    """
    spanned = df.withColumn("_span", F.date_trunc(span, F.col(ts)))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(*BEFORE)
    offsets = (
        spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
        .select(*keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(*order)
    numbered = spanned.withColumn("_pos", F.row_number().over(inside) - 1)
    return (
        numbered.alias("l").join(offsets.alias("r"), null_safe("l", "r", [*keys, "_span"]))
        .select(*[f"l.{c}" for c in df.columns], (F.col("_pos") + F.col("_before")).alias("_row"))
    )


def segmented(
    df: DataFrame, keys: list[str], order: list[str], ts: str, before: int, after: int, rows: int = 8192
) -> DataFrame:
    """Split every key into segments of ``rows`` rows, each with its neighbouring rows.

    A segment also receives the ``before`` rows ahead of it and the ``after`` rows behind
    it (``_own`` is false there), so any row window reaching no further than that gives the
    same result inside ``(keys, _segment)`` as over the whole key. Drop rows with
    ``~_own`` after the window.
    """
    if max(before, after) > rows:
        raise ValueError("a segment must be at least as long as the window reach")
    indexed = row_index(df, keys, order, ts).withColumn("_home", F.floor(F.col("_row") / rows))
    offset = F.col("_row") % rows
    homes = F.array_compact(F.array(
        F.col("_home"),
        F.when(offset >= rows - before, F.col("_home") + 1),
        F.when(offset < after, F.col("_home") - 1),
    ))
    return (
        indexed.withColumn("_segment", F.explode(homes))
        .withColumn("_own", F.col("_segment") == F.col("_home"))
        .drop("_home")
    )


def first_n(df: DataFrame, keys: list[str], order: list[str], ts: str, n: int | dict[str, int]) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, for any ``n`` and any key size.

    Whole days before the cut-off day are kept by their running count. The cut-off days are dealt into ranges of
    ``order`` of a few thousand rows each and written; whole ranges are again kept by count, and only the range that holds
    the n-th row is ranked. ``n`` may map the (single) key's values to limits; a key without a limit keeps all its rows.
    ``order`` must be total and start with ``ts``.
    """
    return _bounded(df, keys, order, ts, n, F.asc)


def _bounded(df: DataFrame, keys: list[str], order: list[str], ts: str, n: int | dict[str, int], direction) -> DataFrame:
    if isinstance(n, dict):
        (key,) = keys
        limit = F.lit(None).cast("long")
        for name, rows in n.items():
            limit = F.when(F.col(key) == name, F.lit(rows).cast("long")).otherwise(limit)
    else:
        limit = F.lit(n).cast("long")
    daily = df.withColumns({"_unit": F.date_trunc("day", F.col(ts)), "_left": limit})
    days, before, n_cut = _by_units(daily, keys, direction)
    if not n_cut:
        return before.select(*df.columns)
    along = [direction(c) for c in order]
    ranges, inside, _ = _by_units(in_ranges(days, [*keys, *along], n_cut, "cut-off"), keys, F.asc)
    rank = F.row_number().over(Window.partitionBy(*keys, "_unit").orderBy(*along))
    last = ranges.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    return before.select(*df.columns).unionByName(inside.select(*df.columns)).unionByName(last.select(*df.columns))


def _by_units(df: DataFrame, keys: list[str], direction) -> tuple[DataFrame, DataFrame, int]:
    """Of rows with a ``_unit`` and the number ``_left`` wanted of their key (null: all): the rows of each key's unit in which that
    number is reached, with what is left for it; the rows of the units before it; how many rows the former are."""
    upto = Window.partitionBy(*keys).orderBy(direction("_unit")).rowsBetween(*UP_TO)
    counts = written(
        df.groupBy(*keys, "_unit").agg(F.count("*").alias("_n"), F.max("_left").alias("_wanted")).withColumn("_upto", F.sum("_n").over(upto))
        .where(F.col("_wanted").isNull() | (F.col("_upto") - F.col("_n") < F.col("_wanted"))), "units")
    n_cut = counts.where("_upto > _wanted").agg(F.sum("_n")).first()[0] or 0
    joined = df.drop("_left").alias("l").join(counts.alias("r"), null_safe("l", "r", [*keys, "_unit"])).select("l.*", "r._n", "r._upto", "r._wanted")
    cut = joined.where("_upto > _wanted").withColumn("_left", F.col("_wanted") - (F.col("_upto") - F.col("_n"))).drop("_n", "_upto", "_wanted")
    return cut, joined.where("_wanted IS NULL OR _upto <= _wanted"), n_cut


def _extreme(df: DataFrame, keys: list[str], order: list[str], pick: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.expr(f"{pick}(struct({', '.join(rest)}), struct({', '.join(order)})) AS _best")
    return df.groupBy(*keys).agg(best).selectExpr(*keys, "_best.*").selectExpr(*df.columns)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``, by an aggregate with map-side combine."""
    return _extreme(df, keys, order, "max_by")


def earliest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    return _extreme(df, keys, order, "min_by")


def last_n(df: DataFrame, keys: list[str], order: list[str], ts: str, n: int | dict[str, int]) -> DataFrame:
    """The last ``n`` rows of each key in ``order``, for any ``n`` and any key size."""
    return _bounded(df, keys, order, ts, n, F.desc)
