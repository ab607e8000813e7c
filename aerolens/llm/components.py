"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.session import drop_written, written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it reaches.

    ``edges``: columns a and b, longs, in any direction, repeats and loops allowed. Each step is two
    aggregations with map-side combine and two joins (hot nodes are split by the skew join); no
    neighbour list is ever collected. Steps end in a written table, so a lost executor costs one
    step; the table of the step before goes then. The number of steps grows with the logarithm of the largest component; links that are stars around their
    smallest node take none.
    """
    far, near = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a != b").select(far, near).distinct(), label)
    while not _stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("n"))
        before, now = now, written(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                                   .union(small.select("u", F.col("m").alias("v"))).distinct(), label)
        drop_written(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or only links to larger ones: all is done then."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()
