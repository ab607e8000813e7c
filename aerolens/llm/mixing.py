"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolens.llm.running import PART, POS, running
from aerolens.llm.texts import given, n_words
from aerolens.session import written

#: Weights of the sources in code point order, repeating; share of all words to take; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) plus ``rank`` and ``target`` words of each source.

    Water filling: with the sources ordered by cap over weight, the level that the budget left by the sources
    before one gives to the rest rises while sources are capped and falls after, so its maximum is the level
    at which none is above its cap. The windows run over one row a source, not over documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS) + 1))
    every, before = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left / rest).withColumn("level", F.max("level").over(every))
    return level.select("source", "source_size", "rank", F.least(1.0 * MOST * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def mix(sized: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of (doc_id, source, size, ...) plus source_size, target, copies and taken (words taken, copies counted).

    Each source is shuffled by a hash of the seed and doc_id. Copy e of a document gets as virtual finish time the
    words of its source up to its end (e whole passes before it) over the source's target; all copies are
    ranged by finish time and taken while their running total is within the budget. Documents are taken
    whole, so a source misses its target by a document or so. Running sums are distributed and rows
    of equal keys split, so one source may hold any share of the rows. Documents without words take nothing;
    sources without words have target 0. Sources are null-safe. Other columns of ``sized`` stay; one that bears a name
    used here (source_size, target, copies, taken, rank, size_before) comes out with ``_given`` added.
    """
    sized = sized.withColumnsRenamed(given(sized, ("source_size", "target", "copies", "taken", "rank", "size_before")))
    keyed = sized.withColumns({
        "__source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")), "__from": F.monotonically_increasing_id(),
        "__key": F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)})
    rows = running(keyed, ["__key", "doc_id", "__from"], ["size"], "__source", "mixing-sources")
    rows = rows.withColumnsRenamed({PART: "__p", POS: "__q"})
    sizes = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixing-targets")
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    goals = sizes.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("__source"), "source_size", "rank", "target")
    placed = written(rows.join(goals, "__source"), "mixing-rows")
    entries = (placed.where("size > 0").select("__p", "__q", "size", "rank", "target", F.explode(F.expr(f"sequence(0, {MOST} - 1)")).alias("copy"),
                                               "size_before", "source_size")
               .withColumn("end", F.col("size_before") + F.col("size") + F.col("copy") * F.col("source_size"))
               .select("__p", "__q", "size", "rank", "end", (F.col("end") / F.col("target")).alias("finish")))
    queue = running(entries, ["finish", "rank", "end"], ["size"], label="mixing-queue")
    taken = (queue.where(F.col("size_before") + F.col("size") <= SHARE * total)
             .groupBy("__p", "__q").agg(F.count("*").cast("int").alias("copies"), F.sum("size").alias("taken")))
    return placed.join(taken, ["__p", "__q"], "left").select(
        *sized.columns, "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged.

    Rows are told apart by their place in a copy written once.
    """
    copy = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing-docs")
    taken = mix(copy.select("doc_id", "source", n_words(F.col("text")).alias("size"), "__row"), seed).where("copies > 0")
    again = taken.select("__row", F.explode(F.sequence(F.lit(1), "copies")).alias("__copy"))
    return copy.join(again, "__row").select(*docs.columns)
