"""Chat formatting: cumulative snapshots of a conversation collapse into the longest, then turns are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolens.llm.running import PART, POS, running
from aerolens.session import written

LANES = 3


def key(conv_id: Column) -> Column:
    """A conversation's id as a string without nulls; null ids are one conversation."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("~"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text) plus ``conv`` (its key) and ``position`` (place of the turn, from 0).

    By turn number, null first, then role and a hash of the text. Repeated rows are turns of their own. A
    conversation may hold any share of the rows: it is split between partitions and the positions go on.
    """
    rows = turns.select("conv_id", "turn", "role", "text", key(F.col("conv_id")).alias("conv"), F.lit(1).cast("long").alias("__one"),
                        F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__from"))
    return running(rows, ["turn", "role", "__hash", "__from"], ["__one"], "conv", "chat-turns").select(
        "conv_id", "conv", "role", "text", F.col("__one_before").alias("position"))


def prefix_hashes(ordered: DataFrame) -> DataFrame:
    """(conv_id, conv, n, h0, h1, h2): a rolling hash of the first ``n`` turns, for every n of each conversation.

    A turn's hash holds its position, role and text; a prefix's hash is their running sum in three
    lanes of 32 bits. Sums can be carried from partition to partition, so a conversation need not be in one task.
    """
    turn = F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    other = F.xxhash64(F.lit(1), "text", F.lit(2), "role")
    lanes = [F.xxhash64(F.lit(i), "position", "__t", "__o").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"__h{i}") for i in range(LANES)]
    narrow = ordered.select("conv_id", "conv", "position", turn.alias("__t"), other.alias("__o")).select("conv_id", "conv", "position", *lanes)
    sums = running(narrow, ["position"], [f"__h{i}" for i in range(LANES)], "conv", "chat-prefixes").drop(PART, POS)
    return sums.select("conv_id", "conv", (F.col("position") + 1).alias("n"),
                       *[(F.col(f"__h{i}_before") + F.col(f"__h{i}")).alias(f"h{i}") for i in range(LANES)])


def covered(ordered: DataFrame) -> DataFrame:
    """(conv_id, conv, n): conversations whose turns are the first turns of a longer one, or equal one of smaller id.

    All prefixes of one hash come down to one row before the join, so a first turn shared by any number of
    conversations makes one row a conversation, not pairs.
    """
    prefixes = prefix_hashes(ordered)
    lengths = prefixes.groupBy("conv").agg(F.max("n").alias("length"))
    hashed = written(prefixes.join(lengths, "conv"), "chat-hashes")
    same = ["n", *(f"h{i}" for i in range(LANES))]
    longest = hashed.groupBy(*same).agg(F.max("length").alias("longest"), F.min(F.when(F.col("n") == F.col("length"), F.col("conv_id"))).alias("first"))
    return hashed.where("n = length").join(longest, same).where(
        (F.col("longest") > F.col("length")) | ~F.col("conv_id").eqNullSafe(F.col("first"))).select("conv_id", "conv", "n")


def rendered(role: Column, text: Column) -> Column:
    """One turn in ChatML; a null role is "unknown", a null text empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, rendered) of the turns of maximal conversations.

    A chat's text is its rendered turns in order of position (``whole_chats``).
    """
    ordered = ordered_turns(turns)
    return ordered.join(covered(ordered).select("conv"), "conv", "left_anti").select(
        "conv_id", "position", "role", rendered(F.col("role"), F.col("text")).alias("rendered"))


def whole_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): one row a chat, for conversations that fit a row."""
    turns = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return formatted.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join("t.rendered", "").alias("text"))
