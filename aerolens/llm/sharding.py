"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.llm.running import running
from aerolens.llm.texts import given

ROUNDS = 6


def round_keys(seed: int) -> list[int]:
    """One key below 2**31 a round, from a multiplicative congruence of the seed."""
    keys, x = [], seed % 2147483646 + 1
    for _ in range(ROUNDS):
        x = x * 48271 % 2147483647
        keys.append(x)
    return keys


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Image of each row number below ``n`` (at most 2**62) under a permutation of 0..n-1.

    A balanced Feistel network on the smallest even number of bits that holds ``n``; images of ``n`` or more
    walk on along their cycle until they fall below it, four steps on average at most.
    """
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in round_keys(seed):
            left, right = right, left ^ ((((right ^ (key & mask)) * 1103515245 + key) >> 9) & mask)
        return (left << half) | right

    out = network(rows.astype(np.int64))
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = network(out[over])
    return out


def shard(docs: DataFrame, n_shards: int, order: list[str], seed: int = 42) -> DataFrame:
    """``docs`` plus ``row`` (place in ``order``, from 0), ``shard`` and ``slot`` (gapless in its shard).

    Law "rows": with p the image of the row number, the shard is p mod ``n_shards`` and the slot p div
    ``n_shards``; counts differ by one at most, and either can be computed from the row number alone.
    Rows that agree in all of ``order`` are interchangeable; where the row came from decides, so a value
    held by any share of the rows is split between partitions. An empty table gives an empty result. Columns of ``docs``
    named ``row``, ``shard`` or ``slot`` come out as ``row_given`` and so on; they may stand in ``order``.
    """
    renamed = given(docs, ("row", "shard", "slot"))
    docs, order = docs.withColumnsRenamed(renamed), [renamed.get(c, c) for c in order]
    rows = docs.withColumns({"__one": F.lit(1).cast("long"), "__from": F.monotonically_increasing_id()})
    table = running(rows, [*order, "__from"], ["__one"], label="shard")
    total = table.agg(F.count("*")).first()[0]

    @F.pandas_udf("long")
    def image(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), total, seed))

    return (table.withColumn("row", F.col("__one_before")).withColumn("__image", image("row"))
            .select(*docs.columns, "row", (F.col("__image") % n_shards).cast("int").alias("shard"),
                    F.expr(f"__image div {n_shards}").alias("slot")))
