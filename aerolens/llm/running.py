"""Running sums over a global order: no single task, no driver pass over rows.

Rows are range-partitioned and sorted, each partition sums its own rows, and one small record a
partition (its last group and that group's sum) gives what the partitions after it must add.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolens.session import importable, written

PART, POS = "__part", "__pos"


def running(df: DataFrame, order: list[str], values: list[str], group: str | None = None, label: str = "running") -> DataFrame:
    """``df`` plus ``<value>_before``: the sum of ``value`` over the rows before this one in its group.

    ``order`` should end in a column that tells rows of equal keys apart, so that a key held by many rows
    is split between partitions. ``group``: a string column without nulls; without it all rows are
    one group. Values are longs without nulls. Also adds ``__part`` and ``__pos``, the row's range
    partition and place there. The result is read from a written table.
    """
    spark = df.sparkSession
    importable(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([group] if group else []), *order]
    added = [T.StructField(PART, T.IntegerType()), T.StructField(POS, T.LongType()), *(T.StructField(f"{v}_before", T.LongType()) for v in values)]
    schema = T.StructType([*df.schema.fields, *added])

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, last, carry = TaskContext.get().partitionId(), 0, None, dict.fromkeys(values, 0)
        for rows in frames:
            if not len(rows):
                continue
            names = rows[group].to_numpy() if group else np.zeros(len(rows), np.int8)
            starts = np.r_[True, names[1:] != names[:-1]]
            if seen and names[0] == last:
                starts[0] = False
            which = np.cumsum(starts)  # 0: the group that the batch before ended in
            first = np.flatnonzero(starts)
            for v in values:
                x = rows[v].to_numpy(np.int64)
                before = np.cumsum(x) - x
                base = np.r_[-carry[v], before[first]]
                rows[f"{v}_before"] = before - base[which]
                carry[v] = int(rows[f"{v}_before"].iloc[-1] + x[-1])
            rows[PART], rows[POS] = np.int32(part), np.arange(seen, seen + len(rows))
            seen, last = seen + len(rows), names[-1]
            yield rows[[f.name for f in schema.fields]]

    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    table = written(ordered.mapInPandas(local, schema), label)
    name = F.col(group) if group else F.lit("")
    ends = sorted(table.groupBy(PART).agg(
        F.min_by(name, POS).alias("first"), F.max_by(name, POS).alias("last"),
        *[F.max_by(F.col(f"{v}_before") + F.col(v), POS).alias(v) for v in values]).collect())  # a row a partition
    offsets, open_group, sums = [], None, [0] * len(values)
    for end in ends:
        goes_on = end["first"] == open_group
        if goes_on:
            offsets.append((end[PART], end["first"], *sums))
        whole = goes_on and end["last"] == open_group
        sums = [(s if whole else 0) + end[v] for s, v in zip(sums, values)]
        open_group = end["last"]
    add = spark.createDataFrame(offsets, "__end_part int, __end_group string" + "".join(f", __carried{i} long" for i in range(len(values))))
    joined = table.join(F.broadcast(add), (F.col(PART) == F.col("__end_part")) & (name == F.col("__end_group")), "left")
    return joined.select(*df.columns, PART, POS, *[
        (F.col(f"{v}_before") + F.coalesce(f"__carried{i}", F.lit(0))).alias(f"{v}_before") for i, v in enumerate(values)])
