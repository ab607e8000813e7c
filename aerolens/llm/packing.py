"""Packing by concatenate and cut: all ids form one row, cut at fixed places; records tell where documents lie.

Pass one encodes each partition as the scan deals it and writes its ids with their place in the partition. The
partitions' totals, one number each, give every partition's place in the whole. Pass two cuts at multiples of the
sequence length. No text and no whole sequence is shuffled: only a sequence that two reading tasks share is put together
from its parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from aerolens.llm.texts import importable
from aerolens.llm.token_files import encoder
from aerolens.session import written

#: Ids of a sequence.
SIZE = 4096


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, local_start, doc_id, n_tokens, ids) of (doc_id, text): a written table, each part in the order of its rows.

    ids are little-endian unsigned 32-bit integers, the text's and then ``end_id``; a null text is empty. Other columns of
    ``docs`` are not read. Rows are packed in the order in which the partitions of ``docs`` hold them.
    """
    importable(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("doc_id", kind),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        of, part, start, end = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [of(t) + end for t in some.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                upto = start + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(upto - sizes), some.column(0), pa.array(sizes), pa.array(ids, pa.binary())],
                    schema.names)
                start = int(upto[-1])

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "packing-ids")


def placed(encoded: DataFrame) -> DataFrame:
    """``encoded`` plus ``before``: the ids of all parts ahead of its own. Only a number a part comes to the driver."""
    sums, offsets, total = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for row in sorted(sums):
        offsets.append((row["part"], total))
        total += row["n"]
    add = encoded.sparkSession.createDataFrame(offsets, "__part int, before long")
    return encoded.join(F.broadcast(add), F.col("part") == F.col("__part")).drop("__part")


def fragments(encoded: DataFrame, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """(sequence_id, offset, n, ids, records): stretches of sequences, most of them whole ones.

    A task walks its rows and cuts where a sequence is full. Where its rows do not go on (another file, another
    part), the stretch so far is a row of its own, to be joined with the rest by ``sequences``. ``records`` are the pieces of
    documents in it: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, offset. ``ids`` is null without ``keep_ids``.
    """
    importable(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType
    record = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "offset"))])
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "n")), T.StructField("ids", T.BinaryType()),
                           T.StructField("records", T.ArrayType(record))])
    arrow = to_arrow_type(kind)

    def frame(done):
        flat = [r for *_, records in done for r in records]
        columns = list(zip(*flat))
        struct = pa.StructArray.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], record.names)
        ends = np.cumsum([0, *(len(d[4]) for d in done)])
        return pa.RecordBatch.from_arrays(
            [*(pa.array([d[i] for d in done], pa.int64()) for i in range(3)), pa.array([d[3] for d in done], pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], schema.names)

    def run(batches):
        window, first, reached, parts, records, done = -1, 0, -1, [], [], []

        def close():
            if records:
                done.append((window, first, reached - window * size - first, b"".join(parts) if keep_ids else None, records))

        for batch in batches:
            doc_ids, starts, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for doc_id, at, ids in zip(doc_ids, starts, blobs):
                if at != reached:
                    close()
                    window, records = -1, []
                n = len(ids) // 4
                here = 0
                while here < n:
                    now, offset = divmod(at + here, size)
                    if now != window:
                        close()
                        window, first, parts, records = now, offset, [], []
                    length = min(size - offset, n - here)
                    piece = ids[4 * here:4 * (here + length)]
                    if keep_ids:
                        parts.append(piece)
                    records.append((doc_id, here, length, zlib.crc32(piece), n, offset))
                    here += length
                    reached = at + here
                if len(done) >= 256:
                    yield frame(done)
                    done = []
        close()
        if done:
            yield frame(done)

    rows = placed(encoded).select("doc_id", (F.col("before") + F.col("local_start")).alias("at"), "ids")
    return rows.mapInArrow(run, schema)


def pieces(found: DataFrame) -> DataFrame:
    """A row for each piece of a document in ``fragments``."""
    return found.select("sequence_id", F.inline("records")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(found: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids, records): whole sequences; ``n`` counts the ids before padding.

    Only the last sequence can be short. It is padded with ``pad_id`` to ``size``, unless its length is a power of two.
    Only stretches short of a sequence, at most two for each run of rows a task reads, are grouped, at most ``size`` ids a group.
    """
    parts = found.where(F.col("n") < size).groupBy("sequence_id").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids", "records"))).alias("p"))
    joined = parts.select("sequence_id", "n", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                          F.flatten(F.col("p.records")).alias("records"))
    pad = pad_id.to_bytes(4, "little").hex()
    whole = F.expr(f"IF((n & (n - 1)) = 0, ids, rpad(ids, {4 * size}, X'{pad}'))")
    return found.where(F.col("n") == size).select("sequence_id", "n", "ids", "records").union(
        joined.select("sequence_id", "n", whole.alias("ids"), "records"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """Training sequences of (doc_id, text), with the records of the documents in them (see ``sequences``).

    Every id lies in exactly one piece. Null texts are empty, so each row gives at least its end id; null ids, repeated rows
    and texts of any length are packed as they come; an empty table gives no sequence.
    """
    return sequences(fragments(encode(docs, tokenizer, end_id), size), size, pad_id)
