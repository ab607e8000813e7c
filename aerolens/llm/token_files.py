"""Token-id files: ORC with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolens.llm.texts import remembered

#: Entries that a Python worker remembers: whole chunks between white space, and words without their punctuation.
CHUNKS, WORDS = 400_000, 1_000_000
#: ASCII punctuation that never joins the letters before it (the apostrophe can).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words of letters that stay single letters when lower-cased, so that many can be encoded in one call.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: White space to str.split() but not to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the library, each chunk encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in order. Letters followed by ASCII punctuation are two words to it as well. Texts that hold
    the start of a special token's name go to the library whole. Memory is bounded: full tables start anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of many words by one call on all of them; a word ends where a token with the suffix does."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):
            return self.library(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks not seen before."""
        if len(self.chunks) + len(chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.words) > WORDS:
            self.words.clear()
        parts = {}
        for chunk in chunks:
            body = chunk.rstrip(TAIL)
            if not body.isalpha():
                parts[chunk] = (chunk,)
            else:
                word = body.lower() if body.isascii() else body
                parts[chunk] = (word, chunk[len(body):]) if len(body) < len(chunk) else (word,)
        new = {p for ps in parts.values() for p in ps if p not in self.words}
        plain = [p for p in new if PLAIN.fullmatch(p)]
        for some, encode in ((plain, self.encode_words), (list(new.difference(plain)), self.library)):
            for at in range(0, len(some), 2000):
                self.words.update(zip(some[at:at + 2000], encode(some[at:at + 2000])))
        words = self.words
        for chunk, ps in parts.items():
            self.chunks[chunk] = words[ps[0]] if len(ps) == 1 else words[ps[0]] + words[ps[1]]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or ODD_SPACE.search(text):
            return self.library([text])[0]
        ids = []
        chunks = text.split()
        for at in range(0, len(chunks), 50_000):
            some = chunks[at:at + 50_000]
            if missing := set(some).difference(self.chunks):
                self.learn(missing | set(some) if len(self.chunks) + len(missing) > CHUNKS else missing)
            ids.append(b"".join(map(self.chunks.__getitem__, some)))
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives the task, until one of ``map_texts`` runs there."""
    if path not in remembered:
        remembered[path] = Encoder(path)
    return remembered[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write (doc_id, text) as ORC token files in ascending doc_id order.

    Columns: doc_id, n_tokens, ids (array<int>, each document ends in ``end_id``), part (range of doc_ids, files of one
    part are in order) and local_start (ids of its part before it). Integer run-length encoding and the row
    index are ORC's own; doc_id carries Bloom filters, so a lookup by id reads few stripes. Nulls encode as
    empty texts; rows of one doc_id are ordered by the text's hash and may be split between parts.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "__hash", "__from"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__from"), "text")

    def run(batches):
        encode, part, start = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [encode(t) + end for t in some.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.r_[0, np.cumsum(sizes)]
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                     pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + offsets[:-1])],
                    ["doc_id", "n_tokens", "ids", "part", "local_start"])
                start += int(offsets[-1])

    encoded = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, part int, local_start long")
    (encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", "10000").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written files; filters on doc_id are pushed to the row indexes and Bloom filters."""
    return spark.read.orc(path)


def positions(tokens: DataFrame) -> DataFrame:
    """Token files' rows plus ``start``, the ids of all documents before each one in the whole corpus.

    Only the sums of the parts, as many as were written, come to the driver.
    """
    sums, offsets, total = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for row in sorted(sums):
        offsets.append((row["part"], total))
        total += row["n"]
    add = tokens.sparkSession.createDataFrame(offsets, "part int, __before long")
    return tokens.join(F.broadcast(add), "part").withColumn("start", F.col("__before") + F.col("local_start")).drop("__before")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows read back from token files."""
    placed = positions(tokens).select("doc_id", "start", "ids")

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ids, ends = lists.flatten().to_numpy().astype("<u4"), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
