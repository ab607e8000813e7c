"""Phrase collocations: padded longest windows are counted once, and ROLLUP sums them to all shorter phrases.

At each word stands one window: the word and its lead columns, up to four words, padded where the piece ends. An
occurrence of a shorter phrase is a prefix of exactly one window, so its count is a sum over windows. A phrase under
the least count can be in no result, nor can a longer one that holds it; so a window is padded from the first word
with which it is too rare. What is too rare is known from a count of hashed window beginnings, a few bytes each, which can
only be too high: a false entry in the filter costs time and changes no count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolens.llm.texts import importable
from aerolens.session import written

#: Longest phrase, least count of a candidate, rows a language.
LONGEST, LEAST, FIRST = 4, 30, 2000
#: Stands for a separator: a byte that no UTF-8 text holds.
CUT = b"\xff"
#: A-Z to a-z, the separators ``[.,;:!?\n-\r]`` to ``CUT``.
TABLE = bytes(b + 32 if 65 <= b <= 90 else CUT[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: A text is read in stretches of about this many bytes that end at a separator.
STRETCH, TOKENS, VOCABULARY, KEYS = 1 << 22, 1 << 19, 1_000_000, 1 << 22
#: A key has 44 bits: the first 12 name its bucket, the first 27 its bit in the filter (16 MB, whatever the corpus).
BUCKET_BITS, FILTER_BITS, KEY_BITS = 12, 27, 44


class Words(dict):
    """Ids of one language's words; a word not seen before gets the next id of all languages."""

    def __init__(self, lang: str, found: list, hashes: list):
        super().__init__({CUT: 0})
        self.lang, self.seed, self.found, self.hashes = lang, lang.encode() + b"\0", found, hashes

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.found)
        self.found.append((self.lang, word))
        self.hashes.append(xxhash.xxh3_64_intdigest(self.seed + word))
        return i


class Vocabulary:
    """Words of all languages by id, their hashes, and the ids of texts."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.found, self.new, self.langs, self.hashes = [("", b"")], [0], {}, np.zeros(0, np.uint64)

    def hash_of(self, ids: np.ndarray) -> np.ndarray:
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array(self.new, np.uint64)])
            self.new.clear()
        return self.hashes[ids]

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Word ids of (lang, text) batches, about ``TOKENS`` at a time; 0 stands between pieces."""
        ids: list[int] = [0]
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in self.langs:
                    self.langs[lang] = Words(lang, self.found, self.new)
                of, flat, at = self.langs[lang].__getitem__, text.translate(TABLE), 0
                while at < len(flat):
                    end = flat.find(CUT, at + STRETCH) if len(flat) - at > STRETCH else -1
                    end = len(flat) if end < 0 else end
                    ids.extend(map(of, flat[at:end].replace(CUT, b" \xff ").split()))
                    ids.append(0)
                    at = end
                    if len(ids) >= TOKENS:
                        yield np.array(ids, np.int64)
                        ids = [0]
                        if len(self.found) > VOCABULARY:
                            self.start()
                            self.langs[lang] = Words(lang, self.found, self.new)
                            of = self.langs[lang].__getitem__
        if len(ids) > 1:
            yield np.array(ids, np.int64)


def keys(hashes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1, 2, ..: the key of the ``k`` words from each place on, and whether they all stand in one piece."""
    n = len(ids)
    hashes, words = np.r_[hashes, np.zeros(LONGEST, np.uint64)], np.r_[ids > 0, np.zeros(LONGEST, bool)]
    so_far, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(LONGEST):
        x = so_far * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        so_far, inside = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), inside & words[k:k + n]
        yield so_far >> np.uint64(64 - KEY_BITS), inside


def packed(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: the high bytes of small ones nearly vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def frequent(docs: DataFrame, least: int = LEAST) -> Broadcast:
    """The filter: a bit for each beginning of a window that may occur ``least`` times in its language.

    Tasks count keys and keep them sorted, as differences within 4,096 buckets, some three bytes a distinct key; a bucket's
    counts are summed in one place and leave a slice of the filter.
    """
    spark = docs.sparkSession
    low_bits, slice_bits, kind = KEY_BITS - BUCKET_BITS, FILTER_BITS - BUCKET_BITS, "u1" if least < 256 else "<u4"

    def count(batches):
        vocabulary, held, size = Vocabulary(), [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(found, np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(low_bits))
            low, n = (found & np.uint64((1 << low_bits) - 1)).astype("<u4"), np.minimum(n, least).astype(kind)
            rows = [(i, len(a), packed(np.diff(a, prepend=a.dtype.type(0))), packed(b))
                    for i, (a, b) in enumerate(zip(np.split(low, ends), np.split(n, ends))) if len(a)]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "size", "low", "n"])

        for ids in vocabulary.chunks(batches):
            held += [key[inside] for key, inside in keys(vocabulary.hash_of(ids), ids)]
            size += sum(map(len, held[-LONGEST:]))
            if size >= KEYS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(batches):
        now, low, n = None, [], []

        def bits():
            at, counts = np.concatenate(low), np.concatenate(n).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, counts = at[order], counts[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            kept = at[first][np.add.reduceat(counts, first) >= least]
            if not len(kept):
                return None
            flags = np.zeros(1 << slice_bits, bool)
            flags[kept >> (low_bits - slice_bits)] = True
            slice_ = zlib.compress(np.packbits(flags, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([slice_], pa.binary())], ["bucket", "bits"])

        for batch in batches:
            for bucket, size, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if low and (made := bits()):
                        yield made
                    now, low, n = bucket, [], []
                low.append(np.cumsum(unpacked(a, size, "<u4"), dtype=np.uint32))
                n.append(unpacked(b, size, kind))
        if low and (made := bits()):
            yield made

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _texts(docs).mapInArrow(count, "bucket int, size int, low binary, n binary")
    slices = counted.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, bits binary")
    return spark.sparkContext.broadcast([tuple(r) for r in slices.collect()])


def windows(docs: DataFrame, kept: Broadcast) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): padded longest windows, counted within a chunk of a task.

    ``""`` pads. A word that is too rare stands as a window of padding only, for the total of its language.
    """
    def run(batches):
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        width = len(bits) >> BUCKET_BITS
        for bucket, packed in kept.value:
            bits[bucket * width:(bucket + 1) * width] = np.frombuffer(zlib.decompress(packed), np.uint8)

        def passes(key):
            at = (key >> np.uint64(KEY_BITS - FILTER_BITS)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        vocabulary = Vocabulary()
        for ids in vocabulary.chunks(batches):
            lead, alive = [], np.ones(len(ids), bool)
            padded = np.r_[ids, np.zeros(LONGEST, np.int64)]
            for k, (key, inside) in enumerate(keys(vocabulary.hash_of(ids), ids)):
                alive = alive & inside & passes(key)
                lead.append(np.where(alive, padded[k:k + len(ids)], 0))
            known = lead[0] > 0
            langs = {lang: i for i, lang in enumerate(vocabulary.langs)}
            rare = np.flatnonzero(~known & (ids > 0))
            by_lang = np.bincount([langs[vocabulary.found[i][0]] for i in ids[rare].tolist()], minlength=len(langs))
            own = np.flatnonzero(known)
            base = len(vocabulary.found)
            left, left_at = np.unique(lead[0][own] * base + lead[1][own], return_inverse=True)
            right, right_at = np.unique(lead[2][own] * base + lead[3][own], return_inverse=True)
            both, n = np.unique(left_at * len(right) + right_at, return_counts=True)
            if len(own):
                a, b = left[both // len(right)], right[both % len(right)]
                columns = [a // base, a % base, b // base, b % base]
            else:
                columns = [np.zeros(0, np.int64)] * LONGEST
            used = np.unique(np.concatenate(columns))
            columns = [np.searchsorted(used, c) for c in columns]
            found = [vocabulary.found[i] for i in used.tolist()]
            texts, of_word = pa.array([w.decode("utf-8", "replace") for _, w in found], pa.string()), pa.array([lang for lang, _ in found], pa.string())
            totals = [(lang, int(by_lang[i])) for lang, i in langs.items() if by_lang[i]]
            if len(both):
                yield pa.RecordBatch.from_arrays(
                    [of_word.take(pa.array(columns[0])), *(texts.take(pa.array(c)) for c in columns), pa.array(n, pa.int64())], names)
            if totals:
                blank = pa.array([""] * len(totals), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in totals], pa.string()), *[blank] * LONGEST, pa.array([t[1] for t in totals], pa.int64())], names)

    names = ["lang", *(f"w{k}" for k in range(1, LONGEST + 1)), "n"]
    return _texts(docs).mapInArrow(run, ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in names))


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, words, phrase, f) of all phrases of one to four words that occur ``least`` times, and for each language a row of
    k = 0 with the number of its words. A null lang is ``und``, a null text empty; other columns are not read."""
    importable(docs.sparkSession)
    counted = windows(docs, frequent(docs, least))
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    once = counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(names)}, {' + '.join(f'1 - grouping({c})' for c in names)} AS k, sum(n) AS f "
        f"FROM {{once}} GROUP BY lang, ROLLUP({', '.join(names)})", once=once)
    last = F.element_at(F.array(F.lit("-"), *names), (F.col("k") + 1).cast("int"))
    enough = summed.where(((F.col("f") >= least) | (F.col("k") == 0)) & (last != ""))
    words = F.slice(F.array(*names), F.lit(1), F.col("k").cast("int"))
    return enough.select("lang", "k", words.alias("words"), F.array_join(words, " ").alias("phrase"), "f")


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of two to four words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language. Phrases that lie inside a
    longer candidate with ``share`` percent of their count are left out. Products are decimals of 38 digits. Repeated rows count as
    often as they stand; an empty table gives no row.
    """
    known = written(phrases(docs, least), "collocation-phrases")
    candidates = known.where("k > 1").select("lang", "k", "words", "phrase", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("tail"))
    part = known.where(f"k BETWEEN 1 AND {LONGEST - 1}")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a")).alias("b"))

    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("size")) for k in range(2, LONGEST) for i in range(1, LONGEST)])
    inner = candidates.where("k > 2").select("lang", "words", "k", "a", F.explode(spans).alias("s")).where("s.size < k AND s.i + s.size - 1 <= k")
    around = inner.groupBy("lang", F.array_join(F.slice("words", F.col("s.i"), F.col("s.size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    scored = best.select("lang", "phrase", "b.*").join(around, ["lang", "phrase"], "left")
    left = scored.where(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = left.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = known.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
