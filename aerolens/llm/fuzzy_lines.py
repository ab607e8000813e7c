"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, union of components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolens.llm.components import components
from aerolens.session import drop_written, recorded, remove, written

#: Characters of a shingle, least Jaccard similarity, bands and rows: a pair at 0.8 meets with probability 0.995.
SHINGLE, SIMILARITY, BANDS, ROWS = 7, 0.8, 10, 4
#: Shuffles that share the bands: all keys at once take more disk than the texts that they come from.
PASSES = 2
#: Buckets up to this many lines are compared in pairs, larger ones through differences from their centre; both are exact.
PAIRED = 32
#: Two sets have a similarity of at least SIMILARITY if their symmetric difference is at most this share of their sizes' sum.
SPREAD = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Bits that summarise a line's changes: a differing bit needs a differing change.
CHANGE_BITS = 1024
#: Bits of the fixed-size filter that says which lines' texts the exact check may need.
FILTER_BITS = 1 << 24

_rng = np.random.default_rng(7)
FACTORS = (_rng.integers(0, 1 << 31, BANDS * ROWS) * 2 + 1).astype(np.uint32)
TERMS = _rng.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space inside a line to blanks.
BLANKS = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")


def normal(line: str) -> str:
    """Lower-cased, runs of ASCII white space as single blanks."""
    return b" ".join(line.lower().encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def normal_lines(text: str | None) -> list[bytes]:
    """The lines of a text as ``normal`` makes them, in UTF-8; one lower-casing of the text, words are only taken apart where blanks meet."""
    lines = (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANKS).split(b"\n")
    return [b" ".join(x.split()) if b"  " in x else x for x in [line.strip(b" ") for line in lines]]


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 11)


def shingles(line: str) -> set[str]:
    """Distinct character shingles; a shorter line is one shingle, filled up with blanks."""
    line = line.ljust(SHINGLE)
    return {line[i:i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines x BANDS) bucket keys from the minima of BANDS * ROWS hash functions over each line's shingles.

    Lines of similar length are laid side by side (short ones repeat their last shingle), so a minimum runs over
    whole rows; blocks bound the memory.
    """
    keys = np.empty((len(lines), BANDS), np.uint64)
    lines = [x.ljust(SHINGLE) for x in lines]
    lengths = np.array([len(x) for x in lines], np.int64) - SHINGLE + 1
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * lengths[order[to]] <= 120_000 and to - at < 4096:
            to += 1
        some, m = order[at:to], lengths[order[at:to]]
        codes = np.frombuffer("".join([lines[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(codes) - SHINGLE + 1, np.uint32)
        for i in range(SHINGLE):
            h = h * np.uint32(0x01000193) + codes[i:len(codes) - SHINGLE + 1 + i]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        starts = np.cumsum(m + SHINGLE - 1) - (m + SHINGLE - 1)
        grid = h[starts + np.minimum(np.arange(m[-1])[:, None], m - 1)]
        work = np.empty_like(grid)
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for f in range(band * ROWS, band * ROWS + ROWS):
                np.multiply(grid, FACTORS[f], out=work)
                np.add(work, TERMS[f], out=work)
                key = (key ^ work.min(axis=0)) * MIX
                key ^= key >> np.uint64(29)
            keys[some, band] = key
        at = to
    return keys


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, line_no, h, keys) for each line with a word; doc tells texts of one id apart.

    ``keys`` only at a line's first place in a batch: equal lines have equal keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                some = batch.slice(part, 2048)
                first: dict[bytes, int] = {}
                rows, numbers, which = [], [], []
                for row, text in enumerate(some.column(2).to_pylist()):
                    for number, line in enumerate(normal_lines(text)):
                        if line:
                            rows.append(row)
                            numbers.append(number)
                            which.append(first.setdefault(line, len(first)))
                if not rows:
                    continue
                lines, which = list(first), np.array(which)
                h = np.array([line_hash(x) for x in lines], np.uint64).view(np.int64)
                fresh = np.zeros(len(which), bool)
                fresh[np.unique(which, return_index=True)[1]] = True
                flat = band_keys([x.decode("utf-8", "surrogatepass") for x in lines]).view(np.int64)[which[fresh]].ravel()
                offsets = np.r_[0, np.cumsum(fresh * BANDS)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows)), some.column(1).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(h[which]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "doc", "line_no", "h", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("doc"), "text").mapInArrow(run, f"doc_id {kind}, doc long, line_no int, h long, keys array<long>")


def shared_buckets(entries: DataFrame) -> DataFrame:
    """(key, h): members of buckets that hold two or more lines, in one shuffle of (key, h).

    Rows are range-partitioned by both columns, so a bucket of any size is split; a task streams its sorted rows and
    keeps one back. Runs at a partition's edge may go on next door and are kept in any case.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # the last row, if not given out yet
        last = None
        for batch in batches:
            k, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.r_[last is None or (k[:1] != last[0]) | (h[:1] != last[1]), (k[1:] != k[:-1]) | (h[1:] != h[:-1])].astype(bool)
            k, h = k[fresh], h[fresh]
            if not len(k):
                continue
            goes_on = np.r_[last is not None and k[0] == last[0], k[1:] == k[:-1]]
            give = goes_on | np.r_[goes_on[1:], False]
            if first:
                give[0], first = True, False
            before = [held] if held is not None and goes_on[0] else []
            held = None if give[-1] else (k[-1], h[-1])
            last = (k[-1], h[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([x[i] for x in before], np.int64), v[give]])) for i, v in enumerate((k, h))], ["key", "h"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in held], ["key", "h"])

    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the lines ``wanted`` (column h) and a few more: a fixed bitmap of 2 MB leaves most others out.

    With very many wanted lines the bitmap fills and lets all through; the result stays right.
    """
    spot = F.expr(f"(h & {FILTER_BITS - 1}L) + 1")  # buckets and positions count from 1
    bitmaps = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()  # FILTER_BITS / 32768 rows of 4 KB at most
    bits = np.zeros(FILTER_BITS, bool)
    for row in bitmaps:
        start = (row["bucket"] - 1) * 32768
        bits[start:start + 32768] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            lines = list({x for text in batch.column(0).to_pylist() for x in normal_lines(text) if x})
            if lines:
                h = np.array([line_hash(x) for x in lines], np.uint64).view(np.int64)
                ok = np.flatnonzero(bits[h & (FILTER_BITS - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array([lines[i].decode("utf-8", "surrogatepass") for i in ok], pa.string())], ["h", "line"])

    found = docs.select("text").mapInArrow(run, "h long, line string")
    return found.groupBy("h").agg(F.any_value("line").alias("line"))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs plus the two lines x and y, sorted by a."""
    with_b = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return with_b.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").sortWithinPartitions("a")


def similar(a, b, both):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common elements are linked."""
    return both >= SIMILARITY * (a + b - both) - 1e-9


def alike(a: set, b: set) -> bool:
    return similar(len(a), len(b), len(a & b))


def overlaps(xs: list[str], ys: list[str], sets: Callable = shingles) -> np.ndarray:
    """For each pair of lines the sizes of both sets that ``sets`` makes and of their common part.

    A shingle's characters, numbered within a block of pairs, fill nine bits each of one number, so numbers are equal only where shingles
    are. Rows of numbers are sorted and changes counted. Blocks with more than 512 different characters,
    and other sets than ``shingles``, are compared as sets of strings.
    """
    out = np.empty((3, len(xs)), np.int64)
    xs, ys = [x.ljust(SHINGLE) for x in xs], [y.ljust(SHINGLE) for y in ys]
    widths = np.maximum([len(x) for x in xs], [len(y) for y in ys]) - SHINGLE + 1
    order, at = np.argsort(widths, kind="stable"), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * widths[order[to]] <= 40_000:
            to += 1
        some, width = order[at:to], widths[order[to - 1]]
        lines = [xs[i] for i in some] + [ys[i] for i in some]
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        known = np.flatnonzero(np.bincount(codes))
        if sets is shingles and len(known) <= 512:
            number = np.zeros(known[-1] + 1, np.uint64)
            number[known] = np.arange(len(known))
            codes, h = number[codes], np.zeros(len(codes) - SHINGLE + 1, np.uint64)
            for i in range(SHINGLE):
                h = h << np.uint64(9) | codes[i:len(h) + i]
            lengths = np.array([len(x) for x in lines])
            starts = np.cumsum(lengths) - lengths
            grid = np.sort(h[starts[:, None] + np.minimum(np.arange(width), (lengths - SHINGLE)[:, None])], axis=1)
            every = np.sort(np.concatenate([grid[:len(some)], grid[len(some):]], axis=1), axis=1)
            sizes, union = (1 + (x[:, 1:] != x[:, :-1]).sum(axis=1) for x in (grid, every))
            a, b = sizes[:len(some)], sizes[len(some):]
            out[:, some] = a, b, a + b - union
        else:
            for i in some:
                a, b = sets(xs[i]), sets(ys[i])
                out[:, i] = len(a), len(b), len(a & b)
        at = to
    return out


def verified(pairs: DataFrame, texts: DataFrame, shingles: Callable = shingles) -> DataFrame:
    """The pairs (a, b) whose lines' shingle sets have a Jaccard similarity of SIMILARITY or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.flatnonzero(similar(*overlaps(batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingles)))
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return with_texts(pairs, texts).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def compared(star: DataFrame, texts: DataFrame, shingles: Callable = shingles) -> DataFrame:
    """Every line b compared with its centre a: whether they are linked, both sets' sizes and, for rows marked
    ``large``, what b's set has that a's has not and then what it lacks, each as sorted hashes, and the parities of
    these changes' counts in CHANGE_BITS classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            large, xs, ys = (batch.column(i).to_pylist() for i in (2, 3, 4))
            size_a, size_b, both = overlaps(xs, ys, shingles)
            last, a, changes, bits = None, set(), [], []
            for far, x, y in zip(large, xs, ys):
                if far:
                    if x != last:
                        last, a = x, shingles(x)
                    b = shingles(y)
                changes.append([*change_hashes(b - a, 1), *change_hashes(a - b, 2)] if far else None)
                bits.append(parities(changes[-1]) if far else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(similar(size_a, size_b, both)), pa.array(size_a, pa.int32()),
                 pa.array(size_b, pa.int32()), pa.array(changes, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64()))], ["a", "b", "linked", "size_a", "size_b", "changes", "bits"])

    return with_texts(star, texts).select("a", "b", "large", "x", "y").mapInArrow(
        run, "a long, b long, linked boolean, size_a int, size_b int, changes array<long>, bits array<long>")


def change_hashes(some: set[str], seed: int) -> list[int]:
    h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in some], np.uint64)
    return np.sort(h.view(np.int64)).tolist()


def parities(hashes: list[int]) -> list[int]:
    odd = np.bincount(np.array(hashes, np.int64) & (CHANGE_BITS - 1), minlength=CHANGE_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def far_pairs(comparisons: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among lines with one centre c, at least one of them not linked to it; loses no link.

    Let F(x) be the symmetric difference of x and c. x and y are linked if |F(x)| + |F(y)| - 2s <= SPREAD (|x| + |y|)
    with s = |F(x) & F(y)|, and x is not linked to c if |F(x)| > SPREAD (|x| + |c|). So y must share at least
    (|F(y)| + SPREAD (|c| - |y|)) / 2 > 0 elements with x, and x at least |F(x)| - |x| (1 / SIMILARITY - 1) with any y.
    Elements are ordered alike everywhere, so linked lines meet in these prefixes, at places after which enough
    elements are left. What single versions of a line add is rare and comes first: versions with changes of
    their own meet nobody. The differing bits of two parity summaries are a lower bound of |F(x) ^ F(y)|, which
    sorts out most that share a change but not enough. Lines already in one component are not compared.
    """
    n = F.size("changes")
    own = comparisons.where("changes IS NOT NULL").select(
        F.col("a").alias("c"), F.col("b").alias("h"), "linked", F.col("size_a").alias("size_c"), F.col("size_b").alias("size"), n.alias("n"), "changes", "bits")
    placed = own.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h")).drop("node")
    every = placed.select("*", F.posexplode("changes").alias("at", "change")).drop("changes").withColumns({
        "near": F.col("at") <= F.col("n") - (F.col("n") + F.lit(SPREAD) * (F.col("size_c") - F.col("size"))) / 2 + 1e-9,
        "wide": F.col("at") <= F.col("size") * (1 / SIMILARITY - 1) + 1e-9})
    x = every.where("NOT linked AND (wide OR near)").select("c", "change", *[F.col(k).alias(f"x_{k}") for k in ("h", "root", "size", "n", "at", "near", "wide", "bits")])
    y = every.where("near").select("c", "change", *[F.col(k).alias(f"y_{k}") for k in ("h", "root", "size", "n", "at", "linked", "bits")])
    least = (F.col("x_n") + F.col("y_n") - SPREAD * (F.col("x_size") + F.col("y_size"))) / 2 - 1e-6
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    apart = sum(F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(CHANGE_BITS // 64))
    met = x.join(y, ["c", "change"]).where(
        (F.col("x_root") != F.col("y_root")) & (left >= least) & (apart <= SPREAD * (F.col("x_size") + F.col("y_size")) + 1e-6)
        & F.when(F.col("y_linked"), F.col("x_wide")).otherwise(F.col("x_near") & (F.col("x_h") < F.col("y_h")))
        & (F.least("x_size", "y_size") >= SIMILARITY * F.greatest("x_size", "y_size") - 1e-6))
    return met.select(F.col("x_h").alias("a"), F.col("y_h").alias("b"))


def key_columns() -> dict[str, Column]:
    """The columns of a line's keys for each pass, by name: a pass reads only its own."""
    each = -(-BANDS // PASSES)
    return {f"keys{i}": F.slice("keys", i * each + 1, each) for i in range(PASSES)}


def line_links(docs: DataFrame, occurrences: DataFrame, counts: DataFrame) -> DataFrame:
    """Links (a, b) between line hashes at SIMILARITY or more that keep all components of the candidates.

    ``occurrences`` has the ``key_columns`` and is removed: it is the largest table by far, and only the buckets need it."""
    passes = [written(shared_buckets(occurrences.where(F.size(keys) > 0).select(F.explode(keys).alias("key"), "h")), "lines-buckets")
              for keys in key_columns()]
    drop_written(occurrences)
    members = reduce(DataFrame.union, passes)
    texts = written(line_texts(docs, members.select("h").distinct()), "lines-texts")
    return bucket_links(members, texts, counts, shingles, "lines")


def bucket_links(members: DataFrame, texts: DataFrame, counts: DataFrame, shingles: Callable, label: str) -> DataFrame:
    """Links (a, b) at SIMILARITY or more between the ``members`` (key, h) of buckets, which keep all components.

    ``texts`` has the line of every h, ``counts`` its copies, and ``shingles`` makes a line's set of strings. First each bucket's members are compared with its most copied line. What that joins is one component, given as links to its root;
    only members of one bucket that are still in different components are then compared with each other:
    in pairs in buckets up to PAIRED lines, through shared differences from the centre in larger ones. Tables go as soon as
    the next ones are written.
    """
    known = written(members.join(counts.select("h", "copies"), "h"), f"{label}-members")
    centre = known.groupBy("key").agg(F.max_by("h", F.struct("copies", "h")).alias("centre"), F.count("*").alias("n"))
    around = written(known.join(centre.where("n > 1"), "key").where("h != centre").select("key", "h", "centre", (F.col("n") > PAIRED).alias("large")), f"{label}-around")
    drop_written(known)
    star = around.groupBy(F.col("centre").alias("a"), F.col("h").alias("b")).agg(F.max("large").alias("large"))
    comparisons = written(compared(star, texts, shingles), f"{label}-compared")
    close = comparisons.where("linked").select("a", "b")
    roots = components(close, f"{label}-first")
    placed = around.where("NOT large").join(roots, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    apart = written(placed.join(split, "key"), f"{label}-apart")
    a, b = apart.select("key", F.col("h").alias("a"), F.col("root").alias("ra")), apart.select("key", F.col("h").alias("b"), F.col("root").alias("rb"))
    rest = a.join(b, "key").where("ra < rb").select("a", "b").union(far_pairs(comparisons, roots)).distinct()
    rest = written(rest, f"{label}-rest")
    drop_written(around, comparisons, apart)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(rest, texts, shingles))


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, n_lines, kept): for each document the numbers of the lines that stay, from 0, sorted.

    Lines that are equal, or chained by shingle similarity SIMILARITY, are one component; its first line by
    (doc_id, text hash, line number; null ids first) stays in the whole corpus. Blank lines always stay and are not
    listed. Rows with equal id and text are one document. A null text has no lines.
    """
    rows = line_rows(docs)
    occurrences = written(rows.withColumns(key_columns()).drop("keys"), "lines")
    place = F.struct("doc_id", "doc", "line_no")
    counts = written(occurrences.groupBy("h").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "lines-counts")
    with recorded() as used:
        links = line_links(docs, occurrences, counts)
    try:
        roots = components(links, "lines-components")
    finally:
        for path in used:
            remove(docs.sparkSession, path)
    first = (counts.join(roots, F.col("h") == F.col("node"), "left").groupBy(F.coalesce("root", "h").alias("root"))
             .agg(F.min("first").alias("first")).select("first.*"))
    lists = first.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    whole = whole.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    same = F.col("w.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("w.doc") == F.col("l.doc"))
    return whole.alias("w").join(lists.alias("l"), same, "left").select(
        "w.doc_id", "w.doc", "w.n_lines", F.coalesce("l.kept", F.array().cast("array<int>")).alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines that do not stay taken out of their texts; columns unchanged."""
    kept = kept_lines(docs).dropDuplicates(["doc_id", "doc"])
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__doc") == F.col("k.doc"))
    joined = docs.withColumn("__doc", F.xxhash64("text")).alias("d").join(kept.alias("k"), same)
    lines = F.split("d.text", "\n", -1)
    stays = F.filter(lines, lambda line, i: F.array_contains("k.kept", i) | ~line.rlike(r"\S"))
    return joined.select(*[F.array_join(stays, "\n").alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
