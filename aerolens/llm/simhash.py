"""SimHash near-duplicates: fingerprints, pigeonring candidate search, connected components."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolens.llm.components import components
from aerolens.llm.texts import map_texts, words
from aerolens.session import written

SEGMENTS = 7
#: Buckets up to this many fingerprints are compared in pairs, larger ones through one-bit variants; both are exact.
PAIRED = 32


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 (seed 42), repeats counted."""
    tokens = words((text or b"").lower())
    if not tokens:
        return 0
    parts = [tokens] if len(tokens) < shingle else zip(*(tokens[i:] for i in range(shingle)))
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, parts)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        block = h[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, plus ``fp``: the 64 bits as a signed long (0 for null or wordless texts)."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]
    return map_texts(docs, text, "fp long", make)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def ring_masks(segments: int) -> list[list[int]]:
    """masks[s][l-1]: the bits of the ``l`` consecutive segments that begin with segment ``s`` on the ring."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = []
    for s in range(segments):
        chain, row = 0, []
        for i in range(segments):
            chain |= own[(s + i) % segments]
            row.append(chain)
        masks.append(row)
    return masks


def links(fingerprints: DataFrame, most: int = 2, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``most`` or fewer differing bits that keep all components.

    Pigeonring: if two fingerprints differ in at most ``most`` of ``segments`` segments' bits in all, some segment
    on the ring starts a chain in which each prefix of l segments differs in at most l * most / segments bits. The
    prefixes with a budget under one bit must be equal: they are the bucket key (7 segments and 2 bits: three
    segments, 27 bits). Inside a bucket the longer prefixes prune pairs before the full distance.
    Large buckets (copies with small changes) emit no pairs: each member gives itself and its variants with one
    other bit turned; two members within two bits share a variant, members of a variant lie within two bits of
    each other, so a star per variant (at most 65 members) links them exactly. That way needs ``most`` = 2; for
    other distances all buckets are compared in pairs.
    """
    masks = ring_masks(segments)
    exact = math.ceil(segments / most) - 1 if most else segments
    if exact < 1:
        raise ValueError("more segments than differing bits are needed")
    keys = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(signed(masks[s][exact - 1]))).alias("key"))
                     for s in range(segments)])
    entries = fingerprints.select("fp", F.explode(keys).alias("e")).select("e.s", "e.key", "fp")
    shared = entries.groupBy("s", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(entries.join(shared, ["s", "key"]), "simhash-members")

    pairs_in = members.where(F.col("n") <= paired) if most == 2 else members
    a, b = pairs_in.select("s", "key", F.col("fp").alias("a")), pairs_in.select("s", "key", F.col("fp").alias("b"))
    pairs = (a.join(b, ["s", "key"]).where((F.col("a") < F.col("b")) & viable(masks, exact, most, segments))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b"))
    if most != 2:
        return pairs.distinct()
    turned = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << bit)) for bit in range(64) if not masks[s][exact - 1] >> bit & 1])
                       for s in range(segments)])
    variants = (members.where(F.col("n") > paired)
                .select("s", "fp", F.explode(F.element_at(turned, F.col("s") + 1)).alias("turn"))
                .select("s", F.col("fp").bitwiseXOR(F.col("turn")).alias("variant"), "fp"))
    stars = (variants.groupBy("s", "variant").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
             .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a != b"))
    return pairs.union(stars).distinct()


def viable(masks: list[list[int]], exact: int, most: int, segments: int) -> Column:
    """Whether the chain from ``s`` keeps every prefix of ``a`` xor ``b`` within its share of ``most``."""
    apart = F.col("a").bitwiseXOR(F.col("b"))
    ok = F.lit(True)
    for length in range(exact + 1, segments):
        chain = F.element_at(F.array(*[F.lit(signed(masks[s][length - 1])) for s in range(segments)]), F.col("s") + 1)
        ok = ok & (F.bit_count(apart.bitwiseAND(chain)) <= length * most // segments)
    return ok


def near_duplicates(fps: DataFrame, most: int = 2, paired: int = PAIRED) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``fps``: root is one fingerprint of its component."""
    distinct = written(fps.select("fp").distinct(), "simhash-distinct")
    linked = components(links(distinct, most, paired=paired), "simhash-components")
    return distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, most: int = 2, shingle: int = 3, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; the component is the smallest doc_id reachable.

    Documents without words have fingerprint zero and link as any other. Repeated rows each give a
    row. A component whose ids are all null has a null component_id.
    """
    fps = written(with_fingerprint(docs.select("doc_id", "text"), "text", shingle), "simhash-fp")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = near_duplicates(fps, most, paired).join(first, "fp")
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id, null last, of repeated rows any one; columns unchanged.

    No copy of the texts is written. A row is known by its id and its text's hash; only where several rows agree
    in both with the chosen one are they grouped, to leave one of them.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("__hash"), "text")
    fps = written(with_fingerprint(hashed, "text", shingle), "simhash-fp")
    roots = near_duplicates(fps, most)
    rows = fps.groupBy("fp", "doc_id", "__hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__hash", "n")
    first = rows.groupBy("fp").agg(F.min(order).alias("o")).join(roots, "fp")
    best = first.groupBy("root").agg(F.min("o").alias("o"))
    chosen = written(best.selectExpr("o.doc_id AS __id", "o.__hash AS __hash", "o.n AS __n"), "simhash-chosen")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    own = [docs[f"`{c}`"] for c in docs.columns]
    single = docs.join(chosen.where("__n = 1"), same).select(*own)
    repeated = docs.join(chosen.where("__n > 1"), same).dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return single.union(repeated)
