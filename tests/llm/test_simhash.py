import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolens.llm import simhash

MASK = (1 << 64) - 1


def brute_fingerprint(text):
    import re
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    parts = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_its_definition(prose):
    for text in [None, "", "  \n", "One", "one TWO", "A b C d", "é É x\x1cy z\x0bq", prose(700, 1), "x " * 10_000]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@settings(max_examples=300)
@given(st.integers(0, MASK), st.lists(st.integers(0, 63), max_size=2))
def test_chain_filter_loses_no_link(a, bits):
    b = a
    for bit in bits:
        b ^= 1 << bit
    masks, m, most = simhash.ring_masks(simhash.SEGMENTS), simhash.SEGMENTS, 2
    assert any(all(((a ^ b) & masks[s][l - 1]).bit_count() * m <= l * most for l in range(1, m + 1)) for s in range(m))


def brute_roots(values, most=2):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def same_classes(got, want):
    def sets(m):
        by = {}
        for k, v in m.items():
            by.setdefault(v, set()).add(k)
        return sorted(map(sorted, by.values()))
    assert sets(got) == sets(want)


def values(seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
            if rng.random() < 0.5:
                base = v
    return out | {0, 1, 3, 7, 15, MASK}


def test_components_equal_brute_force_by_both_ways(spark):
    for paired, most, seed in ((1000, 2, 1), (0, 2, 2), (3, 2, 3), (0, 3, 4), (0, 1, 5)):
        some = values(seed)
        fps = spark.createDataFrame([(simhash.signed(v),) for v in some] * 2, "fp long")
        got = {r["fp"] & MASK: r["root"] & MASK for r in simhash.near_duplicates(fps, most, paired).collect()}
        same_classes(got, brute_roots(some, most))


def docs_of(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, fp string, root int, n int")


def test_classes_of_copies_nulls_and_repeated_rows(spark, prose):
    a = prose(300, 1)
    texts = [(5, a), (3, a), (9, prose(300, 2)), (2, None), (1, ""), (1, ""), (7, " \n "), (None, a), (None, prose(90, 4))]
    rows = simhash.classes(docs_of(spark, [(*t, "x", 1, 2) for t in texts])).collect()
    got = sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (5, 3), (7, 1), (9, 9)]
    assert sorted((r["component_id"] is None, r["component_id"]) for r in rows if r["doc_id"] is None)[0] == (False, 3)
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2, 7)} == {"0" * 16}


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark, prose):
    a = prose(300, 1)
    df = docs_of(spark, [(5, a, "p", 1, 1), (3, a, "q", 2, 2), (3, a, "q", 2, 2), (9, prose(200, 2), None, 3, 3), (None, a, "r", 4, 4)])
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9]


def test_empty_table(spark):
    df = docs_of(spark, [])
    assert simhash.classes(df).count() == 0 and simhash.keep_one(df).count() == 0
