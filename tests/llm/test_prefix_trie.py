import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aerolens.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    """{conv_id: [(role, text), ..]} by turn, null first; turns of one number by their key."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv_id].append((turn is not None, turn or 0, key, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute_nodes(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        ending = ",".join(str(c) for c in cs if len(convs[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], sum(not children[q] for q in below), saved,
                    hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    *[(c, t, "user", f"a b {t}") for c in range(100, 130) for t in range(4)],  # copies over several partitions
    *[(c, t, "user", f"a b {t}") for c in range(40, 44) for t in range(9)],  # and longer ones
    *[(c, t, "user", f"a b {min(t, c % 5)}") for c in range(200, 215) for t in range(6)],
    *[(7, t, "assistant", "x" * t) for t in range(11)], *[(8, t, "assistant", "x" * min(t, 7)) for t in range(13)],
    (1, None, None, None), (1, None, "user", ""), (1, 3, "user", None), (1, 3, "user", None), (2, 1, "", ""), (2, 2, None, "one two"),
    (None, 1, "user", "none"), (-45, 0, "user", "minus"), (-40, 0, "user", "base"), (-40, 1, "user", "base two"),
    (9_007_199_254_740_993, 5, "user", "large id"), (9_007_199_254_740_992, 5, "user", "large id"), (61, 0, "user", "no base"), (3, 1, "a", "b:c"), (4, 1, "a:b", "c"),
]


@pytest.mark.parametrize("block", [3, 256])
def test_trie_equals_brute_force(spark, block):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert found(prefix_trie.conversation_trie(df, block)) == brute_nodes(conversations(ROWS))


@pytest.mark.parametrize("partitions", [1, 13])
def test_rebuilt_trie_equals_brute_force(spark, partitions):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(5) for c in ("position", "key", "length", "block", "conv", "n", "part", "words")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = found(prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.ordered(df)), block=4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == brute_nodes(brute_rebuilt(conversations(ROWS)))


def test_without_conversations_there_is_no_node(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.ordered(none))).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark, folder):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)  # one own turn, no base
    rows = queries.QUERIES["op11_prefix_trie"](spark, folder(conversations=spark.createDataFrame([(lone, 0, "user", "x")], SCHEMA)))
    assert found(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
