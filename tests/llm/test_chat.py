import glob
import os
import random

import duckdb
import pytest

from aerolens.llm import chat, queries


def brute(rows):
    """Conversations that stay: not a prefix of a longer one, the smallest id of equal ones."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    turns = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: x[0])] for c, ts in by.items()}
    return {c for c, t in turns.items() if not any(
        d != c and u[:len(t)] == t and (len(u) > len(t) or d < c) for d, u in turns.items())}


def test_snapshots_collapse_into_the_longest(spark):
    rng, rows = random.Random(4), []
    conv = 0
    for family in range(12):
        whole = [("user" if i % 2 == 0 else "assistant", f"{rng.choice('ab')}{family % 3}") for i in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 5)):
            conv += 1
            rows += [(conv, i, *t) for i, t in enumerate(whole[:rng.randint(1, len(whole))])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    out = chat.format_chats(df).collect()
    assert {r["conv_id"] for r in out} == brute(rows)
    for c in brute(rows):
        own = sorted(((r["position"], r["rendered"]) for r in out if r["conv_id"] == c))
        want = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for cc, _, r, t in sorted(x for x in rows if x[0] == c)]
        assert own == list(enumerate(want))


def test_a_conversation_with_most_rows_and_its_snapshots(spark):
    rows = [(1, i, "user", str(i)) for i in range(900)] + [(2, i, "user", str(i)) for i in range(450)] + [(3, i, "user", "z") for i in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    whole = {r["conv_id"]: r for r in chat.whole_chats(chat.format_chats(df)).collect()}
    assert set(whole) == {1, 3} and whole[1]["n_turns"] == 900
    assert whole[1]["text"].split("<|im_end|>\n")[899] == "<|im_start|>user\n899"


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, None, None, 1), (7, None, "user", "b", 1), (7, 0, "user", "", 1), (7, 0, "user", "", 1),
            (8, 0, None, "x", 1), (9, 0, "x", None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    out = chat.format_chats(df).collect()
    assert len(out) == 7
    assert [r["rendered"] for r in sorted((r for r in out if r["conv_id"] is None), key=lambda r: r["position"])] == [
        "<|im_start|>user\na<|im_end|>\n", "<|im_start|>unknown\n<|im_end|>\n"]


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.CHECKS[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(str(r[i]) for i in order) for r in data)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())
