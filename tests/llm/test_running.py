import itertools
import random

from aerolens.llm import components as components_module
from aerolens.llm.components import components
from aerolens.llm.running import running


def test_running_sums_of_groups_over_partitions(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.6 else rng.choice("bcd"), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    out = running(df, ["i"], ["v"], "g").collect()
    for g in "abcd":
        own = sorted((r["i"], r["v"], r["v_before"]) for r in out if r["g"] == g)
        assert [b for _, _, b in own] == [0, *itertools.accumulate(v for _, v, _ in own)][:-1]


def test_running_sums_of_all_rows_with_equal_keys(spark):
    rows = [(1 if i % 3 else None, i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    out = sorted(running(df, ["k", "i"], ["v"]).collect(), key=lambda r: (r["k"] is not None, r["k"], r["i"]))
    assert [r["v_before"] for r in out] == [0, *itertools.accumulate(r["v"] for r in out)][:-1]


def test_empty(spark):
    assert running(spark.createDataFrame([], "k long, v long"), ["k"], ["v"]).count() == 0


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(edges):
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)]  # a chain
    edges += [(1000, 1000 + i) for i in range(50)]  # a star
    edges += [(rng.randint(-300, -1), rng.randint(-300, -1)) for _ in range(150)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in brute_components([e for e in edges if e[0] != e[1]]).items()}


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_stars_around_their_smallest_node_take_no_step(spark, monkeypatch):
    tables, write = [], components_module.written
    monkeypatch.setattr(components_module, "written", lambda df, label: tables.append(label) or write(df, label))
    stars = [(1, 5), (7, 1), (1, 9), (3, 4), (3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3} and len(tables) == 1
