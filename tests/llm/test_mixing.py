import pytest

from aerolens.llm import mixing


def brute_targets(sizes):
    """Shares by weight, each stopped at twice its size, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: per * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 10, "b": 1000, "c": 5, "d": 7}, {"a": 5, "b": 0, None: 100}, {"z": 1, "é": 1, "~": 900, "=": 3},
                                   {"a": 0}, {"s%02d" % i: 17 * i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def rows_of(spark, seed=1):
    import random
    rng = random.Random(seed)
    rows = [(i, "big" if rng.random() < 0.5 else rng.choice(["a", "b", "", None]), rng.choice([0, 1, 5, 30, 200])) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(6)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rows, df = rows_of(spark)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 400
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert sum(r["taken"] for r in out) <= 1.5 * sum(sizes.values())
    again = mixing.mix(df.repartition(3)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}


def test_null_and_repeated_ids_empty_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a", "x y z", 1), (4, "a", "x y z", 1), (4, "a", "x y z", 1), (5, "a", None, 1), (6, None, "", 1), (7, None, "w", 1)],
                               "doc_id long, source string, text string, size int")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} <= {None, 4, 7}


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r["target"], r["taken"]) for r in mixing.mix(nothing).collect()] == [(0.0, 0), (0.0, 0)]


def test_columns_with_the_names_of_outputs_come_out_renamed(spark):
    names = ["source_size", "target", "copies", "taken", "rank", "size_before"]
    sized = spark.createDataFrame([(i, "ab"[i % 2], 5, *range(6)) for i in range(20)], "doc_id long, source string, size long, " + ", ".join(f"{n} int" for n in names))
    rows = mixing.mix(sized).collect()
    assert all([r[f"{n}_given"] for n in names] == list(range(6)) and r["source_size"] == 50 for r in rows) and sum(r["taken"] for r in rows) <= 150
