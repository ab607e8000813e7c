import zlib

import numpy as np
import pytest

from aerolens.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000, 4097])
def test_permutation_is_one_to_one_and_reproducible(n):
    image = sharding.permute(np.arange(n), n, 42)
    assert sorted(image) == list(range(n))
    assert (image == sharding.permute(np.arange(n), n, 42)).all()


def test_permutation_of_very_many_rows_stays_in_range():
    n = 10**17 + 3
    image = sharding.permute(np.array([0, 1, 2, n - 2, n - 1]), n, 1)
    assert len(set(image.tolist())) == 5 and (image >= 0).all() and (image < n).all()


def test_seeds_differ():
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).mean() > 0.9


def rows_law(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_law_holds_with_ties_nulls_and_clashing_columns(spark):
    data = [(i % 7 if i % 3 else None, "same" if i % 2 else None, -1) for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard_before int").repartition(6)
    out = sharding.shard(df, 7, ["doc_id"])
    assert out.columns == ["doc_id", "text", "shard_before", "row", "shard", "slot"]
    rows = out.collect()
    assert sorted(r["row"] for r in rows) == list(range(500))
    rows_law(rows, 7)


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), 4, ["doc_id"]).count() == 0


def test_placement_does_not_depend_on_partitions(spark):
    df = spark.range(300).selectExpr("id AS doc_id")
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(9), 5, ["doc_id"]).collect()}
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(2), 5, ["doc_id"]).collect()}
    assert a == b


def test_query_columns(spark, folder):
    path = folder(documents=spark.createDataFrame([(1, "é"), (2, None), (3, "")], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in queries.op1_sharding(spark, path).collect()}
    assert [rows[i]["size"] for i in (1, 2, 3)] == [18, 16, 16]
    assert rows[1]["text_crc32"] == zlib.crc32("é".encode()) and rows[2]["text_crc32"] == rows[3]["text_crc32"] == 0
    assert {r["law"] for r in rows.values()} == {"rows"} and all(r["grown_shard"] is None for r in rows.values())
    rows_law(list(rows.values()), 40)


def test_columns_with_the_names_of_outputs_come_out_renamed(spark):
    docs = spark.createDataFrame([(i, 7 - i, i * 10, "s", True) for i in range(8)], "doc_id long, row long, shard int, Slot string, row_given boolean")
    out = sharding.shard(docs, 3, ["row"])
    assert out.columns == ["doc_id", "row_given_given", "shard_given", "Slot_given", "row_given", "row", "shard", "slot"]
    assert all(r["row"] == r["row_given_given"] == 7 - r["doc_id"] and r["shard_given"] == 10 * r["doc_id"] for r in out.collect())


def test_slots_are_exact_beyond_53_bits(spark):
    big = 2 ** 61 + 12345
    assert spark.sql(f"SELECT {big}L div 40 AS slot").first()["slot"] == big // 40
