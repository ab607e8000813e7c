import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from aerolens.llm import decontamination as dec
from aerolens.llm import quality
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_fingerprint, brute_roots

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def through(spark, docs, folder, tmp_path):
    """What each stage returns, written and reread."""
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        out.append(docs)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good, distinct, clean, mixed, tokens = through(spark, docs, DATA, tmp_path)
    rows = [tuple(r) for r in docs.collect()]
    assert [d.columns for d in (good, distinct, clean, mixed)] == [COLUMNS] * 4

    kept = {r[0]: r for r in rows if quality.measure((r[1] or "").encode())[-1]}
    assert {tuple(r) for r in good.collect()} == set(kept.values()) and 0 < len(kept) < len(rows)

    prints = {i: brute_fingerprint(r[1]) for i, r in kept.items()}
    roots, best = brute_roots(set(prints.values())), {}
    for i, fp in prints.items():
        best[roots[fp]] = min(i, best.get(roots[fp], i))
    assert {r["doc_id"] for r in distinct.collect()} == set(best.values())

    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    some = [(i, kept[i][1]) for i in best.values()]
    leaked = {d for d, _ in brute_leaks(items, some)}
    left = set(best.values()) - leaked
    assert {r["doc_id"] for r in clean.collect()} == left

    copies, size, source = Counter(r["doc_id"] for r in mixed.collect()), {}, {}
    assert set(copies) <= left and max(copies.values()) <= 2
    for i in left:
        size[i] = len(kept[i][1].split())
        source[kept[i][3]] = source.get(kept[i][3], 0) + size[i]
    for s, want in brute_targets(source).items():
        own = [i for i in left if kept[i][3] == s]
        assert abs(sum(copies[i] * size[i] for i in own) - want) <= 2 * max(size[i] for i in own)

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for row in tokens.orderBy("start").collect():
        ids = np.array(tokenizer.encode(kept[row["doc_id"]][1], add_special_tokens=False).ids + [2], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert Counter(r["doc_id"] for r in tokens.collect()) == copies


def test_edge_rows_and_clashing_columns_go_through(spark, folder, tmp_path, prose):
    rows = [(1, prose(80, 1), "en", "a", 1, 1, 1), (1, prose(80, 1), "en", "a", 1, 1, 1), (2, None, None, None, None, 1, 1), (3, "", "en", "a", 0, 1, 1),
            (None, prose(90, 2), None, None, None, None, None), (4, prose(20_000, 3), "en", "b", 9, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, fp long")
    path = folder(benchmark=spark.createDataFrame([(1, prose(30, 7)), (None, None)], "item_id long, text string"))
    out = through(spark, docs, path, tmp_path)
    assert all(d.columns == docs.columns for d in out[:4])
    assert {r["doc_id"] for r in out[2].collect()} == {1, None, 4} and out[2].count() == 3


def test_stages_can_be_chained_without_writing(spark, folder, prose):
    docs = spark.createDataFrame([(i, prose(100, i % 7), "en", "a", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    path = folder(documents=docs, benchmark=spark.createDataFrame([(1, prose(30, 70))], "item_id long, text string"))
    out = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, path)
    assert {r["doc_id"] for r in out.collect()} <= set(range(7))


def test_empty_documents(spark, folder):
    path = folder(documents=spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_leak_rule_is_the_operators():
    assert dec.SIMILARITY == 0.8 and dec.most_edits(4) == 0 and dec.most_edits(5) == 1


def test_stages_get_texts_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(40).selectExpr("repeat('word ', 200000) AS text").coalesce(1)
    got = [r["n"] for r in corpus_pipeline.stage(lambda s, d, _: d.mapInArrow(sizes, "n long"))(spark, docs, "").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 10_000_000
