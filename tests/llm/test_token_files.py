import gc
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolens.llm import token_files as tf
from aerolens.llm.texts import importable, map_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Don't STOP it's 's 'S '", "á ́ éé É", "x!!…y ?¿¡!! 1234 12.5%", "<|endoftext|> <|startoftext|>a <|endoftext", "tab\tnew\nline\r\n\x0b\x0c",
       "a\x1cb\x1d \x1ec\x1f", "nbsp thin ideo　x​y", "ΑΣ ΣΑΣ. İI ı ſ ß ẞ", "日本語 テスト 한국어 عربى हिन्दी", "🙂🙂 👩‍👩‍👧 ,,,...", "²³½ Ⅷ ª º", "≠ ≠ a_b_c __",
       "̈́ क़ יִ Ω Å", "w" * 5000, "don’t ‘quote’ “x”", "l'été d'abord aujourd'hui rock'n'roll", "(a) [b] {c} <d> #e# *f* $5 &c; %", "A" * 3 + "'" * 4 + "ll're"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_the_library(library, prose):
    encoder = tf.Encoder(PATH)
    for text in [None, *ODD, *ODD, prose(3000, 1), prose(3000, 1).title(), " ".join(ODD)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text).tolist(), text


def test_bounded_tables_do_not_change_ids(library, prose, monkeypatch):
    monkeypatch.setattr(tf, "CHUNKS", 50)
    monkeypatch.setattr(tf, "WORDS", 40)
    encoder = tf.Encoder(PATH)
    for i in range(20):
        text = prose(200, i % 7) + " " + ODD[i % len(ODD)]
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text).tolist()


def test_files_give_back_every_id(spark, tmp_path, library, prose):
    texts = [(i * 7 % 101, prose(i % 60, i) if i % 5 else ODD[i % len(ODD)], "x") for i in range(101)] + [(500, None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string").repartition(6)
    path = str(tmp_path / "tokens")
    tf.write_tokens(df, path, PATH, 2)
    tokens = tf.read_tokens(spark, path)
    rows = sorted(tf.digests(tokens).collect())
    start = 0
    for (doc_id, text, _), row in zip(sorted(texts), rows):
        ids = np.r_[library(text), [2]].astype("<u4")
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = tokens.where("doc_id = 7")
    assert one.first()["ids"][:-1] == library(dict((d, t) for d, t, _ in texts)[7]).tolist()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString().replace("Or(", "(")
    order = [r["doc_id"] for r in tf.positions(tokens).orderBy("start").collect()]
    assert order == sorted(order)


def test_files_have_bloom_filters_and_indexes(spark, tmp_path):
    from pyarrow import orc
    path = str(tmp_path / "tokens")
    tf.write_tokens(spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), path, PATH, 2)
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert files
    info = orc.ORCFile(f"{path}/{files[0]}")
    assert info.row_index_stride == 10000 and info.nrows > 0 and info.compression == "ZSTD"


def test_lookups_skip_row_groups(spark, tmp_path):
    """One file of many row groups: an id reads its row group; an absent id between the least and the greatest reads none."""
    path, one = str(tmp_path / "tokens"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tf.write_tokens(spark.range(50_000).selectExpr("2 * id AS doc_id", "concat('text ', id) AS text"), path, PATH, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", one)

    def read(doc_id):
        df = tf.read_tokens(spark, path).where(f"doc_id = {doc_id}")
        rows, plan = df.collect(), df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return len(rows), leaf.metrics().apply("numOutputRows").value()

    assert read(60_000) == (1, 10_000)
    absent = [read(2 * i + 1) for i in range(1_000, 50_000, 5_000)]
    assert all(n == 0 for n, _ in absent) and sum(scanned == 0 for _, scanned in absent) >= 8


def test_ties_nulls_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    tf.write_tokens(df, path, PATH, 2)
    rows = sorted(tf.digests(tf.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1]
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(5)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([], "doc_id long, text string")
    tf.write_tokens(df, path, PATH, 2)
    assert tf.digests(tf.read_tokens(spark, path)).count() == 0


def test_other_tasks_let_go_of_the_tables(spark, tmp_path):
    """Workers outlive jobs; the tokenizer's tables grow to some 350 MB."""
    def make():
        left = sum(isinstance(x, tf.Encoder) for x in gc.get_objects())
        return lambda batch: [[left] * len(batch)]

    importable(spark)  # another environment would be other workers
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(4)
    tf.write_tokens(docs, str(tmp_path / "tokens"), PATH, 2)
    assert {r["n"] for r in map_texts(docs, "text", "n int", make).collect()} == {0}
