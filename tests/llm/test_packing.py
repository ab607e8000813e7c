import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolens.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def brute_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture
def docs(spark, prose):
    """Null, empty, repeated and long texts, and names that the operator uses itself."""
    rows = [(i, prose(1 + i * 7 % 40, i), i) for i in range(60)]
    rows += [(60, None, 1), (61, "", 2), (None, prose(9, 5), 3), (5, rows[5][1], 4), (5, rows[5][1], 5), (62, prose(4000, 3), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumns(
        {c: F.lit("x") for c in ("part", "before", "start", "offset", "sequence_id", "records", "n_tokens", "n")}).repartition(5)


@pytest.mark.parametrize("size", [1, 16, 100, 4096, 1 << 20])
def test_sequences_hold_every_id_once_and_only_the_last_is_short(docs, size):
    rows = sorted(packing.pack(docs, PATH, 2, size, 7).collect())
    assert [r["sequence_id"] for r in rows] == list(range(len(rows)))
    total = sum(r["n"] for r in rows)
    assert all(r["n"] == size for r in rows[:-1]) and total == sum(len(brute_ids(r["text"])) for r in docs.collect())
    flat = []
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == (r["n"] if r["n"] & (r["n"] - 1) == 0 else size) and set(ids[r["n"]:]) <= {7}
        at = 0
        for x in r["records"]:
            part = ids[at:at + x["length"]]
            assert x["offset"] == at and zlib.crc32(np.array(part, "<u4").tobytes()) == x["ids_crc32"]
            flat.append((x["doc_id"], x["start"], x["doc_tokens"], part))
            at += x["length"]
        assert at == r["n"]
    seen, now = Counter(), []
    for doc_id, start, doc_tokens, part in flat:  # pieces of a document follow each other
        assert start == len(now)
        now += part
        if len(now) == doc_tokens:
            seen[doc_id, tuple(now)] += 1
            now = []
    assert not now and seen == Counter((r["doc_id"], tuple(brute_ids(r["text"]))) for r in docs.collect())


def test_a_sequence_is_put_together_from_the_files_it_spans(docs):
    found = packing.fragments(packing.encode(docs, PATH, 2), 4096)
    assert found.where("n < 4096").count() > 1 and packing.sequences(found).where("n < 4096").count() <= 1


def test_short_last_sequences_at_a_power_of_two_are_not_padded(spark):
    for n, length in ((3, 4), (4, 8)):  # "a" is one id and the end another
        table = spark.createDataFrame([(1, " ".join("a" * n))], "doc_id long, text string")
        row = packing.pack(table, PATH, 2, 8).first()
        assert (row["n"], len(row["ids"]) // 4) == (n + 1, length)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(empty, PATH).count() == 0
    assert packing.pieces(packing.fragments(packing.encode(empty, PATH, 2))).dtypes[0] == ("doc_id", "string")


def test_query_gives_the_pieces_of_whole_documents(spark, folder, docs):
    rows = queries.QUERIES["op13_packing"](spark, folder(documents=docs.drop("n"))).collect()
    at, tokens = 0, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert (r["sequence_id"], r["offset"]) == divmod(at, 4096)
        at += r["length"]
        tokens[r["doc_id"]] += r["length"]
    assert tokens[60] == tokens[61] == 1 and tokens[62] == len(brute_ids(docs.where("doc_id = 62").first()["text"]))
