import os
import random

import pytest

from aerolens.llm import decontamination as dec
from aerolens.llm import queries
from aerolens.llm.texts import plain_words


def least_edits(item, words):
    """Edits between an item and the best stretch of a text, by the full table."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        row, last = [i], row
        for j, y in enumerate(words, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + (kind != 2)] = [] if kind == 1 else ["zzz"]
    return words


def test_bit_parallel_match_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item = rng.choices(range(1, 5), k=rng.randint(1, 70))
        text = rng.choices(range(5), k=rng.randint(0, 120))
        masks = {}
        for i, x in enumerate(item):
            masks[x] = masks.get(x, 0) | 1 << i
        edits, end = dec.best_match(masks, len(item), text)
        assert edits == least_edits(item, text)
        assert edits == len(item) or least_edits(item, text[:end]) == edits


def corpus(prose, n=240):
    rng = random.Random(5)
    items = [(i, prose(rng.choice([3, 5, 7, 12, 18, 33, 60]), 1000 + i)) for i in range(30)]
    docs = []
    for i in range(n):
        words = prose(rng.choice([0, 3, 40, 150, 600]), i).split()
        if i % 2:
            item = items[rng.randrange(30)][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(item, rng.randint(0, dec.most_edits(len(item)) + 2), rng)
        docs.append((i, " ".join(words).title() if i % 3 else ", ".join(words)))
    return items, docs


def brute(items, docs):
    found = {}
    for d, text in docs:
        words = plain_words((text or "").encode())
        for i, item in items:
            parts = plain_words((item or "").encode())
            if parts and (e := least_edits(parts, words)) <= dec.most_edits(len(parts)):
                found[d, i] = e
    return found


def test_leaks_equal_brute_force(spark, prose):
    items, docs = corpus(prose)
    want = brute(items, docs)
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, item_id int, edits int").repartition(4)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dec.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want)


def test_blocks_of_the_benchmark_find_the_same(spark, prose, monkeypatch):
    items, docs = corpus(prose, 80)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dec, "BLOCK_WORDS", 300)
    assert len(list(dec.blocks(i))) > 1
    got = {(r["doc_id"], r["item_id"]) for r in dec.find_leaks(d, i).collect()}
    want = set(brute(items, docs))
    assert got <= want and len(got) >= 0.98 * len(want)
    kept = {r["doc_id"] for r in dec.without_leaks(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in got}


def test_nulls_short_items_repeats_and_long_texts(spark, prose):
    item = prose(30, 1)
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one two"), (None, prose(20, 9))], "item_id long, text string")
    long = prose(30_000, 2) + " " + item + " " + prose(500, 3)
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "One, two!", 1), (4, long, 1), (4, long, 1), (None, item, 1), (5, prose(20, 9), 1)],
                                 "doc_id long, text string, leaks int")
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in dec.find_leaks(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(3, 4, 0)] + [(4, 1, 0)] * 4 + [(None, 1, 0)] * 2 + [(5, None, 0)], key=str)
    out = dec.without_leaks(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in dec.without_leaks(docs, items, min_words=5).collect()) == [1, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 10, 15, 24, 40, 64])
def test_recall_by_length_in_running_text(prose, n):
    rng = random.Random(n)
    items = [(i, prose(n, 7000 + i)) for i in range(60)]
    index, hits = dec.Index(items), 0
    for trial in range(300):
        i, item = rng.choice(items)
        words = prose(120, trial).split()
        at = rng.randint(0, len(words))
        words[at:at] = edited(item.split(), dec.most_edits(n), rng)
        found = {index.item_ids[p]: edits for p, edits, _ in index.search(" ".join(words).encode())}
        assert all(found[j] == least_edits(plain_words(dict(items)[j].encode()), plain_words(" ".join(words).encode())) for j in found)
        hits += i in found
    assert hits >= 0.99 * 300


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.find_leaks(docs, none).count() == 0 and dec.without_leaks(docs, none).count() == 1
    assert dec.find_leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert set(dec.find_leaks(docs, none).columns) == set(dec.find_leaks(docs, docs.withColumnRenamed("doc_id", "item_id")).columns)


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_query_equals_brute_force_on_exact_passages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    coded = [(d, b" " + b" ".join(plain_words(t.encode())) + b" ") for d, t in docs]
    exact = {(d, i) for i, t in items for d, text in coded if b" " + b" ".join(plain_words(t.encode())) + b" " in text}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op5_decontamination(spark, DATA).collect()}
    assert exact <= set(got) and all(s >= dec.SIMILARITY for s in got.values())
    by = dict(docs)
    for (d, i) in set(got) - exact:
        item = plain_words(dict(items)[i].encode())
        assert least_edits(item, plain_words(by[d].encode())) <= dec.most_edits(len(item))
