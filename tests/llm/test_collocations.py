import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolens.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[ \t]", piece) if w]


def brute(rows, first, least, share):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            counts.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    out = []
    for (lang, words), a in found.items():
        around = [n for (other, longer), n in found.items() if other == lang and len(longer) > len(words)
                  and any(longer[i:i + len(words)] == words for i in range(len(longer)))]
        if any(100 * n >= share * a for n in around):
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        at[lang] += 1
        if at[lang] <= first:
            ranked.append((lang, at[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return ranked


def made(seed, n):
    rng, words = random.Random(seed), ["a", "B", "c", "É", "dé", "É", "x-y", " z", "\x1c", "#", "a" * 40]
    return [(rng.choice(["en", "en", None, "und", "", "fr"]),
             rng.choice([None, "", " ", "...", *(["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rng.randint(1, 60)))] * 8)]))
            for _ in range(n)]


@pytest.mark.parametrize("first,least,share", [(2000, 2, 80), (5, 3, 50), (2000, 300, 80), (1, 1, 101)])
def test_equals_brute_force(spark, first, least, share):
    rows = made(first + least, 80)
    rows += rows[:5]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(3) for c in ("w1", "n", "k", "f", "a", "phrase", "rank", "cut")}).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, first, least, share).collect())
    assert got == sorted(brute(rows, first, least, share)) and (got or least == 300)


def test_one_language_with_one_phrase_that_holds_most_words(spark):
    rows = [("en", "so it goes " * 400)] * 20 + made(1, 10)
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect())
    assert got == sorted(brute(rows, 2000, 30, 80))


def test_products_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("CAST(9000000000000000000 AS bigint) AS a", "CAST(9100000000000000000 AS bigint) AS l", "CAST(9200000000000000000 AS bigint) AS r")
    score = row.selectExpr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r) AS s").first()["s"]
    assert score == 2000000 * 9000000000000000000 // (9100000000000000000 + 9200000000000000000)


def test_long_texts_are_read_in_stretches(monkeypatch):
    rows = [("en" if lang is None else lang, (text or "").encode()) for lang, text in made(3, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["lang", "text"])
    monkeypatch.setattr(collocations, "STRETCH", 20)
    monkeypatch.setattr(collocations, "TOKENS", 15)
    monkeypatch.setattr(collocations, "VOCABULARY", 9)
    vocabulary, got, now = collocations.Vocabulary(), [], []
    for ids in vocabulary.chunks(iter([batch])):
        assert len(vocabulary.hash_of(ids)) == len(ids)
        for i in ids.tolist():
            if i:
                now.append(vocabulary.found[i])
            elif now:
                got.append(now)
                now = []
    assert not now and got == [[(lang, w.encode()) for w in words] for lang, text in rows for words in pieces(text.decode()) if words]


def test_empty_table(spark, folder):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert queries.QUERIES["op12_collocations"](spark, folder(documents=empty)).count() == 0
