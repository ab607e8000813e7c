import os
import random

import pytest

from aerolens.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(1)
    lexicon = {"".join(rng.choices("abc", k=rng.randint(3, 13))): rng.random() for _ in range(25)}
    automaton = toxicity.Automaton(lexicon)
    words = ["".join(rng.choices("abcd", k=rng.randint(0, 14))) for _ in range(400)]
    for term in lexicon:
        for _ in range(6):
            letters = list(term)
            for _ in range(rng.randint(0, 3)):
                letters[rng.randrange(len(letters) + 1):][:0] = [rng.choice("abc")]
                if letters and rng.random() < 0.5:
                    del letters[rng.randrange(len(letters))]
                if letters and rng.random() < 0.5:
                    letters[rng.randrange(len(letters))] = rng.choice("abc")
            words.append("".join(letters))
    for word in words:
        near = [(d, -w, t) for t, w in lexicon.items() if (d := distance(word, t)) <= toxicity.edits_allowed(t)]
        assert automaton.match(word) == ((min(near)[2], min(near)[0]) if near else None)


def test_bounded_memory_does_not_change_matches(monkeypatch):
    lexicon = {"worthless": 1.0, "pathetic": 2.0, "clown": 3.0}
    monkeypatch.setattr(toxicity, "STEPS", 5)
    automaton = toxicity.Automaton(lexicon)
    assert [automaton.match(w) for w in ("worthles", "pathtic", "clwn", "crown", "table", "klowm")] == [
        ("worthless", 1), ("pathetic", 1), ("clown", 1), ("clown", 1), None, None]


def test_quotation_scores_lower_than_abuse():
    scorer = toxicity.Scorer({"clown": 3.0, "worthless": 3.0})
    abuse = scorer.features("you are a clown and a w0rthless one".strip())
    quoted = scorer.features('he said "you are a clown and a w0rthless one" to them')
    assert abuse[0] > quoted[0] and abuse[2] > quoted[2] and quoted[3] > abuse[3] == 0


def labelled(prose, n=160):
    bad = ["grumblet", "snarkoid", "viletude", "muckling"]
    rng, docs, labels = random.Random(3), [], []
    for i in range(n):
        words, toxic = prose(80, i).split(), i % 4 == 0
        if toxic:
            for _ in range(4):
                term = rng.choice(bad)
                if rng.random() < 0.3:
                    term = term[:3] + term[4:]
                words.insert(rng.randrange(80), term)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def test_held_out_rows_are_never_learnt_from_and_are_found(spark, prose):
    docs, labels = labelled(prose)
    d = spark.createDataFrame(docs + [(None, None, "x"), (900, "", "x"), (900, "", "x")], "doc_id long, text string, score string").repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1, 1, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(d, lab).collect()}
    held = [i for i in range(len(docs)) if rows[i]["held_out"]]
    assert len(held) > 20
    import zlib
    assert held == [i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i in held if rows[i]["predicted"] != (i % 4 == 0)]
    assert len(wrong) <= 1
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t, x) for i, q, t, x in labels], "doc_id long, quality int, toxic int, text string")
    assert {r["doc_id"]: r["score"] for r in toxicity.score(d, flipped).collect()} == {i: r["score"] for i, r in rows.items()}
    assert rows[900]["predicted"] == 0 and 0 <= rows[900]["score"] <= 1 and rows[None]["held_out"]


def test_without_labels_and_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score(docs, none).collect()] == [0.5]
    assert toxicity.score(docs.limit(0), none).count() == 0


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_held_out_accuracy_on_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.op4_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) >= 0.95
