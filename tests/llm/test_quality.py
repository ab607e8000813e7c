import random
import re
from collections import Counter

from aerolens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def brute_shares(text):
    words = WORD.findall(text)
    total, out = sum(map(len, words)), []
    for n in quality.MOST_IN_GRAMS:
        seen, hit = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i:i + n])
            if gram in seen:
                hit |= set(range(i, i + n))
            seen.add(gram)
        out.append(sum(len(words[i]) for i in hit) / total)
    return out


def texts():
    rng = random.Random(8)
    parts = ["a", "bé", "c#", "|", "ñandú", "d\n", "e\n", "\x1c", " f", "\t", "\x0b"]
    made = [" ".join(rng.choices(parts, k=rng.randint(0, 250))) for _ in range(200)]
    return [*made, None, "", "\n\n", "same line\n" * 80, "w " * 20_000, "\r\nx\r\nx\r\n", "𝔘nicode " * 60]


def test_base_columns_equal_brute_force(spark):
    some = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string").repartition(4)
    for r in quality.with_quality(df).collect():
        want = brute_base(some[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])


def test_duplicated_characters_equal_brute_force(prose):
    base = prose(200, 1).split()
    for k in (0, 4, 12, 40):
        text = " ".join(base + base[:k] + prose(50, 2).split() + base[30:30 + k])
        row = quality.measure(text.encode())
        assert list(map(lambda x: round(x, 9), row[6:6 + len(quality.MOST_IN_GRAMS)])) == [round(x, 9) for x in brute_shares(text)]


def test_repetitive_texts_go_and_clean_ones_stay(spark, prose):
    clean, line = prose(300, 3), prose(12, 4)
    df = spark.createDataFrame([(1, clean, 5), (2, clean + " " + clean, 5), (3, clean + ("\n" + line) * 40, 5), (4, None, 5), (5, prose(49, 5), 5),
                                (1, clean, 5)], "doc_id long, text string, kept int")
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 1]


def test_empty_table(spark):
    assert quality.keep_good(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_the_names_of_outputs_come_out_renamed(spark, prose):
    docs = spark.createDataFrame([(1, prose(80, 1), 5, "x")], "doc_id long, text string, kept int, n_words string")
    row = quality.with_quality(docs).first()
    assert (row["kept"], row["kept_given"], row["n_words"], row["n_words_given"]) == (True, 5, 80, "x")
    assert quality.keep_good(docs).columns == docs.columns
