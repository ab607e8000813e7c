import random

import numpy as np
import pytest

from aerolens.llm import fuzzy_lines as fl
from aerolens.session import shared_dir, subfolders


def jaccard(a, b):
    a, b = fl.shingles(a), fl.shingles(b)
    return len(a & b) / len(a | b)


def brute_kept(docs):
    """(doc, line number) of the lines that stay, by all pairs of distinct lines."""
    where = {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        for n, line in enumerate((text or "").split("\n")):
            if line := fl.normal(line):
                where.setdefault(line, []).append((doc_id, n))
    lines = list(where)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(lines)):
        for j in range(i):
            if jaccard(lines[i], lines[j]) >= fl.SIMILARITY:
                parent[find(i)] = find(j)
    first = {}
    for i, line in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (9e9, 0)), min(where[line]))
    return set(first.values())


def variant(line, rng, edits):
    chars = list(line)
    for _ in range(edits):
        chars[rng.randrange(len(chars))] = rng.choice("xyz")
    return "".join(chars)


def corpus(prose, n=60):
    rng = random.Random(6)
    bases = [prose(rng.randint(8, 40), 50 + i) for i in range(25)]
    docs = []
    for d in range(n):
        lines = [prose(rng.randint(1, 30), 1000 * d + i) for i in range(rng.randint(0, 4))]
        lines += [variant(rng.choice(bases), rng, rng.choice([0, 0, 1, 1, 2])) for _ in range(rng.randint(0, 5))]
        lines += rng.choices(["", "  ", "ok", "Ok ", "a line that all share  here", "A line that all share here"], k=2)
        rng.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    return docs


def got(df):
    return {(r["doc_id"], n) for r in fl.kept_lines(df).collect() for n in r["kept"]}


@pytest.fixture(params=[32, 1], ids=["small_buckets_in_pairs", "all_buckets_by_changes"])
def paired(request, monkeypatch):
    monkeypatch.setattr(fl, "PAIRED", request.param)


def test_kept_lines_equal_brute_force(spark, prose, paired):
    docs = corpus(prose)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int").repartition(5)
    want = brute_kept(docs)
    result = got(df)
    # a pair at 0.8 is missed once in 200, so a component may rarely stay in two
    assert want <= result and len(result - want) <= 0.01 * len(want)


def test_many_versions_of_one_line_are_one_component(spark, prose, paired):
    rng, base = random.Random(1), prose(60, 1)
    docs = [(0, base), (1, base)] + [(i, variant(base, rng, 2)) for i in range(2, 300)]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)) == {(0, 0)}


def test_chains_without_a_common_centre(spark, prose, paired):
    words = prose(60, 2).split()
    docs = [(i, " ".join([f"w{j:03d}" for j in range(i)] + words[i:])) for i in range(30)]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute_kept(docs)


def versions(prose, n=150):
    """Versions of one line far from it: some alike among themselves, some cut at the same place, some alone."""
    rng, base = random.Random(9), prose(45, 5)
    lines = [base] * 3
    for i in range(n):
        line = variant(base, rng, rng.choice([1, 4, 9, 14]))
        lines.append(line)
        if i % 3 == 0:
            lines += [variant(line, rng, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 3))]
        if i % 5 == 0:
            cut = base[:len(base) - rng.choice([60, 70, 75])]
            lines.append(variant(cut, rng, rng.choice([0, 1, 2])))
    return lines


def test_far_pairs_lose_no_link(spark, prose):
    lines = sorted(set(versions(prose)))
    sets, base = [fl.shingles(x) for x in lines], lines.index(prose(45, 5))
    star = [(base, i, True) for i in range(len(lines)) if i != base]
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    comparisons = fl.compared(spark.createDataFrame(star, "a long, b long, large boolean"), texts).cache()
    linked = {r["b"] for r in comparisons.where("linked").collect()}
    assert linked == {i for i in range(len(lines)) if i != base and fl.alike(sets[base], sets[i])} and 0 < len(linked) < len(lines) - 20
    roots = spark.createDataFrame([(i, base) for i in [*linked, base]], "node long, root long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in fl.far_pairs(comparisons, roots).collect()}
    others = [i for i in range(len(lines)) if i != base]
    want = {(i, j) for i in others for j in others if i < j and fl.alike(sets[i], sets[j]) and not {i, j} <= linked}
    every = {(i, j) for i in others for j in others if i < j and not {i, j} <= linked}
    assert want <= got and len(want) > 30 and len(got) < len(every) / 4


def test_versions_of_a_line_equal_brute_force(spark, prose, paired):
    docs = list(enumerate(versions(prose)))
    want, result = brute_kept(docs), got(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert want <= result and len(result - want) <= 1


def test_signatures_agree_as_often_as_sets_do(prose):
    rng, hits, sims = random.Random(4), [], []
    for i in range(150):
        a = prose(30, i)
        b = variant(a, rng, rng.randint(1, 6))
        keys = fl.band_keys([a, b])
        hits.append((keys[0] == keys[1]).mean())
        sims.append(jaccard(a, b) ** fl.ROWS)
    assert abs(np.mean(hits) - np.mean(sims)) < 0.04


def test_equal_lines_have_equal_keys_whatever_is_beside_them(prose):
    lines = [prose(n, n) for n in (1, 2, 5, 300, 40, 7)] + ["x", "ab", "é" * 7]
    together = fl.band_keys(lines)
    for i, line in enumerate(lines):
        assert (fl.band_keys([line]) == together[i]).all()


def test_runs_at_partition_edges(spark):
    entries = [((1 << 60) + (k % 13 if k % 2 else 5), (-1 << 62) + k % 40) for k in range(700)]
    df = spark.createDataFrame(entries * 2, "key long, h long").repartition(5)
    out = [(r["key"], r["h"]) for r in fl.shared_buckets(df).collect()]
    by = {}
    for k, h in set(entries):
        by.setdefault(k, set()).add(h)
    assert {(k, h) for k, hs in by.items() if len(hs) > 1 for h in hs} <= set(out) <= set(entries)


def test_texts_keep_blank_lines_nulls_and_columns(spark, prose):
    a, b = prose(20, 1), prose(20, 2)
    df = spark.createDataFrame([(1, f"{a}\n\n{b}\n", 1), (2, f"{b}\n{a.upper()}", 1), (2, f"{b}\n{a.upper()}", 1), (3, None, 1), (4, "", 1), (None, a, 1)],
                               "doc_id long, text string, kept int")
    out = fl.dedup_lines(df)
    assert out.columns == df.columns
    rows = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert rows == sorted([(False, 1, f"\n{b}\n"), (False, 2, ""), (False, 2, ""), (False, 3, None), (False, 4, ""), (True, None, a)], key=str)


def test_lines_of_a_text_are_the_normal_lines():
    rng, chars = random.Random(3), list("aAΣσİß\t\r\n\n\x0b\x0c\x1c\u0085  \u00a0.X")
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(3000)] + ["", "\n", " \n\t\n", "ΑΣ\nΣ", "a\ud800  b"]
    for text in texts:
        assert fl.normal_lines(text) == [fl.normal(x).encode("utf-8", "surrogatepass") for x in text.split("\n")]
    assert fl.normal_lines(None) == [b""]


def test_links_of_buckets_are_few_for_many_versions(spark, prose):
    """A line that meets the others in many buckets is linked once, to the smallest of its component."""
    line = prose(30, 3)
    lines = [line] + [line + f" {i}" for i in range(12)]
    members = spark.createDataFrame([(k, h) for k in range(6) for h in range(13) if (h + k) % 4], "key long, h long")
    counts = spark.createDataFrame([(h, (h * 7) % 5) for h in range(13)], "h long, copies long")
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    links = {tuple(sorted((r["a"], r["b"]))) for r in fl.bucket_links(members, texts, counts, fl.shingles, "t").collect() if r["a"] != r["b"]}
    assert links == {(0, h) for h in range(1, 13)}


def test_sizes_of_sets_equal_those_of_sets_of_strings(prose):
    """Also of lines under a shingle's length, surrogates, letters that take few bits or many, and more than 512 characters."""
    rng = random.Random(11)
    lines = ["", "x", "ab" * 40, "é" * 7, "a\ud800 b c d e", "".join(map(chr, range(0x4E00, 0x5100))), "жук 日本 🙂 " * 9]
    lines += [variant(prose(n, n), rng, k) for n in (1, 4, 30, 400) for k in (0, 1, 5)]
    for some in (lines, lines[:5] + lines[6:]):
        xs, ys = zip(*[(x, y) for x in some for y in some])
        want = [(len(a), len(b), len(a & b)) for a, b in ((fl.shingles(x), fl.shingles(y)) for x, y in zip(xs, ys))]
        assert fl.overlaps(list(xs), list(ys)).T.tolist() == [list(w) for w in want]
    assert fl.overlaps([], []).shape == (3, 0)


def test_empty_table(spark):
    assert fl.kept_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_tables_that_are_still_read_stay(spark, prose, monkeypatch):
    before, found = set(subfolders(spark, shared_dir(spark))), []

    def there():
        return sorted({x.rsplit("-", 1)[0] for x in set(subfolders(spark, shared_dir(spark))) - before})
    links = fl.bucket_links
    monkeypatch.setattr(fl, "bucket_links", lambda *a: found.append(there()) or links(*a))
    docs = corpus(prose, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = fl.kept_lines(df)
    assert found == [["lines-buckets", "lines-counts", "lines-texts"]]
    assert there() == ["lines-components", "lines-counts"]
    assert {(r["doc_id"], n) for r in kept.collect() for n in r["kept"]} == brute_kept(docs)


@pytest.mark.parametrize("passes", [1, 3, 10])
def test_passes_share_the_bands(spark, prose, monkeypatch, passes):
    monkeypatch.setattr(fl, "PASSES", passes)
    docs = corpus(prose, 30)
    seen = []
    shared = fl.shared_buckets
    monkeypatch.setattr(fl, "shared_buckets", lambda df: seen.append(df.count()) or shared(df))
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute_kept(docs)
    assert len(seen) == passes and sum(seen) % fl.BANDS == 0 and max(seen) <= sum(seen) * -(-fl.BANDS // passes) // fl.BANDS
