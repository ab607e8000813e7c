"""License scan: a positional rare-token index over license templates."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.llm.notices import templates
from aerolens.llm.texts import importable, map_texts, plain_words

#: Base phrases and their labels.
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: (label, words, phrases that must stand in their places) of each notice.
TEMPLATES = templates()

#: Rarest words of a template looked up in a file; how many must agree on a place; least matched share of IDF weight.
ANCHORS, AGREE, LEAST = 4, 2, 0.5

VOCABULARY = frozenset(w for _, text, _ in TEMPLATES for w in text.split()) | frozenset(w for p in BASE for w in p.split())


def places(words: list[bytes], at: dict[bytes, list[int]], phrase: bytes) -> list[int]:
    """Word positions where ``phrase`` stands, found from its rarest word in this text."""
    parts = phrase.split()
    if not all(p in at for p in parts):
        return []
    anchor = min(range(len(parts)), key=lambda i: len(at[parts[i]]))
    return [p - anchor for p in at[parts[anchor]] if p >= anchor and words[p - anchor:p - anchor + len(parts)] == parts]


def word_at(text: bytes, phrase: bytes) -> int:
    """Number of words of ``text`` before the first place of ``phrase``."""
    return text[:(b" " + text + b" ").index(b" " + phrase + b" ")].count(b" ")


class Scanner:
    """Postings of the templates' words and the IDF of each word."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES):
        self.idf = idf
        self.templates = []
        for label, text, phrases in templates:
            parts = text.split()
            posting = defaultdict(list)
            for i, w in enumerate(parts):
                posting[w].append(i)
            keys = [(word_at(text, phrase), phrase.split()) for phrase in phrases]
            needed = frozenset(w for _, key in keys for w in key)
            self.templates.append((label, parts, posting, keys, needed, sum(idf[w] for w in parts)))

    def scan(self, text: bytes | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text."""
        words = plain_words(text)
        held = VOCABULARY.intersection(words)
        possible = [t for t in self.templates if t[4] <= held]  # no phrase stands where one of its words is missing
        phrases = [p for p in BASE if held.issuperset(p.split())]
        if not possible and not phrases:
            return len(words), 0, None, None, "", "", 0.0
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in held:
                at[w].append(i)
        base = {p: found for p in phrases if (found := places(words, at, p))}
        starts = [i for found in base.values() for i in found]
        based = {BASE[p] for p in base}
        labels, score = set(based), 0.0
        rare = sorted(at, key=lambda w: (-self.idf[w], w))  # the file's license words, rarest first
        for label, parts, posting, keys, _, weight in possible:
            votes = Counter()
            for w in [w for w in rare if w in posting][:ANCHORS]:
                votes.update({p - i for p in at[w] for i in posting[w]})
            for offset, n in votes.items():
                if n < AGREE or offset < 0 or any(words[offset + i:offset + i + len(key)] != key for i, key in keys):
                    continue
                window = words[offset:offset + len(parts)]
                share = sum(self.idf[w] for w, x in zip(parts, window) if w == x) / weight
                if share >= LEAST or label in based:
                    labels.add(label)
                    score = max(score, min(1.0, share))
        if labels and not score:
            score = LEAST  # a base phrase outside any template's place
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(based)), ",".join(sorted(labels)), round(score, 6))


def word_idf(docs: DataFrame, text: str = "text") -> dict[bytes, float]:
    """Smoothed IDF over all documents of every template word: one value a word of the fixed templates."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, total = Counter(), 0  # the fixed vocabulary at most
        for batch in batches:
            total += batch.num_rows
            for t in batch.column(0).to_pylist():
                counted.update(VOCABULARY.intersection(plain_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counted], pa.binary()), pa.array([total, *counted.values()], pa.int64())], ["word", "n"])

    found = docs.select(F.col(f"`{text}`").cast("binary")).mapInArrow(run, "word binary, n long")
    counted = {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counted.get(b"", 0)  # the empty word counts documents
    return {w: math.log((total + 1) / (counted.get(w, 0) + 1)) + 1 for w in VOCABULARY}


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus what the license scan finds in it.

    A file's highest-IDF license words are looked up in the positional index of each template; offsets on
    which several agree are candidates, all of the template's key phrases must stand in their places, and the IDF
    weight of the words in place gives the score. Base phrases are found wherever they stand. Null texts are
    empty. Two passes over the texts, no shuffle of texts. Columns of ``docs`` that bear
    the name of a new one come out with ``_given`` added.
    """
    idf = word_idf(docs, text)

    def make():
        scanner = Scanner(idf)
        return lambda texts: [list(x) for x in zip(*map(scanner.scan, texts))]
    return map_texts(docs, text, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
