"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata on its trie, context windows."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolens.llm.texts import map_texts
from aerolens.session import written

#: Labelled rows that the classifier is fitted on at most (lowest id hashes), and lexicon terms.
LABELLED, LEXICON = 20_000, 1_000
#: A term must stand in this share of the toxic texts, in five of them at least, and be so much likelier there (log).
SUPPORT, LOG_ODDS = 0.005, 1.5
#: Stems are word starts of these lengths.
STEMS = range(5, 9)
#: Words to either side that tell quotation from abuse; what a worker remembers of words and automaton steps.
WINDOW, REMEMBERED, STEPS = 6, 400_000, 400_000

EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”«»„‘’…¿¡"
OPENING, CLOSING = tuple("\"“«„"), "\"”»“"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes quoting term word sagte schrieb nannte dit écrit dijo escribió".split())


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; 0 is held out, and so is a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def tokens(text: str | None) -> list[str]:
    return [w for c in (text or "").lower().split() if (w := c.strip(EDGE))]


def terms(text: str | None) -> set[str]:
    """Distinct words and stems (marked by a trailing ``*``) of a text."""
    distinct = set(tokens(text))
    return distinct | {w[:n] + "*" for w in distinct for n in STEMS if len(w) > n}


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The Levenshtein automata of all terms, run at once over the terms' trie.

    A state is a set of (trie node, edits so far), smallest edits only, closed under skipped letters; states and
    steps are made when a word first needs them and remembered up to a bound.
    """

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.most = [0]
        for term in weights:
            node = 0
            for letter in term:
                self.most[node] = max(self.most[node], edits_allowed(term))
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][letter]
            self.most[node] = max(self.most[node], edits_allowed(term))
            self.ends[node] = term
        self.weights = weights
        self.reset()

    def reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self.number({0: 0})

    def number(self, state: dict[int, int]) -> int:
        """The state's number after skipping letters of terms; -1 if it is empty."""
        todo = sorted(state.items())
        while todo:
            node, edits = todo.pop()
            if state.get(node) == edits:
                for child in self.children[node].values():
                    if edits + 1 <= self.most[child] and edits + 1 < state.get(child, 9):
                        state[child] = edits + 1
                        todo.append((child, edits + 1))
        if not state:
            return -1
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < after.get(node, 9):
                after[node] = edits

        for node, edits in self.states[state].items():
            reach(node, edits + 1)  # a letter too many
            for own, child in self.children[node].items():
                reach(child, edits + (own != letter))
        return self.number(after)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term within its allowed edits of ``word`` of least edits, then largest weight, then by text."""
        if len(self.steps) > STEPS:
            self.reset()
        state = self.start
        for letter in word:
            if (after := self.steps.get((state, letter))) is None:
                after = self.steps[state, letter] = self.step(state, letter)
            if after < 0:
                return None
            state = after
        found = [(edits, -self.weights[t], t) for node, edits in self.states[state].items()
                 if (t := self.ends.get(node)) and edits <= edits_allowed(t)]
        return (min(found)[2], min(found)[0]) if found else None


class Scorer:
    """Features of whole texts by a lexicon of words and stems with their log odds."""

    NAMES = ("exact", "stem", "misspelled", "quoted", "density", "hits", "length")

    def __init__(self, lexicon: dict[str, float]):
        self.words = {t: w for t, w in lexicon.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in lexicon.items() if t.endswith("*")}
        self.automaton = Automaton(self.words)
        self.known: dict[str, tuple | None] = {}

    def look_up(self, chunk: str) -> tuple | None:
        """(kind, term, weight) of a chunk between white space, None for a harmless one. kind: 0 exact, 1 stem, 2 misspelled."""
        word = chunk.strip(EDGE)
        if word in self.words:
            return 0, word, self.words[word]
        stem = max(((self.stems[s], s) for n in STEMS if len(word) > n and (s := word[:n]) in self.stems), default=None)
        if stem:
            return 1, word, stem[0]
        if len(word) >= 4 and (near := self.automaton.match(word)):
            return 2, near[0], self.words[near[0]] / (1 + near[1])
        return None

    def context(self, chunks: list[str], at: int) -> float:
        """Share of the signs of quotation around a place: quotation marks on both sides, a word of reporting."""
        before, after = chunks[max(0, at - WINDOW):at + 1], chunks[at:at + WINDOW + 1]
        marked = any(c.startswith(OPENING) for c in before) and any(c.rstrip(".,;:!?").endswith(tuple(CLOSING)) for c in after)
        reported = any(c.strip(EDGE) in REPORTING for c in before[:-1])
        return 0.5 * marked + 0.5 * reported

    def features(self, text: str | None) -> list[float]:
        chunks = (text or "").lower().split()
        if missing := set(chunks).difference(self.known):
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = set(chunks)
            for chunk in missing:
                self.known[chunk] = self.look_up(chunk)
        best: list[dict[str, float]] = [{}, {}, {}, {}]
        weight, hits = 0.0, 0
        for at, hit in enumerate(map(self.known.__getitem__, chunks)):
            if hit:
                kind, term, w = hit
                quoted = self.context(chunks, at)
                weight, hits = weight + w * (1 - quoted), hits + 1
                best[kind][term] = max(best[kind].get(term, 0.0), w * (1 - quoted))
                if quoted:
                    best[3][term] = max(best[3].get(term, 0.0), w * quoted)
        n = max(1, len(chunks))
        return [*(math.log1p(sum(b.values())) for b in best), math.log1p(100 * weight / n), math.log1p(hits), math.log1p(n) / 5]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on a bounded sample; (weights, intercept)."""
    ones = np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(ones.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ones @ beta, -30, 30)))
        gradient = ones.T @ (y - p) - penalty * beta
        move = np.linalg.solve((ones * (p * (1 - p) + 1e-9)[:, None]).T @ ones + np.diag(penalty), gradient)
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(toxic, text) of at most ``most`` labelled ids outside the held-out fold, those of the lowest hashes; equal texts once."""
    rows = (labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # the limit bounds the broadcast side
    return written(chosen.where("text IS NOT NULL").select((F.col("toxic") != 0).cast("int").alias("toxic"), "text")
                   .dropDuplicates(["toxic", "text"]), "toxicity-training")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[dict[str, float], np.ndarray, float]:
    """(lexicon, feature weights, intercept) from a bounded sample of labelled rows.

    Without a toxic and a clean row the lexicon is empty and every score is the share of toxic rows (0.5: none).
    """
    rows = training_rows(docs, labels, most)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return {}, np.zeros(len(Scorer.NAMES)), math.log(share / (1 - share))
    least = max(5, SUPPORT * n_toxic)
    in_toxic = _counts(rows.where("toxic = 1"), lambda text: terms(text)).where(F.col("n") >= least)
    toxic = {r["term"]: r["n"] for r in in_toxic.collect()}  # at most 1 / SUPPORT times the terms of a text
    some = frozenset(toxic)
    clean = {r["term"]: r["n"] for r in _counts(rows.where("toxic = 0"), lambda text: terms(text) & some).collect()}
    odds = {t: math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, k in toxic.items()}
    best = sorted((t for t, w in odds.items() if w >= LOG_ODDS), key=lambda t: (-odds[t] * toxic[t], t))[:LEXICON]
    lexicon = {t: odds[t] for t in best}
    sample = np.array([[r["toxic"], *r["f"]] for r in _with_features(rows, lexicon).select("toxic", "f").collect()])
    sample = sample[np.lexsort(sample.T)]  # the fit does not depend on the order of partitions
    return lexicon, *fit_logistic(sample[:, 1:], sample[:, 0])


def _counts(rows: DataFrame, of) -> DataFrame:
    """(term, n): texts that hold each term of ``of(text)``."""
    def make():
        def count(texts):
            return [[sorted(of(t.decode())) for t in texts]]
        return count
    return map_texts(rows.select("text"), "text", "terms array<string>", make).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def make():
        scorer = Scorer(lexicon)
        return lambda texts: [[scorer.features(t.decode() if t else None) for t in texts]]
    return map_texts(rows, "text", "f array<double>", make)


def score(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    Terms likelier in toxic texts make the lexicon; misspelled ones are found by Levenshtein automata over its
    trie; hits inside quotation or after words of reporting count as quotation. A logistic regression on
    seven features gives the score. No shuffle of texts but the bounded training rows. Null texts are
    scored as empty ones.
    """
    lexicon, weights, intercept = learn(docs, labels, most)
    scored = _with_features(docs.select("doc_id", "text"), lexicon)
    z = F.lit(intercept)
    for i, w in enumerate(weights):
        z = z + F.lit(float(w)) * F.col("f")[i]
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
