"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit distance."""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolens.llm.running import running
from aerolens.llm.texts import map_texts, n_words, plain_words

#: Least share of an item's words that stay unedited.
SIMILARITY = 0.8
#: Symbols compared in one sample, samples of one walk, and the recall that the walks must reach on edited items in running text.
BITS, SAMPLES, RECALL = 3, 6, 0.99
#: Buckets of the random step function, and words of benchmark items that one pass holds (a block ends with an item).
COINS, BLOCK_WORDS = 4096, 500_000


def most_edits(n: int) -> int:
    return int((1 - SIMILARITY) * n + 1e-9)


def embed(symbols: np.ndarray, starts: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """CGK walks from every start: step j writes the current symbol and moves on if the coin of (j, symbol) says so."""
    out, at = np.empty((len(coins), len(starts)), np.int64), starts.copy()
    for j, coin in enumerate(coins):
        out[j] = symbols[at]
        at += coin[out[j] % COINS]
    return out


def best_match(pattern_masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(least edits, first end) of a pattern of ``m`` symbols against any substring of ``text``: bit-parallel columns."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for i, symbol in enumerate(text):
        eq = pattern_masks.get(symbol, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(horizontal | up) & full, up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best[0]:
            best = (score, i + 1)
    return best


class LengthClass:
    """Items of similar length: one window size, one set of walks, each with its sorted keys and the items' places beside them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], around: np.ndarray, rng: np.random.Generator):
        lengths = [len(x) for _, x in items]
        self.low, self.high = min(lengths), max(lengths)
        self.steps = int(1.8 * self.low)
        # q-gram lemma: an item of n words within k edits shares at least n - q + 1 - q * k of its q-word sequences
        self.q = 3 if min(n - 2 - 3 * most_edits(n) for n in lengths) > 1 else 2
        self.least = min(n - self.q + 1 - self.q * most_edits(n) for n in lengths)
        self.span = self.high + most_edits(self.high)
        self.walks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        own, places = self.joined([x for _, x in items]), np.tile(np.array([p for p, _ in items], np.int32), SAMPLES)
        trial = [items[i][1] for i in rng.permutation(len(items))[:200]] * max(1, 200 // len(items))
        whole, other = self.joined(trial), self.joined([self.edited(x, rng) for x in trial], rng.choice(around, (len(trial), self.steps + 1)))
        found = np.zeros(len(trial), bool)
        # every further walk finds an edited copy with some probability, so the recall is reached
        while len(self.walks) < 2 or found.mean() < RECALL:
            coins = rng.integers(0, 2, (self.steps, COINS))
            # a walk of j steps has read j / 2 words: samples stay within the shortest item
            samples = np.stack([rng.choice(self.steps, BITS, replace=False) for _ in range(SAMPLES)])
            keys = self.keys(*own, coins, samples).ravel()
            order = np.argsort(keys, kind="stable")
            self.walks.append((coins, samples, keys[order], places[order]))
            found |= (self.keys(*whole, coins, samples) == self.keys(*other, coins, samples)).any(axis=0)
        self.recall = float(found.mean())

    def edited(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """As many random edits as still count as a leak."""
        words = list(x)
        for _ in range(most_edits(len(x))):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at:at + (kind != 2)] = [] if kind == 1 else [0]
        return np.array(words, np.int64)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.r_[x, np.full(self.steps + 1, -1)]

    def joined(self, xs: list[np.ndarray], after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sequences one behind the other and where each begins, each with padding, or the words of ``after``, behind it."""
        padded = [self.padded(x) if after is None else np.r_[x, after[i]] for i, x in enumerate(xs)]
        return np.concatenate(padded), np.cumsum([0] + [len(x) for x in padded[:-1]])

    def keys(self, symbols: np.ndarray, starts: np.ndarray, coins: np.ndarray, samples: np.ndarray) -> np.ndarray:
        """One key for each sample and start; the sample's number is part of it."""
        walk = embed(symbols, starts, coins)
        return np.stack([sum(walk[j] * p for j, p in zip(s, (1_000_003, 998_244_353, 2_147_483_629))) * SAMPLES + i for i, s in enumerate(samples)])


class Index:
    """A block of benchmark items: vocabulary, neighbouring word pairs, length classes; items too short for an edit as they are."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = 42, min_words: int = 1):
        rng = np.random.default_rng(seed)
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = [i for i, _ in items]
        self.symbols: dict[int, np.ndarray] = {}
        for place, (_, text) in enumerate(items):
            words = plain_words((text or "").encode())
            if len(words) >= max(1, min_words):
                self.symbols[place] = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
        self.width = len(self.vocabulary) + 1
        groups, short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for place, x in self.symbols.items():
            if most_edits(len(x)):
                groups[int(np.log(len(x)) / np.log(1.4))].append((place, x.astype(np.int64)))
            else:
                short[len(x)][tuple(x.tolist())].append(place)
        coded = [x for group in groups.values() for _, x in group]
        self.grams = {q: np.unique(np.concatenate([self.codes(x, q) for x in coded] or [np.zeros(1, np.int64)])) for q in (2, 3)}
        self.short = {n: (np.unique(np.concatenate([self.codes(np.array(x, np.int64), n) for x in table])), dict(table)) for n, table in short.items()}
        around = np.concatenate(coded) if coded else None
        self.classes = [LengthClass(group, around, rng) for _, group in sorted(groups.items())]

    def masks(self, place: int) -> dict[int, int]:
        """Bit i of a symbol's number says that the item's word i is that symbol."""
        masks: dict[int, int] = defaultdict(int)
        for i, symbol in enumerate(self.symbols[place].tolist()):
            masks[symbol] |= 1 << i
        return masks

    def codes(self, symbols: np.ndarray, q: int) -> np.ndarray:
        """A number for each sequence of ``q`` symbols (equal sequences, equal numbers)."""
        n = len(symbols) - q + 1
        code = symbols[:n]
        for i in range(1, q):
            code = code * self.width + symbols[i:n + i]
        return code

    def shared(self, symbols: np.ndarray, known: np.ndarray, q: int, own: np.ndarray) -> np.ndarray:
        """Places of the text's q-word sequences whose code is among the sorted ``own``."""
        n = len(symbols) - q + 1
        at = known[:max(n, 0)].copy()
        for i in range(1, q):
            at &= known[i:n + i] if n > 0 else at
        at = np.flatnonzero(at)
        if not len(at):
            return at
        code = self.codes(symbols, q)[at]
        return at[own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code]

    def search(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item's place, edits, end word) of every item found in a whole text, at its best place."""
        words = plain_words(text)
        symbols = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        known = symbols > 0
        exact: dict[int, int] = {}
        for n, (codes, table) in self.short.items():
            for i in self.shared(symbols, known, n, codes).tolist():
                for place in table.get(tuple(symbols[i:i + n].tolist()), ()):
                    exact.setdefault(place, i + n)
        found = [(place, 0, end) for place, end in exact.items()]
        shared = {q: self.shared(symbols, known, q, self.grams[q]) for q in {c.q for c in self.classes}}
        for group in self.classes:
            starts = self.windows(shared[group.q], group)
            if not len(starts):
                continue
            padded, candidates = group.padded(symbols), defaultdict(set)
            for coins, samples, own, places in group.walks:
                keys = group.keys(padded, starts, coins, samples).ravel()
                first, end = np.searchsorted(own, keys), np.searchsorted(own, keys, "right")
                for i in np.flatnonzero(end > first).tolist():
                    for place in places[first[i]:end[i]].tolist():
                        candidates[place].add(int(starts[i % len(starts)]))
            for place, at in candidates.items():
                masks, m = self.masks(place), len(self.symbols[place])
                k, best = most_edits(m), None
                for a, b in regions(sorted(at), m + 2 * k, k, len(words)):
                    edits, end = best_match(masks, m, symbols[a:b].tolist())
                    if edits <= k and (best is None or edits < best[0]):
                        best = (edits, a + end)
                if best:
                    found.append((place, *best))
        return found

    @staticmethod
    def windows(shared: np.ndarray, group: LengthClass) -> np.ndarray:
        """Starts of windows that hold enough shared sequences; any other window is beyond the allowed edits."""
        if len(shared) < group.least:
            return shared[:0]
        ends = np.searchsorted(shared, shared + group.span)  # windows that begin at a shared sequence
        full = shared[ends - np.arange(len(shared)) >= group.least]
        # edits of the first words move the true start to before the first shared pair
        back = group.q * most_edits(group.high)
        near = np.unique((full[:, None] - np.arange(back + 1)).ravel())
        return near[near >= 0]


def regions(starts: list[int], length: int, before: int, n: int) -> list[tuple[int, int]]:
    """Merged stretches of words that the windows at ``starts`` reach."""
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, s - before), min(n, s + length)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(items: DataFrame, min_words: int = 1):
    """Indexes of the benchmark in blocks of BLOCK_WORDS words: the driver and a task hold one block at a time."""
    counted = running(items.select("item_id", "text", n_words(F.col("text")).alias("n"), F.monotonically_increasing_id().alias("__from")),
                      ["item_id", "__from"], ["n"], label="benchmark").withColumn("block", F.floor(F.col("n_before") / BLOCK_WORDS))
    last = counted.agg(F.max("block")).first()[0]
    for b in range(0 if last is None else last + 1):
        rows = counted.where(F.col("block") == b).select("item_id", "text").orderBy("item_id", "text").collect()
        yield Index([tuple(r) for r in rows], min_words=min_words)


def with_leaks(docs: DataFrame, index: Index, text: str = "text", add: str = "leaks") -> DataFrame:
    """``docs`` without its text, plus an array of (item_id, item_words, edits, end_word) of the items found in it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index = shared.value
        return lambda texts: [[[{"item_id": index.item_ids[p], "item_words": len(index.symbols[p]), "edits": edits, "end_word": end}
                                for p, edits, end in index.search(t)] for t in texts]]
    return map_texts(docs, text, f"{add} array<struct<item_id: long, item_words: int, edits: int, end_word: long>>", make)


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, item_id, item_words, edits, similarity, end_word): benchmark items that documents hold.

    A document holds an item if some stretch of its words (lower-cased, without punctuation) is within edit
    distance floor(0.2 n) of the item's n words. Windows with too few of the benchmark's two- or three-word
    sequences cannot be and are left out (exact). The others are embedded by CGK walks, which turn few edits into
    few differing positions; samples of the positions are looked up in the items' table, with as many
    walks as edited copies of the items, among other words, need for a recall of RECALL; the exact edit distance
    decides. Items of one to four words allow no edit and are looked up as they are.
    The benchmark is read in blocks, each a pass over the documents without a shuffle. Null texts, items without
    words, and items under ``min_words`` words if the caller wants fewer, match nothing. One row for each document row and item.
    """
    parts = [with_leaks(docs.select("doc_id", "text"), index).select("doc_id", F.explode("leaks").alias("l"))
             .select("doc_id", "l.*") for index in blocks(items, min_words)]
    if not parts:
        parts = [docs.select("doc_id").limit(0).selectExpr("doc_id", "0L item_id", "0 item_words", "0 edits", "0L end_word")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents that hold no item, columns and rows unchanged."""
    out = docs
    for index in blocks(items, min_words):
        named = out.select(*[out[c].alias(f"__c{i}") for i, c in enumerate(docs.columns)], out["text"].alias("__text"))
        out = with_leaks(named, index, "__text", "__leaks").where(F.size("__leaks") == 0).selectExpr(
            *[f"__c{i} AS `{c}`" for i, c in enumerate(docs.columns)])
    return out
