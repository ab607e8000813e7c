"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from aerolens.llm.texts import map_texts, words

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\t\n\x0b\x0c\r"
#: Largest share of a text's word characters that may lie in n-grams of each length, or lines, equal to earlier ones.
#: The first copy does not count against a text: a short clean text may repeat one line.
MOST_IN_GRAMS = {5: 0.15, 7: 0.13, 10: 0.10}
MOST_IN_LINES = 0.30
BASE = np.uint64(0x9E3779B97F4A7C15)

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, "
            + ", ".join(f"dup_share_{n} double" for n in MOST_IN_GRAMS) + ", base_failed boolean, kept boolean")


def chars(text: bytes) -> int:
    """Code points of UTF-8 text: bytes that do not continue one."""
    return len(text) - np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 == 0x80)


def covered(words_hashed: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Whether each word lies in an ``n``-word window found twice or more; ``first``: in the first copy too.

    A polynomial rolling hash modulo 2**64 of mixed word codes, one vectorised step a word of the window.
    """
    m = len(words_hashed) - n + 1
    if m < 2:
        return np.zeros(len(words_hashed), bool)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * BASE + words_hashed[i:i + m]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    repeated = np.zeros(m, bool)
    repeated[order[1:][same]] = True
    if first:
        repeated[order[:-1][same]] = True
    edge = np.zeros(len(words_hashed) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spreads small codes over 64 bits, one to one."""
    x = codes.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def measure(text: bytes | None) -> tuple:
    """The columns of ``MEASURES`` for one text."""
    text = text or b""
    tokens = words(text)
    word_chars = chars(text) - sum(text.count(SPACE[i:i + 1]) for i in range(len(SPACE)))
    symbols = sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    seen, dup_lines, in_lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            in_lines += chars(b"".join(line.split()))
        elif line.split(None, 1):
            seen.add(line)
    codes: dict[bytes, int] = {}
    hashed = mixed(np.array([codes.setdefault(w, len(codes)) for w in tokens], np.int64))
    lengths = np.array([len(w) if w.isascii() else chars(w) for w in codes], np.int64)
    per_word = lengths[[codes[w] for w in tokens]] if tokens else lengths
    repeats = int(covered(hashed, 3, first=True).sum())
    shares = [float(per_word[covered(hashed, n, first=False)].sum()) / word_chars if word_chars else 0.0 for n in MOST_IN_GRAMS]
    line_share = in_lines / word_chars if word_chars else 0.0
    failed = len(tokens) < 50 or 100 * repeats > 50 * len(tokens)
    kept = not failed and line_share <= MOST_IN_LINES and all(s <= most for s, most in zip(shares, MOST_IN_GRAMS.values()))
    return len(tokens), word_chars, symbols, dup_lines, repeats, line_share, *shares, failed, kept


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus the measures and the verdict ``kept``.

    One pass, no shuffle; a null text counts as empty and, like any text under 50 words, is not kept. Columns of ``docs`` that bear
    the name of a new one come out with ``_given`` added.
    """
    def make():
        return lambda texts: [list(x) for x in zip(*map(measure, texts))]
    return map_texts(docs, text, MEASURES, make)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose text passes, columns and rows unchanged."""
    copy = docs.withColumn("__text", docs["text"])
    return with_quality(copy.select(*[copy[c].alias(f"__c{i}") for i, c in enumerate(docs.columns)], "__text"), "__text").where("kept").selectExpr(
        *[f"__c{i} AS `{c}`" for i, c in enumerate(docs.columns)])
