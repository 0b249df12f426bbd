"""Quality rules as a short-circuit cascade.

A rule looks at lazily computed features of a text and rejects it or not.  On a sample it is counted
which rules reject which texts and how many characters those have; a rule's cost is the characters that its
features have to read, weighted by what a feature costs a character.  The next rule in the order is always the one with
the most rejections for its cost, among the texts that no earlier rule rejects and without the features that earlier rules
have computed.  A rejected document meets no further rule.  Counts and weights are fixed numbers, so the
order, and the rule that is named for a rejection, are the same in every run; the verdict doesn't depend on the order at all.

The query's contract asks for the five measures of every text, so there those features are computed for rejected texts
too; ``cascade`` without measures leaves them out.

Input cases: a null or empty text has no words, so the word-count rule rejects it.  Repeated rows get
the same verdict each.  Whole texts are measured, whatever their length.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

#: Documents that costs and selectivities are estimated on.
SAMPLE_DOCS = 2000
SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
WINDOW = 8


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict = {}
    ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0x100000001B3) + mixed[k : k + n]
    order = np.sort(hashed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0  # equal windows have equal hashes
    spots = np.flatnonzero(np.isin(hashed, twice))
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[spots]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    spots = spots[counts[inverse.reshape(-1)] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, spots, 1)
    np.add.at(change, spots + window, -1)
    return int((np.cumsum(change) > 0).sum())


class Text:
    """A text with features that are computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.got: dict[str, object] = {}

    def __getattr__(self, name):
        value = FEATURES[name](self)
        setattr(self, name, value)
        return value


def duplicate_lines(t: Text) -> int:
    full = [line for line in t.lines if line.strip(SPACES)]
    return len(full) - len(set(full))


FEATURES: dict[str, Callable[[Text], object]] = {
    "raw": lambda t: t.text.encode("utf-8", "surrogatepass"),
    "words": lambda t: t.raw.split(),  # bytes: only the six white-space characters of ASCII separate
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, SPACES)),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "lines": lambda t: t.text.split("\n"),
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda t: repeated_words(t.words),
    "n_upper": lambda t: len(re.findall("[A-ZÀ-ÖØ-Þ]", t.text)),
    "n_bangs": lambda t: t.text.count("!") + t.text.count("?"),
    "n_stutter": lambda t: sum(map(operator.eq, t.words, t.words[1:])),
    "top_word": lambda t: max(Counter(t.words).values(), default=0),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Name of each rule, and what it rejects.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 20,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols": lambda t: t.n_symbols > 0.1 * t.n_words,
    "exclamations": lambda t: t.n_bangs > 0.2 * t.n_words,
    "capitals": lambda t: t.n_upper > 0.4 * t.word_chars,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words,
    "repeated_lines": lambda t: t.n_dup_lines > 0.5 * len(t.lines),
    "stutter": lambda t: t.n_stutter > 0.2 * t.n_words,
    "top_word": lambda t: t.top_word > 0.2 * t.n_words,
}
#: The rules whose rejection the base verdict consists of.
BASE = ("few_words", "repeated_windows")
#: What a feature costs for each character of a text, in units of one pass of ``str.count``, measured once; and each rule and text besides.
WEIGHTS = {"raw": 1, "words": 12, "n_words": 0, "word_chars": 6, "n_symbols": 8, "lines": 1, "n_dup_lines": 3, "n_repeat_words": 60, "n_upper": 15, "n_bangs": 2, "n_stutter": 6, "top_word": 12}
PER_TEXT = 100


def features_of(rule: str) -> frozenset[str]:
    """The features that a rule reads, traced on a text."""
    text = Text("one two\nthree")
    RULES[rule](text)
    return frozenset(vars(text)) & FEATURES.keys()


def estimate(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES), sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """rejects (bits, one for each rule), n, chars: about ``sample_docs`` documents, chosen by a hash of the content; a row at most for each set of rules."""
    total = docs.count()
    share = min(1.0, sample_docs / total) if total else 1.0
    unit = F.pmod(F.xxhash64(F.lit("rules"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)

    def make():
        def one(text):
            t = Text(text)
            return sum(1 << k for k, r in enumerate(rules) if RULES[r](t)), len(t.text)

        return lambda texts: [one(t) for t in texts]

    tried = map_rows(docs.where(unit < share), make, "rejects bigint, chars bigint", [])
    return tried.groupBy("rejects").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def order_rules(estimates: list[tuple[int, int, int]], rules: tuple[str, ...] = tuple(RULES)) -> list[str]:
    """Rules by rejections for their cost, given those before them; ties, and what no text tells apart, keep their declared order."""
    order, known, left = [], frozenset(), list(estimates)
    while len(order) < len(rules):
        n, chars = sum(e[1] for e in left), sum(e[2] for e in left)

        def worth(rule: str) -> float:
            rejected = sum(e[1] for e in left if e[0] >> rules.index(rule) & 1)
            cost = PER_TEXT * n + chars * sum(WEIGHTS[f] for f in features_of(rule) - known)
            return rejected / cost if cost else 0.0

        best = max((r for r in rules if r not in order), key=lambda r: (worth(r), -rules.index(r)))
        order.append(best)
        known |= features_of(best)
        left = [e for e in left if not e[0] >> rules.index(best) & 1]
    return order


def cascade(docs: DataFrame, rules: tuple[str, ...] = tuple(RULES), measures: tuple[str, ...] = (), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, the asked ``measures`` of each text, ``rejected_by`` (the first rule in the order that rejects, null if none)."""
    order = order_rules([tuple(r) for r in estimate(docs, rules).collect()], rules)
    tests = [(r, RULES[r]) for r in order]

    def make():
        def one(text):
            t = Text(text)
            by = next((name for name, test in tests if test(t)), None)
            return (*(getattr(t, m) for m in measures), by)

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "".join(f"{m} bigint, " for m in measures) + "rejected_by string", list(columns))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five measures, base_failed, kept, rejected_by of every document."""
    rows = cascade(docs, measures=MEASURES)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
