"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of signs.  An n-gram's vector is the product (binding) of its
letters' vectors, each rotated (permuted) by its distance from the n-gram's end; a document's vector is
the sum (bundling) of its n-grams' vectors.  A language's prototype bundles the normalised vectors of
its training documents, and a document gets the language whose prototype has the largest cosine.

Input cases: a null text, an empty one and one without a letter give ``und`` with score 0.  Equal
cosines go to the language that sorts first.  A null id counts as held out.  Without any
training row every document is ``und``.  Whole texts are read, whatever their length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, map_rows

DIM, ORDER, SEED = 1024, 3, 20240607
#: Training documents per language, chosen by a hash of their id; the profiles are stable far below that.
TRAIN_DOCS = 4000
#: Fixed point for sums of prototypes, so that their order has no influence.
SCALE = 1 << 20
#: N-gram vectors kept per Python worker; a memory bound that has no influence on results.
MAX_VECTORS = 16384
#: Prototypes travel with the task; beyond this many values the caller must split its languages.
MAX_PROTOTYPE_VALUES = 4_000_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point 1 if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Profiles:
    """Document vectors; code points that aren't letters all count as one separator."""

    def __init__(self, dim: int = DIM, order: int = ORDER, seed: int = SEED):
        self.dim, self.order, self.seed = dim, order, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((1024, dim), np.float32)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8) * 2 - 1
        return v

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, given as rows of code points."""
        out = np.ones((len(grams), self.dim), np.int8)
        for k in range(self.order):
            codes, at = np.unique(grams[:, k], return_inverse=True)
            basis = np.stack([np.roll(self.letter(int(c)), self.order - 1 - k) for c in codes])
            out *= basis[at]
        return out

    def grams(self, text: str):
        """Distinct n-grams of a text as packed code points, and how often each occurs; None without a letter."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_table()[raw]
        if not letter.any():
            return None
        symbols = np.where(letter, raw, 32).astype(np.int64)
        symbols = np.concatenate(([32], symbols, [32]))
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32)  # a run of separators is one
        symbols = symbols[keep]
        code = np.zeros(max(1, len(symbols) - self.order + 1), np.int64)
        for k in range(self.order):
            code = (code << 21) | symbols[k : k + len(code)]
        code.sort()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[first], np.diff(np.r_[first, len(code)])

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for sorted n-grams, which are added where new."""
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        new = self.codes[at] != code if len(self.codes) else np.ones(len(code), bool)
        if new.any():
            if len(self.codes) + int(new.sum()) > MAX_VECTORS and len(self.codes):  # keeps memory bounded on large alphabets
                self.codes, self.rows = np.empty(0, np.int64), np.empty(0, np.int64)
                return self.lookup(code)
            fresh, used = code[new], len(self.codes)
            while used + len(fresh) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
            self.vectors[used : used + len(fresh)] = self.bind(np.stack([(fresh >> (21 * (self.order - 1 - k))) & 0x1FFFFF for k in range(self.order)], axis=1))
            codes = np.concatenate((self.codes, fresh))
            order = np.argsort(codes)
            self.codes, self.rows = codes[order], np.concatenate((self.rows, np.arange(used, used + len(fresh))))[order]
            at = np.searchsorted(self.codes, code)
        return self.rows[at]

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter."""
        got = self.grams(text) if text else None
        if got is None:
            return None
        total = np.zeros(self.dim, np.float32)
        for a in range(0, len(got[0]), 1024):
            rows = self.lookup(got[0][a : a + 1024])
            total += got[1][a : a + 1024].astype(np.float32) @ self.vectors[rows]
        norm = float(np.sqrt(np.dot(total, total)))
        return total / norm if norm else None


@lru_cache(maxsize=2)
def profiles(dim: int, order: int, seed: int) -> Profiles:
    return Profiles(dim, order, seed)


def train(rows: DataFrame, dim: int = DIM, order: int = ORDER, seed: int = SEED, per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Prototypes from ``doc_id, text, lang`` rows: languages in order, and one unit row for each.

    At most about ``per_language`` documents of a language are used, chosen by a hash of their id.
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().limit(MAX_PROTOTYPE_VALUES // dim + 1).collect()
    if len(counts) * dim > MAX_PROTOTYPE_VALUES:
        raise ValueError(f"more than {MAX_PROTOTYPE_VALUES // dim} languages of {dim} values are too many to send to each task")
    # One row a language, so few that the texts needn't move to meet them.
    rates = F.broadcast(rows.sparkSession.createDataFrame([(r["lang"], per_language / r["count"]) for r in counts], "rate_lang string, rate double"))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(rates, F.col("lang") == F.col("rate_lang")).where(unit < F.col("rate")).select("lang", "text")

    def bundle(batches):
        make, sums = profiles(dim, order, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = make.vector(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v * SCALE).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["lang", "place", "value"])

    parts = chosen.mapInArrow(bundle, "lang string, place int, value bigint")
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    languages = sorted(r["lang"] for r in counts)
    matrix = np.zeros((len(languages), dim))
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, i, value in sums.collect():
        matrix[place[lang], i] = value
    norms = np.linalg.norm(matrix, axis=1)
    known = norms > 0
    return [lang for lang, k in zip(languages, known) if k], (matrix[known] / norms[known, None]).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, dim: int = DIM, order: int = ORDER, seed: int = SEED, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` plus ``lang_pred`` and ``score``: the cosine with that language's prototype, not below 0."""

    def make():
        vectors = profiles(dim, order, seed)

        def one(text):
            v = vectors.vector(text) if languages else None
            if v is None:
                return UNKNOWN, 0.0
            cosines = prototypes @ v
            best = int(np.argmax(cosines))
            return languages[best], float(min(1.0, max(0.0, cosines[best])))

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "lang_pred string, score double", list(columns))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    languages, prototypes = train(rows.where(~F.col("held_out")))
    return predict(rows, languages, prototypes, columns=("doc_id", "held_out"))
