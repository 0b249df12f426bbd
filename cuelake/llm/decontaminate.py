"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of 32 words.  Over the benchmark's vocabulary, with document
frequencies of the whole corpus, passages are TF-IDF rows; a randomised SVD of the benchmark and all documents, whose
products are summed over partitions, gives a latent space.  Every passage of every document is compared by cosine with the
benchmark's passages there.  A candidate counts as a leak if the longest common subsequence of item
and surrounding text holds at least 80 % of the item's words; a weaker one (60 %) counts as a
paraphrase if it keeps the answer: the text after "answer:", or else the item's rarest words.

The inverse document frequency is taken to the power ``STEEP``.  No word weighs nothing, so an item is found
however many documents hold it, but common words hardly bring unrelated passages together.

Before a subsequence is computed, the item's places whose word occurs at all around the candidate are
counted; that many bound the subsequence, so what falls short of the share that is asked for is left out without loss.

The documents' words are looked up once and kept as numbers in a scratch table, which is read for the frequencies, for the
space and for the search.  What travels with the tasks is bounded by ``PASS_ITEMS`` and ``PASS_WORDS``; a larger benchmark takes further passes.

Input cases: null and empty texts leak nothing, an item without words can't leak, and an empty benchmark
gives an empty result.  Repeated rows give repeated results.  Items that repeat are each reported.  Ids
play no part in the search: rows whose ids are null or repeat are judged by their own texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, scratch

STRIDE = 16  # a passage is two strides
RANK, OVERSAMPLE, SEED = 96, 8, 7
#: Documents that all documents together weigh like in the latent space, beside the benchmark: its own directions stay, however large the corpus.
FIT_WEIGHT = 2000
#: Items, and words of items, that are searched for in one pass over the documents.
PASS_ITEMS, PASS_WORDS = 20_000, 1_000_000
COSINE, LEAK, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.8
#: What a word of all documents still has before the power, and the power.
FLOOR, STEEP = 0.1, 2.5
#: Cells of a block of cosines, and words whose vectors are laid side by side at a time.
CELLS, SLICE = 2_000_000, 1 << 14
#: A word: what stands between white space, without what isn't a letter or digit at its ends.
WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
FIXED = 1 << 20
#: Directions of less than this share of the largest one's square are noise.
LEAST = 1e-6


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


#: The ASCII characters that no word begins or ends with.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def stripped(text: str | None, once: bool = False) -> Iterator[str]:
    """The words as ``words_of`` finds them, and an empty one for what holds no letter or digit: a word ends with the last of these before white space.

    With ``once`` every stretch between white space comes once.
    """
    low = (text or "").lower()
    marks = MARKS if low.isascii() else "".join(c for c in set(low) if not c.isalnum())
    return map(str.strip, set(low.split()) if once else low.split(), repeat(marks))


def numbers_of(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Vocabulary numbers of a text's words, -1 for words that it lacks."""
    words = [*stripped(text)]
    if "" in words:
        words = [w for w in words if w]
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def packing(n_words: int) -> type:
    """Whole numbers that hold the numbers of so many words, and one more for words that are none of them."""
    return np.uint16 if n_words < (1 << 16) - 1 else np.uint32


def unpacked(numbers: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(numbers, kind).astype(np.int32) - 1


def numbered(docs: DataFrame, vocabulary: dict[str, int], columns: list[str]) -> DataFrame:
    """``columns`` and ``numbers``: the vocabulary numbers of each text's words, plus one, as bytes."""
    kind = packing(len(vocabulary))

    def make():
        return lambda texts: [((numbers_of(text, vocabulary) + 1).astype(kind).tobytes(),) for text in texts]

    return scratch(map_rows(docs, make, "numbers binary", columns), "numbers")


class Passages:
    """Sums of word vectors over the passages of a group of texts."""

    def __init__(self, numbers: list[np.ndarray]):
        blocks = [max(1, -(-len(x) // STRIDE)) for x in numbers]
        self.first = np.concatenate(([0], np.cumsum(blocks)))  # of each text, its first block; passage k is blocks k and k + 1
        self.word = np.concatenate([x[x >= 0] for x in numbers]) if numbers else np.empty(0, np.int32)
        self.block = np.concatenate([np.flatnonzero(x >= 0) // STRIDE + f for x, f in zip(numbers, self.first)]) if numbers else np.empty(0, np.int64)
        self.last = np.zeros(self.first[-1], bool)
        self.last[self.first[1:] - 1] = True

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each passage."""
        out = np.zeros((self.first[-1], vectors.shape[1]), np.float32)
        starts = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]]) if len(self.block) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(self.word)]
        for k in range(0, len(starts), SLICE // STRIDE):  # few rows of vectors at a time, however long a text is
            part = starts[k : k + SLICE // STRIDE]
            rows = vectors[self.word[part[0] : ends[min(k + SLICE // STRIDE, len(starts)) - 1]]]
            out[self.block[part]] = np.add.reduceat(rows, part - part[0], axis=0)
        return self.joined(out)

    def joined(self, rows: np.ndarray) -> np.ndarray:
        after = np.roll(rows, -1, axis=0)
        after[self.last] = 0
        return rows + after

    def back(self, rows: np.ndarray, n: int) -> np.ndarray:
        """For each word the sum of the rows of the passages that hold it (the transposed product)."""
        before = np.roll(rows, 1, axis=0)
        before[self.first[:-1]] = 0
        both = rows + before
        out = np.zeros((n, rows.shape[1]))
        order = np.argsort(self.word, kind="stable")
        for k in range(0, len(order), SLICE):
            part = order[k : k + SLICE]
            word = self.word[part]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[starts]] += np.add.reduceat(both[self.block[part]], starts, axis=0)
        return out


def grouped(lens: list[int], size: int = 200_000) -> Iterator[list[int]]:
    """Indexes of texts of so many words in groups of bounded length; a longer text is a group of its own."""
    group, total = [], 0
    for i, n in enumerate(lens):
        if group and total + n > size:
            yield group
            group, total = [], 0
        group.append(i)
        total += n
    if group:
        yield group


def lcs(bits: dict, n: int, words: list) -> int:
    """Matched positions, as bits, of a longest common subsequence; ``bits`` are the item's places of each word."""
    full, v = (1 << n) - 1, (1 << n) - 1
    for w in words:
        m = bits.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


class Item:
    """An item's words as vocabulary numbers, the places of each, and the places of its answer's words."""

    def __init__(self, item_id: int, text: str | None):
        self.id = item_id
        self.words = words_of(text)
        marked = re.search(r"(?is).*\banswer\s*:(.+)", text or "")
        self.answer = set(words_of(marked.group(1))) if marked else set()

    def index(self, vocabulary: dict[str, int], counts: np.ndarray) -> None:
        self.numbers = np.array([vocabulary[w] for w in self.words], np.int32)
        self.bits: dict[int, int] = {}
        for i, k in enumerate(self.numbers.tolist()):
            self.bits[k] = self.bits.get(k, 0) | 1 << i
        answer = {vocabulary[w] for w in self.answer if w in vocabulary} & set(self.bits)
        if not answer:
            distinct = sorted(self.bits, key=lambda k: (counts[k], k))
            answer = set(distinct[: max(1, len(distinct) // 4)])
        self.answer_places = [self.bits[k] for k in sorted(answer)]


def places_met(item: Item, flat: np.ndarray, start: np.ndarray, end: np.ndarray, n_words: int) -> np.ndarray:
    """For each stretch of ``flat``, how many of the item's places have a word that occurs in it."""
    width = int((end - start).max())
    at = start[:, None] + np.arange(width)
    inside = flat[np.minimum(at, len(flat) - 1)]
    inside[at >= end[:, None]] = n_words
    met = np.zeros(len(start), np.int64)
    for low in range(0, len(item.numbers), 64):
        masks = np.zeros(n_words + 1, np.uint64)
        part = item.numbers[low : low + 64]
        np.bitwise_or.at(masks, part, np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        met += np.bitwise_count(np.bitwise_or.reduce(masks[inside], axis=1)).astype(np.int64)
    return met


def document_frequencies(numbers: DataFrame, n: int) -> np.ndarray:
    """For each word of the vocabulary, how many documents have it."""
    kind = packing(n)

    def run(batches):
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[np.unique(np.frombuffer(text.as_buffer(), kind))] += 1
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1:][some])], names=["word", "n"])

    out = np.zeros(n, np.int64)
    for word, count in numbers.select("numbers").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
        out[word] = count
    return out


def product_sums(numbers: DataFrame, vectors: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Over all passages A of the texts: A'(A vectors) and the square of (A vectors), both times ``share``.  Whole numbers, so that their order has no influence."""
    n, width = vectors.shape
    kind = packing(n)

    def run(batches):
        total = np.zeros((n + width, width), np.int64)
        for batch in batches:
            texts = [unpacked(text.as_buffer(), kind) for text in batch.column(0)]
            for group in grouped([len(x) for x in texts]):
                part = Passages([texts[i] for i in group])
                y = part.sums(vectors)
                z = np.concatenate((part.back(y, n), y.astype(np.float64).T @ y))
                total += np.rint(z * (share * FIXED)).astype(np.int64)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), type=pa.list_(pa.int64()))], names=["row", "v"])

    parts = numbers.select("numbers").mapInArrow(run, "row bigint, v array<bigint>")
    sums = parts.groupBy("row").agg(F.array(*[F.sum(F.element_at("v", k + 1)) for k in range(width)]).alias("v"))
    out, got = np.zeros((n + width, width)), sums.toArrow()
    if got.num_rows:
        out[got["row"].to_numpy()] = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out[:n] / FIXED, out[n:] / FIXED


def latent_space(numbers: DataFrame, items: list[Item], idf: np.ndarray, share: float, rank: int = RANK) -> np.ndarray:
    """Word vectors of the space: the best directions of the items' passages and ``share`` times those of all documents.

    Randomised, from one pass: with the products K X and X'K X of a random X the matrix K is near (K X) (X'K X)^-1 (K X)'.
    """
    n = len(idf)
    width = min(n, rank + OVERSAMPLE)
    weigh = idf[:, None]
    vectors = (weigh * np.random.default_rng(SEED).standard_normal((n, width))).astype(np.float32)
    own = Passages([i.numbers for i in items])
    y = own.sums(vectors)
    back, gram = product_sums(numbers, vectors, share)
    product, square = weigh * (own.back(y, n) + back), y.astype(np.float64).T @ y + gram
    values, turned = np.linalg.eigh((square + square.T) / 2)
    some = values > values[-1] * LEAST
    basis, _, _ = np.linalg.svd(product @ (turned[:, some] / np.sqrt(values[some])), full_matrices=False)
    return (weigh * basis[:, :rank]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


HITS = "hits array<struct<item_id: bigint, lcs_share: double, answer_share: double, cosine: double, verdict: string>>"


def searcher(numbers: DataFrame, items: list[Item], vocabulary: dict[str, int], total_docs: int):
    """A ``make`` for ``map_rows``: for each row of ``numbers`` its hits, at most one an item."""
    n_words, kind = len(vocabulary), packing(len(vocabulary))
    counts = document_frequencies(numbers, n_words)
    for item in items:
        item.index(vocabulary, counts)
    weights = (np.log((total_docs + 1) / (counts + 1)) + FLOOR) ** STEEP
    vectors = latent_space(numbers, items, weights, min(1.0, FIT_WEIGHT / max(1, total_docs)))
    parts = [Passages([i.numbers]).sums(vectors) for i in items]
    queries, of = unit(np.concatenate(parts)), np.repeat(np.arange(len(items)), [len(p) for p in parts])

    def make():
        def verified(item, cosines, met, spans, flat):
            """The best hit of an item in one text, tried in the order of what can still be had."""
            n, best, best_share = len(item.words), None, 0.0
            for k in np.argsort(-met, kind="stable").tolist():
                if met[k] < PARAPHRASE * n or met[k] / n <= best_share:
                    break
                hit = lcs(item.bits, n, flat[spans[k][0] : spans[k][1]].tolist())
                share = hit.bit_count() / n
                if share < PARAPHRASE or share <= best_share:
                    continue
                kept = sum(1 for m in item.answer_places if m & hit) / len(item.answer_places)
                if share >= LEAK or kept >= ANSWER:
                    best, best_share = (item.id, share, kept, float(cosines[k]), "leak" if share >= LEAK else "paraphrase"), share
            return best

        def candidates(part: Passages):
            """(block, item, cosine), each pair of block and item once."""
            some = np.zeros(part.first[-1], bool)
            some[part.block] = True
            some = np.flatnonzero(some | np.r_[some[1:], False] & ~part.last)
            rows = unit(part.sums(vectors)[some])
            step, got = max(64, CELLS // len(queries)), []
            for c in range(0, len(some), step):
                cosines = rows[c : c + step] @ queries.T
                at, which = np.nonzero(cosines >= COSINE)
                got.append((some[c + at], of[which], cosines[at, which]))
            block, item, cosine = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 3
            order = np.lexsort((-cosine, block, item))
            block, item, cosine = block[order], item[order], cosine[order]
            first = np.r_[True, (block[1:] != block[:-1]) | (item[1:] != item[:-1])] if len(block) else np.empty(0, bool)
            return block[first], item[first], cosine[first]

        def search(known: list[np.ndarray]):
            """(text, hit) of a group of texts."""
            part = Passages(known)
            flat = np.concatenate([*known, np.full(1, -1, np.int32)])
            flat[flat < 0] = n_words
            begin = np.concatenate(([0], np.cumsum([len(x) for x in known])))
            block, which, cosine = candidates(part)
            edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                item = items[which[a]]
                n, doc = len(item.words), np.searchsorted(part.first, block[a:b], side="right") - 1
                at = begin[doc] + (block[a:b] - part.first[doc]) * STRIDE
                start, end = np.maximum(begin[doc], at - n), np.minimum(begin[doc + 1], at + 2 * STRIDE + n)
                step = max(1, CELLS // (2 * STRIDE + 2 * n))
                met = np.concatenate([places_met(item, flat, start[c : c + step], end[c : c + step], n_words) for c in range(0, b - a, step)])
                good = np.flatnonzero(met >= PARAPHRASE * n)
                for d in np.unique(doc[good]).tolist():
                    here = good[doc[good] == d]
                    best = verified(item, cosine[a:b][here], met[here], list(zip(start[here].tolist(), end[here].tolist())), flat)
                    if best:
                        yield d, best

        def work(coded):
            texts = [unpacked(text, kind) for text in coded]
            out = [[] for _ in texts]
            for group in grouped([len(x) for x in texts]):
                for d, hit in search([texts[i] for i in group]):
                    out[group[d]].append(hit)
            return [([dict(zip(("item_id", "lcs_share", "answer_share", "cosine", "verdict"), h)) for h in found],) for found in out]

        return work

    return make


def passes(benchmark: DataFrame, pass_items: int = PASS_ITEMS, pass_words: int = PASS_WORDS) -> Iterator[list[Item]]:
    """The items in groups of bounded size; the driver holds one group at a time."""
    group, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        item = Item(*row)
        if not item.words:
            continue
        if group and (len(group) >= pass_items or size + len(item.words) > pass_words):
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item.words)
    if group:
        yield group


def searched(docs: DataFrame, items: list[Item], columns: list[str], total_docs: int) -> DataFrame:
    """``columns`` of all rows, with their ``hits`` among the items."""
    vocabulary = {w: k for k, w in enumerate(sorted({w for i in items for w in i.words}))}
    numbers = numbered(docs, vocabulary, columns)
    return map_rows(numbers, searcher(numbers, items, vocabulary, total_docs), HITS, columns, "numbers")


def leaks(docs: DataFrame, benchmark: DataFrame, pass_items: int = PASS_ITEMS) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine, verdict: a row for each document and item that it leaks."""
    total = docs.count()
    out = docs.select("doc_id", F.expr(f"cast(array() as {HITS.split(' ', 1)[1]})").alias("hits")).where("false")
    for items in passes(benchmark, pass_items):
        out = out.unionByName(searched(docs, items, ["doc_id"], total))
    return out.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...], pass_items: int = PASS_ITEMS) -> DataFrame:
    """``columns`` and text of the rows that leak no item.  Each row is judged by its own text, without a join."""
    kept, total = docs, docs.count()
    for items in passes(benchmark, pass_items):
        kept = searched(kept, items, [*columns, "text"], total).where(F.size("hits") == 0).drop("hits")
    return kept.select(*columns, "text")
