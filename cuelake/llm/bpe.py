"""BPE encoding and decoding with a pair occurrence index.

The words of an Arrow batch that have not been seen before are laid out as one long symbol array.
An index maps every mergeable pair to all of its positions in that array.  A heap yields the active
merge ranks in ascending order; a rank is applied at all positions of its pair at once, and the two
pairs that each merge creates are appended to their lists.  A merge can only create pairs of a higher
rank, because each token is made by exactly one merge, so one ascending sweep is enough.

Input cases: a null or empty text gives no tokens; a text that consists of white space alone too.
Repeated rows give repeated results.  Nothing is cut: the length of a text is not limited.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Words kept with their tokens per Python worker; a memory bound that has no influence on results.
CACHE_WORDS = 300_000

#: Code points that ``str.split`` takes for white space and the vocabulary's pattern doesn't.
NO_SPACE = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for a ``tokenizers`` BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.names}
        self.made: list[int] = []
        self.pair: list[tuple[int, int]] = []
        for a, b in model["merges"]:
            self.pair.append((self.vocab[a], self.vocab[b]))
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols])
        self.last = np.array([self.vocab[c + self.suffix] for c in symbols])
        codes = np.array([(a << 20) | b for a, b in self.pair], np.int64)
        self.code_rank = np.argsort(codes)
        self.codes = codes[self.code_rank]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words_of = regex.compile(split, regex.V0).findall
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).split
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).findall
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # code point by code point: no final form of sigma

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by one sweep of the pair occurrence index over all of them."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths + 1) - 1  # of each word, the place of the mark that follows it
        sym = np.full(int(ends[-1]) + 1 if len(raw) else 0, -1, np.int64)
        filled = np.ones(len(sym), bool)
        filled[ends] = False
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym[filled] = self.inner[data]
        sym[ends - 1] = self.last[data[np.cumsum(lengths) - 1]]
        place = np.arange(len(sym), dtype=np.int64)
        after, before = place + 1, place - 1
        where: dict[int, list] = {}  # rank of a pair -> its positions, as ints and arrays
        heap: list[int] = []

        def note(ranks, spots):
            """Append positions to the lists of their pairs."""
            if len(ranks) > 48:
                order = np.argsort(ranks, kind="stable")
                ranks, spots = ranks[order], spots[order]
                cuts = np.flatnonzero(np.diff(ranks)) + 1
                rows = zip(ranks[np.r_[0, cuts]].tolist(), np.split(spots, cuts))
            else:
                rows = zip(ranks.tolist(), spots.tolist())
            for r, at in rows:
                if r in where:
                    where[r].append(at)
                else:
                    where[r] = [at]
                    heapq.heappush(heap, r)

        first = self.ranks(sym[:-1], sym[1:])
        some = np.flatnonzero(first >= 0)
        if len(some):
            note(first[some], some)
        while heap:
            r = heapq.heappop(heap)
            spots = np.unique(np.hstack(where.pop(r)))
            a, b = self.pair[r]
            spots = spots[sym[spots] == a]
            nexts = after[spots]
            fit = sym[nexts] == b
            spots, nexts = spots[fit], nexts[fit]
            if a == b and len(spots) > 1:  # in a run of one symbol, pairs are taken from the left without overlap
                keep, taken = [], -1
                for i, (x, y) in enumerate(zip(spots.tolist(), nexts.tolist())):
                    if x != taken:
                        keep.append(i)
                        taken = y
                spots, nexts = spots[keep], nexts[keep]
            if not len(spots):
                continue
            sym[spots], sym[nexts] = self.made[r], -2
            beyond = after[nexts]
            after[spots] = beyond
            before[beyond] = spots
            left = before[spots]
            left = left[left >= 0]
            froms = np.concatenate((left, spots))
            ranks = self.ranks(sym[froms], sym[after[froms]])
            ok = ranks >= 0
            if ok.any():
                note(ranks[ok], froms[ok])
        alive = sym >= 0
        counts = np.add.reduceat(alive, np.r_[0, ends[:-1] + 1]) if len(raw) else []
        flat = iter(sym[alive].tolist())
        return [list(islice(flat, c)) for c in counts]

    def ranks(self, left, right):
        """The merge rank of each pair, -1 where there is none."""
        code = (left << 20) | right
        code[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.code_rank[at], -1)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the file names no decoder, and special tokens stay."""
        return " ".join([self.names[i] for i in ids])

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks (text between white space) that aren't known yet."""
        fresh = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(fresh) > CACHE_WORDS:  # what these chunks need stays, so frequent words aren't encoded anew
            used = [c for c in chunks if c in self.ids]
            self.ids, self.text = ({c: of[c] for c in used} for of in (self.ids, self.text))
        # Letters of ASCII alone are one word.
        parts = [(c,) if c.isascii() and c.isalpha() else self.words_of(c) for c in fresh]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        tokens = self.encode_words(list(known))
        digits, names = self.digits, self.names
        for c, p in zip(fresh, parts):
            ids = tokens[known[p[0]]] if len(p) == 1 else [t for w in p for t in tokens[known[w]]]
            self.ids[c] = " ".join([digits[t] for t in ids])
            self.text[c] = " ".join([names[t] for t in ids])

    def chunks(self, text: str) -> list[str]:
        """The stretches between white space: no word reaches over it."""
        text = self.normalize(text)
        if any(c in text for c in NO_SPACE):
            return self.words_of(text)
        return text.split()

    def pieces(self, text: str | None) -> list[list[str] | int]:
        """Chunk lists of the stretches between special tokens, and the ids of those tokens."""
        if not text:
            return []
        if "<|" not in text:
            return [self.chunks(text)]
        parts = self.cut_special(text)
        marks = [self.special[m] for m in self.find_special(text)]
        out: list[list[str] | int] = []
        for i, part in enumerate(parts):
            out.append(self.chunks(part))
            if i < len(marks):
                out.append(marks[i])
        return out

    def encode_texts(self, texts: list[str | None], group_chars: int = 3_000_000):
        """(ids joined by a space, decoded text) of each text; groups of texts share one index sweep."""
        group: list[list[list[str] | int]] = []
        size = 0
        for t in texts:
            group.append(self.pieces(t))
            size += len(t or "")
            if size >= group_chars:
                yield from self._finish(group)
                group, size = [], 0
        yield from self._finish(group)

    def _finish(self, group):
        chunks: set[str] = set()
        for parts in group:
            for part in parts:
                if isinstance(part, list):
                    chunks.update(part)
        self.learn(chunks)
        ids, text = self.ids, self.text
        for parts in group:
            a: list[str] = []
            b: list[str] = []
            for part in parts:
                if isinstance(part, list):
                    a.extend(map(ids.__getitem__, part))
                    b.extend(map(text.__getitem__, part))
                else:
                    a.append(str(part))
                    b.append(self.names[part])
            yield " ".join(a), " ".join(b)


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """One encoder per Python worker and file."""
    return WordBPE(path)


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` plus ``ids array<int>`` and ``decoded string`` of each whole text."""

    def make():
        bpe = load(path)
        return lambda texts: [([int(i) for i in a.split()], b) for a, b in bpe.encode_texts(texts)]

    return map_rows(docs, make, "ids array<int>, decoded string", list(columns))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode`` returns, made in the same task."""

    def make():
        bpe = load(path)

        def work(texts):
            return [(a.count(" ") + 1 if a else 0, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) for a, b in bpe.encode_texts(texts)]

        return work

    return map_rows(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def encode_checked(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, ``n_tokens``, ``ids array<int>`` and ``decoded_sha256``: what a training job reads, with the digest of the decoded text."""

    def make():
        bpe = load(path)

        def work(texts):
            out = []
            for a, b in bpe.encode_texts(texts):
                ids = np.fromstring(a, np.int32, sep=" ") if a else np.empty(0, np.int32)
                out.append((len(ids), ids, hashlib.sha256(b.encode()).hexdigest()))
            return out

        return work

    return map_rows(docs, make, "n_tokens bigint, ids array<int>, decoded_sha256 string", list(columns))
