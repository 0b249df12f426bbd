"""Repeated passages by MinHash banding over sliding paragraphs.

A paragraph is any stretch of 50 words, wherever it begins, so a passage is found inside a longer line
too.  The MinHash of a paragraph under one permutation is the least hash of its five-word shingles;
neighbouring paragraphs mostly share it, so a text of n words has only about 2n/47 different ones.  The
number of bands (of one row each) follows from the recall that is asked for at similarity 0.8.
Documents whose paragraphs collide are joined, and the common stretch is grown from the collision to both
sides, over gaps of up to 12 words.  It counts if it has 50 words and an exact Jaccard similarity of 0.8 or
more; a stretch that falls short of that loses its outer blocks, and one that is a little too short is
widened to a paragraph.  Stretches that overlap in a document are one passage; passages are clustered by components.

Every band value with owners in two documents or more pairs all its owners with two of them (the first by
id, one by a hash of value and owner), so a passage of very many documents costs a multiple of its
owners, not their square, and the owners meet in one component.  Owners of a value that aren't in one component
then are compared with one another by the words around their places, see ``links_of_the_rest``: directly where they are few, else by the
rarest shingles there, in rounds of more and more centres.  No pair that shares a band value is left out;
the worst case, very many owners that share rare shingles too but aren't alike, is quadratic.  These words are compared
by 64-bit hashes.
A passage that stands twice in a text is reported at both places if another document has it too.  Of exact
copies the one with the least id is searched; the whole text is their common passage.

Input cases: null and empty texts, and texts under 50 words, have no passages.  Repeats
inside one document alone don't count.  Null ids take no part.  Repeated rows count as copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import scratch
from .components import components

SHINGLE, PARAGRAPH, SIMILARITY, RECALL = 5, 50, 0.8, 0.95
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """The least number of bands that finds a pair of this similarity with this probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return min(bands, len(SEEDS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        fresh = {w for w in set(words) if w not in known}
        if len(known) + len(fresh) > self.most:
            known.clear()
            fresh = set(words)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in fresh)
        return np.fromiter([known[w] for w in words], np.uint64, len(words))


#: Bytes of texts whose words are split and hashed together at most; a longer text is alone.
TEXT_BYTES = 4_000_000


def slices(texts: pa.Array):
    """(first, end) of rows whose texts have ``TEXT_BYTES`` together at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
        yield first, end
        first = end


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one behind the other, as ``words_of`` and ``Hasher`` give them, and where each text begins (and the last ends)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    _, ends, data = coded.dictionary.cast(pa.binary()).buffers()
    ends, data = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    known = np.fromiter([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])], np.uint64, len(coded.dictionary))
    empty = pc.binary_length(coded.dictionary).to_numpy() == 0  # white space at the ends of a text
    codes = coded.indices.to_numpy()
    real = ~empty[codes]
    at = np.concatenate(([0], np.cumsum(real)))
    return known[codes[real]], at[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))]


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(seed)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + words[k : k + n] if n > 0 else out
    return out


def run_ends(values: np.ndarray, places: np.ndarray, apart: int) -> np.ndarray:
    """The places, without those between others of the same value that are less than ``apart`` before and behind: a line that is repeated over and over has two."""
    order = np.lexsort((places, values))
    v, p = values[order], places[order]
    close = (v[1:] == v[:-1]) & (p[1:] - p[:-1] < apart)
    return np.sort(p[~(np.r_[False, close] & np.r_[close, False])])


def band_values(words: np.ndarray, bands: int, paragraph: int = PARAGRAPH, size: int = SHINGLE):
    """(value, place) of the MinHashes of all paragraphs, at the places where they stand (see ``run_ends``), band after band."""
    if len(words) < paragraph:
        return []
    shingles = shingle_hashes(words, size)
    width = paragraph - size + 1
    out = []
    for k in range(bands):
        h = mix(shingles, SEEDS[k])
        # The place of the least hash in each window: least of blocks from the left and from the right.
        pad = (-len(h)) % width
        full = np.concatenate((h, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
        right = np.minimum.accumulate(full, axis=1).reshape(-1)
        left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(left[: len(h) - width + 1], right[width - 1 : len(h)])
        chosen = np.flatnonzero(np.isin(h, least[np.r_[True, least[1:] != least[:-1]]]))
        chosen = run_ends(h[chosen], chosen, paragraph)
        out.append((h[chosen].view(np.int64) ^ np.int64(k), chosen.astype(np.int32)))
    return out


def values_of_texts(words: np.ndarray, first: np.ndarray, bands: int, paragraph: int = PARAGRAPH, size: int = SHINGLE):
    """(text, value, place) of ``band_values`` for texts whose words stand one behind the other, sorted by text."""
    lens, n = np.diff(first), len(words)
    texts, values, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    if n >= paragraph:
        doc = np.repeat(np.arange(len(lens)), lens)
        left = np.repeat(first[1:], lens) - np.arange(n)  # words of the text from here on
        shingles = shingle_hashes(words, size)
        width = paragraph - size + 1
        # The same value in two texts has two keys.
        apart = doc.astype(np.uint64) * np.uint64(SEEDS[0])
        inner, whole = left[: len(shingles)] >= size, left[: n - paragraph + 1] >= paragraph
        for k in range(bands):
            h = mix(shingles, SEEDS[k])
            pad = (-len(h)) % width
            full = np.concatenate((h, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
            right = np.minimum.accumulate(full, axis=1).reshape(-1)
            back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            least = (np.minimum(back[: len(h) - width + 1], right[width - 1 : len(h)]) + apart[: n - paragraph + 1])[whole]
            least = least[np.r_[True, least[1:] != least[:-1]]] if len(least) else least
            keys = h + apart[: len(h)]
            # A table of 22 bits of the keys leaves few places to look up.
            met = np.zeros(1 << 22, bool)
            met[least & np.uint64((1 << 22) - 1)] = True
            chosen = np.flatnonzero(met[keys & np.uint64((1 << 22) - 1)] & inner)
            chosen = chosen[np.isin(keys[chosen], least)]
            chosen = run_ends(keys[chosen], chosen, paragraph)
            texts.append(doc[chosen])
            values.append(h[chosen].view(np.int64) ^ np.int64(k))
            places.append((chosen - first[doc[chosen]]).astype(np.int32))
    text, value, place = map(np.concatenate, (texts, values, places))
    order = np.argsort(text, kind="stable")
    return text[order], value[order], place[order]


def lists(values: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(values))


def entries(texts: DataFrame, bands: int) -> DataFrame:
    """node, n_words, and the values and places of all band values, a row for each text."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, first = hashed_words(batch.column(1).slice(a, b - a))
                text, value, place = values_of_texts(words, first, bands)
                lens = np.bincount(text, minlength=b - a)
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int32()), lists(value, lens), lists(place, lens)]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "n_words", "values", "places"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, n_words int, values array<bigint>, places array<int>")


#: Owners of a band value that all its owners are compared with at first.
CENTRES = 2
#: Words that growth may cross between equal words of two texts, and equal words that must follow.
GAP, AGAIN = 12, 3
#: Share of aligned shingles below which a run isn't compared as a whole.
CUT_AT_ONCE = 0.6


def equal_words(x: list[bytes], y: list[bytes], i: int, j: int) -> int:
    """How many words from (i, j) on are equal; most are compared in slices."""
    n, k = min(len(x) - i, len(y) - j), 0
    while k + 32 <= n and x[i + k : i + k + 32] == y[j + k : j + k + 32]:
        k += 32
    while k < n and x[i + k] == y[j + k]:
        k += 1
    return k


def beside(x: list[bytes], y: list[bytes], i: int, j: int) -> list[tuple[int, int, int]]:
    """Stretches of equal words (place in x, in y, words) from (i, j) on; between them ``GAP`` words at most on either side."""
    out = []
    while True:
        k = equal_words(x, y, i, j)
        if k:
            out.append((i, j, k))
        i, j = i + k, j + k
        v = y[j : j + GAP + AGAIN]
        near: dict[tuple, int] = {}
        for d, w in enumerate(zip(v, v[1:], v[2:])):
            near.setdefault(w, d)
        u = x[i : i + GAP + AGAIN]
        steps = [(c + d, c, d) for c, w in enumerate(zip(u, u[1:], u[2:])) if (d := near.get(w)) is not None]
        if not steps:
            return out
        _, c, d = min(steps)
        i, j = i + c, j + d


def jaccard(a: list[bytes], b: list[bytes], size: int = SHINGLE) -> float:
    s, t = (set(zip(*(x[k:] for k in range(size)))) for x in (a, b))
    return len(s & t) / len(s | t) if s or t else 0.0


class Likeness:
    """Jaccard similarity of the shingles of two stretches; hashes of the shingles are computed when first asked for."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.texts, self.hashes = (a, b), None

    def __call__(self, p: int, e: int, q: int, f: int) -> float:
        if self.hashes is None:
            self.hashes = [list(map(hash, zip(*(x[k:] for k in range(SHINGLE))))) for x in self.texts]
        s, t = (set(x[i : max(i, k - SHINGLE + 1)]) for x, i, k in ((self.hashes[0], p, e), (self.hashes[1], q, f)))
        common = len(s & t)
        return common / max(1, len(s) + len(t) - common)


def good_runs(a: list[bytes], b: list[bytes], chain: list[tuple[int, int, int]], paragraph: int, similarity: float, alike: Likeness):
    """(start and end in a, in b) of the runs of a chain that are alike; a run that isn't is cut at its longest gap.

    A run that is up to ``GAP`` words too short is widened to a paragraph if that is alike too.
    """
    todo = [(0, len(chain) - 1)]
    while todo:
        first, last = todo.pop()
        (p, q, _), (x, y, k) = chain[first], chain[last]
        e, f = x + k, y + k
        short = max(0, paragraph - min(e - p, f - q))
        if short > GAP:
            continue
        aligned = sum(max(0, x[2] - SHINGLE + 1) for x in chain[first : last + 1])
        # A run with few aligned shingles is cut at once, and one that would need more of them in a paragraph isn't widened.
        if short and aligned < CUT_AT_ONCE * 1.3 * (paragraph - SHINGLE + 1):
            continue
        likely = aligned >= CUT_AT_ONCE * max(e - p, f - q)
        if first == last or likely and alike(p, e, q, f) >= similarity:
            for l in range(short + 1):
                r = short - l
                if min(p, q) >= l and e + r <= len(a) and f + r <= len(b) and (not short or alike(p - l, e + r, q - l, f + r) >= similarity):
                    yield p - l, e + r, q - l, f + r
                    break
            continue
        gaps = [max(v[0] - u[0], v[1] - u[1]) - u[2] for u, v in zip(chain[first:last], chain[first + 1 : last + 1])]
        cut = first + gaps.index(max(gaps))
        todo += [(first, cut), (cut + 1, last)]


def common_stretches(a: list[bytes], b: list[bytes], spots: list[tuple[int, int]], paragraph: int = PARAGRAPH, similarity: float = SIMILARITY):
    """(start and end in a, start and end in b) of verified stretches around colliding shingles.

    Places that an earlier stretch holds both are linked already, and what an earlier chain has grown isn't grown again.
    """
    out: dict[tuple[int, int, int, int], None] = {}
    held: dict[int, int] = {}  # distance of the two places -> end in a of what was grown at it
    back, alike = (a[::-1], b[::-1]), Likeness(a, b)
    for i, j in sorted(spots):
        if i < held.get(j - i, -1) or a[i : i + SHINGLE] != b[j : j + SHINGLE] or any(p <= i < e and q <= j < f for p, e, q, f in out):
            continue
        left = [(len(a) - x - k, len(b) - y - k, k) for x, y, k in beside(*back, len(a) - 1 - i, len(b) - 1 - j)]
        right = beside(a, b, i, j)
        x, y, k = left[0]
        chain = [*left[:0:-1], (x, y, k - 1 + right[0][2]), *right[1:]]
        for x, y, k in chain:
            held[y - x] = max(held.get(y - x, -1), x + k)
        out.update(dict.fromkeys(good_runs(a, b, chain, paragraph, similarity, alike)))
    return list(out)


def cut_around(batches, reach: int = 2 * PARAGRAPH):
    """a, b, spots, the words of the text of a from ``reach`` before the first spot to ``reach`` behind the last, and the place of the first of them."""
    for batch in batches:
        cuts, firsts, last, words = [], [], None, []
        for node, spots, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if node != last:  # rows come sorted by text
                last, words = node, words_of(text.as_py())
            places = [s["i"] for s in spots]
            firsts.append(max(0, min(places) - reach))
            cuts.append(b" ".join(words[firsts[-1] : max(places) + reach]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cuts, pa.binary()), pa.array(firsts, pa.int32())], names=["a", "b", "spots", "cut", "first"])


#: Shingles of a paragraph, and how many stand before and behind one that it may hold.
WIDTH, AROUND = PARAGRAPH - SHINGLE + 1, PARAGRAPH - SHINGLE
#: Words before and behind a shingle that are kept with it to compare owners that resemble no centre.
REACH = PARAGRAPH + GAP
#: Owners of a value that are all compared with one another in one task, by products of their shingles.
TOGETHER = 512
#: Owners of a key that are all compared with one another; with more of them, the centres of the first round, and by how much they grow.
CROWD, FIRST_CENTRES, CENTRES_GROW = 32, 4, 16
#: Words around places that are in one batch at most.
BATCH_WORDS = 1_000_000
LINK = "a bigint, b bigint, p bigint, e bigint, q bigint, f bigint"
NEAR = "value bigint, root bigint, node bigint, place int, ahead int, words array<bigint>, before int, least int, around array<int>"


def link_batch(links: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*links)) if links else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["a", "b", "p", "e", "q", "f"])


def fewest_shingles(around: np.ndarray, before: int) -> int:
    """The least number of different shingles in a paragraph that holds the shingle at ``before``."""
    if len(np.unique(around)) == len(around):
        return min(WIDTH, len(around))
    rows = np.sort(windows_around(around, before), axis=1)
    return int((1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)).min(initial=WIDTH))


def stretches(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """The stretches [start, end) of an array as lists."""
    lens = end - start
    return lists(flat[np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())], lens)


def neighbourhoods(batches):
    """Rows of ``NEAR``: 64-bit hashes of the words around a place, of which ``ahead`` stand before it.

    ``around`` are 32 bits of the hash of each shingle of the paragraphs that hold the place, ``before`` of them in front of it; two
    owners that are alike have ``least`` or more in common (less one, for shingles that share these bits).
    """
    for batch in batches:
        for a, b in slices(batch.column(2)):
            words, first = hashed_words(batch.column(2).slice(a, b - a))
            shingles = mix(shingle_hashes(words), SEEDS[-1]).astype(np.uint32).view(np.int32)
            at = batch.column(1).slice(a, b - a)
            doc = np.repeat(np.arange(b - a), pc.list_value_length(at).to_numpy())
            value, root, place = (pc.struct_field(at.flatten(), k).to_numpy() for k in ("value", "root", "place"))
            some = np.flatnonzero(place <= first[doc + 1] - first[doc] - SHINGLE)  # else it's of another text of a repeated id
            # Texts in which a shingle stands twice.
            inside = np.repeat(np.arange(b - a), np.maximum(0, np.diff(first) - SHINGLE + 1))
            each = np.arange(len(inside)) + (first[:-1] - np.concatenate(([0], np.cumsum(np.bincount(inside, minlength=b - a))[:-1])))[inside]
            keys = np.sort(inside.astype(np.uint64) << np.uint64(32) | shingles[each].view(np.uint32)) if len(each) else np.empty(0, np.uint64)
            repeats = np.zeros(b - a, bool)
            repeats[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64)] = True
            for c in range(0, len(some), BATCH_WORDS // (2 * REACH)):
                part = some[c : c + BATCH_WORDS // (2 * REACH)]
                d, p = doc[part], place[part]
                g, begin, end = first[d] + p, first[d], first[d + 1]
                low, high = np.maximum(begin, g - REACH), np.minimum(end, g + SHINGLE + REACH)
                from_, to = np.maximum(begin, g - AROUND), np.minimum(end - SHINGLE + 1, g + AROUND + 1)
                fewest = np.minimum(WIDTH, to - from_)
                for k in np.flatnonzero(repeats[d]).tolist():
                    fewest[k] = fewest_shingles(shingles[from_[k] : to[k]], int(g[k] - from_[k]))
                least = np.ceil(SIMILARITY * fewest - 1e-9).astype(np.int32) - 1
                node = batch.column(0).slice(a, b - a).take(pa.array(d))
                cols = [pa.array(value[part]), pa.array(root[part]), node, pa.array(p, pa.int32()), pa.array(g - low, pa.int32()), stretches(words.view(np.int64), low, high)]
                cols += [pa.array(g - from_, pa.int32()), pa.array(least), stretches(shingles, from_, to)]
                yield pa.RecordBatch.from_arrays(cols, names=["value", "root", "node", "place", "ahead", "words", "before", "least", "around"])


class Owner:
    """The words around a place, from the fields of ``NEAR``."""

    __slots__ = ("node", "place", "low", "ahead", "words")

    def __init__(self, o: dict):
        self.node, self.place, self.low, self.ahead, self.words = o["node"], o["place"], o["place"] - o["ahead"], o["ahead"], o["words"]

    def links(self, other: Owner) -> list[tuple[int, int, int, int, int, int]]:
        """Stretches of both that are alike, the lesser place first."""
        x, y = (self, other) if (self.node, self.place) < (other.node, other.place) else (other, self)
        found = common_stretches(x.words, y.words, [(x.ahead, y.ahead)])
        out = [(x.node, y.node, p + x.low, e + x.low, q + y.low, f + y.low) for p, e, q, f in found]
        return [v for v in out if v[0] != v[1] or v[3] <= v[4]]  # two places of one text are apart


def groups(batches):
    """Tables of the rows of one value each; rows come sorted by value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]).tolist()
        if held and held[-1].column(0)[0].as_py() != value[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)]).combine_chunks()
            held = []
        held.append(batch.slice(edges[-2], edges[-1] - edges[-2]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of each owner's values, which are the values of two owners or more, and one after them for all others; which owner has which column; whether all of an owner's values differ."""
    n, own = len(lens), np.repeat(np.arange(len(lens)), lens)
    known, ids = np.unique(values, return_inverse=True)
    pairs = np.sort(own * len(known) + ids)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    owners = np.bincount(pairs % max(1, len(known)), minlength=len(known))
    differ = np.bincount(pairs // max(1, len(known)), minlength=n) == lens
    shared = owners > 1
    width = int(shared.sum())
    column = np.where(shared, np.cumsum(shared) - 1, width)
    columns = np.full((n, int(lens.max(initial=0))), width)
    columns[own, np.arange(len(own)) - np.repeat(np.cumsum(lens) - lens, lens)] = column[ids]
    return columns, marked(columns, width), differ


def marked(columns: np.ndarray, width: int) -> np.ndarray:
    has = np.zeros((len(columns), width + 1), np.float32)
    has[np.arange(len(columns))[:, None], columns] = 1
    has[:, width] = 0
    return has


#: What a shingle that is in common adds to a stretch's score, and one that isn't, in thousandths.
COMMON, ALONE = round(500 * (1 - SIMILARITY)), -round(1000 * SIMILARITY)


def best_scores(common: np.ndarray, paragraph: int = WIDTH) -> np.ndarray:
    """For each row the best score of a stretch of a paragraph or more, of shingles that all differ; ``common`` are those that the other owner has.

    Stretches of s and t different shingles with c in common are alike if c / (s + t - c) reaches the similarity S, that is if
    (1 + S) c >= S (s + t).  Then the scores, (1 + S) / 2 c - S s and the same with t, add up to 0 or more, so pairs with less are left out without loss.
    """
    if common.shape[1] < paragraph:
        return np.full(len(common), -(1 << 30))
    run = np.zeros((len(common), common.shape[1] + 1), np.int32)
    np.cumsum(np.where(common, COMMON, ALONE), axis=1, out=run[:, 1:])
    return (run[:, paragraph:] - np.minimum.accumulate(run, axis=1)[:, : run.shape[1] - paragraph]).max(axis=1)


def best_scores_with_repeats(common: np.ndarray, before: np.ndarray, paragraph: int = WIDTH) -> np.ndarray:
    """As ``best_scores``, of shingles that repeat, which count once in a stretch; ``before`` is the place of the same shingle before each, or -1."""
    out = np.full(len(common), -(1 << 30))
    if common.shape[1] < paragraph:
        return out
    at, start = np.arange(common.shape[1]), np.arange(common.shape[1] - paragraph + 1)[:, None]
    once = (at >= start) & (before < start)
    for c in range(0, len(common), 64):
        weight = np.where(common[c : c + 64], COMMON, ALONE).astype(np.int32)
        run = np.cumsum(once * weight[:, None, :], axis=2, dtype=np.int32)
        out[c : c + 64] = np.where(at >= start + paragraph - 1, run, -(1 << 30)).max(axis=(1, 2))
    return out


def place_before(shingles: np.ndarray) -> np.ndarray:
    order = np.argsort(shingles, kind="stable")
    same = np.r_[False, shingles[order][1:] == shingles[order][:-1]]
    out = np.full(len(shingles), -1)
    out[order[same]] = order[np.flatnonzero(same) - 1]
    return out


def likely_pairs(owners: pa.Table) -> list[tuple[int, int]]:
    """Pairs of owners of different components that have enough shingles in common, in the order of the owners."""
    root, least, ahead = (owners[c].to_numpy() for c in ("root", "least", "ahead"))
    words = owners["words"].chunk(0)
    lens = pc.list_value_length(words).to_numpy()
    flat = shingle_hashes(np.concatenate((words.flatten().to_numpy().view(np.uint64), np.zeros(SHINGLE - 1, np.uint64))))
    flat = flat[np.arange(lens.sum()) + SHINGLE <= np.repeat(np.cumsum(lens), lens)]
    lens = np.maximum(0, lens - SHINGLE + 1)
    columns, has, differ = numbered(flat, lens)
    # Those of the paragraphs that hold the place.
    around = marked(np.where(np.abs(np.arange(columns.shape[1]) - ahead[:, None]) <= AROUND, columns, has.shape[1] - 1), has.shape[1] - 1)
    enough = (around @ around.T >= np.minimum(least[:, None], least)) & (root[:, None] != root)
    k, m = np.nonzero(np.triu(enough, 1))
    if not len(k):
        return []
    has, ends, scores = has > 0, np.cumsum(lens), np.zeros(len(k), np.int64)
    for x, y in ((k, m), (m, k)):
        open_ = scores >= -COMMON * columns.shape[1]  # what the other side can still bring
        for c in range(0, len(k), 8192):
            part = c + np.flatnonzero(open_[c : c + 8192] & differ[x[c : c + 8192]])
            scores[part] += best_scores(has[y[part][:, None], columns[x[part]]])
        for o in np.unique(x[open_ & ~differ[x]]).tolist():
            part = np.flatnonzero(open_ & (x == o))
            before = place_before(flat[ends[o] - lens[o] : ends[o]])
            scores[part] += best_scores_with_repeats(has[y[part][:, None], columns[o, : lens[o]]], before)
    good = scores >= 0
    return list(zip(k[good].tolist(), m[good].tolist()))


def links_within(batches):
    """Links between all owners of each value that have enough shingles in common; what is joined already isn't compared again."""
    for owners in groups(batches):
        owners = owners.take(pa.array(np.lexsort((owners["place"].to_numpy(), owners["node"].to_numpy()))))
        pairs = likely_pairs(owners.combine_chunks())
        if not pairs:
            continue
        got, root, each = [], owners["root"].to_pylist(), {}
        chosen = sorted({k for pair in pairs for k in pair})
        for k, row in zip(chosen, owners.select(["node", "place", "ahead", "words"]).take(chosen).to_pylist()):
            each[k] = Owner(row)
        for k, m in pairs:
            if root[k] != root[m] and (found := each[k].links(each[m])):
                got += found
                root = [root[k] if r == root[m] else r for r in root]
        yield link_batch(got)


def scores_of_pairs(sides: list[pa.ListArray]) -> np.ndarray:
    """For each pair of owners' words the best scores of both, see ``best_scores``, added up."""
    keys, lens = [], []
    for words in sides:
        n = pc.list_value_length(words).to_numpy()
        flat = shingle_hashes(np.concatenate((words.flatten().to_numpy().view(np.uint64), np.zeros(SHINGLE - 1, np.uint64))))
        real = np.arange(n.sum()) + SHINGLE <= np.repeat(np.cumsum(n), n)
        # The same shingle in two pairs has two keys.
        keys.append((flat + np.repeat(np.arange(len(n)), n).astype(np.uint64) * np.uint64(SEEDS[0]))[real])
        lens.append(np.maximum(0, n - SHINGLE + 1))
    total = np.zeros(len(lens[0]), np.int64)
    for u, v, m in ((keys[0], keys[1], lens[0]), (keys[1], keys[0], lens[1])):
        ends, own, common = np.cumsum(m), np.repeat(np.arange(len(m)), m), np.isin(u, v)
        # What follows a row's last shingle counts as alone, so a stretch that holds it is never the best one.
        table = np.zeros((len(m), max(WIDTH, int(m.max(initial=0)))), bool)
        table[own, np.arange(len(u)) - (ends - m)[own]] = common
        scores = best_scores(table).astype(np.int64)
        order = np.argsort(u, kind="stable")
        for k in np.unique(own[order[1:][u[order][1:] == u[order][:-1]]]).tolist():
            part = slice(ends[k] - m[k], ends[k])
            scores[k] = best_scores_with_repeats(common[part][None], place_before(u[part]))[0]
        total += np.where(m < WIDTH, -(1 << 30), scores)
    return total


def links_of_pairs(batches):
    """Links of pairs x, y, with the components ``s, t`` that they join."""
    for batch in batches:
        got = []
        likely = np.flatnonzero(scores_of_pairs([pc.struct_field(side, "words") for side in batch.columns]) >= 0).tolist()
        for x, y in ([side[k] for side in batch.columns] for k in likely):
            x, y = x.as_py(), y.as_py()
            got += [(*v, x["root"], y["root"]) for v in Owner(x).links(Owner(y))]
        links = link_batch([v[:6] for v in got])
        for k, name in ((6, "s"), (7, "t")):
            links = links.append_column(name, pa.array([v[k] for v in got], pa.int64()))
        yield links


def windows_around(around: np.ndarray, ahead: int) -> np.ndarray:
    """The paragraphs, as rows of shingles, that hold the shingle at ``ahead``."""
    first, last = max(0, ahead - WIDTH + 1), min(ahead, len(around) - WIDTH)
    return np.lib.stride_tricks.sliding_window_view(around, WIDTH)[first : last + 1] if last >= first else np.zeros((0, WIDTH), around.dtype)


def rarest(batches):
    """value, node, place, shingle: of each paragraph around a place the rarest shingles, so many that paragraphs which are alike share one."""
    for batch in batches:
        got = []
        for value, node, place, ahead, size, shared in zip(*(column.to_pylist() for column in batch.columns)):
            counts, hashes = np.ones(size, np.int64), np.arange(size, dtype=np.int64) + (1 << 40)  # shingles of this place alone come first
            at = [s["k"] for s in shared]
            counts[at], hashes[at] = [s["owners"] for s in shared], [s["shingle"] for s in shared]
            order = np.lexsort((hashes, counts))
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            windows, chosen = windows_around(rank, ahead), set()
            if len(np.unique(hashes)) == size:  # all shingles of a paragraph differ
                most = WIDTH - int(np.ceil(SIMILARITY * WIDTH - 1e-9)) + 1
                chosen = set(hashes[order[np.unique(np.partition(windows, most - 1, axis=1)[:, :most])]].tolist())
                windows = windows[:0]
            for row in windows:
                different = list(dict.fromkeys(hashes[order[np.sort(row)]].tolist()))
                chosen.update(different[: len(different) - int(np.ceil(SIMILARITY * len(different) - 1e-9)) + 1])
            got += [(value, node, place, h) for h in chosen if h < 1 << 40]
        cols = list(zip(*got)) if got else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(cols, kinds)], names=["value", "node", "place", "shingle"])


def clusters(links: DataFrame) -> DataFrame:
    """node, start_word, end_word, span, root: passages, which are the stretches of links put together where they overlap, and their components."""
    ends = links.select(F.col("a").alias("node"), F.col("p").alias("start"), F.col("e").alias("end"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.col("q").alias("start"), F.col("f").alias("end"))).distinct()
    ordered = W.partitionBy("node").orderBy("start", "end")
    new = F.coalesce(F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    islands = ends.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("node", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    spans = scratch(spans.withColumn("span", F.xxhash64("node", "start_word")), "spans")
    of = islands.join(spans, ["node", "island"]).select("node", "start", "end", "span")
    one = of.select(F.col("node").alias("a"), F.col("start").alias("p"), F.col("end").alias("e"), F.col("span").alias("s"))
    two = of.select(F.col("node").alias("b"), F.col("start").alias("q"), F.col("end").alias("f"), F.col("span").alias("t"))
    edges = links.join(one, ["a", "p", "e"]).join(two, ["b", "q", "f"]).select(F.col("s").alias("a"), F.col("t").alias("b"))
    return spans.join(components(edges).withColumnRenamed("node", "span"), "span")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b, p, e, q, f of the pairs ``a, i, b, j`` of nodes and places, ordered: the stretches [p, e) and [q, f) around them that are alike."""
    # Linear in the places of the two texts.
    pairs = scratch(pairs.groupBy("a", "b").agg(F.collect_set(F.struct("i", "j")).alias("spots")), "pairs")
    # Of the first text only the words around the spots travel to the second one.
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "spots", "text_a")
    around = with_a.mapInArrow(cut_around, "a bigint, b bigint, spots array<struct<i: int, j: int>>, cut binary, first int")
    both = around.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "spots", "cut", "first", "text_b")

    def verify(batches):
        last, words = None, []
        for batch in batches:
            got = []
            for a, b, spots, cut, first, text in zip(*batch.columns):  # one row at a time: the texts of a batch are long
                a, b, first = a.as_py(), b.as_py(), first.as_py()
                if b != last:  # rows come sorted by text
                    last, words = b, words_of(text.as_py())
                places = [(s["i"] - first, s["j"]) for s in spots.as_py()]
                low = max(0, min(j for _, j in places) - 2 * PARAGRAPH)
                near = words[low : max(j for _, j in places) + 2 * PARAGRAPH]
                for p, e, q, f in common_stretches(cut.as_py().split(), near, [(i, j - low) for i, j in places]):
                    if a != b or e + first <= q + low:  # two places of one text are apart
                        got.append((a, b, p + first, e + first, q + low, f + low))
            yield link_batch(got)

    return scratch(both.mapInArrow(verify, LINK), "links")


def located(entries: DataFrame, grouped: DataFrame) -> DataFrame:
    """The entries ``value, node, place`` with ``root``: the component of the passage that holds the place, or a number of their own."""
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("end", "held")]
    at = entries.select("node", F.col("place").alias("pos"), *nothing, "value")
    starts = grouped.select("node", F.col("start_word").alias("pos"), F.col("end_word").alias("end"), F.col("root").alias("held"), F.lit(None).cast("bigint").alias("value"))
    before = W.partitionBy("node").orderBy("pos", F.col("value").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    last = at.unionByName(starts).withColumn("last", F.last(F.when(F.col("value").isNull(), F.struct("end", "held")), True).over(before))
    inside = F.when(F.col("pos") < F.col("last.end"), F.col("last.held"))
    return last.where("value is not null").select("value", "node", F.col("pos").cast("int").alias("place"), F.coalesce(inside, F.xxhash64("node", "pos")).alias("root"))


def undecided(entries: DataFrame, key: str) -> DataFrame:
    """Entries of those keys whose owners aren't all joined yet, with the number ``n`` of these owners."""
    keys = entries.groupBy(key).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select(key, "n")
    return entries.join(keys, key)


def rare_keys(near: DataFrame) -> DataFrame:
    """key, value, node, place, root, n: owners of crowded values keyed anew by the rarest shingles around them; n owners that aren't all joined."""
    each = near.select("value", "node", "place", "before", F.size("around").alias("size"), F.posexplode("around").alias("k", "shingle"))
    counts = each.groupBy("value", "shingle").agg(F.count("*").alias("owners")).where("owners > 1")
    shared = each.join(counts, ["value", "shingle"]).groupBy("value", "node", "place", "before", "size").agg(F.collect_list(F.struct("k", "shingle", "owners")).alias("shared"))
    chosen = shared.mapInArrow(rarest, "value bigint, node bigint, place int, shingle bigint")
    keys = chosen.join(near.select("value", "node", "place", "root"), ["value", "node", "place"])
    keys = scratch(keys.select(F.xxhash64("value", "shingle").alias("key"), "value", "node", "place", "root"), "keys")
    return undecided(keys, "key")


def crowded_links(near: DataFrame) -> DataFrame:
    """Links between owners of crowded values, which are keyed anew by the rarest shingles around them, in rounds.

    Each round makes some more owners of a key centres (all of them in the last one), and each
    centre meets those that come after it and aren't in its component.
    """
    order = F.pmod(F.xxhash64("key", "node", "place"), F.lit(1 << 40)) / float(1 << 40)
    active = scratch(rare_keys(near).withColumn("at", order), "active")
    links, before, width = active.sparkSession.createDataFrame([], LINK), 0, FIRST_CENTRES
    spot = ["value", "node", "place"]
    while not active.isEmpty():
        last = F.when(F.col("n") <= CROWD, 1.0).otherwise(width / F.col("n"))
        new = active.where((F.col("at") >= before / F.col("n")) & (F.col("at") < last))
        centres = new.select("key", *[F.col(c).alias(f"c_{c}") for c in ("node", "place", "root", "at")])
        x, y = F.struct("node", "place"), F.struct(F.col("c_node").alias("node"), F.col("c_place").alias("place"))
        later = (F.col("at") > F.col("c_at")) | (F.col("at") == F.col("c_at")) & (x > y)
        two = centres.join(active, "key").where(later & (F.col("root") != F.col("c_root"))).select("value", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
        # Shingles first, then the words of those pairs that have enough of them in common.
        for side in ("x", "y"):
            two = two.join(near.select("value", F.struct("node", "place").alias(side), F.struct("least", "around").alias(f"{side}_near")), ["value", side])
        enough = F.size(F.array_intersect("x_near.around", "y_near.around")) >= F.least("x_near.least", "y_near.least")
        two = two.where(enough).select("value", "x", "y")
        for side in ("x", "y"):
            two = two.join(near.select("value", F.struct("node", "place").alias(side), F.struct("node", "place", "root", "ahead", "words").alias(f"{side}_owner")), ["value", side])
        found = scratch(two.select("x_owner", "y_owner").mapInArrow(links_of_pairs, LINK + ", s bigint, t bigint"), "links")
        links = links.unionByName(found.drop("s", "t"))
        active = active.where((F.col("n") > CROWD) & (F.col("n") > width))
        if active.isEmpty():
            break
        # Components of the components that this round has joined; n keeps its value, as the order of centres depends on it.
        merged = components(found.select(F.col("s").alias("a"), F.col("t").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("new"))
        active = active.join(merged, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        near = near.join(merged, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
        open_keys = undecided(active.drop("n"), "key").select("key").distinct()
        active = scratch(active.join(open_keys, "key", "left_semi"), "active")
        before, width = width, width * CENTRES_GROW
    return links


def links_of_the_rest(shared: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between owners ``value, node, place`` of a value of which neither is a centre.

    Values whose owners are all in one component are done.  The others' owners are compared by the words around
    their places.  Of owners with the same words around one stands for all.  Up to ``TOGETHER``
    of them are compared directly, more of them as ``crowded_links`` says.
    """
    rest = scratch(undecided(located(shared, clusters(links)), "value").drop("n"), "rest")
    at = rest.groupBy("node").agg(F.collect_set(F.struct("value", "root", "place")).alias("at"))
    near = scratch(at.join(texts, "node").select("node", "at", "text").mapInArrow(neighbourhoods, NEAR), "near")
    same = ["value", "ahead", "h1", "h2"]
    each = near.select("value", "root", "node", "place", "ahead", F.size("words").alias("size"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
    first = each.groupBy(*same).agg(F.min(F.struct("node", "place")).alias("first"), F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("copies"))
    of = each.join(first.where("copies > 1 and x <> y"), same).where("struct(node, place) <> first")
    low, low_first = F.col("place") - F.col("ahead"), F.col("first.place") - F.col("ahead")
    ends = [low_first, low_first + F.col("size"), low, low + F.col("size")]
    equal = of.where((F.col("size") >= PARAGRAPH) & ((F.col("node") != F.col("first.node")) | (ends[1] <= low)))
    equal = equal.select(F.col("first.node").alias("a"), F.col("node").alias("b"), *[v.cast("bigint").alias(c) for v, c in zip(ends, ("p", "e", "q", "f"))])
    chosen = first.select("value", "first.node", "first.place")
    keys = near.select("value", "node", "place", "root").join(chosen, ["value", "node", "place"], "left_semi")
    left = scratch(undecided(keys, "value").select("value", "node", "place", "n"), "left")
    near = near.join(left, ["value", "node", "place"])
    few = near.where(F.col("n") <= TOGETHER).select("value", "node", "place", "root", "ahead", "words", "least")
    few = few.repartition("value").sortWithinPartitions("value")
    out = equal.unionByName(few.mapInArrow(links_within, LINK))
    crowded = scratch(near.where(F.col("n") > TOGETHER).drop("n"), "crowded")
    if not crowded.isEmpty():
        out = out.unionByName(crowded_links(crowded))
    return scratch(out, "links")


def passages(docs: DataFrame, bands: int | None = None) -> DataFrame:
    """doc_id, start_word, end_word, n_words, cluster_id, copy_of, kept for each passage that repeats across documents.

    Of each cluster the passage of the least doc_id is kept.
    """
    bands = bands or tune_bands()
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy_key"))
    firsts = scratch(rows.groupBy("copy_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "firsts")
    # A text's own id is its node; of copies the one with the least id stands for all, and the others are not searched.
    texts = docs.withColumnRenamed("doc_id", "node")
    found = scratch(entries(texts, bands).join(firsts.select("node"), "node", "left_semi"), "bands")
    spot = F.struct("node", "place")
    each = found.select("node", F.inline(F.arrays_zip("values", "places"))).toDF("node", "value", "place")
    # One shuffle and one sort: first the values of two texts or more, then what is needed of these alone.
    of = W.partitionBy("value")
    some = each.withColumn("least", F.min("node").over(of)).withColumn("last", F.max("node").over(of)).where("least <> last")
    # Centres are chosen in another order for each value, so that a text that is no match for one value's owners doesn't stand for all its neighbours.
    salted = {f"c{r}": F.min_by(spot, F.xxhash64(F.lit(r), "value", "node", "place")).over(of) for r in range(CENTRES - 1)}
    shared = scratch(some.select("value", "node", "place", F.count("*").over(of).alias("n"), F.min(spot).over(of).alias("c"), *[v.alias(k) for k, v in salted.items()]), "shared")
    met = shared.withColumn("c", F.explode(F.array_distinct(F.array("c", *[f"c{r}" for r in range(CENTRES - 1)])))).where("node <> c.node or place <> c.place")
    swap = (F.col("node") > F.col("c.node")) | (F.col("node") == F.col("c.node")) & (F.col("place") > F.col("c.place"))
    pairs = met.select(
        F.least("node", "c.node").alias("a"),
        F.when(swap, F.col("c.place")).otherwise(F.col("place")).alias("i"),
        F.greatest("node", "c.node").alias("b"),
        F.when(swap, F.col("place")).otherwise(F.col("c.place")).alias("j"),
    )
    links = verified(pairs, texts)
    links = links.unionByName(links_of_the_rest(shared.where("n > 2").select("value", "node", "place"), links, texts))
    grouped = clusters(links)
    # Clusters within one document are its own repeats.
    first = grouped.groupBy("root").agg(F.min(F.struct("node", "start_word")).alias("first"), F.max("node").alias("last")).where("first.node <> last").drop("last")
    clustered = grouped.join(first, "root").select(F.col("node").alias("doc_id"), "start_word", "end_word", F.col("first.node").alias("cluster_id"), F.lit(None).cast("long").alias("copy_of"), (F.struct("node", "start_word") == F.col("first")).alias("kept"))
    lengths = found.where(F.col("n_words") >= PARAGRAPH).select("node", F.col("n_words").cast("long").alias("end_word")).distinct()
    copied = rows.join(firsts.where("copies > 1"), "copy_key").join(lengths, "node")
    whole = copied.select("doc_id", F.lit(0).cast("long").alias("start_word"), "end_word", F.col("node").alias("cluster_id"), F.when(F.col("doc_id") != F.col("node"), F.col("node")).alias("copy_of"), (F.col("doc_id") == F.col("node")).alias("kept"))
    both = clustered.unionByName(whole)
    return both.select("doc_id", F.col("start_word").cast("int").alias("start_word"), F.col("end_word").cast("int").alias("end_word"), (F.col("end_word") - F.col("start_word")).cast("int").alias("n_words"), "cluster_id", "copy_of", "kept")
