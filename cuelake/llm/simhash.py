"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments of 32 bits.  A table lists each segment's value with its owner.
For each fingerprint the values within one bit of its segments are enumerated and looked up in that
table, and matches are verified by their complete distance.  Two fingerprints of 64 bits at
distance 2 or less always agree within one bit in one of two segments, so nothing is lost there.

Only distinct fingerprints are compared: copies meet in a grouping first.  A table entry with very
many owners (close copies of one text) is not joined with itself.  For distances up to 2 its owners
meet at the 65 values within one bit of their whole fingerprint instead: two fingerprints share such a
value exactly if they differ in two bits at most, and at most 65 owners share one.

Input cases: a text without words has the fingerprint 0, and null counts as empty.  A text of
fewer words than a shingle is one shingle.  Repeated rows and equal texts share a component.
A null id takes part; a component of null ids alone has the id null.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, scratch
from .components import components
from .paragraphs import Hasher, mix, shingle_hashes, words_of

SEED = 42
#: Owners of a segment value up to which they are joined with one another.
CROWD = 32
HALF = (1 << 32) - 1


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; all words if they are fewer; none without words."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 1:
        return words
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; as a signed number."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    total = np.zeros(64, np.int64)
    for a in range(0, n, 255):  # sums of 255 bits fit a byte
        total += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprint(text: str | None, size: int = 3, n_words: int = 1, distinct: bool = False) -> list[int]:
    """``n_words`` numbers of 64 bits from the shingles of the text, A to Z in lower case."""
    found = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), size)
    if distinct:
        found = list(dict.fromkeys(found))
    digest = xxhash.xxh64_intdigest
    return [majority(np.fromiter([digest(s, SEED + k) for s in found], np.uint64, len(found))) for k in range(n_words)]


def fingerprints(docs: DataFrame, size: int = 3, n_words: int = 1, distinct: bool = False, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` plus ``fp array<bigint>``."""
    return map_rows(docs, lambda: lambda texts: [(fingerprint(t, size, n_words, distinct),) for t in texts], "fp array<bigint>", list(columns))


def segments(fp: Column, n_words: int) -> list[Column]:
    """Segment values as one number each, with the segment's place above its 32 bits."""
    out = []
    for k in range(n_words):
        word = F.element_at(fp, k + 1)
        out.append(F.shiftrightunsigned(word, 32).bitwiseOR(F.lit((2 * k) << 32)))
        out.append(word.bitwiseAND(F.lit(HALF)).bitwiseOR(F.lit((2 * k + 1) << 32)))
    return out


def candidates(nodes: DataFrame, n_words: int, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """From ``node bigint, fp``: candidate pairs ``a, b``, and the crowded table entries ``value``.

    The ball is enumerated from one side alone, by setting each bit that isn't set: of two values that
    differ in one bit, the one without it reaches the other.  Owners of a crowded value are paired
    with three of them, each the first in another order.
    """
    table = scratch(nodes.select("node", F.explode(F.array(*segments(F.col("fp"), n_words))).alias("value")), "segments")
    ordered = [F.min_by("node", F.xxhash64(F.lit(r), F.col("node"))).alias(f"centre{r}") for r in range(2)]
    owners = table.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("least"), *ordered).where(F.col("n") > crowd)
    owners = scratch(owners, "crowded")
    loose = table.join(owners.select("value"), "value", "left_anti")
    centres = owners.select("value", F.explode(F.array_distinct(F.array("least", "centre0", "centre1"))).alias("node"))
    entries = loose.select("value", "node").unionByName(centres).select(F.col("value"), F.col("node").alias("a"))
    clear = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)), lambda bit: F.col("value").bitwiseAND(bit) == 0)
    ball = F.concat(F.array("value"), F.transform(clear, lambda bit: F.col("value").bitwiseOR(bit)))
    probes = table.select(F.col("node").alias("b"), F.explode(ball).alias("value"))
    pairs = probes.join(entries, "value").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, owners.select("value")


def midpoint_edges(nodes: DataFrame) -> DataFrame:
    """Exact links ``a, b`` at distance 2 or less between 64-bit fingerprints ``node``, as stars at shared values."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    near = F.concat(F.array("node"), F.transform(bits, lambda bit: F.col("node").bitwiseXOR(bit)))
    at = nodes.select("node", F.explode(near).alias("value"))
    least = at.groupBy("value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("value", "a")
    return at.join(least, "value").where("node <> a").select("a", F.col("node").alias("b"))


def link_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: fingerprints of 64 bits, linked at distance 2 or less."""
    rows = scratch(fingerprints(docs, size).select("doc_id", F.element_at("fp", 1).alias("node")), "fingerprints")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    nodes = least.select("node", F.array("node").alias("fp"))
    pairs, crowded = candidates(nodes, 1)
    links = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    if not crowded.isEmpty():
        value, word = F.explode(F.array(*segments(F.col("fp"), 1))), F.col("value")
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        reach = nodes.select("node", value.alias("value")).select("node", F.explode(F.concat(F.array(word), F.transform(bits, lambda bit: word.bitwiseXOR(bit)))).alias("value"))
        dense = reach.join(crowded, "value", "left_semi").select("node").distinct()
        links = links.unionByName(midpoint_edges(dense))
    roots = components(links)
    # Each node that has links gets the least id of its component.  They grow with the rows, so neither side is broadcast.
    named = least.join(roots.hint("merge"), "node")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(ids, "root").select("node", "component_id")
    every = least.join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(every, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


#: For near-duplicate texts: shingles of five words; fingerprints of up to ``CLOSE`` bits apart are candidates by multi-index hashing.
TEXT_SHINGLE, TEXT_SIMILARITY, CLOSE = 5, 0.8, 3
#: At a similarity of 0.8 fingerprints differ in about ten bits, beyond any ball that can be enumerated.  Those pairs are found
#: by MinHashes in bands of three: they share a value with probability 1 - (1 - 0.8**3)**14 > 0.9999, wherever their differences lie.
BANDS, BAND_ROWS = 14, 3
BAND_SEEDS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
#: Centres of a shingle with many owners in its first round, and by how much they grow with each round.
CENTRES, CENTRES_GROW = 4, 16
#: Columns that tell a text: a node, and a second hash that differs where two texts share a node by chance.
TEXT_KEY = ("node", "check")


def band_values(shingle: np.ndarray) -> np.ndarray:
    """A number for each band from the hashes of a text's shingles; texts without shingles share theirs."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    shingle = mix(shingle, 0xD6E8FEB86659FD93)
    for k in range(0, len(shingle), 4096):
        least = np.minimum(least, (shingle[k : k + 4096] * BAND_SEEDS).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ row ^ (row >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def text_key(text: str = "text") -> list[Column]:
    """``node, check`` of a text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    check = F.call_function("shiftleft", F.crc32(whole), F.lit(31)).bitwiseOR(F.octet_length(whole).cast("bigint"))
    return [F.xxhash64(whole).alias("node"), check.alias("check")]


def sketched(docs: DataFrame, size: int, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` plus ``fp bigint``, the fingerprint, and ``bands array<bigint>``, both of the text's shingles."""

    def make():
        hashed = Hasher()

        def one(text):
            words = words_of(text)
            found = shingle_hashes(hashed(words), max(1, min(size, len(words))))
            return majority(mix(found, 0x9FB21C651E98DF25)), band_values(found).tolist()

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "fp bigint, bands array<bigint>", list(columns))


def shingle_set(text: str | None, size: int) -> list[int]:
    found = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), size)
    return list({xxhash.xxh64_intdigest(s, SEED) - (1 << 63) for s in found})


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return both.where(common >= similarity * (F.size("s") + F.size("t") - common)).select("a", "b")


def rare_entries(sets: DataFrame, similarity: float) -> DataFrame:
    """value, node, place, size, n: the rarest shingles of each set, so many that sets which are alike share one for certain; n owners, two at least."""
    each = sets.select("node", F.explode("shingles").alias("value"))
    counts = each.groupBy("value").agg(F.count("*").alias("owners"))
    ordered = each.join(counts, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("owners", "value"))).alias("v"))
    size = F.size("v")
    rare = ordered.select("node", size.alias("size"), F.posexplode(F.slice("v", F.lit(1), size - F.ceil(size * similarity - 1e-6).cast("int") + 1)).alias("place", "v"))
    rare = scratch(rare.where("v.owners > 1").select(F.col("v.value").alias("value"), "node", "place", "size"), "rare")
    return rare.join(rare.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value")


def stars(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def crowded_links(crowded: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """The links, and those among the owners ``node`` of crowded band values, which are keyed anew by their rarest shingles.

    Two sets that are alike share one of these, and their first common one stands near the start of both:
    no pair is lost.  In each round a shingle has some more of its owners for centres (all of
    them in the last one), and each new centre meets the owners that come after it and aren't in its
    component yet.  A shingle whose owners are in one component is done.
    """
    if crowded.isEmpty():
        return links
    none = sets.where(F.size("shingles") == 0).select("node")  # these are alike by definition
    links = links.unionByName(none.crossJoin(none.agg(F.min("node").alias("b"))).select(F.col("node").alias("a"), "b"))
    keys = rare_entries(sets.join(crowded.select("node").distinct(), "node", "left_semi"), similarity)
    at = F.pmod(F.xxhash64("value", "node"), F.lit(1 << 40)) / float(1 << 40)
    active, before, width = scratch(keys.withColumn("at", at), "active"), 0, CENTRES
    while not active.isEmpty():
        roots = scratch(components(links), "roots")
        links = stars(roots)
        here = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        unjoined = here.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("value")
        here = scratch(here.join(unjoined, "value", "left_semi"), "here")
        last = F.when(F.col("n") <= crowd, 1.0).otherwise(width / F.col("n"))
        new = here.where((F.col("at") >= before / F.col("n")) & (F.col("at") < last))
        centres = new.select("value", *[F.col(c).alias(f"c_{c}") for c in ("node", "root", "at", "size", "place")])
        later = (F.col("at") > F.col("c_at")) | (F.col("at") == F.col("c_at")) & (F.col("node") > F.col("c_node"))
        # What both sets hold from a first common shingle on must suffice; the margin is for rounding.
        enough = F.least(F.col("size") - F.col("place"), F.col("c_size") - F.col("c_place")) + 1e-6 >= similarity / (1 + similarity) * (F.col("size") + F.col("c_size"))
        met = centres.join(here, ["value"]).where(later & (F.col("root") != F.col("c_root")) & enough)
        pairs = scratch(met.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct(), "pairs")
        links = links.unionByName(scratch(alike(pairs, sets, similarity), "links"))
        active = scratch(here.where((F.col("n") > crowd) & (F.col("n") > width)).drop("root"), "active")
        before, width = width, width * CENTRES_GROW
    return links


def close_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` of ``node, fp``: equal fingerprints as a star, and fingerprints ``CLOSE`` or fewer bits apart through one node of each."""
    first = scratch(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "first")
    pairs, _ = candidates(first.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), 1)
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= CLOSE).distinct()
    of = first.select("fp", F.col("node").alias("x"))
    met = near.join(of.withColumnRenamed("fp", "a"), "a").select("b", F.col("x").alias("u")).join(of.withColumnRenamed("fp", "b"), "b").select("u", "x")
    same = nodes.join(first.where("n > 1").select("fp", F.col("node").alias("u")), "fp").where("node <> u").select("u", F.col("node").alias("x"))
    return met.unionByName(same).select(F.least("u", "x").alias("a"), F.greatest("u", "x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = TEXT_SIMILARITY, size: int = TEXT_SHINGLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, node, check, root of every row: texts whose sets of ``size``-word shingles are alike by ``similarity`` or more (Jaccard), joined transitively.

    Equal texts share a node, so each distinct text is compared once.  Close fingerprints, found by
    multi-index hashing, are verified and joined first.  Then owners of a band value that aren't joined yet are
    all compared with one another; those of crowded values as ``crowded_links`` says.  Every link is verified by the exact similarity.
    Where two different texts share a node, the one with the greater ``check`` is a group of its own.
    """
    rows = scratch(sketched(docs.select("doc_id", "text", *text_key()), size, ("doc_id", *TEXT_KEY)), "sketches")
    nodes = scratch(rows.groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("other"), F.min_by(F.struct("fp", "bands"), "check").alias("s")).select("node", "check", "other", "s.*"), "nodes")
    near = scratch(close_pairs(nodes.select("node", "fp")), "close")
    entries = nodes.select("node", F.explode("bands").alias("value"))
    owners = scratch(entries.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "owners")
    shared = entries.join(owners, "value")
    wanted = shared.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    texts = docs.select("text", *text_key()).join(nodes.join(wanted, "node", "left_semi").select(*TEXT_KEY), list(TEXT_KEY), "left_semi").dropDuplicates(["node"])
    sets = scratch(map_rows(texts, lambda: lambda ts: [(shingle_set(t, size),) for t in ts], "shingles array<bigint>", ["node"]), "shingles")
    joined = scratch(components(scratch(alike(near, sets, similarity), "links")), "joined")
    shared = scratch(shared.join(joined, "node", "left").select("value", "n", "node", F.coalesce("root", "node").alias("root")), "shared")
    loose = shared.where(F.col("n") <= crowd)
    met = loose.select("value", F.col("node").alias("a"), F.col("root").alias("root_a")).join(loose.select("value", F.col("node").alias("b"), F.col("root").alias("root_b")), "value")
    pairs = scratch(met.where("a < b and root_a <> root_b").select("a", "b").distinct(), "pairs")
    # From here on a component's links are its stars: fewer, and the same components.
    links = stars(joined).unionByName(scratch(alike(pairs, sets, similarity), "links"))
    links = crowded_links(shared.where(F.col("n") > crowd).select("node"), links, sets, similarity, crowd)
    named = nodes.join(components(links), "node", "left").select("node", "check", F.coalesce("root", "node").alias("root"))
    strange = rows.join(nodes.where("check <> other").select("node", F.col("check").alias("least")), "node").where("check <> least")
    alone = strange.select("doc_id", *TEXT_KEY, F.xxhash64(F.lit(SEED), *TEXT_KEY).alias("root"))
    return rows.select("doc_id", *TEXT_KEY).join(named, list(TEXT_KEY)).select("doc_id", *TEXT_KEY, "root").unionByName(alone)
