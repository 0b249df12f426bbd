"""Blocks of words that come twice near each other in a document, as runs on diagonals of equal n-grams.

Spark makes the words, hashes them and brings a document's segments together; words don't become rows and pairs of equal n-grams
aren't listed.  A document is searched in one task, distance by distance, in memory that is linear in its words and time
of at most ``max_words`` times its words; distances at which no n-gram comes again are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from cuelake.functions import text as T


def numbered(segs: DataFrame) -> DataFrame:
    """Segments with ``ord``, their place in the document by time."""
    return segs.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("start_ms", "seg_idx")) - 1)


def close_copies(grams: np.ndarray, reach: int) -> tuple[np.ndarray, list[int]]:
    """Places of n-grams that come again within ``reach`` words, and the distances at which they do."""
    order = np.argsort(grams, kind="stable")
    sorted_grams, gaps = grams[order], set()
    live, k, places = np.arange(len(order)), 0, None
    while len(live):  # the k-th next copy is farther away than the one before it
        k += 1
        live = live[: np.searchsorted(live, len(order) - k)]
        apart = order[live + k] - order[live]
        near = (sorted_grams[live + k] == sorted_grams[live]) & (apart <= reach)
        live = live[near]
        gaps.update(np.unique(apart[near]).tolist())
        places = np.sort(order[live]) if places is None else places
    return (np.zeros(0, np.int64) if places is None else places), sorted(gaps)


def repeated_runs(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, known: np.ndarray, size: int = 8, least_words: int = 10, least_chars: int = 20, max_words: int = 300, max_ms: int = 300_000) -> list[np.ndarray]:
    """n_words, a, b (first token of each copy) of the runs of one document.

    ``words`` are hashes; of each token ``sizes`` has the characters and ``starts`` the time of its segment, if that is ``known``.
    """
    out = []
    if len(words) >= 2 * size:
        grams = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(grams)].view(np.uint64)
        places, gaps = close_copies(grams, max_words)
        chars = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        for gap in gaps:
            hit = places[: np.searchsorted(places, len(grams) - gap)]
            hit = hit[grams[hit] == grams[hit + gap]]
            hit = hit[known[hit] & known[hit + gap] & (np.abs(starts[hit + gap] - starts[hit]) <= max_ms)]
            cuts = np.flatnonzero(np.diff(hit) != 1) + 1
            a, last = hit[np.r_[0, cuts]] if len(hit) else hit, hit[np.r_[cuts, len(hit)] - 1] if len(hit) else hit
            n_words = last - a + size
            fit = (n_words >= least_words) & (chars[a + n_words] - chars[a] >= least_chars)
            out.append(np.stack([n_words, a, a + gap])[:, fit])
    return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, np.int64)] * 3


def longest_apart(lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of runs, longest first (then by place), of which no two share a token."""
    taken = np.zeros(int((b + lengths).max()) if len(b) else 0, bool)
    chosen = []
    for k in np.lexsort((b, a, -lengths)).tolist():
        copies = [slice(x, x + lengths[k]) for x in (a[k], b[k])]
        if not any(taken[c].any() for c in copies):
            for c in copies:
                taken[c] = True
            chosen.append(k)
    return chosen


def blocks(segs: DataFrame, **limits) -> DataFrame:
    """doc_id, a, b, n_words, and of each copy's first and last segment the place (by time) and its start or end, of the chosen runs of every document.

    A run inside one and the same stretch of segments takes its tokens but isn't returned.
    """
    ends = [(f"{copy}_{side}", side) for copy in ("first", "second") for side in ("lo", "hi")]
    kind = {f.name: f for f in segs.schema.fields}
    whole = [StructField(c, IntegerType()) for c in ("a", "b", "n_words")]
    places = [StructField(f"{c}_ord", IntegerType()) for c, _ in ends]
    times = [StructField(f"{c}_{t}", kind[t].dataType) for c, side in ends for t in ["start_ms" if side == "lo" else "end_ms"]]
    schema = StructType([kind["doc_id"], *whole, *[f for pair in zip(places, times) for f in pair]])
    arrow = to_arrow_schema(schema)

    def choose(batches):
        for batch in batches:
            docs = batch.column(1)
            first = docs.offsets.to_numpy()  # of each document's segments
            start_ms, _, end_ms, tokens = docs.flatten().flatten()
            at = tokens.offsets.to_numpy()  # of each segment's tokens
            owner = np.repeat(np.arange(len(tokens)), np.diff(at))
            word, size = (c.to_numpy() for c in tokens.flatten().flatten())
            known, starts = (c.to_numpy(zero_copy_only=False)[owner] for c in (start_ms.is_valid(), start_ms.fill_null(0)))
            chosen = []  # document, a, b, n_words and the segments at both ends of both copies
            for d in range(len(docs)):
                whole = slice(at[first[d]], at[first[d + 1]])
                n, a, b = repeated_runs(word[whole], size[whole], starts[whole], known[whole], **limits)
                if len(n):
                    k = longest_apart(n, a, b)
                    n, a, b = n[k], a[k], b[k]
                    chosen.append(np.stack([np.full(len(k), d), a, b, n, *(owner[whole][x] for x in (a, a + n - 1, b, b + n - 1))]))
            d, a, b, n, *ends = np.concatenate(chosen, axis=1) if chosen else np.zeros((8, 0), np.int64)
            columns = [batch.column(0).take(pa.array(d)), a, b, n]
            for seg, times in zip(ends, (start_ms, end_ms, start_ms, end_ms)):
                columns += [seg - first[d], times.take(pa.array(seg))]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = T.tokens(F.lower(F.coalesce("text", F.lit(""))))
    rows = segs.where("doc_id is not null").select("doc_id", "start_ms", "seg_idx", "end_ms", F.transform(found, lambda w: F.struct(F.xxhash64(w).alias("word"), F.length(w).alias("size"))).alias("tokens"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "seg_idx", "end_ms", "tokens"))).alias("segs"))
    kept = docs.mapInArrow(choose, schema)
    return kept.where("first_lo_ord <> second_lo_ord or first_hi_ord <> second_hi_ord")


def dup_blocks(segs: DataFrame, **limits) -> DataFrame:
    """doc_id, first_lo, first_hi, second_lo, second_hi (segments by time), matched_words, time_gap_ms."""
    gap = F.abs(F.col("second_lo_start_ms") - F.col("first_lo_start_ms"))
    return blocks(segs, **limits).select("doc_id", *[F.col(f"{c}_ord").alias(c) for c in ("first_lo", "first_hi", "second_lo", "second_hi")], F.col("n_words").alias("matched_words"), gap.alias("time_gap_ms"))


def deduplicated(segs: DataFrame, **limits) -> DataFrame:
    """The segments without the shorter copy (in time) of each block; the first one goes if both are equally long."""
    b = blocks(segs, **limits)
    shorter = F.col("second_hi_end_ms") - F.col("second_lo_start_ms") < F.col("first_hi_end_ms") - F.col("first_lo_start_ms")
    lo, hi = (F.when(shorter, F.col(f"second_{c}_ord")).otherwise(F.col(f"first_{c}_ord")) for c in ("lo", "hi"))
    gone = b.select("doc_id", F.explode(F.sequence(lo, hi)).alias("ord")).distinct()
    return numbered(segs).join(gone, ["doc_id", "ord"], "left_anti").select(*segs.columns)
