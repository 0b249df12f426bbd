"""Small decisions over a document's rows: gates before costly steps, first values, resumed work, standard layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import text as T


def all_have_words(segs: DataFrame, words: str = "words") -> DataFrame:
    """doc_id, ready: whether every segment has word timings (null and empty count as none)."""
    return segs.groupBy("doc_id").agg(F.every(F.coalesce(F.size(words), F.lit(0)) > 0).alias("ready"))


def word_ratio(segs: DataFrame, words: str = "words", least: float = 0.5) -> DataFrame:
    """doc_id, ratio, low: timed words for each segment; below ``least`` the timing isn't to be trusted."""
    ratio = F.sum(F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(0))) / F.count("*")
    return segs.groupBy("doc_id").agg(ratio.alias("ratio")).withColumn("low", F.col("ratio") < least)


def low_scores(segs: DataFrame, scores: DataFrame, below) -> DataFrame:
    """doc_id, seg_idx, score of spoken segments that score less than ``below``; event markers aren't judged."""
    spoken = segs.where(~T.is_event_marker(F.col("text"))).select("doc_id", "seg_idx")
    return scores.where(F.col("score") < below).join(spoken, ["doc_id", "seg_idx"], "left_semi")


def keep_ids(source: DataFrame, aligned: DataFrame) -> DataFrame:
    """``aligned`` with ``source_id``: the id at the same place of the source, where both have as many rows; else null."""
    n = aligned.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = source.groupBy("doc_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("start_ms", "seg_idx"))
    equal = n.join(m, ["doc_id", "n"]).select("doc_id")
    ids = source.join(equal, "doc_id", "left_semi").select("doc_id", F.col("seg_idx").alias("source_id"), place.alias("place"))
    return aligned.withColumn("place", place).join(ids, ["doc_id", "place"], "left").drop("place")


def needs_alignment(trusted: Column, split: Column) -> Column:
    """Trusted times need no alignment unless sentences are to be split."""
    return ~F.coalesce(trusted, F.lit(False)) | F.coalesce(split, F.lit(False))


def can_be_named(segs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, ready: whether there are enough speakers to tell apart."""
    return segs.groupBy("doc_id").agg((F.count_distinct("speaker") >= least).alias("ready"))


def first_language(chunks: DataFrame) -> DataFrame:
    """doc_id, lang: of the first chunk in which one was found."""
    return chunks.where("lang is not null and lang <> ''").groupBy("doc_id").agg(F.min_by("lang", "chunk_idx").alias("lang"))


def span_starts(chapters: Column) -> Column:
    """Starts of ``array<struct<spans: array<struct<start, ...>>>>``: the least of each chapter's spans, 0 without any."""
    return F.transform(chapters, lambda c: F.coalesce(F.array_min(F.transform(c["spans"], lambda s: s["start"])), F.lit(0.0)))


def resumed(batches: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, n_batches, n_segments of the work that is there already (``batch``, ``seg_idx`` rows in both)."""
    kept = batches.join(done.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_semi")
    return kept.groupBy("doc_id").agg(F.count_distinct("batch").alias("n_batches"), F.count("*").alias("n_segments"))


def with_offsets(pieces: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows found inside slices (``slice_idx``) with the slice's start added to their times."""
    s = slices.select("doc_id", "slice_idx", F.col("start_ms").alias("offset_ms"))
    moved = pieces.join(s, ["doc_id", "slice_idx"])
    return moved.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms")).drop("offset_ms")


def strategy(supervised: Column, transcribed: Column, chars: Column, limit: int = 24_000) -> Column:
    """How a document is worked on: along its captions, along its transcript, or entire where it is short or has neither."""
    return F.when((chars <= limit) | ~(supervised | transcribed), "entire").when(supervised, "caption").otherwise("transcription")


def standard(segs: DataFrame, least_ms: int = 700, most_ms: int = 7000, max_cps: float = 17.0, line_chars: int = 42) -> DataFrame:
    """Segments laid out for reading: long enough to be read at ``max_cps``, within both durations, never into the next one, lines of ``line_chars``.

    A line is broken at the last blank that fits; a word longer than a line stays whole.
    """
    following = F.lead("start_ms").over(W.partitionBy("doc_id").orderBy("start_ms", "seg_idx"))
    wanted = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(least_ms), F.ceil(F.length("text") * 1000 / F.lit(max_cps)))
    end = F.least(F.col("start_ms") + F.least(wanted, F.lit(most_ms)), F.greatest(F.coalesce(following, F.lit((1 << 62))), F.col("start_ms")))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    lines = F.regexp_replace(flat, rf"(.{{1,{line_chars}}})(?: |$)", "$1\n")
    return segs.withColumn("end_ms", end.cast("bigint")).withColumn("text", F.regexp_replace(lines, r"\n$", ""))
