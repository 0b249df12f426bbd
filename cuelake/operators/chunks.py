"""Chunked work: cutting, batching, padding, resuming, map and reduce around an opaque model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

Model = Callable[[list[str]], list[str]]


def split_long(rows: DataFrame, max_ms: int) -> DataFrame:
    """Intervals cut into pieces of at most ``max_ms``, with their ``piece`` number."""
    starts = F.sequence(F.col("start_ms"), F.greatest(F.col("end_ms") - 1, F.col("start_ms")), F.lit(max_ms).cast("long"))
    cut = rows.select("*", F.posexplode(starts).alias("piece", "piece_ms"))
    return cut.withColumn("end_ms", F.least(F.col("piece_ms") + max_ms, F.col("end_ms"))).withColumn("start_ms", F.col("piece_ms")).drop("piece_ms")


def sample_windows(length: Column, size: int, overlap: int) -> Column:
    """Starts and ends of overlapping windows over ``length`` samples; the last is short."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length.cast("long")).alias("end")))


def batches(rows: DataFrame, size: int = 30) -> DataFrame:
    """``batch``: numbers of ``size`` rows each, by segment."""
    return rows.withColumn("batch", F.floor(F.col("seg_idx") / size).cast("int"))


def remaining(all_: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What has no committed result yet."""
    return all_.join(done.select(*keys), list(keys), "left_anti")


def fit(answers: list[str], texts: list[str]) -> list[str]:
    """As many answers as texts: missing ones are the texts themselves, further ones are dropped."""
    return [*answers[: len(texts)], *texts[len(answers) :]]


def map_model(rows: DataFrame, model: Model, out: str, size: int = 30, tries: int = 3) -> DataFrame:
    """``rows`` with ``out``: a model's answer to ``text``, asked for ``size`` texts at a time.

    A call that fails or gives another number of answers is repeated; then texts fill the gaps.  Spark
    spreads partitions over executors, so the calls of a task run one after another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done: list[str] = []
            for a in range(0, len(pdf), size):
                texts, answers = pdf.text.iloc[a : a + size].tolist(), []
                for _ in range(tries):
                    try:
                        answers = model(texts)
                    except RuntimeError:
                        continue
                    if len(answers) == len(texts):
                        break
                done += fit(list(answers), texts)
            yield pdf.assign(**{out: done})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, `{out}` string")


def map_reduce(chunks: DataFrame, mapper: Model, reducer: Model) -> DataFrame:
    """doc_id, summary: each chunk is mapped, and the parts of a document, in order, are reduced once."""
    parts = map_model(chunks.withColumnRenamed("chunk", "text"), mapper, "part")
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "part"))), lambda p: p["part"]), "\n").alias("text"))
    return map_model(whole, reducer, "summary").select("doc_id", "summary")


def review(rows: DataFrame, reviewer: Model, size: int = 100) -> DataFrame:
    """``revised``: a reviewer's text for each draft; a failed batch keeps its drafts."""
    return map_model(rows.withColumnRenamed("text", "source").withColumnRenamed("draft", "text"), reviewer, "revised", size, 1).withColumnRenamed("text", "draft").withColumnRenamed("source", "text")


def apply_translations(segs: DataFrame, translated: DataFrame, target: str) -> DataFrame:
    """Segments with the translation at their place, where there is one."""
    t = translated.select("doc_id", "seg_idx", "translation")
    out = segs.join(t, ["doc_id", "seg_idx"], "left")
    return out.withColumn("target_lang", F.when(F.col("translation").isNotNull(), F.lit(target)))


def merge_groups(groups: DataFrame, *keys: str) -> DataFrame:
    """Groups of segments as one: least start, greatest end, all segment numbers."""
    rows = groups.groupBy(*keys).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.flatten(F.collect_list("seg_idxs"))).alias("seg_idxs"))
    return rows


def whole_words(segs: DataFrame) -> DataFrame:
    """Segments without words get one that spans them, with score 1."""
    one = F.array(F.struct(F.col("text").alias("symbol"), F.col("start_ms"), F.col("end_ms"), F.lit(1.0).alias("score")))
    return segs.withColumn("words", F.when(F.coalesce(F.size("words"), F.lit(0)) <= 0, one).otherwise(F.col("words")))


# Fixed value: what stands behind the end of a sentence.
SENTENCE_GAP = r"(?<=[.!?。！？])\s+"


def split_sentences(segs: DataFrame) -> DataFrame:
    """Segments cut after sentence ends; times by share of characters.  ``part`` numbers the pieces."""
    parts = F.filter(F.split("text", SENTENCE_GAP), lambda p: p != "")
    rows = segs.select("*", F.length("text").alias("n"), F.posexplode(parts).alias("part", "piece"))
    w = W.partitionBy("doc_id", "seg_idx").orderBy("part")
    before = F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.length("piece")).over(W.partitionBy("doc_id", "seg_idx"))
    rows = rows.withColumn("before", before).withColumn("total", total).withColumn("span", F.col("end_ms") - F.col("start_ms"))
    return rows.select("doc_id", "seg_idx", "part", F.col("piece").alias("text"), F.expr("start_ms + span * before div total").alias("start_ms"), F.expr("start_ms + span * (before + length(piece)) div total").alias("end_ms"))


def sliced_sentences(segs: DataFrame) -> DataFrame:
    """``split_sentences`` of segments with word timings: doc_id, seg_idx, part, text, start_ms, end_ms, words.

    ``segs``: doc_id, seg_idx, start_ms, end_ms, text, words (array of symbol, start_ms, end_ms, or null).  Words and sentences are placed by
    the letters and digits before them and drawn together in one order, so each word belongs to one sentence: the one that holds its
    first letter, and a word without letters to the one before.  A sentence has the times of its first and last word; one without
    words has its share of the segment's time.
    """
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    seg = W.partitionBy("doc_id", "seg_idx")
    cut = split_sentences(segs.select("doc_id", "seg_idx", "start_ms", "end_ms", "text"))
    cut = cut.withColumn("size", letters(F.col("text"))).withColumn("kind", F.lit(1)).withColumn("word", F.lit(None).cast(segs.schema["words"].dataType.elementType))
    # An outer explode, as Spark would make the words of an inner one twice, to filter by their number.
    words = segs.select("doc_id", "seg_idx", F.posexplode_outer("words").alias("part", "word")).where("part is not null")
    words = words.select("doc_id", "seg_idx", "part", "word", letters(F.col("word.symbol")).alias("size"), F.lit(2).alias("kind"))
    # All windows and the grouping share this partitioning: words are shuffled once.
    both = cut.unionByName(words, allowMissingColumns=True).repartition("doc_id", "seg_idx")
    # Each kind runs over its own letters.
    at = F.coalesce(F.sum("size").over(W.partitionBy("doc_id", "seg_idx", "kind").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.when(F.col("kind") == 1, 1).when(F.col("size") == 0, 0).otherwise(2)
    both = both.withColumn("at", at).withColumn("rank", rank)
    order = seg.orderBy("at", "rank", "part")
    # Words in front of the first sentence belong to it.
    inside = F.greatest(F.sum((F.col("kind") == 1).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1, F.lit(0))
    own = F.sort_array(F.collect_list(F.when(F.col("kind") == 2, F.struct("part", "word"))))
    whole = lambda c: F.max(F.when(F.col("kind") == 1, F.col(c))).alias(c)
    rows = both.withColumn("number", inside).groupBy("doc_id", "seg_idx", "number").agg(own.alias("own"), whole("text"), whole("start_ms"), whole("end_ms"))
    rows = rows.where("text is not null").withColumn("words", F.transform("own", lambda x: x["word"]))
    first, last = F.get("words", F.lit(0))["start_ms"], F.try_element_at("words", F.lit(-1))["end_ms"]
    times = [F.coalesce(first, "start_ms").alias("start_ms"), F.coalesce(last, "end_ms").alias("end_ms")]
    return rows.select("doc_id", "seg_idx", F.col("number").cast("int").alias("part"), "text", *times, F.when(F.size("words") > 0, F.col("words")).alias("words"))
