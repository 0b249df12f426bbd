"""Matching operators: intervals, positions, bands, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import text as T


#: Frames of a block: running sums never reach further.
BLOCK_FRAMES = 4096


def frame_sums(frames: DataFrame, places: DataFrame, block: int = BLOCK_FRAMES) -> DataFrame:
    """doc_id, frame_idx, mark of each of ``places`` with ``below``: the loss of its document's frames up to there.

    Frames and places are dealt by block in one shuffle and meet in one running sum; what lies in the blocks before is a
    window over their totals.  No task sees all frames of a document, and frames are no side of a join, which a
    small table that many frames derive from would have broadcast.
    """
    here = F.floor(F.col("frame_idx") / block).alias("block")
    loss = (F.col("max_prob") - F.col("aligned_prob")).cast("long").alias("loss")
    marks = places.select("doc_id", "frame_idx", here, F.lit(0).cast("long").alias("loss"), "mark")
    rows = frames.select("doc_id", F.col("frame_idx").cast("long").alias("frame_idx"), here, loss)
    both = rows.withColumn("mark", F.lit(None).cast(places.schema["mark"].dataType)).unionByName(marks)
    within = W.partitionBy("doc_id", "block").orderBy("frame_idx", F.col("mark").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    inner = both.withColumn("inner", F.sum("loss").over(within)).where(F.col("mark").isNotNull())
    totals = both.groupBy("doc_id", "block").agg(F.sum("loss").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = inner.join(totals.select("doc_id", "block", before.alias("before")).hint("merge"), ["doc_id", "block"])
    return sums.select("doc_id", "frame_idx", "mark", (F.col("before") + F.col("inner")).alias("below"))


def interval_scores(spans: DataFrame, frames: DataFrame, *keys: str, frame_ms: int = 20, offset_ms: int = 0) -> DataFrame:
    """doc_id, ``keys``, n_frames, loss_sum: the sum of max_prob - aligned_prob over the frames of each interval (start_ms, end_ms).

    An interval has one frame at least, and none beyond the last one.  A range join would pair every frame with every
    interval that holds it; here an interval looks up the running sums at its two ends.
    """
    n = frames.groupBy("doc_id").agg(F.max("frame_idx").alias("last")).hint("merge")
    at = spans.join(n, "doc_id").withColumn("lo", F.least(F.greatest(F.floor((F.col("start_ms") - offset_ms) / frame_ms), F.lit(0)), F.col("last")))
    at = at.withColumn("hi", F.greatest(F.least(F.floor((F.col("end_ms") - offset_ms) / frame_ms), F.col("last") + 1), F.col("lo") + 1))
    ends = F.array(*[F.struct(F.lit(sign).alias("sign"), (F.col(c) - 1).cast("long").alias("frame_idx")) for sign, c in ((1, "hi"), (-1, "lo"))])
    ends = at.select("doc_id", *keys, (F.col("hi") - F.col("lo")).alias("n_frames"), F.explode(ends).alias("e"))
    looked = frame_sums(frames, ends.select("doc_id", "e.frame_idx", F.struct(*keys, "n_frames", "e.sign").alias("mark")))
    sums = looked.select("doc_id", "mark.*", "below").groupBy("doc_id", *keys)
    return sums.agg(F.first("n_frames").alias("n_frames"), F.sum(F.col("sign") * F.col("below")).alias("loss_sum"))


def frame_scores(segs: DataFrame, frames: DataFrame, frame_ms: int = 20, offset_ms: int = 0) -> DataFrame:
    """doc_id, seg_idx, n_frames, loss_sum of each segment; see ``interval_scores``."""
    return interval_scores(segs, frames, "seg_idx", frame_ms=frame_ms, offset_ms=offset_ms)


def nested_scores(segs: DataFrame, frames: DataFrame, frame_ms: int = 20, offset_ms: int = 0) -> DataFrame:
    """doc_id, seg_idx, word_idx (null for the segment itself), n_frames, loss_sum of segments and their words, looked up together.

    ``segs``: doc_id, seg_idx, start_ms, end_ms, words (array of structs with start_ms and end_ms, or null).
    """
    own = F.array(F.struct(F.lit(None).cast("int").alias("word_idx"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")))
    inner = F.transform("words", lambda w, i: F.struct(i.alias("word_idx"), w["start_ms"].cast("long").alias("start_ms"), w["end_ms"].cast("long").alias("end_ms")))
    both = segs.select("doc_id", "seg_idx", F.explode(F.concat(own, F.when(F.col("words").isNull(), F.slice(own, 1, 0)).otherwise(inner))).alias("x"))
    return interval_scores(both.select("doc_id", "seg_idx", "x.*"), frames, "seg_idx", "word_idx", frame_ms=frame_ms, offset_ms=offset_ms)


def mean_score(scale: int = 1000) -> Column:
    """1 minus the mean loss, to four places, of probabilities in parts of ``scale``."""
    return F.round(1 - F.col("loss_sum") / F.col("n_frames") / scale, 4)


def zip_speakers(segs: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments with the speaker that stands at the same place; the shorter side wins."""
    return segs.drop("speaker").join(labels.select("doc_id", "seg_idx", "speaker"), ["doc_id", "seg_idx"])


def relabel(segs: DataFrame, names: DataFrame) -> DataFrame:
    """Speakers replaced by their names (doc_id, speaker, name) where known."""
    return segs.join(names, ["doc_id", "speaker"], "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")


BUCKET_MS = 60_000


def overlaps(a: DataFrame, b: DataFrame, tolerance_ms: int = 0, extra: Column | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows of a document whose intervals overlap (or come within the tolerance); columns of ``a``, and of ``b`` with the prefix b_.

    Both sides are dealt into time buckets, so the join is on equal keys; a pair is reported in the first bucket that they share.
    """
    right = b.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "doc_id"])
    left = a.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start_ms") - tolerance_ms) / bucket_ms), F.floor((F.col("end_ms") + tolerance_ms) / bucket_ms))))
    right = right.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b_start_ms") / bucket_ms), F.floor(F.col("b_end_ms") / bucket_ms))))
    near = (F.col("b_start_ms") < F.col("end_ms") + tolerance_ms) & (F.col("b_end_ms") > F.col("start_ms") - tolerance_ms)
    first = F.col("bucket") == F.greatest(F.floor((F.col("start_ms") - tolerance_ms) / bucket_ms), F.floor(F.col("b_start_ms") / bucket_ms))
    joined = left.join(right, ["doc_id", "bucket"]).where(near & first)
    return (joined.where(extra) if extra is not None else joined).drop("bucket")


def claim_speakers(segs: DataFrame, turns: DataFrame, min_ms: int = 500) -> DataFrame:
    """doc_id, seg_idx, speaker, overlap_ms: the turn label that overlaps a segment the longest, if by ``min_ms``; ties go to the first label."""
    both = overlaps(segs.select("doc_id", "seg_idx", "start_ms", "end_ms"), turns)
    shared = F.least("end_ms", "b_end_ms") - F.greatest("start_ms", "b_start_ms")
    sums = both.groupBy("doc_id", "seg_idx", F.col("b_label").alias("label")).agg(F.sum(shared).alias("overlap_ms")).where(F.col("overlap_ms") >= min_ms)
    rank = F.row_number().over(W.partitionBy("doc_id", "seg_idx").orderBy(F.desc("overlap_ms"), "label"))
    return sums.withColumn("rank", rank).where("rank = 1").select("doc_id", "seg_idx", F.col("label").alias("speaker"), "overlap_ms")


def match_events(markers: DataFrame, events: DataFrame, aliases: dict[str, str], tolerance_ms: int = 20_000, strategy: str = "merge_first") -> DataFrame:
    """Marker segments with detected events of the same label (aliases resolved) within the tolerance.

    ``merge_first`` keeps the earliest event of each marker, ``keep_all`` keeps all of them, ``split`` too, with their own times.
    """
    label = F.lower(F.regexp_replace(F.trim("text"), r"^\[\s*|\s*\]$", ""))
    named = markers.withColumn("label", F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in aliases.items()), label))
    pairs = overlaps(named, events, tolerance_ms, F.col("label") == F.col("b_label"))
    if strategy == "split":
        return pairs.withColumn("start_ms", F.col("b_start_ms")).withColumn("end_ms", F.col("b_end_ms"))
    if strategy == "merge_first":
        rank = F.row_number().over(W.partitionBy("doc_id", "seg_idx").orderBy("b_start_ms", "b_end_ms"))
        return pairs.withColumn("rank", rank).where("rank = 1").drop("rank")
    return pairs


def lock_chapters(locked: DataFrame, model: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Locked chapters with the model's summary: of the first model chapter within the tolerance, else of the same index, else empty."""
    m = model.select("doc_id", F.col("ch_idx").alias("m_idx"), F.col("start_ms").alias("m_start"), F.col("summary").alias("m_summary"))
    bucket = F.floor(F.col("m_start") / tolerance_ms)
    left = locked.withColumn("bucket", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("start_ms") / tolerance_ms) + d)))
    near = left.join(m.withColumn("bucket", bucket), ["doc_id", "bucket"]).where(F.abs(F.col("m_start") - F.col("start_ms")) < tolerance_ms)
    near = near.groupBy("doc_id", "ch_idx").agg(F.min_by("m_summary", "m_idx").alias("near_summary"))
    same = m.select("doc_id", F.col("m_idx").alias("ch_idx"), F.col("m_summary").alias("same_summary"))
    return locked.join(near, ["doc_id", "ch_idx"], "left").join(same, ["doc_id", "ch_idx"], "left").withColumn("summary", F.coalesce("near_summary", "same_summary", F.lit(""))).drop("near_summary", "same_summary")


def ngram_links(words: DataFrame, size: int = 8, max_words: int = 300, max_ms: int | None = None) -> DataFrame:
    """doc_id, pos_a, pos_b: equal n-grams of a document at most ``max_words`` apart, each with its next occurrence.

    ``words``: doc_id, pos, word and, for the limit in time, start_ms.  Linking each occurrence to the next one
    keeps the result linear; occurrences further on follow from the chain.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    gram = F.array_join(F.collect_list("word").over(w.rowsBetween(0, size - 1)), " ")
    full = F.lead("pos", size - 1).over(w).isNotNull()
    grams = words.withColumn("gram", F.xxhash64(gram)).withColumn("full", full).where("full")
    g = W.partitionBy("doc_id", "gram").orderBy("pos")
    follow = grams.withColumn("pos_b", F.lead("pos").over(g))
    keep = F.col("pos_b") - F.col("pos") <= max_words
    if max_ms is not None:
        follow = follow.withColumn("start_b", F.lead("start_ms").over(g))
        keep = keep & (F.abs(F.col("start_b") - F.col("start_ms")) <= max_ms)
    return follow.where(keep).select("doc_id", F.col("pos").alias("pos_a"), "pos_b")


def role_evidence(segs: DataFrame, buckets: list[str], cap: int = 8) -> DataFrame:
    """doc_id, speaker, bucket, snippet, rank: up to ``cap`` texts of a speaker that mention a role, one bucket for a text (first in order)."""
    bucket = F.coalesce(*(F.when(T.mentions_role(F.col("text"), b), F.lit(b)) for b in T.ROLE_PHRASES if b in buckets))
    hits = segs.withColumn("bucket", bucket).where("bucket is not null").withColumn("snippet", F.trim("text"))
    once = hits.groupBy("doc_id", "speaker", "bucket", F.substring("snippet", 1, 80).alias("head")).agg(F.min("seg_idx").alias("seg_idx"), F.min_by("snippet", "seg_idx").alias("snippet"))
    rank = F.row_number().over(W.partitionBy("doc_id", "speaker").orderBy("seg_idx", "bucket"))
    return once.withColumn("rank", rank).where(F.col("rank") <= cap).select("doc_id", "speaker", "bucket", "snippet", "rank")


def merge_glossaries(user: DataFrame, found: DataFrame) -> DataFrame:
    """source, target: the user's entries over those found."""
    u, f = user.select("source", F.col("target").alias("u")), found.select("source", F.col("target").alias("f"))
    return u.join(f, "source", "full").select("source", F.coalesce("u", "f").alias("target"))


def unknown_words(tokens: DataFrame, vocabulary: DataFrame, most: int = 40) -> DataFrame:
    """Distinct words of ``tokens`` (word) that ``vocabulary`` (word) lacks, up to ``most`` characters."""
    return tokens.where(F.length("word") <= most).select("word").distinct().join(vocabulary.select("word").distinct(), "word", "left_anti")


def fuzzy_titles(titles: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """For each wanted title the listed title that shares most of its words (``id, title`` on both sides)."""
    words = lambda c: F.array_distinct(F.filter(F.split(T.match_normalize(c), " "), lambda w: F.length(w) > 2))
    a = wanted.select(F.col("id").alias("wanted_id"), F.size(words(F.col("title"))).alias("n"), F.explode(words(F.col("title"))).alias("word"))
    b = titles.select("id", F.explode(words(F.col("title"))).alias("word"))
    shared = a.join(b, "word").groupBy("wanted_id", "id").agg((F.count("*") / F.first("n")).alias("share")).where(F.col("share") >= least)
    rank = F.row_number().over(W.partitionBy("wanted_id").orderBy(F.desc("share"), "id"))
    return shared.withColumn("rank", rank).where("rank = 1").drop("rank")


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])
