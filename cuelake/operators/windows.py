"""Order-dependent operators over segments ``doc_id, seg_idx, start_ms, end_ms, ...``.

Every window is partitioned by document and ordered by an explicit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ORDER = ("start_ms", "seg_idx")


def by_doc(*order: str):
    return W.partitionBy("doc_id").orderBy(*(order or ORDER))


def gap_sessions(segs: DataFrame, max_gap_ms: int = 4000) -> DataFrame:
    """``session``: a number that grows with each gap above ``max_gap_ms``."""
    w = by_doc()
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) > max_gap_ms, F.lit(False)).cast("int")
    return segs.withColumn("new_session", new).withColumn("session", F.sum("new_session").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new_session")


def recalculate_durations(segs: DataFrame, last_floor_ms: int = 100) -> DataFrame:
    """``duration_ms``: to the next start, not below 0; of the last to the document's end, not below ``last_floor_ms``."""
    follow = F.lead("start_ms").over(by_doc())
    end = F.max("end_ms").over(W.partitionBy("doc_id"))
    return segs.withColumn("duration_ms", F.when(follow.isNotNull(), F.greatest(follow - F.col("start_ms"), F.lit(0))).otherwise(F.greatest(end - F.col("start_ms"), F.lit(last_floor_ms))))


def widen(segs: DataFrame, max_pad_ms: int = 2000) -> DataFrame:
    """``wide_start_ms, wide_end_ms``: half of the gap to each neighbour, at most ``max_pad_ms``; never narrower."""
    w = by_doc()
    before = F.col("start_ms") - F.coalesce(F.lag("end_ms").over(w), F.lit(0))
    after = F.lead("start_ms").over(w) - F.col("end_ms")
    left = F.least(F.greatest(F.floor(before / 2), F.lit(0)), F.lit(max_pad_ms))
    right = F.when(after.isNull(), F.lit(max_pad_ms)).otherwise(F.least(F.greatest(F.floor(after / 2), F.lit(0)), F.lit(max_pad_ms)))
    return segs.withColumn("wide_start_ms", F.col("start_ms") - left).withColumn("wide_end_ms", F.col("end_ms") + right)


def fallback_windows(groups: DataFrame, start: str = "start_ms", end: str = "end_ms", order: str = "group_idx", cap_ms: int = 2000) -> DataFrame:
    """For a group without times: from the previous known end to the next known start; after the last, ``cap_ms`` more."""
    w = by_doc(order)
    before = F.last(end, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(start, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    first = F.coalesce(F.col(start), before, F.lit(0).cast("long"))
    return groups.withColumn("window_start_ms", first).withColumn("window_end_ms", F.coalesce(F.col(end), after, first + cap_ms))


def margins(segs: DataFrame, lead_ms: int = 100, tail_ms: int = 100, min_gap_ms: int = 80) -> DataFrame:
    """``margin_start_ms, margin_end_ms``: extended to both sides, but ``min_gap_ms`` away from the neighbours' own times."""
    w = by_doc()
    floor = F.coalesce(F.lag("end_ms").over(w) + min_gap_ms, F.lit(0))
    ceiling = F.lead("start_ms").over(w) - min_gap_ms
    start = F.least(F.col("start_ms"), F.greatest(F.col("start_ms") - lead_ms, floor))
    end = F.greatest(F.col("end_ms"), F.least(F.col("end_ms") + tail_ms, F.coalesce(ceiling, F.col("end_ms") + tail_ms)))
    return segs.withColumn("margin_start_ms", start).withColumn("margin_end_ms", end)


def fill_chapter_ends(chapters: DataFrame) -> DataFrame:
    """An end of 0 becomes the next start; the last stays 0."""
    follow = F.lead("start_ms").over(by_doc("start_ms", "ch_idx"))
    return chapters.withColumn("end_ms", F.when(F.col("end_ms") == 0, F.coalesce(follow, F.lit(0))).otherwise(F.col("end_ms")))


def interpolate(lines: DataFrame, chapter_start: str = "chapter_ms", length: str = "n_chars", order: str = "seg_idx") -> DataFrame:
    """``time_ms`` of each line: chapters share their span by length of text; ``chapter_start`` is set on a chapter's first line.

    The last chapter has no known end: it runs at the rate of the known ones.
    """
    w = by_doc(order)
    rows = lines.withColumn("chapter", F.count(chapter_start).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("begin_ms", F.last(chapter_start, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("next_ms", F.first(chapter_start, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    inside = W.partitionBy("doc_id", "chapter")
    rows = rows.withColumn("before", F.coalesce(F.sum(length).over(inside.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum(length).over(inside))
    known = F.col("next_ms").isNotNull() & F.col("begin_ms").isNotNull()
    doc = W.partitionBy("doc_id")
    rate_ms = F.sum(F.when(known, (F.col("next_ms") - F.col("begin_ms")) * F.col(length))).over(doc)
    rate_chars = F.sum(F.when(known, F.col("total") * F.col(length))).over(doc)
    span = F.expr("(next_ms - begin_ms) * before div total")
    tail = F.when(rate_chars > 0, F.floor(F.col("before") * rate_ms / rate_chars)).otherwise(F.lit(0))
    return rows.withColumn("time_ms", F.when(known & (F.col("total") > 0), F.col("begin_ms") + span).when(F.col("begin_ms").isNotNull(), F.col("begin_ms") + tail)).drop("next_ms", "before", "total")


def carry_forward(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """Nulls of a column take the last value seen before."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(by_doc(*order).rowsBetween(W.unboundedPreceding, 0)))


def score_anomalies(segs: DataFrame, drop: float = 80, size: int = 5) -> DataFrame:
    """doc_id, drop_at, mutation_at, before, after: the first place where the mean of the next ``size`` scores lies more than ``drop`` below the mean of the last ``size``.

    The mutation is the largest single step near that place.  Scores that are null don't take part, and a document needs
    two full windows.
    """
    w = by_doc("seg_idx")
    rows = segs.where("score is not null").withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).withColumn("i", F.row_number().over(w) - 1)
    rows = rows.withColumn("before", F.avg("score").over(w.rowsBetween(-size, -1))).withColumn("after", F.avg("score").over(w.rowsBetween(0, size - 1)))
    rows = rows.withColumn("step", F.abs(F.lead("score").over(w) - F.col("score")))
    found = rows.where((F.col("n") >= 2 * size) & (F.col("i") >= size) & (F.col("i") <= F.col("n") - size) & (F.col("before") - F.col("after") > drop))
    first = found.groupBy("doc_id").agg(F.min("i").alias("at"), F.min_by("seg_idx", "i").alias("drop_at"), F.min_by("before", "i").alias("before_mean"), F.min_by("after", "i").alias("after_mean"))
    near = rows.join(first, "doc_id").where((F.col("i") >= F.col("at") - 1) & (F.col("i") < F.least(F.col("at") + size, F.col("n") - 1)))
    return near.groupBy("doc_id", "drop_at", "before_mean", "after_mean").agg(F.max_by("seg_idx", F.struct("step", -F.col("i"))).alias("mutation_at"))


def context(segs: DataFrame, batch: int = 30, size: int = 5) -> DataFrame:
    """doc_id, batch, before, after: the texts of up to ``size`` segments on either side of each batch."""
    w = by_doc("seg_idx")
    rows = segs.withColumn("batch", F.floor(F.col("seg_idx") / batch).cast("int"))
    rows = rows.withColumn("before", F.collect_list("text").over(w.rowsBetween(-size, -1))).withColumn("after", F.collect_list("text").over(w.rowsBetween(1, size)))
    return rows.groupBy("doc_id", "batch").agg(F.min_by("before", "seg_idx").alias("before"), F.max_by("after", "seg_idx").alias("after"))


def trim_tail(lines: DataFrame, noise: Column, order: str = "line_no") -> DataFrame:
    """Lines up to the last one that is neither blank nor noise."""
    good = F.max(F.when(~noise & (F.trim(F.col("line")) != ""), F.col(order))).over(W.partitionBy("doc_id"))
    return lines.withColumn("last_good", good).where(F.col(order) <= F.col("last_good")).drop("last_good")


def budget(parts: DataFrame, length: str, limit: int, order: str) -> DataFrame:
    """Parts in order, up to the first that would exceed ``limit`` in all."""
    used = F.sum(length).over(by_doc(order).rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("used", used).where(F.col("used") <= limit).drop("used")


def chapter_marks(segs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each chapter with the first segment that starts at or after it (null if none): an as-of match to the right, by one union and sort."""
    rows = chapters.select("doc_id", "start_ms", F.lit(0).alias("kind"), "ch_idx", "title", F.lit(None).cast("int").alias("seg_idx")).unionByName(segs.select("doc_id", "start_ms", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("ch_idx"), F.lit(None).cast("string").alias("title"), "seg_idx"))
    w = by_doc("start_ms", "kind", "seg_idx").rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn("before_seg", F.first("seg_idx", ignorenulls=True).over(w)).where("kind = 0").select("doc_id", "ch_idx", "title", "start_ms", "before_seg")


def asof(left: DataFrame, right: DataFrame, key: str, value: str, *, on: str = "doc_id", position: str) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row whose ``key`` is not above ``position``: one union, one sort, no join."""
    cols = [c for c in left.columns if c not in (on, position)]
    a = left.select(on, F.col(position).alias("at_"), F.lit(1).alias("kind_"), F.struct(*cols).alias("row_"), F.lit(None).cast(right.schema[value].dataType).alias("value_"))
    b = right.select(on, F.col(key).alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), F.col(value).alias("value_"))
    w = W.partitionBy(on).orderBy("at_", "kind_").rowsBetween(W.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("found_", F.last("value_", ignorenulls=True).over(w)).where("kind_ = 1")
    return out.select(on, F.col("at_").alias(position), *[F.col("row_").getField(c).alias(c) for c in cols], F.col("found_").alias(value))
