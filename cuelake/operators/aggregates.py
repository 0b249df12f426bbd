"""Aggregations over segments, votes, signals and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def majority(votes: DataFrame, *keys: str) -> DataFrame:
    """The label with most votes for each key; of equal ones the one seen in the earliest round, then the first by name."""
    counts = votes.groupBy(*keys, "label").agg(F.count("*").alias("n_votes"), F.min("round").alias("first_round"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct("label", "n_votes"), F.struct("n_votes", -F.col("first_round"))).alias("best"))
    return best.select(*keys, "best.label", "best.n_votes")


def speaker_counts(segs: DataFrame) -> DataFrame:
    """doc_id, speaker, n_segments, n_chars, avg_chars (whole number); a missing speaker counts as UNKNOWN."""
    speaker = F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.lit("UNKNOWN"))
    full = segs.where(F.trim("text") != "")
    out = full.groupBy("doc_id", speaker.alias("speaker")).agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))
    return out.withColumn("avg_chars", F.expr("n_chars div greatest(n_segments, 1)"))


def collect_turns(segs: DataFrame, most: int = 30) -> DataFrame:
    """doc_id, turns array<struct<speaker, text>>: the first ``most`` turns in order."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("seg_idx"))
    first = segs.where(F.trim("text") != "").withColumn("rank", rank).where(F.col("rank") <= most)
    item = F.struct("rank", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), F.trim("text").alias("text"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias("turns"))


GENERIC_LABELS = ("guest", "speaker", "host", "unknown")


def talk_format(counts: DataFrame, least: int = 3, dominant: int = 75, minor: int = 10) -> DataFrame:
    """Generic labels with under ``minor`` % of a document's segments become Audience, where one of ``least`` or more speakers has ``dominant`` % of them."""
    doc = W.partitionBy("doc_id")
    total, n, top = F.sum("n_segments").over(doc), F.count("*").over(doc), F.max("n_segments").over(doc)
    generic = F.lower(F.regexp_replace("name", r"[\s_]*\d*$", "")).isin(*GENERIC_LABELS)
    audience = (n >= least) & (100 * top >= dominant * total) & generic & (100 * F.col("n_segments") < minor * total)
    return counts.withColumn("label", F.when(audience, "Audience").otherwise(F.col("name")))


def dominant_speaker(counts: DataFrame) -> DataFrame:
    """The speaker with most segments of each document, the first by name on a tie."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_segments"), "speaker"))
    return counts.withColumn("rank", rank).where("rank = 1").drop("rank")


def signal_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """Percentiles 0, 5, 10, 50, 90, 95, 100 (linear), mean and population deviation of ``value``."""
    marks = (0, 5, 10, 50, 90, 95, 100)
    p = F.percentile("value", F.array(*[F.lit(m / 100) for m in marks]))
    out = samples.groupBy(*keys).agg(p.alias("p"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select(*keys, *[F.element_at("p", i + 1).alias(f"p{m}") for i, m in enumerate(marks)], "mean", "std")


def rms_gain(samples: DataFrame, *keys: str, stride: int = 16, target: float = -14.0, top: float = 40.0) -> DataFrame:
    """keys, rms_db, gain_db from every ``stride``-th sample (``pos``); only signals from -80 to below -24 dB are raised."""
    some = samples.where(F.col("pos") % stride == 0)
    power = some.groupBy(*keys).agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    rms = F.when(F.col("power") > 0, 10 * F.log10("power"))
    gain = F.when((rms >= -80) & (rms < -24), F.least(F.lit(target) - rms, F.lit(top))).otherwise(F.lit(0.0))
    return power.select(*keys, rms.alias("rms_db"), gain.alias("gain_db"))


def mix_channels(channels: Column) -> Column:
    """Mean of equally long channels, sample by sample."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, n), F.element_at(channels, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def confidence(source: Column, chars: Column, chunked: Column, truncated: Column) -> Column:
    """Hundredths: a base for the kind of source, less 5 if chunked, 15 if under 500 characters, 10 if truncated; 5 to 95."""
    base = F.when(source == "captions", 85).when(source == "mixed", 75).when(source == "metadata", 45).otherwise(60)
    score = base - F.when(chunked, 5).otherwise(0) - F.when(chars < 500, 15).otherwise(0) - F.when(truncated, 10).otherwise(0)
    return F.greatest(F.lit(5), F.least(F.lit(95), score))


def speaking_rate(segs: DataFrame) -> DataFrame:
    """doc_id, n_chars, span_ms: what characters per second follow from."""
    return segs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), (F.max("end_ms") - F.min("start_ms")).alias("span_ms"))


def recurring_names(lines: DataFrame, least: int = 3, distinct: int = 2) -> DataFrame:
    """doc_id, line, n: lines that recur in a document, if there are enough different ones."""
    counts = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("kinds", F.count("*").over(W.partitionBy("doc_id"))).where(F.col("kinds") >= distinct).drop("kinds")


def match_ratio(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + (o == "=").cast("int")) / F.greatest(F.size(ops), F.lit(1))


def wer_bucket(wer: Column) -> Column:
    """exact, good, fair or poor; null for null."""
    return F.when(wer == 0, "exact").when(wer < 0.1, "good").when(wer < 0.32, "fair").when(wer.isNotNull(), "poor")


def share_bucket(share: Column, closed: bool) -> Column:
    """high, medium or low share of equal steps; at its beginning (``closed``) 0.7 and 0.5 themselves count, at its end they don't."""
    high, medium = (share >= 0.7, share >= 0.5) if closed else (share > 0.7, share > 0.5)
    return F.when(high, "high").when(medium, "medium").when(share.isNotNull(), "low")


def best_track(tracks: DataFrame, priority=("json3", "srv3", "vtt", "ttml", "srv2", "srv1"), *keys: str) -> DataFrame:
    """The best format for each key by a list of extensions, else the first listed (``ord``)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("ext")), F.lit(0).cast("bigint")), F.lit(len(priority) + 1).cast("bigint"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(place, "ord"))
    return tracks.withColumn("rank", rank).where("rank = 1").drop("rank")


def best_audio(formats: DataFrame, ext: str, cap: int | None, *keys: str) -> DataFrame:
    """The best audio format: asked extension, then common ones, then bit rate within ``cap`` (kbit/s, 20 tolerated)."""
    rate = F.coalesce("abr", "tbr", F.lit(0))
    quality = rate if cap is None else F.when(rate <= cap + 20, rate).otherwise(F.lit(-1000))
    order = [F.desc(F.col("ext") == ext), F.desc(F.col("ext").isin("m4a", "webm", "opus")), F.desc(quality), "ord"]
    return formats.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")


def best_video(formats: DataFrame, ext: str, height: int | None, *keys: str) -> DataFrame:
    """The best video format: with sound, asked extension, height up to ``height``, bit rate."""
    tall = F.coalesce("height", F.lit(0))
    fit = tall if height is None else F.when(tall > height, F.lit(-1000)).otherwise(tall)
    sound = F.coalesce(F.col("acodec") != "none", F.lit(False))
    order = [F.desc(sound), F.desc(F.col("ext") == ext), F.desc(fit), F.desc(F.coalesce("tbr", "vbr", F.lit(0))), "ord"]
    return formats.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank = 1").drop("rank")
