"""Timed text derived from the driver's tables, in Spark and in SQL; whole-number arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cuelake.operators.joins import BLOCK_FRAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment for each turn of a conversation; a turn lasts 60 ms a character, after a gap that its number gives."""
    c = table(spark, sf_dir, "conversations")
    gap, length = (F.col("conv_id") * 7919 + F.col("turn") * 104729) % 6500, 60 * F.length("text").cast("long")
    end = F.sum(gap + length).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seg_idx"), F.col("role").alias("speaker"), "text", (end - length).alias("start_ms"), end.alias("end_ms"))


SEG = """seg AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, role AS speaker, text, end_ms - len_ms AS start_ms, end_ms FROM (
 SELECT *, CAST(sum(gap_ms + len_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms FROM (
 SELECT *, (conv_id * 7919 + turn * 104729) % 6500 AS gap_ms, 60 * CAST(length(text) AS BIGINT) AS len_ms FROM conversations)))"""


def timed_words(words, span_start="start_ms", span_end="end_ms"):
    """Words as structs of symbol, start_ms, end_ms, whose times part the segment's evenly; their number stands beside each, so it is counted once."""
    n = F.size(words)
    beside = F.arrays_zip(words.alias("w"), F.array_repeat(n, n).alias("n"))
    at = lambda i, x: F.col(span_start) + F.floor(i * (F.col(span_end) - F.col(span_start)) / x["n"])
    return F.transform(beside, lambda x, i: F.struct(x["w"].alias("symbol"), at(i, x).alias("start_ms"), at(i + 1, x).alias("end_ms")))


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second track: the segments' words without each 7th, each 11th written as x, shifted in time."""
    s = segments(spark, sf_dir)
    words = F.transform(F.split("text", r"\s+"), lambda w, i: F.when((i + 1) % 7 == 0, F.lit(None)).when((i + 1) % 11 == 0, F.lit("x")).otherwise(w))
    shift = (F.col("seg_idx") % 5) * 100
    return s.select("doc_id", "seg_idx", "speaker", F.array_join(F.filter(words, lambda w: w.isNotNull()), " ").alias("text"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 ms under each conversation, with confidences in thousandths."""
    ends = segments(spark, sf_dir).groupBy("doc_id").agg(F.floor(F.max("end_ms") / 20).alias("last"))
    blocks = ends.select("doc_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK_FRAMES))).alias("block"))
    # Few bytes become very many rows: a fixed number of partitions, which adaptive execution doesn't draw together.
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "block")
    first = F.col("block") * BLOCK_FRAMES
    f = spread.select("doc_id", F.explode(F.sequence(first, F.least(first + BLOCK_FRAMES - 1, F.col("last")))).alias("frame_idx"))
    top = F.lit(900) + (F.col("frame_idx") * 37) % 100
    return f.select("doc_id", "frame_idx", top.alias("max_prob"), (top - (F.col("frame_idx") * 53) % 60).alias("aligned_prob"))


FRAMES = """frames AS (SELECT doc_id, frame_idx, 900 + (frame_idx * 37) % 100 AS max_prob, 900 + (frame_idx * 37) % 100 - (frame_idx * 53) % 60 AS aligned_prob FROM (
 SELECT doc_id, unnest(range(0, max(end_ms) // 20 + 1)) AS frame_idx FROM seg GROUP BY doc_id))"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter at every third turn; ends are unknown (0)."""
    s = segments(spark, sf_dir).where("seg_idx % 3 = 0")
    return s.select("doc_id", F.floor(F.col("seg_idx") / 3).cast("int").alias("ch_idx"), F.concat(F.lit("Part "), F.floor(F.col("seg_idx") / 3)).alias("title"), "start_ms", F.lit(0).cast("long").alias("end_ms"))


CHAPTERS = "chapters AS (SELECT doc_id, CAST(seg_idx // 3 AS INTEGER) AS ch_idx, concat('Part ', seg_idx // 3) AS title, start_ms, CAST(0 AS BIGINT) AS end_ms FROM seg WHERE seg_idx % 3 = 0)"


def model_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapters(spark, sf_dir)
    return c.select("doc_id", "ch_idx", (F.col("start_ms") + (F.col("ch_idx") % 3) * 600).alias("start_ms"), F.concat(F.lit("About "), F.col("title")).alias("summary"))


MODEL_CHAPTERS = "model_chapters AS (SELECT doc_id, ch_idx, start_ms + (ch_idx % 3) * 600 AS start_ms, concat('About ', title) AS summary FROM chapters)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled stretches: a user's events, each up to five seconds from its second in the month."""
    e = table(spark, sf_dir, "events")
    start = sum((part("ts").cast("long") * ms for part, ms in ((F.dayofmonth, 86_400_000), (F.hour, 3_600_000), (F.minute, 60_000))), F.second("ts").cast("long") * 1000)
    return e.select(F.col("user_id").alias("doc_id"), "event_id", start.alias("start_ms"), (start + F.col("event_id") % 5000 + 1).alias("end_ms"), F.col("event_type").alias("label"))


INTERVALS = """intervals AS (SELECT user_id AS doc_id, event_id, start_ms, start_ms + event_id % 5000 + 1 AS end_ms, event_type AS label FROM (
 SELECT *, CAST(day(ts) AS BIGINT) * 86400000 + CAST(hour(ts) AS BIGINT) * 3600000 + CAST(minute(ts) AS BIGINT) * 60000 + CAST(second(ts) AS BIGINT) * 1000 AS start_ms FROM events))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns of a diariser over the conversations: stretches of seven seconds."""
    ends = segments(spark, sf_dir).groupBy("doc_id").agg(F.max("end_ms").alias("end_ms"))
    t = ends.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end_ms") / 7000))).alias("k"))
    return t.select("doc_id", (F.col("k") * 7000).alias("start_ms"), (F.col("k") * 7000 + 7000).alias("end_ms"), F.concat(F.lit("SPEAKER_0"), (F.col("k") + F.col("doc_id")) % 3).alias("label"))


TURNS = """turns AS (SELECT doc_id, k * 7000 AS start_ms, k * 7000 + 7000 AS end_ms, concat('SPEAKER_0', (k + doc_id) % 3) AS label FROM (
 SELECT doc_id, unnest(range(0, max(end_ms) // 7000 + 1)) AS k FROM seg GROUP BY doc_id))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, unnest(range(0, len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents as segments, one behind the other, of 60 ms a character."""
    rows = lines(spark, sf_dir)
    end = F.sum(60 * (F.length("line").cast("long") + 1)).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    start = end - 60 * (F.length("line").cast("long") + 1)
    return rows.select("doc_id", F.col("line_no").cast("int").alias("seg_idx"), F.col("line").alias("text"), start.alias("start_ms"), end.alias("end_ms"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of labels for each document that has one."""
    d = table(spark, sf_dir, "labels").select("doc_id")
    r = d.select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("round"))
    return r.select("doc_id", "round", F.concat(F.lit("name"), (F.col("doc_id") * F.col("round")) % 3).alias("label"))


VOTES = "votes AS (SELECT doc_id, round, concat('name', (doc_id * round) % 3) AS label FROM labels, (VALUES (1), (2), (3)) r(round))"


#: Lines of the pages as SQL gets them: marks 1 for a line's end, 2 for a blank line, 3 between pieces of a line.  Hidden elements of these pages
#: aren't nested and hold no shown text.
PAGE_LINES = """shown AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1),
 '(?is)<!--.*?-->|<nav\\b.*?</nav>|<footer\\b.*?(</footer>|$)|<header\\b.*?</header>|<script\\b.*?</script>|<style\\b.*?</style>', chr(3), 'g') AS s FROM pages),
 marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)<(p|br|li|h[1-6])\\b[^>]*>', chr(1), 'g'), '(?i)</(p|div)>', chr(1) || chr(2) || chr(1), 'g'), '(?i)</(li|h[1-6])>', chr(1), 'g'), '<[^>]*>', chr(3), 'g') AS s FROM shown),
 items AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(s, '&quot;', '"'), '&amp;', '&'), chr(1)), lambda i: array_to_string(list_filter(list_transform(string_split(i, chr(3)),
 lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')), lambda i: i <> '') AS x FROM marked),
 kept AS (SELECT page_id, list_filter(x, lambda i, k: i <> chr(2) OR (k > 1 AND x[k - 1] <> chr(2))) AS x FROM items),
 page_lines AS (SELECT page_id AS doc_id, CAST(k - 1 AS INTEGER) AS line_no, CASE WHEN line = chr(2) THEN '' ELSE line END AS line FROM (
 SELECT page_id, unnest(y) AS line, generate_subscripts(y, 1) AS k FROM (SELECT page_id, string_split(array_to_string(x, chr(10)), chr(10)) AS y FROM kept)))"""
