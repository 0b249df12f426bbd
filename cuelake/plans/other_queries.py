"""Queries over sequential operators, chunks, sources, sinks, pages and windows of events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cuelake.functions import clock, text as T
from cuelake.operators import aggregates, alignment, chunks, duplicates, gates, joins, pages, sequential, speakers, summaries
from cuelake.sources import captions, writers
from cuelake.streaming import windows as streams

from .inputs import CHAPTERS, PAGE_LINES, SEG, chapters, document_segments, hypothesis, segments, table
from .registry import query


@query()
def segmenter_full(spark, d):
    return sequential.segment(segments(spark, d), max_ms=30_000)


@query()
def align_groups(spark, d):
    return alignment.align(segments(spark, d), hypothesis(spark, d))


@query()
def wer_stats(spark, d):
    t = alignment.totals(alignment.align(segments(spark, d), hypothesis(spark, d)))
    return t.withColumn("bucket", aggregates.wer_bucket(F.col("wer")))


@query("SELECT doc_id, count(*) AS n_segments, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_words FROM seg GROUP BY doc_id", SEG)
def aligned_with_itself(spark, d):
    """Each group of a track with itself is equal, and no row or word is lost."""
    s = segments(spark, d).withColumn("text", F.array_join(F.transform(F.split("text", " "), lambda w, i: F.concat(F.lit("w"), i)), " "))
    g = alignment.align(s, s).where("wer = 0 and diff_ms >= 0 and n_cor = ref_len")
    return g.groupBy("doc_id").agg(F.sum(F.col("sub_hi") - F.col("sub_lo")).alias("n_segments"), F.sum("ref_len").alias("n_words"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'exact' WHEN l_discount < 0.1 THEN 'good' WHEN l_discount < 0.32 THEN 'fair' ELSE 'poor' END AS bucket FROM lineitem")
def quality_buckets(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", aggregates.wer_bucket(F.col("l_discount")).alias("bucket"))


@query()
def timestamp_transfer(spark, d):
    norm = T.match_normalize(F.col("text"))
    s = segments(spark, d).withColumn("keys", T.match_keys(norm))
    ref = hypothesis(spark, d).withColumn("start_ms", F.col("start_ms") + 250).withColumn("end_ms", F.col("end_ms") + 250).withColumn("norm", norm)
    return sequential.transfer(s, ref)


@query()
def dup_blocks(spark, d):
    return duplicates.dup_blocks(document_segments(spark, d))


@query()
def dedup_segments(spark, d):
    """Lines of the documents without the shorter copy of each block that comes twice nearby."""
    return duplicates.deduplicated(document_segments(spark, d)).select("doc_id", "seg_idx", "start_ms", "end_ms")


@query()
def chunk_text_overlap(spark, d):
    c = sequential.chunks(table(spark, d, "documents"), size=2000, overlap=400)
    return c.select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def short_alignment(start: int, end: int, rows: list) -> list | None:
    """A stand-in for a decoder: it needs three rows or eight seconds."""
    return rows if len(rows) >= 3 or end - start >= 8000 else None


@query()
def merge_retry(spark, d):
    s = segments(spark, d)
    failed = F.col("end_ms") - F.col("start_ms") < 8000
    status = F.when(F.col("seg_idx") % 5 == 4, "skip").when(failed, "fail").otherwise("ok")
    own = F.array("seg_idx")
    g = s.select("doc_id", F.col("seg_idx").alias("group_idx"), "start_ms", "end_ms", status.alias("status"), F.when(status == "ok", own).otherwise(F.slice(own, 1, 0)).alias("rows"), own.alias("source"))
    return sequential.retry_groups(g, short_alignment)


@query("SELECT doc_id, seg_idx, k AS piece, start_ms + k * 3000 AS start_ms, least(start_ms + k * 3000 + 3000, end_ms) AS end_ms FROM (SELECT *, unnest(range(0, greatest(end_ms - 1 - start_ms, 0) // 3000 + 1)) AS k FROM seg)", SEG)
def interval_split(spark, d):
    return chunks.split_long(segments(spark, d), 3000).select("doc_id", "seg_idx", F.col("piece").cast("long").alias("piece"), "start_ms", "end_ms")


@query("SELECT doc_id, k * 1600 AS start, least(k * 1600 + 2000, n_chars) AS \"end\" FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars - 1, 0) // 1600 + 1)) AS k FROM documents)")
def chunk_overlap(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(chunks.sample_windows(F.col("n_chars"), 2000, 400)).alias("w"))
    return w.select("doc_id", "w.start", "w.end")


@query("SELECT doc_id, seg_idx // 3 AS batch, count(*) AS n FROM seg GROUP BY ALL", SEG)
def batch_assign(spark, d):
    return chunks.batches(segments(spark, d), 3).groupBy("doc_id", "batch").agg(F.count("*").alias("n"))


@query("SELECT doc_id, seg_idx FROM seg WHERE NOT (seg_idx // 3) % 2 = 0", SEG)
def resume_anti(spark, d):
    b = chunks.batches(segments(spark, d), 3)
    return chunks.remaining(b, b.where("batch % 2 = 0").select("doc_id", "batch").distinct(), "doc_id", "batch").select("doc_id", "seg_idx")


@query("SELECT doc_id, seg_idx FROM seg WHERE speaker IN (SELECT speaker FROM seg GROUP BY speaker HAVING count(*) > 50)", SEG)
def known_semi(spark, d):
    s = segments(spark, d)
    known = s.groupBy("speaker").count().where("count > 50")
    return s.join(known, "speaker", "left_semi").select("doc_id", "seg_idx")


@query("SELECT doc_id, 'supervisions' AS track, seg_idx, start_ms FROM seg UNION ALL SELECT doc_id, 'transcription', seg_idx, start_ms + (seg_idx % 5) * 100 FROM seg", SEG)
def tracks_union(spark, d):
    a = segments(spark, d).withColumn("track", F.lit("supervisions"))
    b = hypothesis(spark, d).withColumn("track", F.lit("transcription"))
    cols = ["doc_id", "track", "seg_idx", "start_ms"]
    return a.select(*cols).unionByName(b.select(*cols))


@query("SELECT doc_id, seg_idx, concat('de: ', text) AS translation FROM seg", SEG)
def translate_batches(spark, d):
    s = segments(spark, d).select("doc_id", "seg_idx", "text")
    out = chunks.map_model(s, lambda texts: ["de: " + t for t in texts], "translation")
    return out.select("doc_id", "seg_idx", "translation")


@query("SELECT doc_id, CAST(count(*) AS VARCHAR) AS summary FROM seg GROUP BY doc_id", SEG)
def map_reduce_summary(spark, d):
    c = segments(spark, d).select("doc_id", F.col("seg_idx").alias("chunk_idx"), F.col("text").alias("chunk"))
    return chunks.map_reduce(c, lambda texts: ["1"] * len(texts), lambda texts: [str(len(t.split("\n"))) for t in texts])


@query("SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, array_to_string(list(seg_idx ORDER BY seg_idx), ',') AS ids FROM seg GROUP BY doc_id, seg_idx // 2", SEG)
def merge_groups(spark, d):
    s = segments(spark, d).select("doc_id", F.floor(F.col("seg_idx") / 2).alias("g"), "start_ms", "end_ms", F.array("seg_idx").alias("seg_idxs"))
    return chunks.merge_groups(s, "doc_id", "g").select("doc_id", "start_ms", "end_ms", F.array_join("seg_idxs", ",").alias("ids"))


@query("SELECT n_name AS source, CASE WHEN n_nationkey % 2 = 0 THEN concat('u-', n_name) ELSE concat('f-', n_name) END AS target FROM nation")
def glossary_merge(spark, d):
    n = table(spark, d, "nation")
    user = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("source"), F.concat(F.lit("u-"), "n_name").alias("target"))
    found = n.where("n_nationkey % 2 = 1 or n_nationkey % 4 = 0").select(F.col("n_name").alias("source"), F.concat(F.lit("f-"), "n_name").alias("target"))
    return joins.merge_glossaries(user, found)


@query("SELECT r_name AS path, n_name AS source, concat(n_name, '!') AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def glossary_md_parse(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), "n_name", F.lit(" | "), "n_name", F.lit("! |")))), "\n")
    files = n.groupBy(F.col("r_name").alias("path")).agg(F.concat(F.lit("# Terms\n\n| term | wording |\n| --- | --- |\n"), lines, F.lit("\n\nend | of\n")).alias("value"))
    return captions.glossary_markdown(files)


@query("SELECT user_id, arg_min(ext, (p, ord)) AS ext FROM (SELECT user_id, event_id AS ord, event_type AS ext, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM events) GROUP BY user_id")
def best_format_pick(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("ext"))
    return aggregates.best_track(e, ("purchase", "click"), "user_id").select("user_id", "ext")


@query("SELECT user_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ext = 'm4a' AS INT) DESC, CAST(ext IN ('m4a', 'webm', 'opus') AS INT) DESC, CASE WHEN abr <= 148 THEN abr ELSE -1000 END DESC, ord) AS r FROM (SELECT user_id, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'm4a' WHEN 1 THEN 'webm' ELSE 'mp3' END AS ext, (event_id * 13) % 320 AS abr FROM events)) WHERE r = 1")
def best_audio_pick(spark, d):
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.when(k == 0, "m4a").when(k == 1, "webm").otherwise("mp3").alias("ext"), ((F.col("event_id") * 13) % 320).alias("abr"), F.lit(None).cast("long").alias("tbr"))
    return aggregates.best_audio(e, "m4a", 128, "user_id").select("user_id", "ord")


@query("SELECT item_id, text AS overview, CAST(0 AS INTEGER) AS n_tags, CASE WHEN item_id % 2 = 0 THEN 'Untitled' ELSE concat('Item ', item_id) END AS title FROM benchmark")
def summary_defaults(spark, d):
    title = F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("Item "), "item_id"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("overview"), title.alias("title"))), F.lit("\n```"))
    b = table(spark, d, "benchmark").select("item_id", summaries.summary_of(answer).alias("s"))
    return b.select("item_id", "s.overview", F.size("s.tags").alias("n_tags"), "s.title")


WORD_STARTS = "wt AS (SELECT doc_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM seg)"


def timed_words(spark, d):
    """Segments with word timings; every third segment has none."""
    word = F.struct(F.lit("w").alias("symbol"), F.col("start_ms"))
    words = F.when(F.col("seg_idx") % 3 != 0, F.transform(F.split("text", " "), lambda w: word))
    return segments(spark, d).withColumn("words", words)


@query("SELECT doc_id, bool_and(n > 0) AS ready, sum(n) / count(*) AS ratio, sum(n) < 0.5 * count(*) AS low FROM wt GROUP BY doc_id", SEG, WORD_STARTS)
def word_gates(spark, d):
    s = timed_words(spark, d)
    return gates.all_have_words(s).join(gates.word_ratio(s), "doc_id")


@query("SELECT doc_id, seg_idx + 1 AS seg_idx, CASE WHEN doc_id % 2 = 0 THEN seg_idx END AS source_id FROM seg WHERE doc_id % 2 = 0 OR seg_idx > 0", SEG)
def id_preserve(spark, d):
    s = segments(spark, d)
    aligned = s.where("doc_id % 2 = 0 or seg_idx > 0").withColumn("seg_idx", F.col("seg_idx") + 1)
    return gates.keep_ids(s, aligned).select("doc_id", "seg_idx", "source_id")


@query("SELECT doc_id, count(DISTINCT speaker) >= 2 AS ready FROM seg GROUP BY doc_id", SEG)
def naming_gate(spark, d):
    return gates.can_be_named(segments(spark, d))


@query("SELECT doc_id, concat('l', min(seg_idx)) AS lang FROM seg WHERE seg_idx % 4 = 2 GROUP BY doc_id", SEG)
def first_language(spark, d):
    found = F.when(F.col("seg_idx") % 4 == 2, F.concat(F.lit("l"), "seg_idx")).when(F.col("seg_idx") % 4 == 1, "")
    return gates.first_language(segments(spark, d).select("doc_id", F.col("seg_idx").alias("chunk_idx"), found.alias("lang")))


@query("SELECT doc_id, count(DISTINCT seg_idx // 3) AS n_batches, count(*) AS n_segments FROM seg WHERE (seg_idx // 3) % 2 = 0 GROUP BY doc_id", SEG)
def resume_counts(spark, d):
    b = chunks.batches(segments(spark, d), 3)
    return gates.resumed(b, b.where("batch % 2 = 0"))


@query("SELECT doc_id, seg_idx, start_ms, CAST(least(start_ms + least(greatest(end_ms - start_ms, 700, ceil(length(text) * 1000 / 17.0)), 7000), coalesce(lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, seg_idx), 9000000000000)) AS BIGINT) AS end_ms FROM seg", SEG)
def standard_layout(spark, d):
    return gates.standard(segments(spark, d)).select("doc_id", "seg_idx", "start_ms", "end_ms")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.05 THEN 'medium' ELSE 'low' END AS prefix, CASE WHEN l_discount > 0.07 THEN 'high' WHEN l_discount > 0.05 THEN 'medium' ELSE 'low' END AS suffix FROM lineitem")
def share_buckets(spark, d):
    tenfold = F.round(F.col("l_discount").cast("double") * 10, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", aggregates.share_bucket(tenfold, True).alias("prefix"), aggregates.share_bucket(tenfold, False).alias("suffix"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def tpch_pricing(spark, d):
    part = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return part.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def tpch_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT doc_id, md5(string_agg(concat(number, chr(10), t(start_ms, ','), ' --> ', t(end_ms, ','), chr(10), coalesce(speaker || ': ', ''), text, chr(10)), chr(10) ORDER BY number)) AS srt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, seg_idx) AS number FROM seg) GROUP BY doc_id".replace("t(start_ms, ',')", "format('{:02d}:{:02d}:{:02d},{:03d}', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000)").replace("t(end_ms, ',')", "format('{:02d}:{:02d}:{:02d},{:03d}', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, end_ms % 1000)"), SEG)
def render_srt(spark, d):
    return writers.srt(segments(spark, d)).select("doc_id", F.md5("value").alias("srt_md5"))


@query("SELECT doc_id, md5(concat('WEBVTT', chr(10), chr(10), string_agg(concat(t(start_ms, '.'), ' --> ', t(end_ms, '.'), chr(10), coalesce(speaker || ': ', ''), text, chr(10)), chr(10) ORDER BY start_ms, seg_idx))) AS vtt_md5 FROM seg GROUP BY doc_id".replace("t(start_ms, '.')", "format('{:02d}:{:02d}:{:02d}.{:03d}', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000)").replace("t(end_ms, '.')", "format('{:02d}:{:02d}:{:02d}.{:03d}', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, end_ms % 1000)"), SEG)
def render_vtt(spark, d):
    return writers.vtt(segments(spark, d)).select("doc_id", F.md5("value").alias("vtt_md5"))


@query("SELECT doc_id, md5(string_agg(concat('**', speaker, ':** ', trim(text), ' [', format('{:02d}:{:02d}:{:02d}', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60), ']'), chr(10) || chr(10) ORDER BY start_ms, seg_idx)) AS md_md5 FROM seg GROUP BY doc_id", SEG)
def render_md(spark, d):
    return writers.markdown(segments(spark, d)).select("doc_id", F.md5("value").alias("md_md5"))


@query("SELECT doc_id, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars FROM seg GROUP BY doc_id", SEG)
def render_json(spark, d):
    files = writers.json(segments(spark, d)).select(F.col("doc_id").cast("string").alias("path"), "value")
    s = captions.json(files)
    return s.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_items"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, seg_idx, start_ms, end_ms, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS text FROM seg", SEG)
def srt_round_trip(spark, d):
    one = F.regexp_replace("text", r"\s*\n\s*", " ")
    files = writers.srt(segments(spark, d).withColumn("text", one).drop("speaker")).select(F.col("doc_id").cast("string").alias("path"), "value")
    return captions.cues(files).select(F.col("path").cast("long").alias("doc_id"), F.col("seg_idx").cast("int").alias("seg_idx"), "start_ms", "end_ms", "text")


@query("SELECT doc_id, speaker, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1) % 10 AS INTEGER) AS color FROM (SELECT doc_id, speaker, min(seg_idx) AS f FROM seg GROUP BY ALL)", SEG)
def speaker_colors(spark, d):
    return writers.speaker_colors(segments(spark, d)).select("doc_id", "speaker", F.col("color").cast("int").alias("color")).distinct()


@query("SELECT * FROM page_lines", PAGE_LINES)
def html_lines(spark, d):
    return pages.html_lines(table(spark, d, "pages"))


@query(
    """SELECT doc_id, 'timed' AS strategy, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM seg WHERE doc_id % 3 = 0 GROUP BY doc_id
 UNION ALL SELECT doc_id, 'whole', 1, 0 FROM (SELECT doc_id, string_agg(CASE WHEN doc_id % 3 = 1 THEN upper(speaker[1]) || lower(speaker[2:]) || ': ' || trim(text) ELSE text END, chr(10)) AS t
 FROM seg WHERE doc_id % 3 > 0 GROUP BY doc_id HAVING count(*) < 10) WHERE length(t) > 200
 UNION ALL SELECT doc_id, 'named', count(*), count(DISTINCT speaker) FROM seg WHERE doc_id % 3 = 1 GROUP BY doc_id HAVING count(*) >= 10""",
    SEG,
)
def transcript_strategy(spark, d):
    s = segments(spark, d)
    md = writers.markdown(s.where("doc_id % 3 = 0")).select("doc_id", F.posexplode(F.split(F.regexp_replace("value", r"(?s)\*\*([^*]+?):\*\* (.*?) \[([0-9:]+)\]", "$1 ($3) $2"), "\n")).alias("line_no", "line"))
    plain = writers.joined(s.where("doc_id % 3 = 1"), F.concat(F.initcap("speaker"), F.lit(": "), F.trim("text"))).select("doc_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rest = writers.joined(s.where("doc_id % 3 = 2"), F.col("text")).select("doc_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return pages.transcripts(md.unionByName(plain).unionByName(rest)).groupBy("doc_id", "strategy").agg(F.count("*").alias("n_turns"), F.count_distinct("speaker").alias("n_speakers"))


EVENT_TIMES = "SELECT time_bucket(INTERVAL '{0}', ts, TIMESTAMP '2000-01-01') AS start, time_bucket(INTERVAL '{0}', ts, TIMESTAMP '2000-01-01') + INTERVAL '{0}' AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL"


@query(EVENT_TIMES.format("1 hour"))
def tumbling_counts(spark, d):
    return streams.windowed_counts(table(spark, d, "events"), "1 hour", None, None, "event_type")


@query("SELECT start, start + INTERVAL '2 hours' AS \"end\", count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') - k * INTERVAL '1 hour' AS start FROM events, (VALUES (0), (1)) v(k)) GROUP BY start")
def sliding_counts(spark, d):
    return streams.windowed_counts(table(spark, d, "events"), "2 hours", "1 hour", None)


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s")
def session_counts(spark, d):
    return streams.sessions(table(spark, d, "events"), "30 minutes", None, "user_id")


@query("SELECT doc_id, seg_idx, n FROM (SELECT doc_id, seg_idx, count(*) AS n FROM (SELECT doc_id, seg_idx, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')), chr(1)), lambda x: x <> '')) AS p FROM seg) GROUP BY ALL)", SEG)
def sentence_split(spark, d):
    return chunks.split_sentences(segments(spark, d)).groupBy("doc_id", "seg_idx").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS n_chapters, min(start_ms) AS first_ms, array_to_string(list(title ORDER BY ch_idx), '; ') AS titles FROM chapters GROUP BY doc_id", SEG, CHAPTERS)
def chapter_summary(spark, d):
    c = chapters(spark, d)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch_idx", "title"))), lambda x: x["title"]), "; ")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chapters"), F.min("start_ms").alias("first_ms"), titles.alias("titles"))


def videos(spark, d):
    """Metadata of a video for each supplier, with two or three tracks."""
    k = F.col("s_suppkey")
    track = lambda ext: F.struct(F.lit(ext).alias("ext"), F.concat(F.lit("u"), k.cast("string")).alias("url"))
    subs = F.when(k % 2 == 0, F.create_map(F.lit("en"), F.array(track("vtt"), track("json3")))).otherwise(F.create_map(F.lit("de"), F.array(track("vtt"))))
    info = F.struct(k.cast("string").alias("id"), F.col("s_name").alias("title"), subs.alias("subtitles"), F.create_map(F.lit("en"), F.array(track("ttml"))).alias("automatic_captions"))
    return table(spark, d, "supplier").select(F.to_json(info).alias("value"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS video_id, CASE WHEN s_suppkey % 2 = 0 THEN 'manual' ELSE 'asr' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'json3' ELSE 'ttml' END AS ext FROM supplier")
def track_choice(spark, d):
    return summaries.pick_tracks(summaries.caption_tracks(videos(spark, d)), "en").select("video_id", "kind", "ext")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS video_id, 'en' AS lang, 'asr' AS kind, 'ttml' AS exts FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'en' ELSE 'de' END, 'manual', CASE WHEN s_suppkey % 2 = 0 THEN 'json3,vtt' ELSE 'vtt' END FROM supplier")
def track_list(spark, d):
    t = summaries.list_tracks(summaries.caption_tracks(videos(spark, d)))
    return t.select("video_id", "lang", "kind", F.array_join("exts", ",").alias("exts"))


@query("SELECT c_nationkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS entry, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'host' ELSE '' END AS role, c_mktsegment AS affiliation FROM customer")
def speaker_blocks(spark, d):
    w = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), w.alias("entry"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "host").otherwise("").alias("role"), F.col("c_mktsegment").alias("affiliation"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("bio"))
    lines = speakers.format_block(c).select("doc_id", F.posexplode(F.split("block", "\n")).alias("line_no", "line"))
    return speakers.parse_block(lines).select("doc_id", F.col("entry").cast("int").alias("entry"), "name", "role", "affiliation")


@query("SELECT doc_id, seg_idx, speaker, start_ms - start_ms % 1000 AS start_ms FROM seg", SEG)
def flat_turns(spark, d):
    s = segments(spark, d)
    line = F.concat("speaker", F.lit(" ["), clock.hms(F.floor(F.col("start_ms") / 1000)), F.lit("]:\n"), F.regexp_replace("text", r"\s+", " "))
    turns = summaries.flat_turns(writers.joined(s, line).select("doc_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return turns.select("doc_id", order.alias("seg_idx"), "speaker", "start_ms")
