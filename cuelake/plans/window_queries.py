"""Queries over ordered rows: sessions, windows, interpolation, budgets."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cuelake.functions import text as T
from cuelake.operators import aggregates, gates, joins, windows

from .inputs import CHAPTERS, FRAMES, INTERVALS, LINES, MODEL_CHAPTERS, SEG, TURNS, VOTES, chapters, frames, intervals, lines, model_chapters, segments, table, timed_words, turns, votes
from .registry import query

ORD = "PARTITION BY doc_id ORDER BY start_ms, seg_idx"
SESSIONS = f"""sess AS (SELECT *, CAST(sum(n) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
 SELECT *, CASE WHEN start_ms - lag(end_ms) OVER ({ORD}) > 4000 THEN 1 ELSE 0 END AS n FROM seg))"""


@query("SELECT doc_id, seg_idx, speaker, start_ms, end_ms FROM seg", SEG)
def seg_scan(spark, d):
    return segments(spark, d).select("doc_id", "seg_idx", "speaker", "start_ms", "end_ms")


@query("SELECT doc_id, seg_idx, start_ms - 1500 AS start_ms, end_ms - 1500 AS end_ms FROM seg", SEG)
def seg_shift(spark, d):
    return segments(spark, d).select("doc_id", "seg_idx", (F.col("start_ms") - 1500).alias("start_ms"), (F.col("end_ms") - 1500).alias("end_ms"))


@query(f"SELECT doc_id, seg_idx, CASE WHEN lead(start_ms) OVER ({ORD}) IS NULL THEN greatest(max(end_ms) OVER (PARTITION BY doc_id) - start_ms, 100) ELSE greatest(lead(start_ms) OVER ({ORD}) - start_ms, 0) END AS duration_ms FROM seg", SEG)
def seg_duration_fix(spark, d):
    return windows.recalculate_durations(segments(spark, d)).select("doc_id", "seg_idx", "duration_ms")


@query("SELECT doc_id, session, count(*) AS n_segments, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM sess GROUP BY doc_id, session", SEG, SESSIONS)
def gap_sessions(spark, d):
    s = windows.gap_sessions(segments(spark, d))
    return s.groupBy("doc_id", "session").agg(F.count("*").alias("n_segments"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query("SELECT doc_id, session, speaker, sum(words)::BIGINT AS n_words, sum(ms)::BIGINT AS speaking_ms, sum(sum(ms)) OVER (PARTITION BY doc_id, session)::BIGINT AS session_ms FROM (SELECT *, len(string_split(trim(text), ' ')) AS words, end_ms - start_ms AS ms FROM sess) GROUP BY doc_id, session, speaker", SEG, SESSIONS)
def flagship_sessions(spark, d):
    s = windows.gap_sessions(segments(spark, d)).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    by = s.groupBy("doc_id", "session", "speaker").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n_words"), F.sum("ms").alias("speaking_ms"))
    return by.withColumn("session_ms", F.sum("speaking_ms").over(W.partitionBy("doc_id", "session")))


@query(f"SELECT doc_id, seg_idx, start_ms - least(greatest((start_ms - coalesce(lag(end_ms) OVER w, 0)) // 2, 0), 2000) AS wide_start_ms, end_ms + CASE WHEN lead(start_ms) OVER w IS NULL THEN 2000 ELSE least(greatest((lead(start_ms) OVER w - end_ms) // 2, 0), 2000) END AS wide_end_ms FROM seg WINDOW w AS ({ORD})", SEG)
def widen_window(spark, d):
    return windows.widen(segments(spark, d)).select("doc_id", "seg_idx", "wide_start_ms", "wide_end_ms")


KNOWN = "g AS (SELECT doc_id, seg_idx AS group_idx, CASE WHEN seg_idx % 3 <> 1 THEN start_ms END AS start_ms, CASE WHEN seg_idx % 3 <> 1 THEN end_ms END AS end_ms FROM seg)"


@query("SELECT doc_id, group_idx, window_start_ms, coalesce(end_ms, nxt, window_start_ms + 2000) AS window_end_ms FROM (SELECT *, coalesce(start_ms, last_value(end_ms IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY group_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS window_start_ms, first_value(start_ms IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY group_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM g)", SEG, KNOWN)
def fallback_window(spark, d):
    known = F.col("seg_idx") % 3 != 1
    g = segments(spark, d).select("doc_id", F.col("seg_idx").alias("group_idx"), F.when(known, F.col("start_ms")).alias("start_ms"), F.when(known, F.col("end_ms")).alias("end_ms"))
    return windows.fallback_windows(g).select("doc_id", "group_idx", "window_start_ms", "window_end_ms")


@query(f"SELECT doc_id, seg_idx, least(start_ms, greatest(start_ms - 100, coalesce(lag(end_ms) OVER w + 80, 0))) AS margin_start_ms, greatest(end_ms, least(end_ms + 100, coalesce(lead(start_ms) OVER w - 80, end_ms + 100))) AS margin_end_ms FROM seg WINDOW w AS ({ORD})", SEG)
def margins(spark, d):
    return windows.margins(segments(spark, d)).select("doc_id", "seg_idx", "margin_start_ms", "margin_end_ms")


@query("SELECT doc_id, ch_idx, coalesce(lead(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, ch_idx), 0) AS end_ms FROM chapters", SEG, CHAPTERS)
def chapter_ends(spark, d):
    return windows.fill_chapter_ends(chapters(spark, d)).select("doc_id", "ch_idx", "end_ms")


@query("SELECT doc_id, seg_idx, begin_ms + CASE WHEN next_ms IS NULL THEN CASE WHEN rc > 0 THEN CAST(floor(bef * rm / rc) AS BIGINT) ELSE 0 END ELSE CAST((next_ms - begin_ms) * bef // tot AS BIGINT) END AS time_ms FROM (SELECT *, sum(CASE WHEN next_ms IS NOT NULL THEN (next_ms - begin_ms) * n_chars END) OVER (PARTITION BY doc_id) AS rm, sum(CASE WHEN next_ms IS NOT NULL THEN tot * n_chars END) OVER (PARTITION BY doc_id) AS rc FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY doc_id, begin_ms ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(n_chars) OVER (PARTITION BY doc_id, begin_ms) AS tot FROM (SELECT doc_id, seg_idx, length(text) AS n_chars, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS begin_ms, first_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN start_ms END AS m FROM seg))))", SEG)
def timestamp_interpolate(spark, d):
    rows = segments(spark, d).select("doc_id", "seg_idx", F.length("text").alias("n_chars"), F.when(F.col("seg_idx") % 3 == 0, F.col("start_ms")).alias("chapter_ms"))
    return windows.interpolate(rows).select("doc_id", "seg_idx", "time_ms")


@query("SELECT doc_id, seg_idx, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS speaker FROM (SELECT *, CASE WHEN seg_idx % 4 = 0 THEN concat(speaker, seg_idx) END AS s FROM seg)", SEG)
def carry_forward(spark, d):
    s = segments(spark, d).select("doc_id", "seg_idx", F.when(F.col("seg_idx") % 4 == 0, F.concat("speaker", "seg_idx")).alias("speaker"))
    return windows.carry_forward(s, "speaker", "seg_idx")


@query("SELECT doc_id, max(line_no) FILTER (trim(line) <> '' AND NOT contains(lower(line), 'licen') AND length(line) >= 40) AS last_line FROM lines GROUP BY doc_id HAVING last_line IS NOT NULL", LINES)
def line_trim_tail(spark, d):
    noise = F.lower("line").contains("licen") | (F.length("line") < 40)
    return windows.trim_tail(lines(spark, d), noise).groupBy("doc_id").agg(F.max("line_no").cast("long").alias("last_line"))


@query("SELECT doc_id, count(*) AS n_kept, sum(n)::BIGINT AS n_chars FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT doc_id, line_no, length(line) AS n FROM lines)) WHERE used <= 1500 GROUP BY doc_id", LINES)
def paragraph_budget(spark, d):
    rows = lines(spark, d).select("doc_id", "line_no", F.length("line").alias("n"))
    return windows.budget(rows, "n", 1500, "line_no").groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum("n").alias("n_chars"))


@query("SELECT doc_id, seg_idx // 3 AS batch, array_to_string(first(b ORDER BY seg_idx), '|') AS before, array_to_string(last(a ORDER BY seg_idx), '|') AS after FROM (SELECT doc_id, seg_idx, list(speaker) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, list(speaker) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM seg) GROUP BY doc_id, seg_idx // 3", SEG)
def context_rows(spark, d):
    c = windows.context(segments(spark, d).withColumn("text", F.col("speaker")), 3, 2)
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return c.select("doc_id", "batch", join("before").alias("before"), join("after").alias("after"))


@query("SELECT doc_id, ch_idx, start_ms, (SELECT min(seg_idx) FROM seg s WHERE s.doc_id = c.doc_id AND s.start_ms >= c.start_ms) AS before_seg FROM (SELECT doc_id, ch_idx, start_ms + 700 AS start_ms FROM chapters) c", SEG, CHAPTERS)
def chapter_insert(spark, d):
    c = chapters(spark, d).withColumn("start_ms", F.col("start_ms") + 700)
    return windows.chapter_marks(segments(spark, d), c).select("doc_id", "ch_idx", "start_ms", "before_seg")


@query("SELECT s.doc_id, s.seg_idx, c.title FROM seg s ASOF JOIN chapters c ON s.doc_id = c.doc_id AND s.start_ms >= c.start_ms", SEG, CHAPTERS)
def asof_lookup(spark, d):
    s = segments(spark, d).select("doc_id", "seg_idx", "start_ms")
    return windows.asof(s, chapters(spark, d), "start_ms", "title", position="start_ms").select("doc_id", "seg_idx", "title")


SPANS = "span AS (SELECT s.doc_id, seg_idx, least(start_ms // 20, last) AS lo, greatest(least(end_ms // 20, last + 1), least(start_ms // 20, last) + 1) AS hi FROM seg s JOIN (SELECT doc_id, max(frame_idx) AS last FROM frames GROUP BY doc_id) USING (doc_id))"
LOSS = f"loss AS (SELECT s.doc_id, s.seg_idx, count(*) AS n_frames, sum(max_prob - aligned_prob)::BIGINT AS loss_sum FROM span s JOIN frames f ON f.doc_id = s.doc_id AND frame_idx >= lo AND frame_idx < hi GROUP BY s.doc_id, s.seg_idx)"


@query("SELECT * FROM loss", SEG, FRAMES, SPANS, LOSS)
def frame_score_join(spark, d):
    return joins.frame_scores(segments(spark, d), frames(spark, d))


WORDS = """words AS (SELECT doc_id, seg_idx, CAST(i - 1 AS INTEGER) AS word_idx, start_ms + (i - 1) * ms // n AS start_ms, start_ms + i * ms // n AS end_ms FROM (
 SELECT *, end_ms - start_ms AS ms, len(string_split(text, ' ')) AS n FROM seg), LATERAL (SELECT unnest(range(1, n + 1)) AS i)
 UNION ALL SELECT doc_id, seg_idx, NULL, start_ms, end_ms FROM seg)"""
WORD_SPANS = """word_spans AS (SELECT doc_id, seg_idx, word_idx, least(start_ms // 20, last) AS lo, greatest(least(end_ms // 20, last + 1), least(start_ms // 20, last) + 1) AS hi
 FROM words JOIN (SELECT doc_id, max(frame_idx) AS last FROM frames GROUP BY doc_id) USING (doc_id))"""
BELOW = """below AS (SELECT doc_id, frame_idx, sum(max_prob - aligned_prob) OVER (PARTITION BY doc_id ORDER BY frame_idx) AS s FROM frames)"""


@query(
    """SELECT w.doc_id, w.seg_idx, w.word_idx, hi - lo AS n_frames, CAST(b.s - coalesce(a.s, 0) AS BIGINT) AS loss_sum FROM word_spans w
 JOIN below b ON b.doc_id = w.doc_id AND b.frame_idx = hi - 1 LEFT JOIN below a ON a.doc_id = w.doc_id AND a.frame_idx = lo - 1""",
    SEG, FRAMES, WORDS, WORD_SPANS, BELOW,
)
def word_score_join(spark, d):
    """Frame scores of segments and of their words, whose times part a segment's evenly."""
    s = segments(spark, d)
    s = s.withColumn("words", timed_words(F.split("text", " ")))
    return joins.nested_scores(s, frames(spark, d))


def scored(spark, d):
    s = joins.frame_scores(segments(spark, d), frames(spark, d))
    return s.select("doc_id", "seg_idx", (1000 - F.expr("loss_sum div n_frames")).alias("score"))


SCORED = "scored AS (SELECT doc_id, seg_idx, 1000 - loss_sum // n_frames AS score FROM loss)"


@query("SELECT doc_id, seg_idx, score FROM scored JOIN seg USING (doc_id, seg_idx) WHERE score < 975 AND NOT (starts_with(trim(text), '[') AND ends_with(trim(text), ']'))", SEG, FRAMES, SPANS, LOSS, SCORED)
def low_score_segments(spark, d):
    return gates.low_scores(segments(spark, d), scored(spark, d), 975)


EVENT_SCORES = "es AS (SELECT user_id AS doc_id, event_id AS seg_idx, CAST(floor(value * 10) AS BIGINT) AS score FROM events)"


@query("SELECT doc_id, min(i) AS at FROM (SELECT doc_id, i, n, avg(score) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - avg(score) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS fall FROM (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM es)) WHERE n >= 10 AND i >= 5 AND i <= n - 5 AND fall > 200 GROUP BY doc_id", EVENT_SCORES)
def score_anomaly(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seg_idx"), F.floor(F.col("value") * 10).alias("score"))
    found = windows.score_anomalies(e, drop=200)
    order = e.withColumn("i", (F.row_number().over(W.partitionBy("doc_id").orderBy("seg_idx")) - 1).cast("long"))
    return found.select("doc_id", F.col("drop_at").alias("seg_idx")).join(order, ["doc_id", "seg_idx"]).select("doc_id", F.col("i").alias("at"))


@query("SELECT doc_id, seg_idx, label AS speaker, overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY overlap_ms DESC, label) AS r FROM (SELECT s.doc_id, seg_idx, t.label, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms))::BIGINT AS overlap_ms FROM seg s JOIN turns t ON s.doc_id = t.doc_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms GROUP BY ALL) WHERE overlap_ms >= 500) WHERE r = 1", SEG, TURNS)
def speaker_overlap(spark, d):
    return joins.claim_speakers(segments(spark, d), turns(spark, d))


@query("SELECT s.doc_id, s.seg_idx, concat('SPK', (s.seg_idx * 7) % 3) AS speaker FROM seg s WHERE s.seg_idx % 5 <> 4", SEG)
def speaker_zip(spark, d):
    s = segments(spark, d)
    labels = s.where("seg_idx % 5 <> 4").select("doc_id", "seg_idx", F.concat(F.lit("SPK"), (F.col("seg_idx") * 7) % 3).alias("speaker"))
    return joins.zip_speakers(s, labels).select("doc_id", "seg_idx", "speaker")


@query("SELECT doc_id, seg_idx, CASE WHEN speaker = 'user' AND doc_id % 2 = 0 THEN concat('Guest ', doc_id) ELSE speaker END AS speaker FROM seg", SEG)
def speaker_relabel(spark, d):
    s = segments(spark, d)
    names = s.where("speaker = 'user' AND doc_id % 2 = 0").select("doc_id", "speaker", F.concat(F.lit("Guest "), "doc_id").alias("name")).distinct()
    return joins.relabel(s, names).select("doc_id", "seg_idx", "speaker")


@query("SELECT m.doc_id, m.event_id AS seg_idx, min(i.start_ms) AS event_ms FROM intervals m JOIN intervals i ON m.doc_id = i.doc_id AND m.label = i.label AND i.start_ms < m.end_ms + 20000 AND i.end_ms > m.start_ms - 20000 GROUP BY ALL", INTERVALS)
def event_match_merge_first(spark, d):
    i = intervals(spark, d)
    marks = i.select("doc_id", F.col("event_id").alias("seg_idx"), "start_ms", "end_ms", F.concat(F.lit("["), "label", F.lit("]")).alias("text"))
    return joins.match_events(marks, i.drop("event_id"), {}).select("doc_id", "seg_idx", F.col("b_start_ms").alias("event_ms"))


@query("SELECT c.doc_id, c.ch_idx, coalesce((SELECT arg_min(m.summary, m.ch_idx) FROM model_chapters m WHERE m.doc_id = c.doc_id AND abs(m.start_ms - c.start_ms) < 1000), (SELECT any_value(m.summary) FROM model_chapters m WHERE m.doc_id = c.doc_id AND m.ch_idx = c.ch_idx), '') AS summary FROM chapters c", SEG, CHAPTERS, MODEL_CHAPTERS)
def chapter_lock(spark, d):
    return joins.lock_chapters(chapters(spark, d), model_chapters(spark, d)).select("doc_id", "ch_idx", "summary")


WORDS = "w AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, lower(unnest(x)) AS word FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\\s+') AS x FROM documents))"


@query("SELECT doc_id, pos AS pos_a, nxt AS pos_b FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) AS nxt FROM (SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w) WHERE n = 8) WHERE nxt - pos <= 300", WORDS)
def ngram_pairs(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\s+")).alias("pos", "word")).withColumn("word", F.lower("word"))
    return joins.ngram_links(w).select("doc_id", F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b"))


@query("SELECT doc_id, label, n_votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_votes DESC, f) AS r FROM (SELECT doc_id, label, count(*) AS n_votes, min(round) AS f FROM votes GROUP BY ALL)) WHERE r = 1", VOTES)
def majority_vote(spark, d):
    return aggregates.majority(votes(spark, d), "doc_id")


@query("SELECT doc_id, speaker, count(*) AS n_segments, sum(length(text))::BIGINT AS n_chars, sum(length(text))::BIGINT // count(*) AS avg_chars FROM seg WHERE trim(text) <> '' GROUP BY ALL", SEG)
def speaker_counts(spark, d):
    return aggregates.speaker_counts(segments(spark, d))


TALK = "c AS (SELECT user_id AS doc_id, event_type AS speaker, concat('Guest ', length(event_type)) AS name, count(*) * (CASE WHEN event_type = 'click' THEN 20 ELSE 1 END) AS n_segments FROM events GROUP BY user_id, event_type)"


@query("SELECT doc_id, speaker, CASE WHEN count(*) OVER p >= 3 AND 100 * max(n_segments) OVER p >= 75 * sum(n_segments) OVER p AND 100 * n_segments < 10 * sum(n_segments) OVER p THEN 'Audience' ELSE name END AS label FROM c WINDOW p AS (PARTITION BY doc_id)", TALK)
def talk_format(spark, d):
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("speaker")).agg(F.count("*").alias("n"))
    c = c.select("doc_id", "speaker", F.concat(F.lit("Guest "), F.length("speaker")).alias("name"), (F.col("n") * F.when(F.col("speaker") == "click", 20).otherwise(1)).alias("n_segments"))
    return aggregates.talk_format(c).select("doc_id", "speaker", "label")


@query("SELECT label, count(*) AS n, " + ", ".join(f"quantile_cont(v, {m / 100}) AS p{m}" for m in (0, 5, 10, 50, 90, 95, 100)) + " FROM (SELECT user_id % 7 AS label, floor(value * 100) AS v FROM events) GROUP BY label")
def audio_percentiles(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("label"), F.floor(F.col("value") * 100).cast("double").alias("value"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    return n.join(aggregates.signal_stats(e, "label").drop("mean", "std"), "label")


@query("SELECT label, round(10 * log10(power) * 100) AS rms_cdb, round(CASE WHEN 10 * log10(power) >= -80 AND 10 * log10(power) < -24 THEN least(-14 - 10 * log10(power), 40) ELSE 0 END * 100) AS gain_cdb FROM (SELECT vec_id AS label, sum(q * q)::DOUBLE / count(*) / 1e12 AS power FROM (SELECT vec_id, CAST(floor(CAST(x AS DOUBLE) * 20000) AS BIGINT) AS q FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) WHERE pos % 16 = 0) GROUP BY vec_id) WHERE power > 0")
def rms_gain(spark, d):
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.posexplode("embedding").alias("pos", "x"))
    some = s.where("pos % 16 = 0").withColumn("q", F.floor(F.col("x").cast("double") * 20000))
    power = some.groupBy("label").agg((F.sum(F.col("q") * F.col("q")).cast("double") / F.count("*") / 1e12).alias("power")).where("power > 0")
    g = aggregates.rms_gain(power.select("label", F.lit(0).alias("pos"), F.sqrt("power").alias("value")), "label")
    return g.select("label", F.round(F.col("rms_db") * 100).alias("rms_cdb"), F.round(F.col("gain_db") * 100).alias("gain_cdb"))


@query("SELECT doc_id, CAST(greatest(5, least(95, CASE source WHEN 'src0' THEN 85 WHEN 'src1' THEN 75 WHEN 'src2' THEN 45 ELSE 60 END - CASE WHEN n_chars > 24000 THEN 5 ELSE 0 END - CASE WHEN n_chars < 500 THEN 15 ELSE 0 END - CASE WHEN n_chars > 50000 THEN 10 ELSE 0 END)) AS INTEGER) AS confidence FROM documents")
def confidence_rule(spark, d):
    kind = F.when(F.col("source") == "src0", "captions").when(F.col("source") == "src1", "mixed").when(F.col("source") == "src2", "metadata").otherwise("other")
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", aggregates.confidence(kind, n, n > 24000, n > 50000).alias("confidence"))


@query("SELECT doc_id, sum(length(text))::BIGINT AS n_chars, max(end_ms) - min(start_ms) AS span_ms FROM seg GROUP BY doc_id", SEG)
def speaking_rate(spark, d):
    return aggregates.speaking_rate(segments(spark, d))


@query("SELECT doc_id, line, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS kinds FROM (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) >= 2)) WHERE kinds >= 2", LINES)
def recurring_lines(spark, d):
    return aggregates.recurring_names(lines(spark, d), 2, 2)


@query("SELECT doc_id, array_to_string(list(concat(speaker, ':', length(trim(text))) ORDER BY seg_idx), '|') AS turns FROM seg WHERE trim(text) <> '' GROUP BY doc_id", SEG)
def turn_lists(spark, d):
    t = aggregates.collect_turns(segments(spark, d))
    return t.select("doc_id", F.array_join(F.transform("turns", lambda x: F.concat(x["speaker"], F.lit(":"), F.length(x["text"]))), "|").alias("turns"))


@query("SELECT doc_id, speaker, bucket, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, speaker ORDER BY seg_idx, bucket) AS INTEGER) AS rank FROM (SELECT doc_id, speaker, bucket, substr(trim(text), 1, 80) AS h, min(seg_idx) AS seg_idx FROM (SELECT *, CASE WHEN contains(l, 'rep') OR contains(l, 'deal') OR contains(l, 'sales') OR contains(l, 'pipeline') OR contains(l, 'enterprise') OR contains(l, 'account') OR contains(l, 'quota') OR contains(l, 'outbound') THEN 'sales' END AS bucket FROM (SELECT *, lower(text) AS l FROM seg)) WHERE bucket IS NOT NULL GROUP BY ALL)) WHERE rank <= 8", SEG)
def role_evidence(spark, d):
    return joins.role_evidence(segments(spark, d), ["sales"]).select("doc_id", "speaker", "bucket", "rank")
