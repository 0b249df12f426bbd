"""Queries over text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import clock, text as T
from cuelake.functions.languages import find_language
from cuelake.operators import joins

from .inputs import LINES, SEG, lines, segments, table
from .registry import query

NORMALIZE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^<>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '’', ''''), '‘', ''''), '\\s+', ' ', 'g'))"
MATCH = "trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
TOKEN_SQL = T.TOKEN.replace("'", "''")


@query(f"SELECT page_id, md5({NORMALIZE.format('html')}) AS norm_md5, length({NORMALIZE.format('html')}) AS n_chars FROM pages")
def text_normalize(spark, d):
    n = T.normalize(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("n_chars"))


@query(f"SELECT doc_id, md5({MATCH.format('text')}) AS norm_md5 FROM documents")
def match_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.match_normalize(F.col("text"))).alias("norm_md5"))


@query(
    """SELECT conv_id, turn, array_to_string(list_distinct_ordered, '|') AS match_keys FROM (
 SELECT conv_id, turn, list_filter(ks, lambda k, i: k IS NOT NULL AND list_position(ks, k) = i) AS list_distinct_ordered FROM (
 SELECT conv_id, turn, [CASE WHEN len(w) >= 8 THEN array_to_string(w[1:8], ' ') END, CASE WHEN len(w) >= 5 THEN array_to_string(w[1:5], ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[1:3], ' ') END,
  CASE WHEN length(n) >= 20 THEN substr(n, 1, 20) END, CASE WHEN length(n) >= 12 THEN substr(n, 1, 12) END, CASE WHEN length(n) >= 6 THEN substr(n, 1, 6) END] AS ks FROM (
 SELECT conv_id, turn, n, string_split(n, ' ') AS w FROM (SELECT conv_id, turn, """
    + MATCH.format("text")
    + " AS n FROM conversations))))"
)
def match_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.match_keys(T.match_normalize(F.col("text"))), "|").alias("match_keys"))


@query(f"SELECT conv_id, turn, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '{TOKEN_SQL}', 1), lambda x: NOT regexp_full_match(x, '\\s+')) AS t FROM conversations)")
def tokenize_multilingual(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, "|")).alias("tokens_md5"))


@query()
def attach_punctuation(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text"), keep_spaces=True).alias("t"))
    return rows.select("conv_id", "turn", F.filter(T.attach_punctuation(F.col("t")), lambda x: ~x.rlike(r"^\s+$")).alias("words"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_SQL}', 1)) AS token FROM documents) WHERE NOT regexp_full_match(token, '\\s+') GROUP BY token ORDER BY n DESC, token LIMIT 50")
def token_topk(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(f"SELECT DISTINCT word FROM (SELECT lower(unnest(regexp_extract_all(text, '{TOKEN_SQL}', 1))) AS word FROM documents) WHERE regexp_matches(word, '^[\\p{{L}}]+') AND length(word) <= 40 AND word NOT IN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{TOKEN_SQL}', 1))) FROM benchmark)")
def oov_words(spark, d):
    words = lambda name: table(spark, d, name).select(F.explode(T.tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("word"))
    return joins.unknown_words(words("documents").where(F.col("word").rlike(r"^[\p{L}]+")), words("benchmark"))


@query(f"SELECT doc_id, seg_idx, starts_with(trim(text), '[') AND ends_with(trim(text), ']') AS is_marker, right(rtrim(text), 1) IN ({', '.join(repr(c) if c != chr(39) else chr(39) * 4 for c in T.END_PUNCTUATION)}) AS ends_sentence FROM seg", SEG)
def sentence_end_flag(spark, d):
    return segments(spark, d).select("doc_id", "seg_idx", T.is_event_marker(F.col("text")).alias("is_marker"), T.ends_sentence(F.col("text")).alias("ends_sentence"))


@query("SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: regexp_full_match(w, '[\\[(]?\\d{1,2}:\\d{2}(:\\d{2})?([.,]\\d{1,3})?[\\])]?'))) > 0) AS n_timed FROM lines GROUP BY doc_id", LINES)
def contamination_flag(spark, d):
    timed = T.has_timestamp_word(F.col("line"))
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(timed).alias("n_timed"))


@query("SELECT event_id, s, format('{:02d}:{:02d}:{:02d}', s // 3600, (s // 60) % 60, s % 60) AS hms FROM (SELECT event_id, (event_id * 7919) % 90000 AS s FROM events)")
def hms_format(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") * 7919) % 90000).alias("s"))
    return e.select("event_id", "s", clock.hms(F.col("s")).alias("hms"))


@query("SELECT event_id, (event_id * 7919) % 90000 AS seconds FROM events")
def hms_parse(spark, d):
    return hms_format(spark, d).select("event_id", clock.seconds_of(F.col("hms")).alias("seconds"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN format('[{:d}:{:02d}:{:02d}]', s // 3600, (s // 60) % 60, s % 60) ELSE format('[{:02d}:{:02d}]', s // 60, s % 60) END AS mark FROM (SELECT event_id, (event_id * 7919) % 9000 AS s FROM events)")
def heading_time(spark, d):
    return table(spark, d, "events").select("event_id", clock.short((F.col("event_id") * 7919) % 9000 * 1000 + 999).alias("mark"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]{1,8})$', 1)), '') AS extension FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), T.extension(u).alias("extension"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:youtube\\.com/watch\\?v=|youtu\\.be/|youtube\\.com/shorts/)([a-zA-Z0-9_-]{11})', 1), ''), nullif(regexp_extract(u, 'youtube\\.com/embed/([a-zA-Z0-9_-]{11})', 1), ''), 'youtube_media') AS video_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', lpad(CAST(page_id AS VARCHAR), 11, 'a')) WHEN 1 THEN concat('https://youtu.be/', lpad(CAST(page_id AS VARCHAR), 11, 'b'), '?t=3') WHEN 2 THEN concat('https://youtube.com/embed/', lpad(CAST(page_id AS VARCHAR), 11, '-')) ELSE url END AS u FROM pages)")
def url_video_id(spark, d):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    u = F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(n, 11, "a"))).when(kind == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(n, 11, "b"), F.lit("?t=3"))).when(kind == 2, F.concat(F.lit("https://youtube.com/embed/"), F.lpad(n, 11, "-"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.video_id(u).alias("video_id"))


@query("SELECT page_id, length(html) >= 100 AND (contains(html, 'NET::ERR_CERT') OR contains(html, 'Your connection is not private')) AS hijacked FROM pages")
def hijacked_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.is_hijacked(F.col("html")).alias("hijacked"))


@query("SELECT doc_id, sections >= 2 AS is_lyrics, sections AS n_sections FROM (SELECT doc_id, count(DISTINCT s) AS sections FROM (SELECT doc_id, lower(unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END)) AS s FROM (SELECT doc_id, regexp_extract_all(CASE doc_id % 3 WHEN 0 THEN concat('[Verse 1] ', text, ' [Chorus]') ELSE text END, '(?i)\\[\\s*((?:pre[-\\s]?|post[-\\s]?)?(?:verse|chorus|hook|bridge|outro|intro|refrain|interlude|instrumental|coda|drop|breakdown|reprise))\\b[^\\]]*\\]', 1) AS x FROM seg)) GROUP BY doc_id)", SEG)
def lyrics_flag(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[Verse 1] "), "text", F.lit(" [Chorus]"))).otherwise(F.col("text"))
    s = segments(spark, d).select("doc_id", F.explode_outer(T.song_sections(text)).alias("s"))
    n = s.groupBy("doc_id").agg(F.count_distinct("s").alias("n_sections"))
    return n.select("doc_id", (F.col("n_sections") >= 2).alias("is_lyrics"), "n_sections")


@query("SELECT lang, CASE lang WHEN 'en' THEN 'en' WHEN 'deutsch' THEN 'de' WHEN 'French' THEN 'fr' WHEN 'español' THEN 'es' END AS language_code, count(*) AS n FROM (SELECT CASE lang WHEN 'de' THEN 'deutsch' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'español' ELSE lang END AS lang FROM documents) GROUP BY lang")
def language_lookup(spark, d):
    named = F.when(F.col("lang") == "de", "deutsch").when(F.col("lang") == "fr", "French").when(F.col("lang") == "es", "español").otherwise(F.col("lang"))
    counts = table(spark, d, "documents").groupBy(named.alias("lang")).agg(F.count("*").alias("n"))
    return find_language(counts, "lang", spark).select("lang", "language_code", "n")


@query("SELECT doc_id, CASE WHEN n_chars < 13000 THEN 'short' WHEN n_chars < 60000 THEN 'medium' ELSE 'long' END AS length_kind FROM documents")
def auto_length(spark, d):
    return table(spark, d, "documents").select("doc_id", T.auto_length(F.col("n_chars")).alias("length_kind"))


@query("SELECT event_id, least(greatest((event_id % 20000) * 1000 // 6, 30000), 1800000) AS timeout_ms FROM events")
def timeout_clamp(spark, d):
    return table(spark, d, "events").select("event_id", T.timeout_ms(F.col("event_id") % 20000).alias("timeout_ms"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair_parse(spark, d):
    broken = F.concat(F.lit("<think>so</think>Here: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" ok"))
    e = table(spark, d, "events").select("event_id", T.json_payload(broken).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'en' END AS language, trim(text) AS plain FROM conversations")
def asr_tags(spark, d):
    tagged = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<|en|> "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.asr_tag(tagged).alias("t")).select("conv_id", "turn", "t.language", F.col("t.text").alias("plain"))


@query("SELECT s_suppkey, n, CASE s_suppkey % 5 WHEN 0 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS is_person FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Ada van Dorn' WHEN 1 THEN 'Dorn Capital' WHEN 2 THEN '张三' WHEN 3 THEN 'we are here' ELSE 'Ada Dorn and Bo Lee' END AS n FROM supplier)")
def person_names(spark, d):
    k = F.col("s_suppkey") % 5
    n = F.when(k == 0, "Ada van Dorn").when(k == 1, "Dorn Capital").when(k == 2, "张三").when(k == 3, "we are here").otherwise("Ada Dorn and Bo Lee")
    return table(spark, d, "supplier").select("s_suppkey", n.alias("n")).select("s_suppkey", "n", T.looks_like_person(F.col("n")).alias("is_person"))


@query("SELECT p_partkey, r, CASE p_partkey % 4 WHEN 0 THEN 'engineering' WHEN 1 THEN 'engineering' WHEN 2 THEN 'design' END AS bucket FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Head of Engineering' WHEN 1 THEN 'VP, infrastructure' WHEN 2 THEN 'Lead of user experience' ELSE 'Chair' END AS r FROM part)")
def role_bucket(spark, d):
    k = F.col("p_partkey") % 4
    r = F.when(k == 0, "Head of Engineering").when(k == 1, "VP, infrastructure").when(k == 2, "Lead of user experience").otherwise("Chair")
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r", T.role_bucket(F.col("r")).alias("bucket"))


@query("SELECT page_id, concat('https://host.example/', page_id) AS transcript_url FROM pages WHERE page_id % 3 < 2")
def transcript_links(spark, d):
    link = F.concat(F.lit("https://host.example/"), "page_id")
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("About\n*Transcript:*\n\n"), link)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Show Notes: "), link)).otherwise(F.lit("Subscribe\nTranscript by hand"))
    p = table(spark, d, "pages").select("page_id", T.transcript_url(F.split(text, "\n")).alias("transcript_url"))
    return p.where("transcript_url is not null")


@query("SELECT c_custkey, CASE WHEN q <= 320 THEN CAST(q AS VARCHAR) ELSE 'best' END AS audio, CASE WHEN q <= 320 THEN 'best' ELSE CAST(q AS VARCHAR) END AS video, CASE c_custkey % 4 WHEN 0 THEN 1440 WHEN 1 THEN 30 WHEN 2 THEN 2400 END AS limit_s FROM (SELECT c_custkey, (c_custkey * 37) % 1080 AS q FROM customer)")
def quality_choices(spark, d):
    c = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 37) % 1080).cast("string").alias("q"))
    k = F.col("c_custkey") % 4
    model = F.when(k == 0, "nvidia/parakeet-tdt").when(k == 1, "Whisper-large").when(k == 2, "mistral/Voxtral").otherwise("own")
    return c.select("c_custkey", T.audio_quality(F.col("q")).alias("audio"), T.video_quality(F.col("q")).alias("video"), T.audio_limit(model).alias("limit_s"))
