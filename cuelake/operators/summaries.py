"""Shapes of model answers: summaries, reviews, translations, prompts; and the videos' track lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import clock, text as T
from cuelake.operators import aggregates, chunks, joins, windows

SUMMARY = "title string, overview string, chapters array<struct<title: string, start: double, `end`: double, summary: string, quotes: array<string>>>, entities array<struct<name: string, type: string, description: string>>, tags array<string>, seo_title string, seo_description string, confidence struct<score: double, rationale: string>, metadata map<string, string>"


def summary_of(answer: Column, fallback_title: str = "Untitled") -> Column:
    """A summary with safe values for whatever the answer lacks; tags in lower case, chapter ends filled from the next start."""
    s = F.from_json(T.json_payload(answer), SUMMARY)
    text = lambda c: F.coalesce(c, F.lit(""))
    raw = F.coalesce(s["chapters"], F.array().cast("array<struct<title: string, start: double, end: double, summary: string, quotes: array<string>>>"))
    nth = lambda i: F.coalesce(F.try_element_at(raw, i + 2)["start"], F.lit(0.0))
    chapters = F.transform(raw, lambda c, i: F.struct(text(c["title"]).alias("title"), F.coalesce(c["start"], F.lit(0.0)).alias("start"), F.when(F.coalesce(c["end"], F.lit(0.0)) == 0, nth(i)).otherwise(c["end"]).alias("end"), text(c["summary"]).alias("summary"), F.coalesce(c["quotes"], F.array().cast("array<string>")).alias("quotes")))
    entities = F.coalesce(F.transform(s["entities"], lambda e: F.struct(text(e["name"]).alias("name"), text(e["type"]).alias("type"), text(e["description"]).alias("description"))), F.array().cast("array<struct<name: string, type: string, description: string>>"))
    tags = F.coalesce(F.transform(s["tags"], F.lower), F.array().cast("array<string>"))
    title = F.coalesce(F.nullif(s["title"], F.lit("")), F.lit(fallback_title))
    return F.struct(title.alias("title"), text(s["overview"]).alias("overview"), chapters.alias("chapters"), entities.alias("entities"), tags.alias("tags"), text(s["seo_title"]).alias("seo_title"), text(s["seo_description"]).alias("seo_description"), s["confidence"].alias("confidence"), s["metadata"].alias("metadata"))


def summary_json(s: Column) -> Column:
    """The summary as JSON: quotes only where there are any, confidence and metadata only where present."""
    chapters = F.transform(s["chapters"], lambda c: F.struct(c["title"].alias("title"), c["start"].alias("start"), c["end"].alias("end"), c["summary"].alias("summary"), F.when(F.size(c["quotes"]) > 0, c["quotes"]).alias("quotes")))
    metadata = F.when(F.size(s["metadata"]) > 0, s["metadata"])
    return F.to_json(F.struct(s["title"].alias("title"), s["overview"].alias("overview"), chapters.alias("chapters"), s["entities"].alias("entities"), s["tags"].alias("tags"), s["seo_title"].alias("seo_title"), s["seo_description"].alias("seo_description"), s["confidence"].alias("confidence"), metadata.alias("metadata")), {"ignoreNullFields": "true"})


def unwrap_list(answer: Column) -> Column:
    """The strings of an answer: a list, or the first list among the usual keys, or the answer alone."""
    j = T.json_payload(answer)
    lists = [F.from_json(j, "array<string>"), *(F.from_json(F.get_json_object(j, f"$.{k}"), "array<string>") for k in ("translations", "results", "data", "to_translate"))]
    whole = [F.when(j.startswith("["), lists[0]), *lists[1:]]
    return F.coalesce(*whole, F.array(j))


def review_of(answer: Column, drafts: Column) -> Column:
    """array<struct<revised, critique>>: a list of texts, or items with revised, translated or translation; gaps keep the draft."""
    j = T.json_payload(answer)
    plain = F.from_json(j, "array<string>")
    items = F.from_json(F.coalesce(F.get_json_object(j, "$.items"), j), "array<struct<revised: string, translated: string, translation: string, critique: string, reason: string>>")
    legacy = j.rlike(r'^\s*\[\s*(?:"|\])')
    full = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    from_items = F.transform(items, lambda x, i: F.struct(F.coalesce(full(x["revised"], x["translated"], x["translation"]), F.try_element_at(drafts, i + 1), F.lit("")).alias("revised"), F.coalesce(full(x["critique"], x["reason"]), F.lit("")).alias("critique")))
    return F.when(legacy, F.transform(plain, lambda x: F.struct(x.alias("revised"), F.lit("").alias("critique")))).otherwise(from_items)


def glossary_terms(analyses: DataFrame) -> DataFrame:
    """source, target of the terms in analyses (``terminology array<struct<source, translation>>``); the last of equal terms wins."""
    t = analyses.select("doc_id", F.posexplode("terminology").alias("pos", "t")).select("doc_id", "pos", F.trim("t.source").alias("source"), F.trim("t.translation").alias("target"))
    return t.where("source <> '' and target <> ''").groupBy("source").agg(F.max_by("target", F.struct("doc_id", "pos")).alias("target"))


def prompt(texts: Column, target: str, glossary: Column, before: Column, after: Column) -> Column:
    """A request to translate numbered texts, with terms and surroundings where there are any."""
    numbered = F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    terms = F.when(F.size(glossary) > 0, F.concat(F.lit("Use these terms:\n"), F.array_join(F.transform(F.map_entries(glossary), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")))
    around = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}:\n"), F.array_join(c, "\n")))
    return F.concat_ws("\n\n", F.lit(f"Translate each text to {target}. Answer with a JSON list of as many strings."), terms, around("Before", before), around("After", after), numbered)


def translate(segs: DataFrame, model: chunks.Model, target: str, reviewer: chunks.Model | None = None, size: int = 30) -> DataFrame:
    """Segments with ``translation`` and ``target_lang``: drafts in batches, then a review if there is a reviewer."""
    drafts = chunks.map_model(segs.select("doc_id", "seg_idx", "text"), model, "draft", size)
    if reviewer:
        drafts = chunks.review(drafts, reviewer).withColumn("draft", F.col("revised"))
    return chunks.apply_translations(segs, drafts.select("doc_id", "seg_idx", F.col("draft").alias("translation")), target)


def summarize(docs: DataFrame, mapper: chunks.Model, reducer: chunks.Model, locked: DataFrame | None = None, *, source: str = "captions", limit: int = 24_000) -> DataFrame:
    """doc_id, summary, confidence: texts above ``limit`` characters are mapped in chunks and reduced; locked chapters keep titles and times."""
    from cuelake.operators import sequential

    long = F.length("text") > limit
    parts = sequential.chunks(docs.where(long)).unionByName(docs.where(~long).select("doc_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk")))
    answers = chunks.map_reduce(parts, mapper, reducer)
    out = answers.withColumn("summary", summary_of(F.col("summary"))).join(docs.select("doc_id", F.length("text").alias("n_chars")), "doc_id")
    out = out.withColumn("confidence", aggregates.confidence(F.lit(source), F.col("n_chars"), F.col("n_chars") > limit, F.lit(False)))
    if locked is not None:
        model = out.select("doc_id", F.posexplode("summary.chapters").alias("ch_idx", "c")).select("doc_id", "ch_idx", F.bround(F.col("c.start") * 1000).cast("long").alias("start_ms"), F.col("c.summary").alias("summary"))
        kept = windows.fill_chapter_ends(joins.lock_chapters(locked, model))
        item = F.struct("ch_idx", "title", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "summary")
        lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("locked_chapters"))
        out = out.join(lists, "doc_id", "left")
    return out.drop("n_chars")


# Stored video metadata -------------------------------------------------------------------------------

VIDEO = "id string, title string, uploader string, subtitles map<string, array<struct<ext: string, url: string>>>, automatic_captions map<string, array<struct<ext: string, url: string>>>"


def caption_tracks(infos: DataFrame) -> DataFrame:
    """video_id, lang, kind, ext, url, ord of metadata JSON (``value``); manual tracks come before automatic ones."""
    v = infos.select(F.from_json("value", VIDEO).alias("v"))
    out = None
    for rank, (field, kind) in enumerate((("subtitles", "manual"), ("automatic_captions", "asr"))):
        t = v.select(F.col("v.id").alias("video_id"), F.explode(f"v.{field}").alias("lang", "formats")).select("video_id", "lang", F.posexplode("formats").alias("pos", "f"))
        t = t.select("video_id", "lang", F.lit(kind).alias("kind"), "f.ext", "f.url", (F.lit(1000 * rank) + F.col("pos")).alias("ord"))
        out = t if out is None else out.unionByName(t)
    return out


def pick_tracks(tracks: DataFrame, lang: str) -> DataFrame:
    """For each video its best format in a language, manual tracks first."""
    some = tracks.where((F.col("lang") == lang) | F.col("lang").startswith(lang + "-"))
    kind = F.min(F.when(F.col("kind") == "manual", 0).otherwise(1)).over(W.partitionBy("video_id"))
    some = some.withColumn("best_kind", kind).where((F.col("kind") == "manual") == (F.col("best_kind") == 0)).drop("best_kind")
    return aggregates.best_track(some, ("json3", "srv3", "vtt", "ttml", "srv2", "srv1"), "video_id")


def list_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("video_id", "lang", "kind").agg(F.array_sort(F.collect_set("ext")).alias("exts"))


def parent_channels(videos: DataFrame, links: DataFrame, most: int = 2) -> DataFrame:
    """video_id, channel of the first of at most ``most`` linked videos whose uploader is another."""
    rank = F.row_number().over(W.partitionBy("video_id").orderBy("pos"))
    some = links.withColumn("rank", rank).where(F.col("rank") <= most)
    own = videos.select("video_id", F.col("channel").alias("own"))
    other = videos.select(F.col("video_id").alias("linked_id"), "channel")
    met = some.join(other, "linked_id").join(own, "video_id").where("channel <> own")
    return met.groupBy("video_id").agg(F.min_by("channel", "rank").alias("channel"))


def audio_selector(track: Column, quality: Column) -> Column:
    """A download tool's selector for an audio track (null, original, a format id or a language) and quality."""
    q = T.audio_quality(quality)
    cap = F.when(q == "medium", "[abr<=160]").when(q == "low", "[abr<=70]").when(q.rlike(r"^\d+$"), F.concat(F.lit("[abr<="), (q.cast("int") + 20).cast("string"), F.lit("]"))).otherwise("")
    by = F.when(F.lower(track) == "original", "[format_id*=drc]").when(track.contains("-") | track.rlike(r"^\d+$"), F.concat(F.lit("[format_id="), track, F.lit("]"))).otherwise(F.concat(F.lit("[language^="), track, F.lit("]")))
    chosen = F.concat(F.lit("bestaudio"), by, cap, F.lit("/bestaudio"), cap, F.lit("/bestaudio/best"))
    return F.when(track.isNull(), F.concat(F.lit("bestaudio"), cap, F.lit("/bestaudio/best"))).otherwise(chosen)


def video_selector(audio: Column, quality: Column) -> Column:
    """A selector for video up to a height, with the first choice of the audio selector."""
    q, first = T.video_quality(quality), F.split_part(audio, F.lit("/"), F.lit(1))
    h = F.concat(F.lit("[height<="), q, F.lit("]"))
    tall = F.concat(F.lit("bestvideo"), h, F.lit("+"), first, F.lit("/bestvideo"), h, F.lit("+bestaudio/best"), h, F.lit("/best"))
    return F.when(q.rlike(r"^\d+$"), tall).otherwise(F.concat(F.lit("bestvideo*+"), first, F.lit("/bestvideo*+bestaudio/best")))


def flat_turns(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, speaker, start_ms, text of ``Name [H:MM:SS]:`` lines; a bare ``[H:MM:SS]`` starts a new turn of the same speaker."""
    named, bare = r"^(.+?)\s*\[(\d{1,2}:\d{2}:\d{2})\]\s*:?\s*$", r"^\s*\[(\d{1,2}:\d{2}:\d{2})\]\s*$"
    line = F.col("line")
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    is_bare = line.rlike(bare)
    is_named = line.rlike(named) & ~is_bare
    rows = lines.withColumn("mark", is_bare | is_named).withColumn("run", F.sum((is_bare | is_named).cast("int")).over(w))
    rows = rows.withColumn("speaker", F.coalesce(F.last(F.when(is_named, F.trim(F.regexp_extract(line, named, 1))), True).over(w), F.lit("")))
    rows = rows.withColumn("hms", F.last(F.when(is_named, F.regexp_extract(line, named, 2)).when(is_bare, F.regexp_extract(line, bare, 1)), True).over(w))
    said = rows.where(~F.col("mark") & (F.trim("line") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), lambda x: x["t"]), " ")
    return said.groupBy("doc_id", "run", "speaker", "hms").agg(F.min("line_no").alias("line_no"), text.alias("text")).select("doc_id", "line_no", "speaker", (clock.seconds_of(F.col("hms")) * 1000).alias("start_ms"), "text")
