"""Caption sources: files in, segments out.

Every reader takes a DataFrame ``path, value`` of whole files (``read_files``) and gives
``path, seg_idx, start_ms, end_ms, text, speaker`` (JSON and word-tagged cues: ``words`` too).
Parsing is done with columns, so files are spread over the cluster and never come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cuelake.functions import clock

TIMES = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"
SPEAKER = r"^(?:\[([^\]:]+)\]:\s*|>>\s*([^:]{1,40}):\s*|([A-Z][A-Z0-9_ .'-]{0,39}):\s*)"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, value: whole text files, whichever file system holds them."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("value", F.replace(F.regexp_replace("value", "^﻿", ""), F.lit("\r\n"), F.lit("\n")))


def speaker_of(text: Column) -> tuple[Column, Column]:
    """(speaker or null, rest) of a cue that begins with a speaker."""
    name = F.coalesce(*(F.nullif(F.regexp_extract(text, SPEAKER, k), F.lit("")) for k in (1, 2, 3)))
    return F.trim(name), F.when(name.isNotNull(), F.regexp_replace(text, SPEAKER, "")).otherwise(text)


def _numbered(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("path").orderBy("pos")
    return rows.withColumn("seg_idx", F.row_number().over(w) - 1).drop("pos")


def _finish(rows: DataFrame) -> DataFrame:
    speaker, rest = speaker_of(F.col("raw"))
    return _numbered(rows.withColumn("speaker", speaker).withColumn("text", F.trim(rest))).select("path", "seg_idx", "start_ms", "end_ms", "text", "speaker")


def cues(files: DataFrame) -> DataFrame:
    """SRT and WebVTT: blocks between blank lines that hold a line of times."""
    block = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("pos", "block")).where(F.col("block").rlike(TIMES))
    body = F.regexp_replace(F.regexp_replace("block", rf"(?s)^.*?{TIMES}[^\n]*\n?", ""), r"<[^>]*>", "")
    return _finish(block.select("path", "pos", clock.ms_of(F.regexp_extract("block", TIMES, 1)).alias("start_ms"), clock.ms_of(F.regexp_extract("block", TIMES, 2)).alias("end_ms"), F.trim(F.regexp_replace(body, r"\s*\n\s*", " ")).alias("raw")))


def tagged_words(files: DataFrame) -> DataFrame:
    """path, seg_idx, word_idx, symbol, start_ms of cues with ``<time><c> word</c>`` tags."""
    block = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("pos", "block")).where(F.col("block").rlike(TIMES))
    tag = r"<((?:\d+:)?\d{1,2}:\d{2}\.\d{3})><c[^>]*>\s*([^<]*?)\s*</c>"
    pairs = F.arrays_zip(F.regexp_extract_all("block", F.lit(tag), F.lit(1)).alias("at"), F.regexp_extract_all("block", F.lit(tag), F.lit(2)).alias("word"))
    rows = _numbered(block.select("path", "pos", pairs.alias("pairs")))
    return rows.select("path", "seg_idx", F.posexplode("pairs").alias("word_idx", "p")).select("path", "seg_idx", "word_idx", F.col("p.word").alias("symbol"), clock.ms_of(F.col("p.at")).alias("start_ms"))


def sbv(files: DataFrame) -> DataFrame:
    """SubViewer: ``start,end`` lines over the text."""
    times = r"^(\d+:\d{2}:\d{2}\.\d{3}),(\d+:\d{2}:\d{2}\.\d{3})\n"
    block = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("pos", "block")).where(F.col("block").rlike(times))
    return _finish(block.select("path", "pos", clock.ms_of(F.regexp_extract("block", times, 1)).alias("start_ms"), clock.ms_of(F.regexp_extract("block", times, 2)).alias("end_ms"), F.trim(F.regexp_replace(F.regexp_replace("block", times, ""), r"\s*\n\s*", " ")).alias("raw")))


def sub(files: DataFrame, fps: float = 25.0) -> DataFrame:
    """MicroDVD: ``{first frame}{last frame}text``."""
    line = r"^\{(\d+)\}\{(\d+)\}(.*)$"
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").rlike(line))
    ms = lambda k: F.floor(F.regexp_extract("line", line, k).cast("long") * 1000 / fps)
    return _finish(rows.select("path", "pos", ms(1).alias("start_ms"), ms(2).alias("end_ms"), F.replace(F.regexp_extract("line", line, 3), F.lit("|"), F.lit(" ")).alias("raw")))


def ass(files: DataFrame) -> DataFrame:
    """ASS and SSA: ``Dialogue:`` lines; hundredths of a second; the name field is the speaker."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").startswith("Dialogue:"))
    part = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    text = F.trim(F.regexp_replace(F.regexp_replace(part.getItem(9), r"\{[^}]*\}", ""), r"\\[Nn]", " "))
    out = rows.select("path", "pos", clock.ms_of(F.trim(part.getItem(1))).alias("start_ms"), clock.ms_of(F.trim(part.getItem(2))).alias("end_ms"), text.alias("raw"), F.nullif(F.trim(part.getItem(4)), F.lit("")).alias("named"))
    speaker, rest = speaker_of(F.col("raw"))
    return _numbered(out.withColumn("speaker", F.coalesce("named", speaker)).withColumn("text", F.trim(rest))).select("path", "seg_idx", "start_ms", "end_ms", "text", "speaker")


def lrc(files: DataFrame) -> DataFrame:
    """Lyrics: ``[mm:ss.xx]text``; a line lasts until the next one, the last four seconds."""
    line = r"^\[(\d+:\d{2}(?:\.\d{1,3})?)\](.*)$"
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").rlike(line))
    at = rows.select("path", "pos", clock.ms_of(F.regexp_extract("line", line, 1)).alias("start_ms"), F.trim(F.regexp_replace(F.regexp_extract("line", line, 2), r"<[^>]*>", "")).alias("raw"))
    return _finish(at.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(W.partitionBy("path").orderBy("pos")), F.col("start_ms") + 4000)))


def separated(files: DataFrame, mark: str) -> DataFrame:
    """TSV and CSV with a head line: start, end (milliseconds), text and perhaps speaker; audacity labels: seconds without a head."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\d"))
    part = F.split("line", mark, 4)
    number = lambda c: F.when(c.contains("."), F.bround(c.cast("decimal(18,3)") * 1000).cast("long")).otherwise(c.cast("long"))
    out = rows.select("path", "pos", number(part.getItem(0)).alias("start_ms"), number(part.getItem(1)).alias("end_ms"), F.trim(F.regexp_replace(part.getItem(2), '^"|"$', "")).alias("raw"), F.try_element_at(part, F.lit(4)).alias("named"))
    speaker, rest = speaker_of(F.col("raw"))
    return _numbered(out.withColumn("speaker", F.coalesce(F.nullif(F.trim("named"), F.lit("")), speaker)).withColumn("text", F.trim(rest))).select("path", "seg_idx", "start_ms", "end_ms", "text", "speaker")


JSON = "array<struct<text: string, start: double, `end`: double, speaker: string, words: array<struct<word: string, start: double, `end`: double>>>>"


def json(files: DataFrame) -> DataFrame:
    """A JSON list of text, start, end (seconds), speaker and words."""
    rows = files.select("path", F.posexplode(F.from_json("value", JSON)).alias("seg_idx", "s"))
    ms = lambda c: F.bround(c * 1000).cast("long")
    words = F.transform("s.words", lambda w: F.struct(w["word"].alias("symbol"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms"), F.lit(None).cast("double").alias("score")))
    return rows.select("path", "seg_idx", ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), F.col("s.text").alias("text"), F.col("s.speaker").alias("speaker"), words.alias("words"))


def plain(files: DataFrame) -> DataFrame:
    """A text file: a segment for each line that isn't blank, without times."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "raw")).where(F.trim("raw") != "")
    return _finish(rows.withColumn("start_ms", F.lit(0).cast("long")).withColumn("end_ms", F.lit(0).cast("long")))


def markdown(files: DataFrame) -> DataFrame:
    """Transcripts ``**Speaker:** text [HH:MM:SS]``; a turn lasts until the next one."""
    line = r"^(?:\*\*(.+?):\*\*\s*)?(.*?)\s*\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*$"
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.col("line").rlike(line) & ~F.col("line").startswith("#"))
    out = rows.select("path", "pos", (clock.seconds_of(F.regexp_extract("line", line, 3)) * 1000).alias("start_ms"), F.regexp_extract("line", line, 2).alias("text"), F.nullif(F.regexp_extract("line", line, 1), F.lit("")).alias("speaker"))
    out = out.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(W.partitionBy("path").orderBy("pos")), F.col("start_ms")))
    return _numbered(out).select("path", "seg_idx", "start_ms", "end_ms", "text", "speaker")


def textgrid(files: DataFrame) -> DataFrame:
    """path, tier, start_ms, end_ms, label: the intervals of a TextGrid; empty labels are left out."""
    item = files.select("path", F.posexplode(F.split("value", r"\n\s*item \[\d+\]:")).alias("tier_no", "item")).where("tier_no > 0")
    named = item.select("path", F.regexp_extract("item", r'name = "([^"]*)"', 1).alias("tier"), F.explode(F.split("item", r"intervals \[\d+\]:")).alias("part"))
    number = lambda k: F.bround(F.regexp_extract("part", rf"{k} = ([0-9.]+)", 1).cast("decimal(18,4)") * 1000).cast("long")
    rows = named.where(F.col("part").rlike(r'text = "')).select("path", "tier", number("xmin").alias("start_ms"), number("xmax").alias("end_ms"), F.regexp_extract("part", r'text = "([^"]*)"', 1).alias("label"))
    return rows.where("label <> ''")


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "srt": cues, "vtt": cues, "sbv": sbv, "sub": sub, "ass": ass, "ssa": ass, "lrc": lrc, "txt": plain, "md": markdown, "gemini": markdown, "json": json,
    "tsv": lambda f: separated(f, "\t"), "csv": lambda f: separated(f, ","), "aud": lambda f: separated(f, "\t"),
}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Segments of the files at ``path``; the kind follows from the extension unless given."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {', '.join(READERS)}")
    return READERS[kind](read_files(spark, path))


def with_sidecars(segments: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments with the intervals of files of the same name but for the extension, as ``tiers``."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    side = intervals.groupBy(stem("path").alias("stem")).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "tier", "label"))).alias("tiers"))
    return segments.withColumn("stem", stem("path")).join(side, "stem", "left").drop("stem")


def glossary_markdown(files: DataFrame) -> DataFrame:
    """path, source, target: rows of a Markdown table behind its line of dashes."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("cell", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    w = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("table_", F.sum((~F.col("cell")).cast("int")).over(w)).where("cell")
    rule = F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")
    inside = W.partitionBy("path", "table_").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("behind", F.max(rule.cast("int")).over(inside) == 1).where(F.col("behind") & ~rule)
    part = F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|")
    return rows.where(F.size(part) >= 2).select("path", F.trim(part.getItem(0)).alias("source"), F.trim(part.getItem(1)).alias("target")).where("source <> '' and target <> ''")


def glossary_yaml(files: DataFrame) -> DataFrame:
    """path, source, target: ``key: value`` lines; comments and quotes are dropped."""
    rows = files.select("path", F.explode(F.split("value", "\n")).alias("line")).where(~F.trim("line").startswith("#") & F.col("line").contains(":"))
    strip = lambda c: F.regexp_replace(F.trim(c), r"^[\"']|[\"']$", "")
    return rows.select("path", strip(F.regexp_extract("line", r"^([^:]+):", 1)).alias("source"), strip(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("target")).where("source <> '' and target <> ''")


def page_metadata(files: DataFrame) -> DataFrame:
    """path, front map, body, chapters array<struct<start_ms, title>> of a page with front matter; chapters if there are two or more."""
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "")
    keys = F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_]+):\s*(.*)$"), F.lit(1))
    values = F.transform(F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_]+):\s*(.*)$"), F.lit(2)), lambda v: F.regexp_replace(v, r'^"|"$', ""))
    mark = r"(?m)^\s*(\d{1,2}:\d{2}(?::\d{2})?)\s+(?:[–—-]\s*)?(\S.*)$"
    marks = F.zip_with(F.regexp_extract_all("body", F.lit(mark), F.lit(1)), F.regexp_extract_all("body", F.lit(mark), F.lit(2)), lambda t, x: F.struct((clock.seconds_of(t) * 1000).alias("start_ms"), F.trim(x).alias("title")))
    out = files.select("path", F.map_from_arrays(keys, values).alias("front"), body.alias("body"))
    return out.withColumn("chapters", F.when(F.size(marks) >= 2, marks))


def existing_outputs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, stem, extension of files that are there already, derived ones left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("extension", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    return out.where(~F.lower("stem").rlike(r"[._-](karaoke|bilingual|diarized|aligned|transcript)$"))
