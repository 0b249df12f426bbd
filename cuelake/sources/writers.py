"""Caption sinks: segments in, one text for each document out, in every format that has a reader and some more.

A renderer gives ``doc_id, value``; ``write`` stores them as text files with Spark's own writer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import clock

CJK = ("zh", "ja", "ko")


def joined(segs: DataFrame, line: Column, between: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """Lines of a document in order, in one text."""
    rows = segs.select("doc_id", F.struct("start_ms", "seg_idx", line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), between)
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), text, F.lit(tail)).alias("value"))


def best_track(segs: DataFrame) -> DataFrame:
    """Of several tracks of a document the first of alignments, supervisions, transcription."""
    rank = F.when(F.col("track") == "alignments", 0).when(F.col("track") == "supervisions", 1).otherwise(2)
    return segs.withColumn("rank", rank).withColumn("best", F.min("rank").over(W.partitionBy("doc_id"))).where("rank = best").drop("rank", "best")


def spoken(segs: DataFrame) -> Column:
    """The text, behind its speaker if it has one."""
    if "speaker" not in segs.columns:
        return F.col("text")
    return F.concat(F.coalesce(F.concat(F.nullif(F.col("speaker"), F.lit("")), F.lit(": ")), F.lit("")), F.col("text"))


def numbered(segs: DataFrame) -> DataFrame:
    return segs.withColumn("number", F.row_number().over(W.partitionBy("doc_id").orderBy("start_ms", "seg_idx")))


def times(mark: str) -> Column:
    return F.concat(clock.hms_ms(F.col("start_ms"), mark), F.lit(" --> "), clock.hms_ms(F.col("end_ms"), mark))


def srt(segs: DataFrame) -> DataFrame:
    return joined(numbered(segs), F.concat(F.col("number").cast("string"), F.lit("\n"), times(","), F.lit("\n"), spoken(segs), F.lit("\n")))


def vtt(segs: DataFrame) -> DataFrame:
    return joined(segs, F.concat(times("."), F.lit("\n"), spoken(segs), F.lit("\n")), head="WEBVTT\n\n")


def sbv(segs: DataFrame) -> DataFrame:
    at = F.concat(clock.hms_ms(F.col("start_ms"), "."), F.lit(","), clock.hms_ms(F.col("end_ms"), "."))
    return joined(segs, F.concat(at, F.lit("\n"), spoken(segs), F.lit("\n")))


def sub(segs: DataFrame, fps: int = 25) -> DataFrame:
    frame = lambda c: F.floor((F.col(c) * fps + 999) / 1000)
    return joined(segs, F.concat(F.lit("{"), frame("start_ms"), F.lit("}{"), frame("end_ms"), F.lit("}"), F.replace(spoken(segs), F.lit("\n"), F.lit("|"))))


def lrc(segs: DataFrame) -> DataFrame:
    ms = F.col("start_ms")
    at = F.format_string("[%02d:%02d.%02d]", F.floor(ms / 60000), F.pmod(F.floor(ms / 1000), F.lit(60)), F.floor(F.pmod(ms, F.lit(1000)) / 10))
    return joined(segs, F.concat(at, spoken(segs)))


def ass_time(c: Column) -> Column:
    s = F.floor(c / 1000)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.floor(F.pmod(c, F.lit(1000)) / 10))


ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour\nStyle: Default,Arial,48,&H00FFFFFF\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def ass(segs: DataFrame) -> DataFrame:
    name = F.coalesce("speaker", F.lit("")) if "speaker" in segs.columns else F.lit("")
    return joined(segs, F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,"), name, F.lit(",0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N"))), head=ASS_HEAD)


def karaoke(segs: DataFrame) -> DataFrame:
    """ASS with a fill tag of hundredths of a second before each word."""
    tags = F.array_join(F.transform("words", lambda w: F.concat(F.lit("{\\kf"), F.floor((w["end_ms"] - w["start_ms"]) / 10), F.lit("}"), w["symbol"])), " ")
    return ass(segs.withColumn("text", F.when(F.size("words") > 0, tags).otherwise(F.col("text"))))


def separated(segs: DataFrame, mark: str, seconds: bool = False) -> DataFrame:
    number = (lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.pmod(F.col(c), F.lit(1000)))) if seconds else (lambda c: F.col(c).cast("string"))
    clean = F.replace(F.replace(spoken(segs), F.lit("\n"), F.lit(" ")), F.lit(mark), F.lit(" " if mark == "\t" else ";"))
    return joined(segs, F.concat(number("start_ms"), F.lit(mark), number("end_ms"), F.lit(mark), clean), head="" if seconds else f"start{mark}end{mark}text\n")


def json(segs: DataFrame) -> DataFrame:
    speaker = [F.col("speaker")] if "speaker" in segs.columns else []
    item = F.to_json(F.struct(F.col("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), *speaker))
    return joined(segs, item, ",\n", "[\n", "\n]\n")


def markdown(segs: DataFrame) -> DataFrame:
    """``**Speaker:** text [HH:MM:SS]``; no speaker if it is empty or Unknown."""
    name = F.when(F.coalesce("speaker", F.lit("")).isin("", "Unknown"), "").otherwise(F.concat(F.lit("**"), "speaker", F.lit(":** "))) if "speaker" in segs.columns else F.lit("")
    return joined(segs, F.concat(name, F.trim("text"), F.lit(" ["), clock.hms(F.floor(F.col("start_ms") / 1000)), F.lit("]")), "\n\n")


def reading_text(segs: DataFrame) -> DataFrame:
    """``[MM:SS] [Speaker] text``; parts that a document lacks throughout are left out."""
    doc = W.partitionBy("doc_id")
    rows = segs.withColumn("any_speaker", F.max(F.col("speaker").isNotNull().cast("int")).over(doc)).withColumn("any_time", F.max((F.col("end_ms") > 0).cast("int")).over(doc))
    time = F.when(F.col("any_time") == 1, clock.short(F.col("start_ms")))
    name = F.when((F.col("any_speaker") == 1) & F.col("speaker").isNotNull(), F.concat(F.lit("["), "speaker", F.lit("]")))
    return joined(rows, F.concat_ws(" ", time, name, F.col("text")))


def textgrid(intervals: DataFrame) -> DataFrame:
    """A TextGrid for each document from ``doc_id, tier, start_ms, end_ms, label``."""
    sec = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.pmod(F.col(c), F.lit(1000)))
    part = F.concat(F.lit("            xmin = "), sec("start_ms"), F.lit("\n            xmax = "), sec("end_ms"), F.lit('\n            text = "'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"\n'))
    tiers = intervals.withColumn("part", part).groupBy("doc_id", "tier").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "part"))).alias("parts"), F.max("end_ms").alias("end_ms"))
    body = F.array_join(F.transform("parts", lambda p, i: F.concat(F.lit("        intervals ["), i + 1, F.lit("]:\n"), p["part"])), "")
    tier = F.concat(F.lit('        class = "IntervalTier"\n        name = "'), "tier", F.lit('"\n        xmin = 0\n        xmax = '), sec("end_ms"), F.lit("\n        intervals: size = "), F.size("parts"), F.lit("\n"), body)
    docs = tiers.withColumn("text", tier).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tier", "text"))).alias("tiers"), F.max("end_ms").alias("end_ms"))
    items = F.array_join(F.transform("tiers", lambda t, i: F.concat(F.lit("    item ["), i + 1, F.lit("]:\n"), t["text"])), "")
    return docs.select("doc_id", F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), sec("end_ms"), F.lit("\ntiers? <exists>\nsize = "), F.size("tiers"), F.lit("\nitem []:\n"), items).alias("value"))


def ttml(segs: DataFrame) -> DataFrame:
    escaped = F.replace(F.replace(F.replace(spoken(segs), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit('      <p begin="'), clock.hms_ms(F.col("start_ms"), "."), F.lit('" end="'), clock.hms_ms(F.col("end_ms"), "."), F.lit('">'), escaped, F.lit("</p>"))
    return joined(segs, line, head='<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml">\n  <body>\n    <div>\n', tail="\n    </div>\n  </body>\n</tt>\n")


RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "srt": srt, "vtt": vtt, "sbv": sbv, "sub": sub, "lrc": lrc, "ass": ass, "ssa": ass, "json": json, "md": markdown, "ttml": ttml,
    "tsv": lambda s: separated(s, "\t"), "csv": lambda s: separated(s, ","), "aud": lambda s: separated(s, "\t", True),
}


def write(segs: DataFrame, kind: str, path: str) -> None:
    """One text file row for each document below ``path``; tracks, if any, by precedence."""
    rows = best_track(segs) if "track" in segs.columns else segs
    RENDERERS[kind](rows).repartition("doc_id").write.partitionBy("doc_id").text(path)


def wrap_width(language: Column, width: int) -> Column:
    """Characters in a line: half as many in Chinese, Japanese and Korean."""
    return F.when(F.substring(F.lower(language), 1, 2).isin(*CJK), F.lit(width // 2)).otherwise(F.lit(width))


COLORS = 10


def speaker_colors(segs: DataFrame) -> DataFrame:
    """``color``: 0 to 9 by the order in which a document's speakers first appear."""
    first = segs.groupBy("doc_id", "speaker").agg(F.min(F.struct("start_ms", "seg_idx")).alias("first"))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("first"))
    return segs.join(first.select("doc_id", "speaker", F.pmod(order - 1, F.lit(COLORS)).alias("color")), ["doc_id", "speaker"], "left")


def one_word_each(segs: DataFrame) -> DataFrame:
    """A segment for each word."""
    w = segs.select("doc_id", "seg_idx", "speaker", F.posexplode("words").alias("word_idx", "w"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("seg_idx", "word_idx")) - 1
    return w.select("doc_id", number.alias("seg_idx"), F.col("w.start_ms").alias("start_ms"), F.col("w.end_ms").alias("end_ms"), F.col("w.symbol").alias("text"), "speaker")


def summary_markdown(summaries: DataFrame) -> DataFrame:
    """doc_id, value of summaries: title, overview, chapters with times and quotes, tags."""
    chapter = lambda c: F.concat(F.lit("## "), clock.short(c["start_ms"]), F.lit(" "), c["title"], F.lit("\n\n"), c["summary"], F.when(F.size(c["quotes"]) > 0, F.concat(F.lit("\n\n> "), F.array_join(c["quotes"], "\n> "))).otherwise(F.lit("")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join(F.transform("tags", F.lower), ", ")))
    head = F.concat(F.lit('---\ntitle: "'), F.replace("title", F.lit('"'), F.lit('\\"')), F.lit('"\n---'))
    return summaries.select("doc_id", F.concat_ws("\n\n", head, F.nullif("overview", F.lit("")), F.array_join(F.transform("chapters", chapter), "\n\n"), tags).alias("value"))
