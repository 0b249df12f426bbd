"""Captions of editors: Final Cut's and Premiere's XML, Avid's caption text, and SAMI.

Times of editors are frames of a rational rate or fractions of a second; all of it is integer arithmetic, rounded to the
nearest frame or millisecond, so a time on a frame survives any number of round trips.  XML is taken element by element with
``from_xml``, after the elements were cut out of the file's text.

Input cases: an element without a start gives no segment, one without an end ends where it starts; entities and
line breaks in texts are resolved, and a line break reads as a space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.sources import captions, writers


@dataclass(frozen=True)
class Rate:
    """Frames a second as a fraction; ``drop`` counts timecodes with dropped numbers (30000/1001 only)."""

    frames: int
    seconds: int
    drop: bool = False

    @property
    def base(self) -> int:
        """Frame numbers of a second of timecode."""
        return -(-self.frames // self.seconds)


NTSC, NTSC_DROP, PAL, FILM = Rate(30000, 1001), Rate(30000, 1001, True), Rate(25, 1), Rate(24000, 1001)
#: Frame numbers that drop-frame timecode leaves out each minute but the tenth, and frames of ten minutes and of one.
DROPPED, TEN_MINUTES, MINUTE = 2, 17_982, 1798


def nearest(top: Column, bottom: int | Column) -> Column:
    """top / bottom as the nearest whole number, halves up."""
    bottom = F.lit(bottom) if isinstance(bottom, int) else bottom
    return F.call_function("div", 2 * top + bottom, 2 * bottom)


def frames_of(ms: Column, rate: Rate) -> Column:
    return nearest(ms.cast("long") * rate.frames, 1000 * rate.seconds)


def ms_of(frames: Column, rate: Rate) -> Column:
    return nearest(frames.cast("long") * (1000 * rate.seconds), rate.frames)


def timecode(frames: Column, rate: Rate) -> Column:
    """HH:MM:SS:FF, with a semicolon before the frames where numbers are dropped."""
    whole = lambda a, b: F.call_function("div", a, F.lit(b))
    if rate.drop:
        rest = F.pmod(frames, F.lit(TEN_MINUTES))
        frames = frames + 9 * DROPPED * whole(frames, TEN_MINUTES) + F.when(rest >= DROPPED, DROPPED * whole(rest - DROPPED, MINUTE)).otherwise(0)
    s = whole(frames, rate.base)
    shape = "%02d:%02d:%02d;%02d" if rate.drop else "%02d:%02d:%02d:%02d"
    return F.format_string(shape, whole(s, 3600), F.pmod(whole(s, 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(frames, F.lit(rate.base)))


def frames_of_timecode(text: Column, rate: Rate) -> Column:
    """Frames of HH:MM:SS:FF; a semicolon before the frames says that numbers are dropped, whatever the rate says."""
    part = F.transform(F.split(text, "[:;]"), lambda x: x.cast("long"))
    minutes = part[0] * 60 + part[1]
    plain = (minutes * 60 + part[2]) * rate.base + part[3]
    dropped = plain - DROPPED * (minutes - F.call_function("div", minutes, F.lit(10)))
    return F.when(text.contains(";"), dropped).otherwise(plain)


def fraction(frames: Column, rate: Rate) -> Column:
    """Seconds as a fraction, in the way of ``1001/30000s``."""
    return F.concat((frames * rate.seconds).cast("string"), F.lit(f"/{rate.frames}s"))


def parts_of_fraction(text: Column) -> tuple[Column, Column]:
    """Top and bottom of ``1001/30000s``, ``5s`` or ``0.5s`` (in thousandths); null for anything else."""
    number = lambda k: F.regexp_extract(text, r"^(\d+)/(\d+)s$", k).try_cast("long")
    plain = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)s$", 1).try_cast("decimal(18,6)")
    bottom = F.nullif(number(2), F.lit(0))
    return F.when(bottom.isNotNull(), number(1)).otherwise(F.round(plain * 1000).cast("long")), F.when(bottom.isNotNull(), bottom).when(plain.isNotNull(), 1000)


def ms_of_fraction(text: Column) -> Column:
    top, bottom = parts_of_fraction(text)
    return nearest(top * 1000, bottom)


def ms_of_sum(a: Column, b: Column) -> Column:
    """Milliseconds of two fractions together, rounded once."""
    (top, bottom), (more, under) = parts_of_fraction(a), parts_of_fraction(b)
    return nearest((top * under + more * bottom) * 1000, bottom * under)


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))


def _elements(files: DataFrame, tag: str, shape: str) -> DataFrame:
    """path, value, pos, x: the elements of a file, parsed."""
    found = F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))
    return files.select("path", "value", F.posexplode(found).alias("pos", "element")).withColumn("x", F.from_xml("element", shape, {"ignoreSurroundingSpaces": "false"}))


def fcpxml(files: DataFrame) -> DataFrame:
    """Titles of Final Cut's XML."""
    rows = _elements(files, "title", "_offset STRING, _duration STRING, text STRUCT<`text-style`: ARRAY<STRUCT<_VALUE: STRING, _ref: STRING>>>")
    start = ms_of_fraction(F.col("x._offset"))
    raw = _one_line(F.array_join(F.transform(F.col("x.text.text-style"), lambda t: t["_VALUE"]), ""))
    rows = rows.select("path", "pos", start.alias("start_ms"), F.coalesce(ms_of_sum(F.col("x._offset"), F.col("x._duration")), start).alias("end_ms"), F.coalesce(raw, F.lit("")).alias("raw"))
    return captions._finish(rows.where("start_ms is not null"))


def premiere(files: DataFrame) -> DataFrame:
    """Generator items of Premiere's XML, in frames of the first rate that the file names."""
    rows = _elements(files, "generatoritem", "start BIGINT, end BIGINT, name STRING")
    base = F.coalesce(F.regexp_extract("value", r"<timebase>\s*(\d+)\s*</timebase>", 1).try_cast("long"), F.lit(25))
    ntsc = F.regexp_extract("value", r"(?i)<ntsc>\s*(\w+)\s*</ntsc>", 1)
    seconds = F.when(F.upper(ntsc) == "TRUE", 1001).otherwise(1000)
    ms = lambda c: nearest(F.col(c) * seconds, base)
    rows = rows.select("path", "pos", ms("x.start").alias("start_ms"), ms("x.end").alias("end_ms"), F.coalesce(_one_line(F.col("x.name")), F.lit("")).alias("raw"))
    return captions._finish(rows.where("start_ms is not null").withColumn("end_ms", F.greatest("start_ms", F.coalesce("end_ms", "start_ms"))))


TIMECODE = r"\d{2}:\d{2}:\d{2}[:;]\d{2}"


def avid(files: DataFrame, rate: Rate = PAL) -> DataFrame:
    """Avid's caption text; the file doesn't tell its rate."""
    body = F.regexp_extract("value", r"(?s)<begin subtitles>(.*?)(?:<end subtitles>|\z)", 1)
    block = files.select("path", F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("pos", "block"))
    head = rf"^\s*({TIMECODE})\s+({TIMECODE})[ \t]*\n?"
    block = block.where(F.col("block").rlike(head))
    ms = lambda k: ms_of(frames_of_timecode(F.regexp_extract("block", head, k), rate), rate)
    return captions._finish(block.select("path", "pos", ms(1).alias("start_ms"), ms(2).alias("end_ms"), _one_line(F.regexp_replace("block", head, "")).alias("raw")))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def sami(files: DataFrame) -> DataFrame:
    """SAMI: a text holds until the next SYNC; a blank one only ends the one before, and the last lasts four seconds if nothing ends it."""
    sync = F.regexp_extract_all("value", F.lit(r"(?si)<sync\s[^>]*?start\s*=\s*\"?\d+.*?(?=<sync\s|</body>|\z)"), F.lit(0))
    rows = files.select("path", F.posexplode(sync).alias("pos", "block"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("block", r"\s*\n\s*", " "), r"(?i)<br\s*/?>", " "), r"<[^>]*>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    rows = rows.select("path", "pos", F.regexp_extract("block", r"(?si)start\s*=\s*\"?(\d+)", 1).cast("long").alias("start_ms"), F.trim(text).alias("raw"))
    following = F.lead("start_ms").over(W.partitionBy("path").orderBy("start_ms", "pos"))
    return captions._finish(rows.withColumn("end_ms", F.coalesce(following, F.col("start_ms") + 4000)).where("raw <> ''"))


def as_fcpxml(segs: DataFrame, rate: Rate = NTSC) -> DataFrame:
    start, end = frames_of(F.col("start_ms"), rate), frames_of(F.col("end_ms"), rate)
    line = F.concat(
        F.lit('        <title offset="'), fraction(start, rate), F.lit('" duration="'), fraction(end - start, rate), F.lit('" ref="r2" lane="1"><text><text-style ref="ts1">'),
        escaped(writers.spoken(segs)), F.lit("</text-style></text></title>"),
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE fcpxml>\n<fcpxml version="1.9">\n  <resources>\n    <format id="r1" frameDuration="{rate.seconds}/{rate.frames}s"/>\n  </resources>\n  <project>\n    <sequence format="r1">\n      <spine>\n'
    return writers.joined(segs, line, head=head, tail="\n      </spine>\n    </sequence>\n  </project>\n</fcpxml>\n")


def as_premiere(segs: DataFrame, rate: Rate = NTSC) -> DataFrame:
    frame = lambda c: frames_of(F.col(c), rate).cast("string")
    line = F.concat(F.lit("        <generatoritem><name>"), escaped(writers.spoken(segs)), F.lit("</name><start>"), frame("start_ms"), F.lit("</start><end>"), frame("end_ms"), F.lit("</end></generatoritem>"))
    ntsc = "TRUE" if rate.seconds == 1001 else "FALSE"
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE xmeml>\n<xmeml version="4">\n  <sequence>\n    <rate><timebase>{rate.base}</timebase><ntsc>{ntsc}</ntsc></rate>\n    <media><video><track>\n'
    return writers.joined(segs, line, head=head, tail="\n    </track></video></media>\n  </sequence>\n</xmeml>\n")


def as_avid(segs: DataFrame, rate: Rate = PAL) -> DataFrame:
    at = lambda c: timecode(frames_of(F.col(c), rate), rate)
    text = F.regexp_replace(writers.spoken(segs), r"\n[ \t]*(?=\n)", "")
    line = F.concat(at("start_ms"), F.lit(" "), at("end_ms"), F.lit("\n"), text, F.lit("\n"))
    return writers.joined(segs, line, head="@ This file written with the Avid Caption plugin, version 1\n\n<begin subtitles>\n\n", tail="\n<end subtitles>\n")


def as_sami(segs: DataFrame) -> DataFrame:
    """A blank SYNC stands where nothing is said until the next segment."""
    following = F.lead("start_ms").over(W.partitionBy("doc_id").orderBy("start_ms", "seg_idx"))
    rows = segs.withColumn("following", following)
    said = F.replace(escaped(writers.spoken(segs)), F.lit("\n"), F.lit("<br>"))
    sync = lambda c, x: F.concat(F.lit("<SYNC Start="), F.col(c).cast("string"), F.lit("><P Class=CC>"), x)
    blank = F.when(F.col("following").isNull() | (F.col("following") > F.col("end_ms")), F.concat(F.lit("\n"), sync("end_ms", F.lit("&nbsp;")))).otherwise("")
    return writers.joined(rows, F.concat(sync("start_ms", said), blank), head="<SAMI>\n<BODY>\n", tail="\n</BODY>\n</SAMI>\n")


captions.READERS |= {"smi": sami, "sami": sami, "fcpxml": fcpxml, "xml": premiere, "avid": avid}
writers.RENDERERS |= {"smi": as_sami, "sami": as_sami, "fcpxml": as_fcpxml, "xml": as_premiere, "avid": as_avid}
