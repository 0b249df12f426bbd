"""Transcript pages by a grammar with modes, all of it windows over the page's lines.

Lines are drawn together to blocks and taken apart again within one partitioning by page.  Each line and block learns what it
would be under every strategy; counts over the page then decide which strategy holds, and only its rows are put together.

The modes of a page with timed lines are preamble, contents, turn, chapter and ended.  Contents begin at their heading and end
with the first line that is no entry; a line that repeats an entry's title is a chapter.  A turn ends with the next timed line, a chapter or a
line of the page's furniture; what follows such a line, or a chapter, up to the next timed line belongs to no turn.

Input cases: null lines are empty.  A page without lines, or with less text than a transcript, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import clock

from .partitions import spread

# Patterns of lines and blocks.
TIMED = r"^(.+?)\s+[(\[](\d{1,2}:\d{2}:\d{2})[)\]]:?\s*(.*)"
ENTRY = r"^(\d{1,2}:\d{2}(?::\d{2})?)\s*[–—-]\s*(.+)"
HEADING = r"^#{1,6}\s+(.+?)(?:\s+[(\[](\d{1,2}:\d{2}:\d{2})[)\]])?\s*$"
CONTENTS = r"(?i)^(table of contents|here are the)"
SKIPPED = r"^(Skip to|Go back to|Watch the full|Useful links|Please note that the transcript|Here are some useful links)"
MENU = r"^(Skip to|Go back|Watch the|Useful links|Table of Contents)"
ENDED = (
    r"^(\d+\s*Likes?|Discussion|Comments|Restacks?|Subscribe|Ready for|Share|Reply|Like$|©|Privacy|Terms|Start your|Substack"
    r"|Show Topics|See all|\d{1,2}月\d{1,2}日)"
)
NOISE = (
    r"^(\d+\s*Likes?\s*(∙|·)?\s*\d*\s*Restacks?|Discussion about this|Comments?\s*Restacks?|Ready for more\?|Share$|Reply$|Like$|Subscribe$"
    r"|©\s*\d{4}|Privacy\s*∙\s*Terms|Start your Substack|Get the app$|Show Topics$|See all$|Sign in$|Click on any sentence in the transcript"
    r"|\d{1,2}月\d{1,2}日$|OK: \d+ bytes)"
)
INLINE_NOISE = (
    r"\s*(?:There aren't comments yet.*|Click on any sentence in the transcript.*|DO NOT SELL OR SHARE MY PERSONAL INFORMATION.*"
    r"|What is this\?.*Report Ad.*|OK: \d+ bytes.*)$"
)
ARTICLE = r"^## Transcript(\n|$)"
ARTICLE_CHAPTER = r"^###?\s+(\d{1,2}:\d{2}:\d{2})\s*[-–—]?\s*(.*)"
ARTICLE_SPEAKER = r"^\*\*([^*]+)\*\*(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$"
ARTICLE_END = r"^(####?\s+Discussion|CommentsRestacks|\d+\s*Likes?\s*(∙|·|\[)|Like\s*(\(\d+\))?\s*Reply)"
LONG_TIME, BLOCK_TIME = r"^\d{1,2}:\d{2}:\d{2}$", r"^\d{1,2}:\d{2}(?::\d{2})?$"
NO_SPEAKER = r"^(#|\[|!|http|---|\d)"
SPEAKER_NUMBER = r"^SPEAKER\s*\d+$"
NAMED = r"^([A-Z][a-zA-ZÀ-ɏ'.\-]+(?: [A-Z][a-zA-ZÀ-ɏ'.\-]+){0,3}):\s+(.+)"
NAME_ALONE = r"^[A-Z][a-zA-ZÀ-ɏ'\-]+(?: [A-Z][a-zA-ZÀ-ɏ'\-]+){0,3}$"
STARTS = r"^Starting point is (\d{1,2}:\d{2}:\d{2})\s*(.*)"
# Not a fixed value: bold speakers under headings with a time, as this library's own sink writes them.
BOLD, TIME_HEADING = r"^\*\*(.+?):?\*\*:?\s*(.*)$", r"^#{2,3}\s*\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*(.*)$"

#: Strategies in order, with the turns and speakers that each needs.
NEEDS = [("timed", 1, 0), ("article", 5, 0), ("blocks", 3, 0), ("named", 10, 2), ("recurring", 10, 2), ("started", 3, 0), ("headed", 5, 0)]
#: A page without a strategy is one turn if it has more characters than this.
LEAST_CHARS = 200
#: Characters of lines in a partition, and what a line counts for beside its own: all marks of a line take some 100 times as much in the windows.
PARTITION_CHARS, LINE_CHARS = 4 << 20, 100


def page():
    return W.partitionBy("doc_id")


def in_order():
    return page().orderBy("line_no")


def so_far():
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def before():
    return in_order().rowsBetween(W.unboundedPreceding, -1)


def group(pattern: str, n: int, column: str = "line") -> Column:
    return F.regexp_extract(column, pattern, n)


def running(flag: Column, over=None) -> Column:
    return F.coalesce(F.sum(flag.cast("int")).over(over or so_far()), F.lit(0))


def last_of(value: Column, over=None) -> Column:
    return F.last(value, ignorenulls=True).over(over or so_far())


def blocks_of(lines: DataFrame) -> DataFrame:
    """A row for each block (lines up to the next blank one): doc_id, place, line_no, block, lines with the blank ones behind."""
    rows = lines.select("doc_id", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    blank = F.trim("line") == ""
    edge = ~blank & F.coalesce(F.lag(blank).over(in_order()), F.lit(True))
    rows = rows.withColumn("place", F.sum(edge.cast("int")).over(so_far()))
    kept = rows.groupBy("doc_id", "place").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return kept.select("doc_id", "place", F.col("lines")[0]["line_no"].alias("line_no"), F.when(text != "", text).alias("block"), "lines")


def article_marks(b: DataFrame) -> DataFrame:
    """``a_turn``, ``a_speaker``, ``a_ms``: paragraphs below ``## Transcript``, with times spread over each chapter by its characters."""
    opened = running(F.col("block").rlike(ARTICLE), before()) > 0
    chapter, speaker = F.col("block").rlike(ARTICLE_CHAPTER), F.col("block").rlike(ARTICLE_SPEAKER)
    short = (F.length("block") < 15) | (F.col("block").startswith("[") & F.col("block").endswith(")") & (F.length("block") < 200))
    other = F.col("block").isNotNull() & ~chapter & ~speaker & ~short
    heading = F.col("block").startswith("#")
    end = other & (F.col("block").rlike(ARTICLE_END) | (~heading & F.col("block").rlike(NOISE)))
    b = b.withColumn("a_open", opened).withColumn("a_ended", running(F.coalesce(F.col("a_open") & end, F.lit(False))) > 0)
    b = b.withColumn("a_turn", F.coalesce(F.col("a_open") & ~F.col("a_ended") & other & ~heading, F.lit(False)))
    b = b.withColumn("a_speaker", F.coalesce(last_of(F.when(F.col("a_open") & speaker, group(ARTICLE_SPEAKER, 1, "block"))), F.lit("Unknown")))
    b = b.withColumn("a_start", F.coalesce(last_of(F.when(F.col("a_open") & chapter, clock.seconds_of(group(ARTICLE_CHAPTER, 1, "block")))), F.lit(0).cast("long")))
    # Chapters are runs of turns with one time.
    start = F.when(F.col("a_turn"), F.col("a_start"))
    b = b.withColumn("a_new", F.col("a_turn") & F.coalesce(last_of(start, before()) != F.col("a_start"), F.lit(True)))
    b = b.withColumn("a_chapter", running(F.col("a_new")))
    within = W.partitionBy("doc_id", "a_chapter")
    chars = F.when(F.col("a_turn"), F.length("block")).otherwise(0).cast("long")
    b = b.withColumn("a_total", F.sum(chars).over(within)).withColumn("a_before", F.coalesce(F.sum(chars).over(within.orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    later = in_order().rowsBetween(1, W.unboundedFollowing)
    b = b.withColumn("a_next", F.first(F.when(F.col("a_new"), F.col("a_start")), ignorenulls=True).over(later))
    # In the last chapter: characters per second of the chapters before.
    b = b.withColumn("a_last", F.max("a_chapter").over(page())).withColumn("a_first_s", F.min(start).over(page()))
    known = F.coalesce(F.sum(F.when(F.col("a_chapter") < F.col("a_last"), chars)).over(page()), F.lit(0).cast("long"))
    b = b.withColumn("a_known", known).withColumn("a_known_s", F.max(F.when(F.col("a_new") & (F.col("a_chapter") == F.col("a_last")), F.col("a_start"))).over(page()) - F.col("a_first_s"))
    last = F.when((F.col("a_known") > 0) & (F.col("a_known_s") > 0), F.expr("a_before * a_known_s div nullif(a_known, 0)")).otherwise(F.expr("a_before * 600 div nullif(a_total, 0)"))
    inner = F.expr("a_before * (a_next - a_start)") / F.expr("nullif(a_total, 0)")
    spread = F.when(F.col("a_chapter") == F.col("a_last"), last).otherwise(F.floor(inner))
    return b.withColumn("a_ms", (F.col("a_start") + spread) * 1000)


def block_marks(b: DataFrame) -> DataFrame:
    """``b_turn``, ``b_speaker``, ``b_hms``, ``b_said``: blocks of speaker, time, text, or of time, number of the speaker (may be missing), text.

    Blocks are taken from the top: what one turn has used starts no other.
    """
    b = b.withColumn("b1", F.lead("block").over(in_order())).withColumn("b2", F.lead("block", 2).over(in_order()))
    named = F.col("b1").rlike(LONG_TIME) & (F.length("block") < 80) & ~F.col("block").rlike(NO_SPEAKER)
    time = F.col("block").rlike(BLOCK_TIME)
    numbered = time & F.col("b1").rlike(SPEAKER_NUMBER)
    plain = time & ~numbered & (F.length("b1") > 20) & ~F.col("b1").rlike(r"^\d{1,2}:\d{2}")
    kind = F.when(F.col("b2").isNull(), None).when(named, "named").when(numbered, "numbered").when(plain, "plain")
    b = b.withColumn("b_kind", kind).withColumn("b_end", F.col("place") + F.when(F.col("b_kind") == "plain", 2).otherwise(3))
    # What a candidate takes from the blocks behind it is put down here: the windows below carry no text of other blocks.
    b = b.withColumn("b_own", F.when(F.col("b_kind") == "named", F.col("block")).when(F.col("b_kind") == "numbered", F.col("b1")))
    b = b.withColumn("b_hms", F.when(F.col("b_kind") == "named", F.col("b1")).when(F.col("b_kind").isNotNull(), F.col("block")))
    b = b.withColumn("b_said", F.when(F.col("b_kind") == "plain", F.col("b1")).when(F.col("b_kind").isNotNull(), F.col("b2"))).drop("b1", "b2")
    end = F.when(F.col("b_kind").isNotNull(), F.col("b_end"))
    # Only candidates that reach into one another have to be judged in turn.
    alone = F.col("b_kind").isNotNull() & F.coalesce(F.max(end).over(before()) <= F.col("place"), F.lit(True))
    b = b.withColumn("island", running(alone))
    rivals = F.sort_array(F.collect_list(F.when(F.col("b_kind").isNotNull(), F.struct("place", "b_end"))).over(W.partitionBy("doc_id", "island")))
    none = F.struct(F.lit(0).cast("bigint").alias("free"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda s, x: F.when(x["place"] >= s["free"], F.struct(x["b_end"].cast("bigint").alias("free"), F.concat(s["taken"], F.array(x["place"].cast("bigint"))).alias("taken"))).otherwise(s)
    b = b.withColumn("taken", F.aggregate(rivals, none, take)["taken"])
    b = b.withColumn("b_turn", F.coalesce(F.col("b_kind").isNotNull() & F.array_contains("taken", F.col("place").cast("bigint")), F.lit(False))).drop("taken")
    return b.withColumn("b_speaker", F.coalesce(last_of(F.when(F.col("b_turn"), F.col("b_own"))), F.lit("Unknown"))).drop("b_own")


def timed_modes(rows: DataFrame) -> DataFrame:
    """``t_mode``: preamble, contents, chapter, turn, more (of the turn) or null; ``t_run`` numbers the turns; ``t_title``."""
    heading, entry, start = F.col("line").rlike(HEADING), F.col("s").rlike(ENTRY), F.col("s").rlike(CONTENTS)
    rows = rows.withColumn("hit", F.col("line").rlike(TIMED) & ~heading)
    rows = rows.withColumn("t_run", running(F.col("hit"))).withColumn("t_toc", running(start & (F.col("t_run") == 0)))
    listed = entry & (F.col("t_toc") > 0) & (F.col("t_run") == 0)
    rows = rows.withColumn("t_listed", running(listed, before()))
    left = (F.col("s") != "") & ~entry & ~start & (F.col("t_toc") > 0) & (F.col("t_listed") > 0)
    rows = rows.withColumn("t_left", F.max(left.cast("int")).over(W.partitionBy("doc_id", "t_toc").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) > 0)
    inside = (F.col("t_toc") > 0) & ~F.col("t_left") & (F.col("t_run") == 0)
    rows = rows.withColumn("t_entry", inside & entry)
    rows = rows.withColumn("titles", F.collect_set(F.when(F.col("t_entry"), F.trim(group(ENTRY, 2, "s")))).over(page()))
    rows = rows.withColumn("t_titled", (F.col("s") != "") & F.array_contains("titles", F.col("s")))
    chapter = F.col("t_titled") | heading
    end = F.col("line").rlike(ENDED)
    menu = F.col("line").rlike(MENU)
    event = F.when(~F.col("hit") & ~menu & end, "ended").when(~F.col("hit") & ~menu & chapter, "chapter")
    # The first such line of a turn decides about all lines up to the next turn.
    turn = W.partitionBy("doc_id", "t_run").orderBy("line_no")
    rows = rows.withColumn("event", event).withColumn("t_after", F.first("event", ignorenulls=True).over(turn.rowsBetween(W.unboundedPreceding, -1)))
    said = (F.length("line") > 10) & ~menu
    early = F.when(inside & entry, "contents").when(inside | start | (F.col("s") == "") | F.col("s").rlike(SKIPPED), None).when(chapter, "chapter").when(F.length("s") > 20, "preamble")
    late = F.when(F.col("hit"), "turn").when(F.col("t_after").isNotNull(), F.when((F.col("t_after") == "chapter") & (F.col("event") == "chapter") & heading, "chapter"))
    late = late.when(F.col("event") == "chapter", "chapter").when(F.col("event").isNull() & said, "more")
    title = F.when(heading, group(HEADING, 1)).when(F.col("t_entry"), F.trim(group(ENTRY, 2, "s"))).otherwise(F.col("s"))
    rows = rows.withColumn("t_mode", F.when(F.col("t_run") == 0, early).otherwise(late)).drop("titles")
    return rows.withColumn("t_title", F.when(F.col("t_mode").isin("chapter", "contents"), title))


def recurring_marks(rows: DataFrame) -> DataFrame:
    """``r_kind``: chapter or turn; ``r_speaker``, ``r_hms``: paragraphs under names that stand alone three times or more, two names at least."""
    alone = F.col("s").rlike(NAME_ALONE) & (F.length("s") < 30)
    rows = rows.withColumn("r_name", alone & (F.count("*").over(W.partitionBy("doc_id", "s")) >= 3))
    rows = rows.withColumn("r_names", F.size(F.collect_set(F.when(F.col("r_name"), F.col("s"))).over(page())))
    rows = rows.withColumn("r_start", F.coalesce(F.max(F.when(F.col("s") == "Transcript", F.col("line_no"))).over(page()), F.lit(-1)))
    chapter = F.col("s").rlike(ENTRY)
    began = F.col("line_no") > F.col("r_start")
    stop = began & ~chapter & ~F.col("r_name") & F.col("s").rlike(NOISE)
    rows = rows.withColumn("r_on", began & (running(stop) == 0))
    rows = rows.withColumn("r_speaker", last_of(F.when(F.col("r_on") & F.col("r_name") & ~chapter, F.col("s"))))
    rows = rows.withColumn("r_hms", last_of(F.when(F.col("r_on") & chapter, group(ENTRY, 1, "s"))))
    turn = ~F.col("r_name") & (F.length("s") >= 20) & F.col("r_speaker").isNotNull()
    return rows.withColumn("r_kind", F.when(F.col("r_on") & chapter, "chapter").when(F.col("r_on") & turn, "turn"))


def parse(lines: DataFrame) -> DataFrame:
    """doc_id, strategy, line_no, kind, speaker, start_ms, text of each page.

    ``lines``: doc_id, line_no, line.  ``kind`` is preamble, contents, chapter or turn.  ``start_ms`` is null where the page tells no time.
    """
    lines = spread(lines, "doc_id", F.coalesce(F.length("line"), F.lit(0)) + LINE_CHARS, PARTITION_CHARS)
    b = block_marks(article_marks(blocks_of(lines)))
    marks = {"a_turn": "a_turn", "a_speaker": "a_turn", "a_ms": "a_turn", "block": "a_turn", "b_turn": "b_turn", "b_speaker": "b_turn", "b_hms": "b_turn", "b_said": "b_turn"}
    rows = b.select("doc_id", F.posexplode("lines").alias("k", "x"), *marks)
    # A block's marks and text stand at its first line, and there only if it is a turn: else each line would carry the whole block.
    shown = [F.when((F.col("k") == 0) & F.col(flag), F.col(c)).alias(c) for c, flag in marks.items()]
    rows = rows.select("doc_id", "x.line_no", "x.line", F.trim("x.line").alias("s"), *shown)
    rows = recurring_marks(timed_modes(rows))
    rows = rows.withColumn("named", F.col("line").rlike(NAMED)).withColumn("starts", F.col("line").rlike(STARTS)).withColumn("bold", F.col("line").rlike(BOLD))
    rows = rows.withColumn("s_run", running(F.col("starts"))).withColumn("h_run", running(F.col("bold")))
    count = lambda flag: F.sum(flag.cast("int")).over(page())
    kinds = lambda value: F.size(F.collect_set(value).over(page()))
    found = {
        "timed": (count(F.col("hit") | F.coalesce((F.col("t_mode") == "chapter") & F.col("t_titled"), F.lit(False))), F.lit(0)),
        "article": (count(F.col("a_turn")), F.lit(0)),
        "blocks": (count(F.col("b_turn")), F.lit(0)),
        "named": (count(F.col("named")), kinds(F.when(F.col("named"), group(NAMED, 1)))),
        "recurring": (count(F.col("r_kind").isNotNull()), F.col("r_names")),
        "started": (count(F.col("starts")), F.lit(0)),
        "headed": (count(F.col("bold")), F.lit(0)),
    }
    chosen = F.coalesce(*[F.when((F.coalesce(found[name][0], F.lit(0)) >= turns) & (found[name][1] >= speakers), name) for name, turns, speakers in NEEDS], F.lit("whole"))
    rows = rows.withColumn("strategy", chosen).withColumn("chars", F.sum(F.length("line") + 1).over(page()) - 1)

    seconds = lambda hms: clock.seconds_of(F.when(hms != "", hms)) * 1000
    none, text = F.lit(None), F.regexp_replace("block", r"\s*\n\s*", " ")
    heading_ms = last_of(F.when(F.col("line").rlike(TIME_HEADING), group(TIME_HEADING, 1)))
    # For each strategy: kind, rows of one run (null: a row alone), speaker, time, words.
    t_said = F.when(F.col("hit"), F.trim(group(TIMED, 3))).when(F.col("t_mode").isin("chapter", "contents"), F.col("t_title")).otherwise(F.col("s"))
    t_time = F.when(F.col("hit"), group(TIMED, 2)).when(F.col("t_mode") == "contents", group(ENTRY, 1, "s")).when(F.col("t_mode") == "chapter", group(HEADING, 2))
    r_said = F.when(F.col("r_kind") == "chapter", F.trim(group(ENTRY, 2, "s"))).otherwise(F.col("s"))
    as_turn = lambda flag: F.when(flag, "turn")
    forms = {
        "timed": (F.when(F.col("t_mode") == "more", "turn").otherwise(F.col("t_mode")), F.when(F.col("t_mode").isin("turn", "more"), F.col("t_run")), F.when(F.col("hit"), group(TIMED, 1)), seconds(t_time), t_said),
        "article": (as_turn(F.col("a_turn")), none, F.col("a_speaker"), F.col("a_ms"), text),
        "blocks": (as_turn(F.col("b_turn")), none, F.col("b_speaker"), seconds(F.col("b_hms")), F.regexp_replace("b_said", r"\s*\n\s*", " ")),
        "named": (as_turn(F.col("named")), none, group(NAMED, 1), none, F.trim(group(NAMED, 2))),
        "recurring": (F.col("r_kind"), none, F.when(F.col("r_kind") == "turn", F.col("r_speaker")), F.coalesce(seconds(F.col("r_hms")), F.lit(0)), r_said),
        "started": (as_turn(F.col("s_run") > 0), F.col("s_run"), none, F.when(F.col("starts"), seconds(group(STARTS, 1))), F.when(F.col("starts"), F.trim(group(STARTS, 2))).otherwise(F.col("s"))),
        "headed": (as_turn((F.col("h_run") > 0) & ~F.col("line").rlike(TIME_HEADING)), F.col("h_run"), F.when(F.col("bold"), group(BOLD, 1)), F.when(F.col("bold"), seconds(heading_ms)), F.when(F.col("bold"), group(BOLD, 2)).otherwise(F.col("s"))),
        "whole": (as_turn(F.col("chars") > LEAST_CHARS), F.lit(0), none, none, F.col("line")),
    }
    pick = lambda at, kind: F.coalesce(*[F.when(F.col("strategy") == name, form[at].cast(kind)) for name, form in forms.items()])
    columns = [pick(at, kind).alias(c) for at, (c, kind) in enumerate((("kind", "string"), ("run", "long"), ("speaker", "string"), ("start_ms", "long"), ("said", "string")))]
    out = rows.select("doc_id", "line_no", "strategy", *columns).where("kind is not null")
    # Rows of a run share its number; a row alone has its own, below zero.
    out = out.withColumn("run", F.coalesce("run", -1 - F.col("line_no").cast("long")))
    words = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "said", "speaker", "start_ms"))), lambda x: x)
    turns = out.groupBy("doc_id", "strategy", "kind", "run").agg(words.alias("x"))
    joined = F.when(F.col("strategy") == "whole", F.array_join(F.transform("x", lambda x: x["said"]), "\n")).otherwise(F.array_join(F.filter(F.transform("x", lambda x: x["said"]), lambda s: s != ""), " "))
    first = F.col("x")[0]
    turns = turns.select("doc_id", "strategy", first["line_no"].alias("line_no"), "kind", first["speaker"].alias("speaker"), first["start_ms"].alias("start_ms"), joined.alias("text"))
    # The page's furniture at the end of the last turn is cut off.
    last = F.row_number().over(page().orderBy(F.col("line_no").desc())) == 1
    turns = turns.withColumn("last", last).withColumn("text", F.when(F.col("last") & (F.col("strategy") != "whole"), F.regexp_replace("text", INLINE_NOISE, "")).otherwise(F.col("text")))
    return turns.where("strategy not in ('started', 'whole') or text <> ''").drop("last")


def markdown(parsed: DataFrame) -> DataFrame:
    """doc_id, markdown: the preamble, the contents, and the turns with their speakers and times; a whole text as it is."""
    time = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit(" ["), clock.hms(F.col("start_ms") / 1000), F.lit("]"))).otherwise("")
    known = F.col("speaker").isNotNull() & ~F.col("speaker").isin("", "Unknown")
    turn = F.concat(F.when(known, F.concat(F.lit("**"), "speaker", F.lit(":** "))).otherwise(""), "text", time)
    entry = F.concat(F.lit("- "), F.regexp_replace(clock.hms(F.col("start_ms") / 1000), "^0(?:0:0?)?", ""), F.lit(" – "), "text")
    line = F.when(F.col("kind") == "contents", entry).when(F.col("kind") == "chapter", F.concat(F.lit("## "), "text")).when(F.col("kind") == "turn", F.when(F.col("strategy") == "whole", F.col("text")).otherwise(turn)).otherwise(F.col("text"))
    of = lambda kinds, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isin(kinds), F.struct("line_no", "shown")))), lambda x: x["shown"]), sep)
    rows = parsed.withColumn("shown", line).groupBy("doc_id").agg(of(["preamble"], "\n").alias("p"), of(["contents"], "\n").alias("c"), of(["turn", "chapter"], "\n\n").alias("t"))
    parts = [F.when(F.col("p") != "", F.col("p")), F.when(F.col("c") != "", F.concat(F.lit("## Table of Contents\n"), "c")), F.when(F.col("t") != "", F.col("t"))]
    return rows.select("doc_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))
