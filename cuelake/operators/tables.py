"""Page parsers as table functions for SQL.

    tables.register(spark)
    SELECT p.page_id, l.line_no, l.line FROM pages p, LATERAL page_lines(p.html) l
    SELECT * FROM timed_turns(TABLE(lines) PARTITION BY doc_id ORDER BY line_no)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from cuelake.operators import page_grammar, pages

TIMED, HEADING = re.compile(page_grammar.TIMED), re.compile(page_grammar.HEADING)
ENDED, MENU = re.compile(page_grammar.ENDED), re.compile(page_grammar.MENU)


@udtf(returnType="line_no int, line string")
class PageLines:
    """The lines of an HTML page; a null page has one empty line."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from enumerate(pages.lines_of(html))


@udtf(returnType="doc_id bigint, line_no int, speaker string, start_ms bigint, text string")
class TimedTurns:
    """Turns of timed lines of one page, given its lines (doc_id, line_no, line) in order.

    A turn is held until its end is known, so a page of any length takes the room of a turn.  Titles of
    contents aren't known here: only headings begin chapters.
    """

    def __init__(self) -> None:
        self.turn: tuple | None = None
        self.open = False

    def done(self) -> Iterator[tuple]:
        if self.turn:
            doc, line_no, speaker, ms, said = self.turn
            yield doc, line_no, speaker, ms, " ".join(x for x in said if x)
        self.turn, self.open = None, False

    def eval(self, row: Row) -> Iterator[tuple]:
        line = row["line"] or ""
        heading, hit = HEADING.match(line), TIMED.match(line)
        if hit and not heading:
            yield from self.done()
            ms = 0
            for part in hit[2].split(":"):
                ms = ms * 60 + int(part)
            self.turn, self.open = (row["doc_id"], row["line_no"], hit[1], ms * 1000, [hit[3].strip(" ")]), True
        elif self.open and not MENU.match(line):
            if ENDED.match(line) or heading:
                self.open = False
            elif len(line) > 10:
                self.turn[4].append(line.strip(" "))

    def terminate(self) -> Iterator[tuple]:
        yield from self.done()


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_lines", PageLines)
    spark.udtf.register("timed_turns", TimedTurns)
