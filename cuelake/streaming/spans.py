"""Spans and chunks with state that lives across micro-batches, is kept in order of event time, and ends by timers.

Both processors hold what arrives in list state until the watermark has passed it, so rows may come in any order within the
watermark's delay.  Rows behind the watermark are dropped.  Streams need the RocksDB state store:

    spark.conf.set(*spans.STATE_STORE)

``merged_spans`` and ``decoded_chunks`` give the same rows for a batch as for a stream of its rows that drops none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

SPAN = "doc_id bigint, start_ms bigint, end_ms bigint, n_rows int"
Span = tuple[int, int, int]  # start, end, rows


def drawn_together(rows: Iterable[tuple[int, int]], open_: Span | None, gap_ms: int, cap_ms: int) -> tuple[list[Span], Span | None]:
    """Closed spans, and the one that is still open, after rows in order of their starts.

    A row joins the open span if it begins at most ``gap_ms`` behind its end and the span stays within ``cap_ms``.
    """
    closed = []
    for start, end in rows:
        if open_ and start - open_[1] <= gap_ms and max(open_[1], end) - open_[0] <= cap_ms:
            open_ = open_[0], max(open_[1], end), open_[2] + 1
        else:
            closed += [open_] if open_ else []
            open_ = start, end, 1
    return closed, open_


def millis(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times, utc=True).astype("datetime64[ms, UTC]").astype("int64")


class SpanProcessor(StatefulProcessor):
    """Waiting rows in a list, the open span in a value; a timer closes a span that no row can join any more."""

    def __init__(self, gap_ms: int, cap_ms: int):
        self.gap_ms, self.cap_ms = gap_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "start_ms bigint, end_ms bigint")
        self.span = handle.getValueState("span", "start_ms bigint, end_ms bigint, n_rows int")

    def settled(self, key: tuple, rows: list[tuple[int, int]], now: int) -> Iterator[pd.DataFrame]:
        """Move all rows up to the watermark into spans, and emit the spans that are closed."""
        ready = sorted(r for r in rows if r[0] <= now)
        later = [r for r in rows if r[0] > now]
        open_ = tuple(self.span.get()) if self.span.exists() else None
        closed, open_ = drawn_together(ready, open_, self.gap_ms, self.cap_ms)
        if open_ and open_[1] + self.gap_ms < now:
            closed, open_ = [*closed, open_], None
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if open_:
            self.span.update(open_)
        elif self.span.exists():
            self.span.clear()
        due = min([r[0] for r in later] + ([open_[1] + self.gap_ms + 1] if open_ else []), default=None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(max(due, now + 1))
        if closed:
            yield pd.DataFrame([(key[0], *s) for s in closed], columns=["doc_id", "start_ms", "end_ms", "n_rows"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for pdf in rows:
            held += [(s, e) for s, e in zip(pdf.start_ms.tolist(), pdf.end_ms.tolist()) if s >= now]
        yield from self.settled(key, held, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self.settled(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def merged_spans(rows: DataFrame, gap_ms: int = 2000, cap_ms: int = 30_000, late: str = "1 minute") -> DataFrame:
    """doc_id, start_ms, end_ms, n_rows: detected spans drawn together over gaps of at most ``gap_ms``, none beyond ``cap_ms`` unless a row is.

    ``rows``: doc_id, start_ms, end_ms (whole milliseconds of event time).  A row without a start is left out; one without an end
    ends where it starts.  A key whose stream ends is closed by the next row of any key that is late enough.
    """
    timed = rows.where("start_ms is not null").select("doc_id", "start_ms", F.greatest("start_ms", F.coalesce("end_ms", "start_ms")).alias("end_ms"))
    if rows.isStreaming:
        timed = timed.withColumn("ts", F.timestamp_millis("start_ms")).withWatermark("ts", late)
        return timed.groupBy("doc_id").transformWithStateInPandas(SpanProcessor(gap_ms, cap_ms), SPAN, "Append", "EventTime")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        closed, open_ = drawn_together(sorted(zip(pdf.start_ms.tolist(), pdf.end_ms.tolist())), None, gap_ms, cap_ms)
        return pd.DataFrame([(key[0], *s) for s in [*closed, open_]], columns=["doc_id", "start_ms", "end_ms", "n_rows"])

    return timed.groupBy("doc_id").applyInPandas(whole, SPAN)


DECODED = "doc_id bigint, flush_idx int, n_chunks int, score_sum bigint, complete boolean"


#: Number of the next chunk of a document that has ended.
ENDED = -1


class ChunkProcessor(StatefulProcessor):
    """Chunks in the order of their numbers, whatever the order of arrival; what never ends is flushed incomplete after a silence."""

    def __init__(self, every: int, silence_ms: int):
        self.every, self.silence_ms = every, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk_idx int, score bigint, is_last boolean")
        self.sums = handle.getValueState("sums", "next int, flushes int, chunks int, score bigint")

    def taken(self, key: tuple, rows: list[tuple], over: bool) -> Iterator[pd.DataFrame]:
        """Take the chunks that follow one another; all of them when it is ``over``."""
        upcoming, flushes, chunks, score = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        out, left = [], []
        for idx, value, last in sorted(set(rows)):
            if upcoming == ENDED or idx < upcoming:
                continue
            if idx > upcoming and not over:
                left.append((idx, value, last))
                continue
            upcoming, chunks, score = ENDED if last else idx + 1, chunks + 1, score + value
            if last or self.every and chunks == self.every:
                out.append((key[0], flushes, chunks, score, last))
                flushes, chunks, score = flushes + 1, 0, 0
        if over and upcoming != ENDED and chunks:
            out.append((key[0], flushes, chunks, score, False))
        self.waiting.clear()
        if over:
            self.sums.clear()
        else:
            # An ended document is remembered for as long as a silence, so that repeated chunks don't begin it anew.
            self.sums.update((upcoming, flushes, chunks, score))
            if left and upcoming != ENDED:
                self.waiting.put(left)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "flush_idx", "n_chunks", "score_sum", "complete"])

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, held, newest = timerValues.getCurrentWatermarkInMs(), self.held(), 0
        for pdf in rows:
            held += list(zip(pdf.chunk_idx.tolist(), pdf.score.tolist(), pdf.is_last.tolist()))
            newest = max(newest, int(millis(pdf.ts).max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield from self.taken(key, held, False)
        self.handle.registerTimer(max(newest, now) + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self.taken(key, self.held(), True)

    def close(self) -> None:
        pass


def decoded_chunks(rows: DataFrame, every: int, silence_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """doc_id, flush_idx, n_chunks, score_sum, complete: scores of a document's chunks, a row at each flush and at the end.

    ``rows``: doc_id, chunk_idx (from 0), score, is_last, ts.  Repeated chunks count once.  A document without a last chunk is
    closed, incomplete, when ``silence_ms`` of event time have passed since its newest chunk.
    """
    cut = rows.select("doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.coalesce(F.col("score").cast("long"), F.lit(0)).alias("score"), F.coalesce("is_last", F.lit(False)).alias("is_last"), F.col("ts").cast("timestamp").alias("ts")).where("chunk_idx >= 0")
    if rows.isStreaming:
        return cut.withWatermark("ts", late).groupBy("doc_id").transformWithStateInPandas(ChunkProcessor(every, silence_ms), DECODED, "Append", "EventTime")
    # Of equal numbers one chunk counts; nothing behind the last chunk does.
    once = cut.groupBy("doc_id", "chunk_idx").agg(F.min(F.struct("score", "is_last")).alias("c")).select("doc_id", "chunk_idx", "c.*")
    ended = F.coalesce(F.max(F.col("is_last").cast("int")).over(W.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    once = once.withColumn("ended", ended).where("ended = 0")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_idx")) - 1
    flush = F.floor(place / every) if every else F.lit(0)
    parts = once.withColumn("flush_idx", flush.cast("int")).groupBy("doc_id", "flush_idx").agg(F.count("*").cast("int").alias("n_chunks"), F.sum("score").alias("score_sum"), F.max("is_last").alias("complete"))
    return parts.select(*[c.split()[0] for c in DECODED.split(", ")])


def late_rows(rows: DataFrame, delay_ms: int, arrival: str = "batch", ts: str = "ts") -> DataFrame:
    """``rows`` with ``late``: behind the watermark of a stream that takes the numbered batches one by one.

    A batch is judged by the watermark of the batches before: their newest event less ``delay_ms``, in whole milliseconds.
    """
    newest = rows.groupBy(arrival).agg(F.max(F.unix_millis(F.col(ts).cast("timestamp"))).alias("newest"))
    # A row for each batch, not for each event.
    mark = newest.select(F.col(arrival).alias("b"), (F.max("newest").over(W.orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)) - delay_ms).alias("mark"))
    met = rows.join(mark, F.col(arrival) == F.col("b")).drop("b")
    return met.withColumn("late", F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")) < F.col("mark"), F.lit(False))).drop("mark")
