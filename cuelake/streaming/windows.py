"""Streaming counterparts: windows with late data, sessions, chunked decoding with flushes.

Inputs are streaming DataFrames with an event time ``ts``; NTZ times must be cast to timestamps first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(rows: DataFrame, name: str = "ts") -> DataFrame:
    return rows.withColumn(name, F.col(name).cast("timestamp"))


def windowed_counts(rows: DataFrame, size: str, slide: str | None = None, late: str | None = "1 hour", *keys: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows, or overlapping ones with ``slide``; rows later than ``late`` are dropped by a stream."""
    timed = event_time(rows)
    timed = timed.withWatermark("ts", late) if late and rows.isStreaming else timed
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n")


def sessions(rows: DataFrame, gap: str, late: str | None = "1 hour", *keys: str) -> DataFrame:
    """Sessions that end after ``gap`` without a row."""
    timed = event_time(rows)
    timed = timed.withWatermark("ts", late) if late and rows.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n")


def distinct_events(rows: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """Rows without repeats of their keys within the watermark."""
    timed = event_time(rows)
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else timed.dropDuplicates(list(keys))


def flush_every(total_s: Column, chunk_s: int, asked: int | None = None) -> Column:
    """After how many chunks a decoder flushes: as asked (0: never), else about every 20 minutes on audio above 40 minutes in chunks of 5 or more."""
    if asked is not None:
        return F.lit(asked)
    return F.when((total_s > 2400) & F.lit(chunk_s >= 300), F.lit(1200 // chunk_s)).otherwise(F.lit(0))


DECODED = "doc_id bigint, flush_idx int, n_chunks int, score_sum bigint, complete boolean"
STATE = "chunks int, score bigint, flushes int"


def decode(rows: DataFrame, every: int, last: str = "is_last") -> DataFrame:
    """Per ``doc_id``, chunk scores (``chunk_idx, score``) summed with state across micro-batches; a row at each flush and at the end.

    ``every`` is the number of chunks between flushes, 0 for none; the row of the end is complete, the others aren't.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunks, score, flushes = state.get if state.exists else (0, 0, 0)
        out, ended = [], False
        rows_ = pd.concat(list(frames)).sort_values("chunk_idx")
        for value, final in zip(rows_.score, rows_[last]):
            chunks, score = chunks + 1, score + int(value)
            if final or every and chunks == every:
                out.append((key[0], flushes, chunks, score, bool(final)))
                chunks, score, flushes, ended = 0, 0, flushes + 1, ended or bool(final)
        if ended:
            state.remove()
        else:
            state.update((chunks, score, flushes))
        yield pd.DataFrame(out, columns=["doc_id", "flush_idx", "n_chunks", "score_sum", "complete"])

    return rows.groupBy("doc_id").applyInPandasWithState(step, DECODED, STATE, "append", GroupStateTimeout.NoTimeout)
