"""Batch results of the stateful streams, over events."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from cuelake.streaming import spans

from .inputs import table
from .registry import query

HOUR = 3_600_000
SPANS = """r AS MATERIALIZED (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) * 60000 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events),
 m AS (SELECT user_id, k, s AS first, e AS last, 1 AS span FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, CASE WHEN joins THEN m.first ELSE r.s END, CASE WHEN joins THEN greatest(m.last, r.e) ELSE r.e END,
 CASE WHEN joins THEN m.span ELSE m.span + 1 END FROM m JOIN r ON r.user_id = m.user_id AND r.k = m.k + 1, LATERAL (SELECT r.s - m.last <= 7200000 AND greatest(m.last, r.e) - m.first <= 43200000 AS joins) j)"""


def timed_events(spark, d):
    """An interval for each event: as many minutes as its value's whole part."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), start.alias("start_ms"), (start + F.floor("value").cast("long") * 60_000).alias("end_ms"))


@query(f"SELECT user_id AS doc_id, min(first) AS start_ms, max(last) AS end_ms, CAST(count(*) AS INTEGER) AS n_rows FROM (WITH RECURSIVE {SPANS} SELECT * FROM m) GROUP BY user_id, span")
def capped_spans(spark, d):
    """Intervals of a user drawn together over gaps of two hours, none beyond twelve."""
    return spans.merged_spans(timed_events(spark, d), 2 * HOUR, 12 * HOUR)


@query(
    """SELECT user_id AS doc_id, CAST(k // 10 AS INTEGER) AS flush_idx, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS score_sum, bool_or(k = n - 1 AND user_id % 3 > 0) AS complete FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id, k // 10"""
)
def chunk_flushes(spark, d):
    """A user's events as chunks, flushed after each tenth; every third user's last chunk never comes."""
    w = W.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("chunk_idx", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count("*").over(w))
    last = (F.col("chunk_idx") == F.col("n") - 1) & (F.col("user_id") % 3 > 0)
    chunks = e.select(F.col("user_id").alias("doc_id"), "chunk_idx", F.floor("value").alias("score"), last.alias("is_last"), "ts")
    return spans.decoded_chunks(chunks, 10)


@query(
    """SELECT batch, count(*) AS n, count(*) FILTER (WHERE ms < mark) AS n_late FROM (SELECT event_id // 1000 AS batch, epoch_us(ts) // 1000 AS ms FROM events) e JOIN (
 SELECT batch AS b, max(max(ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 432000000 AS mark FROM (SELECT event_id // 1000 AS batch, epoch_us(ts) // 1000 AS ms FROM events) GROUP BY batch) m ON m.b = e.batch GROUP BY batch"""
)
def late_drop(spark, d):
    """Events of each batch of a thousand that a watermark of five days would drop."""
    rows = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 1000))
    return spans.late_rows(rows, 5 * 24 * HOUR).groupBy("batch").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))
