"""Spans and chunks in streams: unordered and late rows, timers, equality with batches."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.streaming import spans


@pytest.fixture()
def streamed(spark, tmp_path):
    """Rows of a stream that takes the given batches one by one, and the rows dropped behind the watermark."""
    before = spark.conf.get(spans.STATE_STORE[0], None)
    spark.conf.set(*spans.STATE_STORE)

    def run(batches, shape, make, name):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={k:03}"))
        schema = spark.createDataFrame([], shape).schema.add("n", "integer")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    yield run
    if before:
        spark.conf.set(spans.STATE_STORE[0], before)
    else:
        spark.conf.unset(spans.STATE_STORE[0])


def test_spans_are_capped_and_gaps_bounded():
    join = lambda rows: spans.drawn_together(rows, None, 2000, 30_000)
    assert join([]) == ([], None)
    assert join([(0, 1000), (3000, 4000), (6001, 7000)]) == ([(0, 4000, 2)], (6001, 7000, 1))
    assert join([(0, 29_000), (29_500, 30_000), (30_000, 30_001)]) == ([(0, 30_000, 2)], (30_000, 30_001, 1))
    assert join([(0, 50_000), (50_000, 50_001), (100, 200)][:2]) == ([(0, 50_000, 1)], (50_000, 50_001, 1))
    assert join([(0, 9000), (100, 200), (10_000, 11_000)]) == ([], (0, 11_000, 3))


SPANS = "doc_id bigint, start_ms bigint, end_ms bigint"


def test_stream_of_unordered_spans_equals_the_batch(spark, streamed):
    r = random.Random(3)
    rows = [(d, s := t * 1500 + r.randint(0, 4000), s + r.randint(0, 3000)) for d in range(3) for t in range(60)]
    rows.sort(key=lambda x: x[1] + r.randint(0, 20_000))  # at most 20 s late
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)] + [[(99, 10**6, 10**6)], [(99, 10**6 + 1, 10**6 + 1)]]
    make = lambda df: spans.merged_spans(df, late="30 seconds")
    got = streamed(batches, SPANS, make, "spans_unordered")
    want = sorted(map(tuple, make(spark.createDataFrame(rows, SPANS)).collect()), key=str)
    assert got == want and max(e - s for _, s, e, _ in got) <= 30_000 and len(got) > 10


def test_late_spans_are_dropped(spark, streamed):
    batches = [[(1, 1000, 2000)], [(1, 100_000, 101_000)], [(1, 3000, 4000), (1, 99_000, 99_500)], [(1, 300_000, 300_001)], [(2, 300_002, 300_003)]]
    got = streamed(batches, SPANS, lambda df: spans.merged_spans(df, late="10 seconds"), "spans_late")
    assert [g for g in got if g[1] < 300_000] == [(1, 1000, 2000, 1), (1, 99_000, 101_000, 2)]


CHUNKS = "doc_id bigint, chunk_idx int, score int, is_last boolean, ts timestamp"


def test_chunks_in_any_order_and_without_an_end(spark, streamed):
    from datetime import datetime, timedelta

    r = random.Random(5)
    base = datetime(2024, 1, 1)
    rows = [(d, k, 10 * d + k, k == 8 and d != 2, base + timedelta(seconds=20 * k + d)) for d in (1, 2, 3) for k in range(9)]
    rows.sort(key=lambda x: x[4] + timedelta(seconds=r.randint(0, 100)))
    batches = [rows[i : i + 5] for i in range(0, len(rows), 5)] + [[rows[0]], [(9, 0, 0, False, base + timedelta(hours=2))], [(9, 1, 0, False, base + timedelta(hours=2))]]
    make = lambda df: spans.decoded_chunks(df, 4)
    got = [g for g in streamed(batches, CHUNKS, make, "chunks_unordered") if g[0] < 9]
    assert got == sorted(map(tuple, make(spark.createDataFrame(rows, CHUNKS)).collect()), key=str)
    assert [g[-1] for g in got] == [False, False, True, False, False, False, False, False, True]


def test_batches_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 7, None), (None, 1, 2), (1, 7, 3)], SPANS).withColumn("ts", F.lit("x"))
    assert sorted(map(tuple, spans.merged_spans(df).collect()), key=str) == [(1, 7, 7, 2), (None, 1, 2, 1)]
    assert spans.merged_spans(df.limit(0)).count() == 0
    rows = [(1, 0, None, None, None), (1, 0, None, None, None), (1, 2, 5, True, None), (1, 3, 7, False, None), (2, -1, 1, True, None)]
    assert list(map(tuple, spans.decoded_chunks(spark.createDataFrame(rows, CHUNKS), 0).collect())) == [(1, 0, 2, 5, True)]


def test_late_rows_of_a_stream_of_batches(spark):
    rows = [(0, 10), (0, 5), (1, 3), (1, 4), (1, 20), (2, 9), (2, 15), (2, None)]
    df = spark.createDataFrame(rows, "batch int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.batch, r.s): r.late for r in spans.late_rows(df, 6000).collect()}
    assert {k for k, v in got.items() if v} == {(1, 3), (2, 9)}
