"""Readers, renderers, pages and streams."""

import pytest
from pyspark.sql import functions as F

from cuelake import commands
from cuelake.operators import aggregates, joins, pages, windows
from cuelake.sources import captions, writers
from cuelake.streaming import windows as streams

CUES = [(1, 0, 500, 4000, "Hello there.", "ALICE"), (1, 1, 4500, 8000, "Good, and you?", "BOB"), (1, 2, 3_723_040, 3_725_000, "Fine", None)]


@pytest.fixture(scope="module")
def segs(spark):
    return spark.createDataFrame(CUES, "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string")


@pytest.mark.parametrize("kind", ["srt", "vtt", "sbv", "ass", "json", "tsv", "csv", "aud", "sub", "lrc", "md"])
def test_round_trip(spark, segs, tmp_path, kind):
    rows = writers.RENDERERS[kind](segs).select("value").collect()
    (tmp_path / f"a.{kind}").write_text(rows[0].value, encoding="utf-8")
    got = captions.read(spark, str(tmp_path / f"a.{kind}")).orderBy("seg_idx").collect()
    near = 1000 if kind == "md" else 40
    assert [r.seg_idx for r in got] == [0, 1, 2]
    assert all(abs(r.start_ms - c[2]) < near for r, c in zip(got, CUES))
    if kind not in ("lrc", "md"):
        assert all(abs(r.end_ms - c[3]) < near for r, c in zip(got, CUES))
    assert [r.speaker for r in got] == ["ALICE", "BOB", None]
    assert [r.text.replace(";", ",") for r in got] == [c[4] for c in CUES]


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string")


def test_speakers_and_word_tags(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.500 align:start\n<00:00:01.000><c> Hi</c><00:00:01.500><c> you</c>\n\n00:05.000 --> 00:06.000\n[SPEAKER_02]: two\nlines\n\n00:07.000 --> 00:08.000\n>> DAVID: yes\n"
    got = captions.cues(files(spark, vtt)).orderBy("seg_idx").collect()
    assert [(r.start_ms, r.text, r.speaker) for r in got] == [(1000, "Hi you", None), (5000, "two lines", "SPEAKER_02"), (7000, "yes", "DAVID")]
    words = captions.tagged_words(files(spark, vtt)).orderBy("word_idx").collect()
    assert [(r.symbol, r.start_ms) for r in words] == [("Hi", 1000), ("you", 1500)]


def test_textgrid_and_glossaries(spark):
    rows = [(1, "speaker", 0, 1500, 'A "x"'), (1, "speaker", 1500, 2000, "B"), (1, "VAD", 0, 900, "speech")]
    grid = writers.textgrid(spark.createDataFrame(rows, "doc_id bigint, tier string, start_ms bigint, end_ms bigint, label string"))
    got = captions.textgrid(grid.select(F.col("doc_id").cast("string").alias("path"), F.replace("value", F.lit('""'), F.lit("'")).alias("value"))).collect()
    assert sorted((r.tier, r.start_ms, r.end_ms) for r in got) == [("VAD", 0, 900), ("speaker", 0, 1500), ("speaker", 1500, 2000)]
    md = "| a | b |\nno\n| term | wording |\n| --- | :-: |\n| x | y |\n| z |\n\n| p | q |\n"
    assert [(r.source, r.target) for r in captions.glossary_markdown(files(spark, md)).collect()] == [("x", "y")]
    yaml = "# no: comment\nterm: 'wording'\nempty:\n\"k\": v: w\n"
    assert [(r.source, r.target) for r in captions.glossary_yaml(files(spark, yaml)).collect()] == [("term", "wording"), ("k", "v: w")]


def test_page_metadata(spark):
    page = '---\ntitle: "A talk"\nchannel: C\n---\nIntro\n0:00 Start\n1:02:03 - Middle\n'
    r = captions.page_metadata(files(spark, page, "no front\n0:10 once")).orderBy("path").collect()
    assert r[0].front == {"title": "A talk", "channel": "C"} and [(c.start_ms, c.title) for c in r[0].chapters] == [(0, "Start"), (3_723_000, "Middle")]
    assert r[1].chapters is None and r[1].body.startswith("no front")


def test_tracks_colors_karaoke(spark, segs):
    both = segs.withColumn("track", F.lit("transcription")).unionByName(segs.limit(1).withColumn("track", F.lit("supervisions")))
    assert writers.best_track(both).count() == 1
    colors = {r.speaker: r.color for r in writers.speaker_colors(segs.where("speaker is not null")).collect()}
    assert colors == {"ALICE": 0, "BOB": 1}
    words = segs.withColumn("words", F.when(F.col("seg_idx") == 0, F.array(F.struct(F.lit("Hello").alias("symbol"), F.lit(500).alias("start_ms"), F.lit(1500).alias("end_ms")))))
    assert "{\\kf100}Hello" in writers.karaoke(words).first().value
    assert writers.one_word_each(words.where("words is not null")).first().text == "Hello"
    assert writers.reading_text(segs).first().value.split("\n")[0] == "[00:00] [ALICE] Hello there."
    assert "<p begin=" in writers.ttml(segs).first().value


def lines(spark, *texts):
    rows = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "doc_id int, line_no int, line string")


def test_transcript_strategies(spark):
    timed = "Intro\nAnn (00:00:05) Hello\nmore words here\nBo [00:01:00]: Hi\nSubscribe"
    headed = "\n".join(["## 0:10 One"] + [f"**A{k}:** said {k}" for k in range(5)])
    named = "\n".join(f"{'Ann' if k % 2 else 'Bo Li'}: line {k}" for k in range(10))
    recurring = "\n".join(f"{'Ann' if k % 2 else 'Bo'}\nsome words number {k} here" for k in range(10))
    started = "Starting point is 00:00:00\na b\nStarting point is 00:00:30\nc\nStarting point is 00:01:00\nd"
    got = pages.transcripts(lines(spark, timed, headed, named, recurring, started, "x" * 300, "short"))
    kinds = {r.doc_id: (r.strategy, r.n) for r in got.groupBy("doc_id", "strategy").agg(F.count("*").alias("n")).collect()}
    assert kinds == {0: ("timed", 2), 1: ("headed", 5), 2: ("named", 10), 3: ("recurring", 10), 4: ("started", 3), 5: ("whole", 1)}
    first = got.where("doc_id = 0").orderBy("line_no").collect()
    assert [(r.speaker, r.start_ms, r.text) for r in first] == [("Ann", 5000, "Hello more words here"), ("Bo", 60000, "Hi")]


def test_html_lines():
    html = "<html><head><title>t</title></head><body><nav>no</nav><p>One <b>two</b></p><script>x</script><ul><li>a<li>b</ul></body></html>"
    assert pages.lines_of(html) == ["One two", "", "a", "b"]
    assert pages.lines_of("plain\ntext") == ["plain", "text"] and pages.lines_of(None) == [""]


def test_session_markdown(spark):
    df = spark.sql("select 1L as doc_id, map(0, 'Ann') as speakers, array(named_struct('speaker', 0, 'start', 61.0D, 'text', ' Hi '), named_struct('speaker', 1, 'start', 3600.5D, 'text', 'Yo')) as utterances")
    assert pages.session_markdown(df).first().markdown == "**Ann:** Hi [00:01:01]\n\n**Speaker 1:** Yo [01:00:00]"


def test_overlaps_in_buckets(spark):
    a = spark.createDataFrame([(1, i, i * 7000, i * 7000 + 130_000) for i in range(20)], "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint")
    b = spark.createDataFrame([(1, i * 11_000, i * 11_000 + 9000, f"l{i}") for i in range(20)], "doc_id bigint, start_ms bigint, end_ms bigint, label string")
    for slack in (0, 20_000):
        want = sorted((x.seg_idx, y.label) for x in a.collect() for y in b.collect() if y.start_ms < x.end_ms + slack and y.end_ms > x.start_ms - slack)
        assert sorted((r.seg_idx, r.b_label) for r in joins.overlaps(a, b, slack).collect()) == want


def test_votes_talk_and_names(spark):
    votes = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, "x"), (2, 2, "y"), (2, 3, "y")], "doc_id int, round int, label string")
    assert sorted((r.doc_id, r.label) for r in aggregates.majority(votes, "doc_id").collect()) == [(1, "b"), (2, "y")]
    counts = spark.createDataFrame([(1, "s0", "Ann", 90), (1, "s1", "Guest 1", 5), (1, "s2", "Guest", 5), (2, "s0", "Guest", 50), (2, "s1", "B", 50)], "doc_id int, speaker string, name string, n_segments int")
    assert sorted((r.doc_id, r.speaker, r.label) for r in aggregates.talk_format(counts).collect()) == [(1, "s0", "Ann"), (1, "s1", "Audience"), (1, "s2", "Audience"), (2, "s0", "Guest"), (2, "s1", "B")]
    assert aggregates.dominant_speaker(counts).where("doc_id = 2").first().speaker == "s0"
    got = joins.fuzzy_titles(spark.createDataFrame([(1, "The old river bank"), (2, "A new town")], "id int, title string"), spark.createDataFrame([(9, "Old river, old bank")], "id int, title string")).collect()
    assert [(r.wanted_id, r.id) for r in got] == [(9, 1)]


def test_margins_and_widening_keep_order(spark, segs):
    m = windows.margins(segs).orderBy("seg_idx").collect()
    assert [(r.margin_start_ms, r.margin_end_ms) for r in m] == [(400, 4100), (4400, 8100), (3_722_940, 3_725_100)]
    w = windows.widen(segs).orderBy("seg_idx").collect()
    assert [(r.wide_start_ms, r.wide_end_ms) for r in w] == [(250, 4250), (4250, 10_000), (3_721_040, 3_727_000)]


def test_streams_equal_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    for name, make in (("tumbling", lambda e: streams.windowed_counts(e, "1 hour", None, "1 hour", "event_type")), ("sliding", lambda e: streams.windowed_counts(e, "2 hours", "1 hour")), ("sessions", lambda e: streams.sessions(e, "30 minutes", "1 hour", "user_id"))):
        assert run(make(stream), name) == sorted(map(tuple, make(events).collect()))
    assert len(run(streams.distinct_events(stream, "event_id"), "distinct", "append")) == events.count()


def test_stateful_decoding_flushes(spark, tmp_path):
    rows = [(d, k, 10 + k, k == 6) for d in (1, 2) for k in range(7)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_idx int, score int, is_last boolean")
    for n in range(0, 7, 2):
        df.where(f"chunk_idx between {n} and {n + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.decode(stream, 3).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = sorted((r.doc_id, r.flush_idx, r.n_chunks, r.score_sum, r.complete) for r in spark.table("decoded").collect())
    assert got == [(d, *x) for d in (1, 2) for x in ((0, 3, 33, False), (1, 3, 42, False), (2, 1, 16, True))]


def test_page_lines_of_awkward_markup():
    page = "<html><body>a &amp; b<p>one<br/>two</p><script>if (a<b) {</script><nav>menu<nav>x</nav></nav>c<!-- <p>no</p> --><div/>d < e<style>p{}</body>"
    assert pages.lines_of(page) == ["a & b", "one", "two", "", "c", "", "d < e"]
    assert pages.lines_of("x <p>y") == ["x <p>y"] and pages.lines_of(None) == [""] and pages.lines_of("<html>no body") == [""]


def rows_of(spark, *docs):
    rows = [(d, i, line) for d, text in enumerate(docs) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id bigint, line_no int, line string")


def test_blocks_newsletters_and_front_matter(spark):
    a = "Ann Lee\n\n0:00:05\n\nHello all\nof you\n\nBo Ray\n\n0:01:00\n\nHi\n\nAnn Lee\n\n1:00:00\n\nBye"
    b = "0:05\n\nSPEAKER 1\n\nHello\n\n1:00\n\na text that is long enough\n\n2:00\n\nSPEAKER 2\n\nBye"
    got = pages.block_turns(rows_of(spark, a, b)).orderBy("doc_id", "line_no").collect()
    assert [(r.speaker, r.start_ms, r.text) for r in got] == [("Ann Lee", 5000, "Hello all of you"), ("Bo Ray", 60_000, "Hi"), ("Ann Lee", 3_600_000, "Bye"), ("SPEAKER 1", 5000, "Hello"), ("SPEAKER 1", 60_000, "a text that is long enough"), ("SPEAKER 2", 120_000, "Bye")]
    page = "An [advert](http://x)\n[(00:01:00) - Start](https://y/z)\n**Ann**\n\nsee [this](u) now\nagain\n**Bo**\nyes"
    got = pages.newsletter_markdown(rows_of(spark, page, "no speaker")).collect()
    assert [(r.doc_id, r.markdown) for r in got] == [(0, "## Table of Contents\n- 00:01:00 – Start\n\n**Ann:** see this now again\n\n**Bo:** yes")]
    info = spark.createDataFrame([("T", 5, None, "C", "u", "s", "about\n\nit *CONTACT x *SPONSORS: y")], "t string, d int, up string, c string, u string, s string, x string")
    text = info.select(pages.front_matter(*[F.col(c) for c in info.columns]).alias("f")).first().f
    assert text == '---\ntitle: T\nduration: 5\nchannel: C\nurl: "u"\ntranscript_source: s\ndescription: |\n  about\n  it *CONTACT x\n---\n\n'


def test_commands(spark, segs, tmp_path):
    (tmp_path / "a.srt").write_text(writers.RENDERERS["srt"](segs).first().value, encoding="utf-8")
    track = commands.load(spark, str(tmp_path / "a.srt"))
    moved = commands.convert(track, normalize=True, shift_ms=-1000, split=True).orderBy("seg_idx").collect()
    assert [(r.start_ms, r.text) for r in moved] == [(0, "Hello there."), (3500, "Good, and you?"), (3_722_040, "Fine")]
    groups = commands.diff(track, track.withColumn("text", F.replace("text", F.lit("you"), F.lit("he")))).collect()
    assert sum(g.n_sub for g in groups) == 1 and sum(g.n_ins + g.n_del for g in groups) == 0
    commands.convert_files(spark, str(tmp_path / "a.srt"), str(tmp_path / "out"), "vtt")
    assert "WEBVTT" in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_standard_layout_breaks_lines(spark):
    from cuelake.operators import gates

    rows = spark.createDataFrame([(1, 0, 0, 100, "a text of several words that is to be broken somewhere"), (1, 1, 1500, 1600, "x")], "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string")
    got = gates.standard(rows, line_chars=20).orderBy("seg_idx").collect()
    assert [(r.end_ms, r.text) for r in got] == [(1500, "a text of several\nwords that is to be\nbroken somewhere"), (2200, "x")]


def test_scores_of_nested_words_equal_plain_sums(spark):
    import random

    r = random.Random(1)
    frames = [(d, k, r.randint(0, 90), r.randint(0, 9)) for d in (1, 2) for k in range(0, 9000)]
    segs = [(d, i, s := r.randint(-500, 190_000), s + r.randint(0, 9000), [(s + 10, s + 30), (s - 5000, s - 4000)] if i % 3 else None) for d in (1, 2, 3) for i in range(40)]
    f = spark.createDataFrame(frames, "doc_id int, frame_idx int, max_prob int, aligned_prob int")
    s = spark.createDataFrame(segs, "doc_id int, seg_idx int, start_ms long, end_ms long, words array<struct<start_ms: long, end_ms: long>>")
    loss = {d: [a - b for x, _, a, b in frames if x == d] for d in (1, 2)}

    def want(d, start, end):
        lo = max(0, min(start // 20, 8999))
        hi = max(lo + 1, min(end // 20, 9000))
        return hi - lo, sum(loss[d][lo:hi])

    wanted = {(d, i, w): want(d, *x) for d, i, a, b, words in segs if d < 3 for w, x in ((None, (a, b)), *enumerate(words or []))}
    got = {(x.doc_id, x.seg_idx, x.word_idx): (x.n_frames, x.loss_sum) for x in joins.nested_scores(s, f).collect()}
    assert got == wanted
