"""Speakers blocks, descriptions, model answers, track lists."""

import json

from pyspark.sql import functions as F

from cuelake.operators import speakers as P, summaries as M


def lines(spark, *texts):
    return spark.createDataFrame([(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))], "doc_id int, line_no int, line string")


BLOCK = """Title: A talk
Speakers:
- Alice Chen (host) @ Ocean Lab (north)
  aliases: Al, Ally
  bio: Host of the show.
  More of her.

- Shawn Wang (Swyx)
- Bob Smith (guest) @ River Institute
  aliases: Bob, Bob
Other: end
- Not One"""


def test_speakers_block_round_trip(spark):
    got = P.parse_block(lines(spark, BLOCK, "no block")).orderBy("entry").collect()
    assert [(r.name, r.role, r.affiliation, r.aliases, r.bio) for r in got] == [
        ("Alice Chen", "host", "Ocean Lab (north)", ["Al", "Ally"], "Host of the show. More of her."),
        ("Shawn Wang", "", "", ["Swyx"], ""),
        ("Bob Smith", "guest", "River Institute", ["Bob"], ""),
    ]
    block = P.format_block(P.parse_block(lines(spark, BLOCK))).first().block
    assert block.split("\n")[:4] == ["Speakers:", "- Alice Chen (host) @ Ocean Lab (north)", "  aliases: Al, Ally", "  bio: Host of the show. More of her."]
    again = P.parse_block(lines(spark, block)).orderBy("entry").collect()
    assert [r.name for r in again] == ["Alice Chen", "Shawn Wang", "Bob Smith"]


def test_descriptions(spark):
    text = "Intro " + "x" * 700 + "\n\nOur guest is Ada.\nhttps://a.b\n0:10 start\n\nnothing here\n\nThe host asks " + "y" * 900 + "\n\nThe guest again"
    got = spark.createDataFrame([(text,)], "d string").select(P.speaker_description(F.col("d")).alias("x")).first().x
    assert got.split("\n\n") == [text[:600] + "...", "Our guest is Ada."]
    kept = P.filter_lines(lines(spark, "\n".join(["https://x", "first", "0:10 no", "z" * 900, "later"]))).first().text
    assert kept.startswith("first\nzzz") and kept.endswith("z…") and len(kept) <= 800
    ctx = spark.range(1).select(P.context_block(F.lit("T"), F.lit(""), F.lit(None).cast("string"), F.array(*map(F.lit, "abc")), F.array().cast("array<string>"), 2).alias("x")).first().x
    assert ctx == "Title: T\nTopics: a; b"


def test_candidate_names(spark):
    rows = [(1, "Rivers with Ada van Dorn and more", "Bo Lee", ""), (2, "Ada Dorn: on rivers", "River Media", ""), (3, "Rivers", "x", "We are joined by Cy Young today."), (4, "对话张三", "c", "")]
    got = P.candidate_names(spark.createDataFrame(rows, "doc_id int, title string, channel string, description string")).collect()
    assert sorted((r.doc_id, r.kind, r.name) for r in got) == [(1, "guest", "Ada van Dorn"), (1, "host", "Bo Lee"), (2, "guest", "Ada Dorn"), (3, "guest", "Cy Young"), (4, "guest", "张三")]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_summary_answers(spark):
    raw = json.dumps({"overview": "o", "tags": ["A", "b"], "chapters": [{"title": "x", "start": 0}, {"title": "y", "start": 5.5, "quotes": ["q"]}]})
    s = one(spark, M.summary_of(F.lit(f"```json\n{raw}\n```")))
    assert s.title == "Untitled" and s.tags == ["a", "b"] and [(c.start, c.end) for c in s.chapters] == [(0.0, 5.5), (5.5, 0.0)]
    d = json.loads(one(spark, M.summary_json(M.summary_of(F.lit(raw)))))
    assert "quotes" not in d["chapters"][0] and d["chapters"][1]["quotes"] == ["q"] and "metadata" not in d and "confidence" not in d
    assert one(spark, M.summary_of(F.lit("nonsense"))).overview == ""


def test_list_and_review_answers(spark):
    assert one(spark, M.unwrap_list(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, M.unwrap_list(F.lit('{"results":["a"]}'))) == ["a"]
    assert one(spark, M.unwrap_list(F.lit('{"x":1}'))) == ['{"x":1}']
    drafts = F.array(F.lit("d1"), F.lit("d2"))
    assert one(spark, M.review_of(F.lit('["r1","r2"]'), drafts)) == [("r1", ""), ("r2", "")]
    assert one(spark, M.review_of(F.lit('{"items":[{"revised":"r1","critique":"c"},{"reason":"n"}]}'), drafts)) == [("r1", "c"), ("d2", "n")]


def test_translation_and_summary_flows(spark):
    segs = spark.createDataFrame([(1, i, f"t{i}", i * 1000, i * 1000 + 900) for i in range(5)], "doc_id int, seg_idx int, text string, start_ms bigint, end_ms bigint")
    got = M.translate(segs, lambda t: [x.upper() for x in t], "de", lambda t: [x + "!" for x in t]).orderBy("seg_idx").collect()
    assert [(r.translation, r.target_lang) for r in got][:2] == [("T0!", "de"), ("T1!", "de")]
    docs = spark.createDataFrame([(1, "x" * 100), (2, "line\n" * 9000)], "doc_id int, text string")
    answer = json.dumps({"title": "t", "chapters": [{"title": "m", "start": 10.4, "summary": "s"}]})
    locked = spark.createDataFrame([(1, 0, "Start", 0, 0), (1, 1, "Next", 10_000, 0)], "doc_id int, ch_idx int, title string, start_ms bigint, end_ms bigint")
    out = {r.doc_id: r for r in M.summarize(docs, lambda t: ["m"] * len(t), lambda t: [answer] * len(t), locked).collect()}
    assert (out[1].confidence, out[2].confidence) == (70, 80)
    assert [(c.title, c.end, c.summary) for c in out[1].locked_chapters] == [("Start", 10.0, "s"), ("Next", 0.0, "s")]
    text = one(spark, M.prompt(F.array(F.lit("a"), F.lit("b")), "German", F.create_map(F.lit("k"), F.lit("v")), F.array().cast("array<string>"), F.array(F.lit("z"))))
    assert text.endswith("After:\nz\n\n1. a\n2. b") and "k = v" in text and "Before" not in text


def test_tracks_and_selectors(spark):
    info = {"id": "v", "title": "t", "subtitles": {"en": [{"ext": "vtt", "url": "1"}, {"ext": "json3", "url": "2"}], "de": []}, "automatic_captions": {"en": [{"ext": "json3", "url": "3"}], "fr": [{"ext": "ttml", "url": "4"}]}}
    tracks = M.caption_tracks(spark.createDataFrame([(json.dumps(info),)], "value string"))
    assert [r.url for r in M.pick_tracks(tracks, "en").collect()] == ["2"] and [r.url for r in M.pick_tracks(tracks, "fr").collect()] == ["4"]
    assert {(r.lang, r.kind): r.exts for r in M.list_tracks(tracks).collect()} == {("en", "manual"): ["json3", "vtt"], ("en", "asr"): ["json3"], ("fr", "asr"): ["ttml"]}
    assert one(spark, M.audio_selector(F.lit(None).cast("string"), F.lit("medium"))) == "bestaudio[abr<=160]/bestaudio/best"
    a = M.audio_selector(F.lit("en"), F.lit("128"))
    assert one(spark, a) == "bestaudio[language^=en][abr<=148]/bestaudio[abr<=148]/bestaudio/best"
    assert one(spark, M.video_selector(a, F.lit("low"))) == "bestvideo[height<=360]+bestaudio[language^=en][abr<=148]/bestvideo[height<=360]+bestaudio/best[height<=360]/best"
    videos = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Z")], "video_id string, channel string")
    links = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("a", 2, "d"), ("b", 0, "a")], "video_id string, pos int, linked_id string")
    assert [(r.video_id, r.channel) for r in M.parent_channels(videos, links).collect()] == [("a", "Y")]


def test_flat_turns_and_terms(spark):
    got = M.flat_turns(lines(spark, "Ann [0:00:05]:\nhello\nthere\n[0:01:00]\nmore\nBo [1:00:00]\nhi")).orderBy("line_no").collect()
    assert [(r.speaker, r.start_ms, r.text) for r in got] == [("Ann", 5000, "hello there"), ("Ann", 60_000, "more"), ("Bo", 3_600_000, "hi")]
    df = spark.sql("select 1 as doc_id, array(named_struct('source',' a ','translation','x'), named_struct('source','a','translation','y'), named_struct('source','','translation','z')) as terminology")
    assert [(r.source, r.target) for r in M.glossary_terms(df).collect()] == [("a", "y")]
