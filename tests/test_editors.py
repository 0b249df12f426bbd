"""Captions of editors: clocks, round trips, hand-written files."""

from pyspark.sql import functions as F

from cuelake.sources import captions, editors, writers


def test_drop_frame_timecodes_are_a_bijection(spark):
    n = 30 * 60 * 30 * 3
    df = spark.range(0, n, 1, 4).select("id", editors.timecode(F.col("id"), editors.NTSC_DROP).alias("t"), editors.timecode(F.col("id"), editors.PAL).alias("p"))
    back = df.withColumn("f", editors.frames_of_timecode(F.col("t"), editors.NTSC)).withColumn("q", editors.frames_of_timecode(F.col("p"), editors.PAL))
    assert back.where("f <> id or q <> id").count() == 0
    assert back.where("t rlike '[1-9]:00;0[01]$'").count() == 0
    got = {r.id: r.t for r in df.where(F.col("id").isin(1799, 1800, 17_981, 17_982, 107_892)).collect()}
    assert got == {1799: "00:00:59;29", 1800: "00:01:00;02", 17_981: "00:09:59;29", 17_982: "00:10:00;00", 107_892: "01:00:00;00"}


def test_times_on_frames_survive(spark):
    df = spark.range(0, 50_000, 1, 4)
    for rate in (editors.NTSC, editors.PAL, editors.FILM):
        assert df.where(editors.frames_of(editors.ms_of(F.col("id"), rate), rate) != F.col("id")).count() == 0
    texts = spark.createDataFrame([("1001/30000s",), ("5s",), ("0.5s",), ("1/0s",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(editors.ms_of_fraction(F.col("t"))).collect()] == [33, 5000, 500, None, None, None]


def test_round_trips(spark):
    rows = [(1, 0, 1000, 2000, 'a <b> & "c"'), (1, 1, 2000, 2040, "d\ne"), (1, 2, 5_400_000, 5_404_000, "é"), (2, 0, 0, 40, "x")]
    segs = spark.createDataFrame(rows, "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string")
    want = [(d, i, s, e, t.replace("\n", " ")) for d, i, s, e, t in rows]
    for kind, reader, rate in (("sami", editors.sami, None), ("fcpxml", editors.fcpxml, editors.PAL), ("xml", editors.premiere, editors.PAL), ("avid", editors.avid, None)):
        made = writers.RENDERERS[kind](segs) if rate is None else {"fcpxml": editors.as_fcpxml, "xml": editors.as_premiere}[kind](segs, rate)
        got = reader(made.select(F.col("doc_id").cast("string").alias("path"), "value"))
        assert sorted((int(r.path), r.seg_idx, r.start_ms, r.end_ms, r.text) for r in got.collect()) == want, kind


def test_files_as_others_write_them(spark, tmp_path):
    (tmp_path / "a.smi").write_text('<SAMI><BODY>\n<SYNC Start="100"><P Class=ENCC>One<br>two &amp; <i>three</i>\n<sync start=900><p>&nbsp;\n<SYNC Start=2000><P>End</BODY></SAMI>')
    (tmp_path / "b.fcpxml").write_text('<fcpxml><spine><title name="x" offset="3003/30000s" duration="1s"><text><text-style ref="t">A</text-style><text-style>B</text-style></text></title><title name="no time"><text/></title></spine></fcpxml>')
    (tmp_path / "c.xml").write_text("<xmeml><sequence><rate><timebase>30</timebase><ntsc>TRUE</ntsc></rate><generatoritem id='1'><name>BOB: hi</name><start>30</start><end>60</end></generatoritem></sequence></xmeml>")
    (tmp_path / "d.avid").write_text("@ head\n\n<begin subtitles>\n\n00:00:01:00 00:00:02:12\nline one\nline two\n\nno times\n\n<end subtitles>\n")
    show = lambda name: [(r.start_ms, r.end_ms, r.text, r.speaker) for r in captions.read(spark, str(tmp_path / name)).orderBy("seg_idx").collect()]
    assert show("a.smi") == [(100, 900, "One two & three", None), (2000, 6000, "End", None)]
    assert show("b.fcpxml") == [(100, 1100, "AB", None)]
    assert show("c.xml") == [(1001, 2002, "hi", "BOB")]
    assert show("d.avid") == [(1000, 2480, "line one line two", None)]
