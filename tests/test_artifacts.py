"""Side artefacts, furniture of pages, chapters of sessions, files with the times of others."""

from pyspark.sql import functions as F

from cuelake import commands
from cuelake.operators import pages
from cuelake.sources import artifacts


def test_kinds_are_written_in_one_pass_and_read_back_equal(spark, tmp_path):
    docs = spark.sql("""select 1L as doc_id, 'plain' as style, '' as register, array(named_struct('source', 'a', 'translation', 'b', 'context', 'c'), named_struct('source', 'd', 'translation', '', 'context', null)) as terminology,
        array(named_struct('source', 'm', 'intent', 'i', 'strategy', '')) as metaphors, 'more' as notes union all select 2L, null, null, null, null, null""")
    rows = spark.createDataFrame([(1, 1, "y", "Y", "Z", None), (1, 0, "x", "X", "X", ""), (3, 0, "q", None, "Q", "why")], "doc_id bigint, seg_idx int, text string, draft string, revised string, note string")
    kinds = [artifacts.analysis(docs), artifacts.draft(rows.withColumn("translation", F.col("draft"))), artifacts.critique(rows)]
    want = {(r.doc_id, r.kind): r.value for k in kinds for r in k.collect()}
    folder = artifacts.write(str(tmp_path / "out"), *kinds)
    assert {(r.doc_id, r.kind): r.value for r in artifacts.read(spark, folder).collect()} == want
    assert want[1, "analysis"] == '# Analysis\n\n- Style: plain\n\n## Terminology\n- "a" -> "b" (c)\n- "d"\n\n## Metaphor Map\n- "m"\n  - intent: i\n\n## Notes\nmore\n'
    assert want[2, "analysis"] == "# Analysis\n\n## Terminology\n- None\n\n## Metaphor Map\n- None\n"
    assert want[1, "draft"] == "# Draft Translation\n\n## Segment 1\n- Source: x\n- Translation: X\n\n## Segment 2\n- Source: y\n- Translation: Y\n"
    assert want[3, "critique"] == "# Critique\n\n## Segment 1\n- Source: q\n- Draft: \n- Revised: Q\n- Changed: yes\n- Note: why\n"
    assert not list((tmp_path / "out").glob("_run*"))


def test_furniture_is_peeled_from_the_end_only(spark):
    page = ["Share", "first", "12 Likes ∙ 3 Restacks", "last There aren't comments yet, be the first", "OK: 12 bytes", "", "5月3日", "Subscribe"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(page)], "doc_id int, line_no int, line string")
    assert [r.line for r in pages.without_furniture(df).orderBy("line_no").collect()] == ["Share", "first", "12 Likes ∙ 3 Restacks", "last"]


def test_sessions_with_chapters(spark):
    df = spark.sql("""select 1L as doc_id, map(0, 'Ann') as speakers, array(named_struct('speaker', 0, 'start', 61.0D, 'text', 'Hi')) as utterances,
        map('Late', named_struct('spans', array(named_struct('start', 3700.9D))), 'Early', named_struct('spans', array(named_struct('start', 70.0D), named_struct('start', 5.0D))), 'None', named_struct('spans', cast(array() as array<struct<start: double>>))) as narrative""")
    assert pages.session_markdown(df).first().markdown == "## Table of Contents\n- 0:05 – Early\n- 1:01:40 – Late\n\n**Ann:** Hi [00:01:01]"


def test_times_of_a_reference_file(spark):
    shape = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string"
    segs = spark.createDataFrame([(1, 0, 0, 10, "Hello there my friend of old"), (1, 1, 10, 20, "A second line of many words"), (2, 0, 5, 9, "alone")], shape)
    ref = spark.createDataFrame([(1, 0, 1000, 1900, "hello there, my friend of old"), (1, 1, 2000, 2600, "a second line of many words!")], shape)
    got = sorted((r.doc_id, r.seg_idx, r.start_ms, r.end_ms) for r in commands.retimed(segs, ref).collect())
    assert got == [(1, 0, 1000, 2000), (1, 1, 2000, 2600), (2, 0, 5, 9)]
