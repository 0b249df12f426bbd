"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from cuelake.llm import pii, simhash
from cuelake.llm.queries import ORACLES, QUERIES


def test_pipeline_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        path = f"{tmp_path}/{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and counts[2] == counts[3] == counts[4]
    before, after = seen[0].collect(), {r.doc_id for r in seen[1].collect()}
    root = {r.doc_id: r.root for r in simhash.near_duplicates(seen[0]).collect()}
    assert len(after) == len(set(root.values()))
    assert {root[i] for i in after} == {root[r.doc_id] for r in before}
    for r in seen[3].collect():
        assert not pii.spans(r.text)[1] and r.n_chars == len(r.text)
    assert all(len(r.ids) == r.n_tokens for r in seen[4].collect())


def test_stages_take_awkward_tables(spark, data):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted int, `row` string"
    rows = [(1, None, None, None, None, "a", 1, "r"), (2, "", "en", "s", 0, None, None, None), (2, "", "en", "s", 0, None, None, None), (None, "mail a@b.cd " * 30, None, None, 1, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert name == "bpe_encoding" or out.columns == docs.columns
            out.collect()
    single = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), data).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "None"]


def test_stages_judge_rows_and_not_ids(spark, data):
    """Ids that repeat over different texts, copies without ids, repeated rows, and leaks among them."""
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 150").first().text
    long = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, check string"
    row = lambda i, t, extra="e": (i, t, "en", "s", 1, extra, "c")
    rows = [row(1, long[0]), row(1, long[1]), row(2, long[2]), row(None, long[3]), row(None, long[3]), row(None, long[3]), row(7, long[2]), row(5, long[4]), row(5, long[4]), row(5, long[4], "f"), row(None, long[4])]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), data).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", long[0]), ("1", long[1]), ("2", long[2]), ("None", long[3]), ("5", long[4])])
    rows = [row(1, long[0]), row(1, f"{long[1]} {item}"), row(None, f"{item} {long[2]}"), row(None, long[3]), row(3, None)]
    clean = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, schema), data).collect()
    assert sorted(str((r.doc_id, r.text)) for r in clean) == sorted(str(x) for x in [(1, long[0]), (None, long[3]), (3, None)])


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
