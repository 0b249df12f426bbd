"""Keys at any depth, and page parsers as table functions."""

import json
import random

from pyspark.sql import functions as F

from cuelake.operators import nested, page_grammar, pages, tables


def walk(x, key, path="$", place=()):
    """path, place of the holder, value of each member, depth first, members by name."""
    if isinstance(x, dict):
        for k, name in enumerate(sorted(x)):
            if name == key:
                yield f"{path}.{name}", place, x[name]
            yield from walk(x[name], key, f"{path}.{name}", (*place, k))
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from walk(v, key, f"{path}[{k}]", (*place, k))


def find(x, key):
    """The first value: an object's own member before what its members hold."""
    if isinstance(x, dict):
        if x.get(key) is not None:
            return x[key]
        x = [x[k] for k in sorted(x)]
    for v in x if isinstance(x, list) else ():
        if (got := find(v, key)) is not None:
            return got
    return None


def made(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([1, "x", None, True, 'a "quoted" {[', 2.5, "\\"])
    if kind < 0.65:
        return {r.choice(["key", "a", "b", "zz"]): made(r, depth - 1) for _ in range(r.randint(0, 4))}
    return [made(r, depth - 1) for _ in range(r.randint(0, 4))]


def test_keys_at_any_depth_equal_a_plain_walk(spark):
    r = random.Random(8)
    docs = [made(r, 7) for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "doc_id bigint, value string")
    got = sorted((h.doc_id, h.path, tuple(h.place), json.dumps(json.loads(h.found), sort_keys=True)) for h in nested.find_key(df, "key").collect())
    assert got == sorted((i, p, q, json.dumps(v, sort_keys=True)) for i, x in enumerate(docs) for p, q, v in walk(x, "key"))
    first = {h.doc_id: json.loads(h.found) for h in nested.first_found(df, "key").collect()}
    assert first == {i: v for i, x in enumerate(docs) if (v := find(x, "key")) is not None}


def test_depth_and_odd_documents(spark):
    texts = ["1", '"[[["', "[]", '{"a": [{"b": "\\"}]"}]}', None, "{broken", '{"key": null, "x": {"key": 3}}', "[" * 40 + '{"key": 0}' + "]" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, value string")
    assert [x[0] for x in df.orderBy("doc_id").select(nested.depth(F.col("value"))).collect()] == [0, 0, 1, 3, None, 1, 2, 41]
    assert sorted((h.doc_id, h.path[-9:], h.found) for h in nested.find_key(df, "key").collect()) == [(6, "$.key", "null"), (6, "$.x.key", "3"), (7, "[0][0].key"[-9:], "0")]
    assert nested.find_key(df.where("value is null"), "key").count() == 0


def test_lateral_lines_equal_the_dataframe(spark, data):
    tables.register(spark)
    table = spark.read.parquet(f"{data}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None)], "page_id bigint, url string, html string"))
    table.createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT p.page_id AS doc_id, l.line_no, l.line FROM pages_of_test p, LATERAL page_lines(p.html) l")
    want = pages.html_lines(table)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_turns_by_partition_equal_the_grammar(spark):
    tables.register(spark)
    r = random.Random(2)
    lines = ["Ann Lee (00:00:0{}) said so", "Bo [00:1{}:00]: yes", "more words of the turn", "short", "12 Likes", "Go back to the top", "## A heading of the page", "", None]
    rows = [(d, n, (x := r.choice(lines)) and x.format(r.randint(0, 9))) for d in range(40) for n in range(25)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id bigint, line_no int, line string")
    df.createOrReplaceTempView("lines_of_test")
    got = spark.sql("SELECT * FROM timed_turns(TABLE(lines_of_test) PARTITION BY doc_id ORDER BY line_no)")
    want = page_grammar.parse(df).where("kind = 'turn' and strategy = 'timed'").select(*got.columns)
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0


def test_nested_documents_are_gathered_flat_and_by_their_events(spark, tmp_path, monkeypatch):
    """Partitions follow the events, and no shuffle carries the nested objects."""
    from pyspark.sql import functions as F
    from cuelake.plans import structure_queries as Q

    e = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(Q, "PARTITION_EVENTS", 6, raising=False)
    docs = Q.nested_events(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 10
    got = {r.user_id: r.value for r in docs.collect()}
    assert len(got) == 7 and got[3].startswith('{"events":[{"event_id":3,"props":{"k":3},"list":[{"k":"click","deep":[{"k":3}]}]},{"event_id":10,')
