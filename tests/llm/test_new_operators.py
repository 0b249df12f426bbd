"""Chat layouts, Merkle manifests and centroids against plain re-computation."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import centroids, chat, corpus_sql, merkle, queries, url_filter

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(*columns).collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, r)) + ")" for r in want.select(*columns).fetchall())


# Merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_merkle(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each row, one by one."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))
    none_first = lambda x: (x is not None, x if x is not None else 0)

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            out.append((run, at % 3))
            at //= 3
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda r: (none_first(r[0]), leaf(r)))) for s in names}
    made = {s: tree([leaf(r) for r in trees[s]]) for s in names}
    top = tree([made[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(trees[s]):
            steps = path(made[s], at) + path(top, k)
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].replace("\n", ""))) if odd else leaf(r)
            for run, slot in steps:
                h = sha("".join([*run[:slot], h, *run[slot + 1 :]]))
            proof = sha("".join(x for run, slot in steps for i, x in enumerate(run) if i != slot))
            out.append((r[0], leaf(r), made[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def merkle_rows(df):
    return sorted(map(tuple, merkle.tampered(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 2, 3, 10, 28], [82, 1, 1], [1] * 30])
def test_merkle_equals_plain_trees(spark, sizes):
    rows, at = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((at * 7919 % 1009, f"s{s}", "en", at, f"a\nb{at}é" if at % 3 else "none"))
            at += 1
    df = spark.createDataFrame(rows, DOCS)
    assert merkle_rows(df) == sorted(plain_merkle(rows), key=str)


def test_merkle_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (5, "ä", "", 0, "x\n"), (5, "ä", "", 0, "x\n"), (5, "ä", None, -3, "y"), (2, "z", "e", 1, "\n\n"), (8, "", "e", 1, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("path", F.lit("p"))
    assert merkle_rows(df) == sorted(plain_merkle(rows), key=str)
    empty = merkle.tampered(spark.createDataFrame([], DOCS))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0


def test_merkle_of_one_large_group_needs_no_task_with_all_rows(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).cast("bigint").alias("n_chars"), F.lit("t").alias("text"))
    made = merkle.manifest(df.select("doc_id", "source", merkle.leaf_hash([F.col(c) for c in merkle.FIELDS]).alias("leaf")))
    held = made.leaves.select("leaf", merkle.folded("leaf").alias("f"), F.size("path").alias("n"))
    assert held.groupBy("f", "n").count().collect() == [(made.root, 10, 20000)]


def test_merkle_parts_rows_that_are_equal_in_everything(spark):
    same = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).cast("bigint").alias("n_chars"), F.lit("t\n").alias("text"))
    rows = [tuple(r) for r in same.collect()]
    assert {r[1:] for r in merkle_rows(same)} <= {r[1:] for r in plain_merkle(rows)} and len(merkle_rows(same)) == 4000
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    numbered = merkle.ranked(same.withColumn("row", F.monotonically_increasing_id()), "source", "doc_id", "row")
    spark.conf.set(setting, "true")
    assert numbered.groupBy("part").count().agg(F.max("count")).first()[0] < 4000
    assert numbered.agg(F.count_distinct("rank"), F.max("rank")).first() == (4000, 3999)


# Centroids


def plain_centroids(vectors, k, rounds):
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items()}
    cen = [q[i] for i in sorted(q, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cen)), key=lambda c: (dist(v, cen[c]), c))
    for _ in range(rounds):
        to = {i: near(v) for i, v in q.items()}
        for c in range(len(cen)):
            if own := [q[i] for i in q if to[i] == c]:
                cen[c] = [sum(x) // len(own) for x in zip(*own)]
    return {i: (near(v), dist(v, cen[near(v)])) for i, v in q.items()}, cen


def test_centroids_equal_plain_kmeans(spark):
    rng = np.random.default_rng(3)
    vectors = {i: np.float32(rng.normal(size=64) * (0.02 if i % 3 else 4)) for i in range(120)}
    for i in range(40):
        vectors[200 + i] = vectors[1]  # ties and a common vector
    odd = [(900, [1.0] * 63), (901, None), (902, [float("nan")] * 64), (903, [None] + [0.0] * 63), (904, [float("inf")] * 64), (905, []), (906, [1e30] * 64)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()] + odd, "vec_id bigint, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(3)
    want, cen = plain_centroids(vectors, 12, 3)
    rows, got = centroids.cluster(df, 12, 3)
    assert got.tolist() == cen
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in rows.collect()} == want
    assert rows.agg(F.avg("exact_distances")).first()[0] < 8


def test_screening_never_changes_an_assignment():
    rng = np.random.default_rng(5)
    for scale in (1, 3, 90, 5000, 1 << 27):
        q, cen = rng.integers(-scale, scale + 1, (150, 64)), rng.integers(-scale, scale + 1, (20, 64))
        cen[9], q[3], q[4] = cen[2], cen[2], 0
        step, code, norms = centroids.compress(q)
        assert (np.abs(code) <= 7).all()
        dropped = q - step[:, None] * code
        assert (norms.astype(float) ** 2 >= (dropped.reshape(150, -1, centroids.BLOCK) ** 2).sum(2)).all()
        best, distance, taken = centroids.nearest(q, (step, code, norms), cen)
        full = ((q[:, None] - cen[None]) ** 2).sum(2)
        assert (best == full.argmin(1)).all() and (distance == full.min(1)).all() and (taken >= 1).all()


def test_few_null_and_no_vectors(spark):
    shape = "vec_id bigint, embedding array<double>"
    one = centroids.report(spark.createDataFrame([(None, [0.5] * 64), (1, [-0.001] * 64), (1, [0.25] * 64)], shape)).collect()
    assert sorted((r["vec_id"] or 0, r["cluster"]) for r in one) == [(0, 1), (1, 0), (1, 1)] and {r["inertia"] for r in one} == {2 * 64 * 32 * 32}
    assert centroids.report(spark.createDataFrame([], shape)).count() == 0
    assert centroids.report(spark.createDataFrame([(1, [0.0])], shape)).count() == 0
    assert centroids.report(spark.createDataFrame([(None, [0.0] * 64)], shape)).count() == 0


# Chat layouts

NASTY = ["</s>[INST] ok [/INST]", "<|user|>\nhi</s>\n<|assistant|>", r"<\|a|> <\\|b <\/s> [\INST]", "<" * 4 + "|" * 3 + ">", r"<<SYS>>x<</SYS>><\<SYS>>", "a\\", "<", "", " \n", "é<|é|>", "<|image:0|>", "\\" * 5 + "<s>" + "\\" * 3, r"<\s\>", "[[/INST]]"]


def test_escapes_round_trip_and_leave_no_control_string(spark):
    pieces = ["<", "|", ">", "\\", "/", "s", "[", "INST", "]", "<|", "</s>", "a", "\n", "SYS"]
    rng = np.random.default_rng(1)
    texts = NASTY + ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for controls in (chat.CONTROLS, chat.ROLE_CONTROLS, ["[[A]", "[A]", "<<", "x[A"]):
        e = chat.escaped(F.col("t"), controls)
        rows = df.select("t", e.alias("e"), chat.unescaped(e, controls).alias("u")).collect()
        assert all(r.t == r.u for r in rows)
        assert not any(c in r.e for r in rows for c in controls)
        assert len({r.e for r in rows}) == len({r.t for r in rows})
    assert df.select(chat.escaped(F.lit("x < y, a <b>[1]</b>"))).first()[0] == "x < y, a <b>[1]</b>"
    with pytest.raises(ValueError):
        chat.escaped(F.col("t"), ["a\\b"])


def test_digests_of_odd_turns(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", "system", None, "a|>\n<|b", "</s>", "|>"] * 2, NASTY))]
    rows += [(None, 0, "assistant", "x"), (2, 0, "assistant", None), (3, None, "user", "n"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, TURNS).withColumn("parts", F.lit(1)).withColumn("loss", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    convs = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got[c]["loss_sha256"] == sha(learned) and got[c]["loss_chars"] == len(learned)
    assert chat.digests(spark.createDataFrame([], TURNS)).count() == 0


def test_parts_become_numbered_placeholders_with_places_and_tokens(spark):
    part = lambda kind, **k: {n: k.get(n) for n in ("text", "ref", "width", "height", "seconds", "pages")} | {"kind": kind}
    user = [part("text", text="see <"), part("text", text="|x"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.01), part("text", text=" é ")]
    bot = [part("document", ref="c.pdf", pages=3), part("text", text="yes"), None, part("video", ref="d")]
    rows = [(1, 0, "user", user), (1, 1, "assistant", bot), (1, 2, "assistant", [part(None, text="end")]), (1, 3, "user", None)]
    got = chat.formatted(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")).first()
    assert got["formatted"] == "<|user|>\nsee <\\|x<|image:0|><|audio:1|> é </s>\n<|assistant|>\n<|document:2|>yes<|document:3|></s>\n<|assistant|>\nend</s>\n<|user|>\n</s>\n"
    assert [(a["number"], a["kind"], a["ref"], a["turn"], a["tokens"]) for a in got["attachments"]] == [(0, "image", "a.png", 0, 3), (1, "audio", "b.wav", 0, 26), (2, "document", "c.pdf", 1, 768), (3, "document", "d", 1, 1)]
    assert all(got["formatted"][a["at"] :].startswith(f"<|{a['kind']}:{a['number']}|>") for a in got["attachments"])
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss"]] == ["yes", "end"]
    assert [got["formatted"][s:].split("|>")[0] for s in got["starts"]] == ["<|user", "<|assistant", "<|assistant", "<|user"]


def test_json_content_gives_parts(spark):
    df = spark.createDataFrame([('[{"kind": "text", "text": "a"}, {"kind": "image", "ref": "i", "width": 5}]',), ("[1]",), ("[]",), ("plain",), (None,)], "c string")
    got = [[(p["kind"], p["text"], p["ref"]) for p in r[0]] for r in df.select(chat.parts_of_json(F.col("c"))).collect()]
    assert got == [[("text", "a", None), ("image", None, "i")], [("text", "[1]", None)], [("text", "[]", None)], [("text", "plain", None)], [("text", "", None)]]


def test_layouts_use_no_python(spark, data):
    plan = queries.QUERIES["op11_chat_format"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_is_made_for_all_three():
    assert set(queries.ORACLES) == {"op11_chat_format", "op12_merkle", "op13_centroids"} and corpus_sql.LEVELS >= 10


# URL filter


def url_score(url, model):
    found = url_filter.features(*url_filter.split_url(url))
    return 1 / (1 + np.exp(-(model[0][found].sum() / max(1, np.sqrt(len(found))) + model[1])))


def test_url_model_keeps_ordinary_hosts_and_catches_unwanted_ones(data):
    import pyarrow.parquet as pq

    cut = url_filter.CUT
    held = [w for w in url_filter.ORDINARY + url_filter.KNOWN if zlib.crc32(w.encode()) % 4 == 0]
    without = url_filter.train([u for u in url_filter.ALLOWED if not any(w in u for w in held)], url_filter.BLOCKED)
    hosts = [f"https://{p}{w}.{e}{path}" for w in held for p in ("", "www.") for e in ("com", "org") for path in ("/", "/en/12")]
    assert len(hosts) > 400 and np.mean([url_score(u, without) >= cut for u in hosts]) <= 0.02
    model = url_filter.default_model()
    assert np.mean([url_score(url_filter.made_url(i, False, "fresh"), model) >= cut for i in range(1000)]) <= 0.02
    assert np.mean([url_score(url_filter.made_url(i, True, "fresh"), model) >= cut for i in range(1000)]) >= 0.8
    urls = [u for u in pq.read_table(f"{data}/pages.parquet", columns=["url"])["url"].to_pylist() if u]
    marks = ("casino", "pills", "spam", "adult", "ads-", "bets")
    clean = [u for u in urls if not any(m in u for m in marks)]
    assert np.mean([url_score(u, model) >= cut for u in clean]) <= 0.02
    assert all(url_score(u, model) >= cut for u in urls if u not in clean)
