"""Sequential operators: hand cases, plain models and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import alignment as A, duplicates as D, sequential as S
from cuelake.operators.chunks import fit, map_model, sample_windows, split_long
from cuelake.plans.inputs import hypothesis, segments


def cut(rows, **k):
    return list(S.cut_segments([(a, b, i, t) for i, (a, b, t) in enumerate(rows)], **k))


def test_segmenter_gap_marker_and_length():
    assert cut([(0, 1000, "a"), (1500, 2000, "b"), (7000, 8000, "c")]) == [(0, 4000, False, [0, 1]), (7000, 10000, False, [2])]
    assert cut([(0, 1000, "a"), (1200, 1400, "[Applause]"), (1500, 2000, "b")]) == [(0, 1100, False, [0]), (1200, 1400, True, [1]), (1500, 4000, False, [2])]
    assert cut([(0, 1000, "[Music]")]) == [(0, 1000, True, [0])]
    assert cut([]) == []
    long = [(i * 1000, i * 1000 + 1000, "x") for i in range(20)]
    assert [len(g[3]) for g in cut(long, max_ms=5000)] == [5, 5, 5, 5]
    calm = [(0, 4000, "a"), (5000, 5500, "b."), (5600, 5700, "c")]
    assert [g[3] for g in cut(calm, max_ms=5000)] == [[0], [1, 2]]


def test_segmenter_keeps_every_row(spark, data):
    s = segments(spark, data)
    got = S.segment(s, 20_000).select("doc_id", F.explode("seg_idxs").alias("seg_idx"))
    assert got.count() == s.count() and got.exceptAll(s.select("doc_id", "seg_idx")).count() == 0


def ops_of(a: list[str], b: list[str]):
    return A.Aligned([a], [b]).ops(0, len(a) + len(b) + 2)


def plain_distance(a, b):
    t = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(t[j - 1] + (x != y), t[j] + 1, row[-1] + 1))
        t = row
    return t[-1]


def test_edit_steps_are_least_and_complete():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randint(0, 12))], [r.choice("abc") for _ in range(r.randint(0, 12))]
        ops = ops_of(a, b)
        assert [x for x, *_ in ops if x not in (None, A.MARK)] == a and [y for _, y, _ in ops if y not in (None, A.MARK)] == b
        assert sum(o != "=" for *_, o in ops) == plain_distance(a, b)
        x, y = (np.array([ord(c) for c in t], np.int64) for t in (a, b))
        halved = A.edit_steps(x, y, cells=6)
        i, j, cost = 0, 0, 0
        for s in halved.tolist():
            cost += s != A.PAIR or x[i] != y[j]
            i, j = i + (s != A.INSERTED), j + (s != A.DELETED)
        assert (i, j, cost) == (len(x), len(y), plain_distance(a, b))


def plain_counts(pairs):
    """The counts of an alignment, pair by pair."""
    out, hidden = dict.fromkeys(("n_ins", "n_del", "n_sub", "n_cor", "ref_len"), 0), 0
    for k, (a, b, op) in enumerate(pairs):
        if hidden:
            hidden -= 1
        elif (a, b) in A.SAME_WORD:
            hidden, out["ref_len"] = 1, out["ref_len"] + 1
        elif tuple(p[:2] for p in pairs[k : k + 2]) in A.SAME_TWO:
            hidden, out["ref_len"] = 2, out["ref_len"] + 2
        elif not (a == b == A.MARK):
            out["ref_len"] += 1
            out[{"i": "n_ins", "d": "n_del", "s": "n_sub", "=": "n_cor"}[op]] += 1
    return out


def test_error_counts(spark):
    r, rows = random.Random(5), []
    words = [w for pair in A.SAME_WORD for w in pair] + ["let", "us", "'s", "do", "not", "n't", A.MARK, "a", "b"]
    two = [p for pair in A.SAME_TWO for p in pair]
    for k in range(200):
        pairs = [r.choice([(x, x), (x, y), (x, None), (None, y), r.choice(A.SAME_WORD), *two]) for x, y in zip(r.choices(words, k=12), r.choices(words, k=12))]
        if k % 3 == 0:
            pairs[3:5] = list(r.choice(A.SAME_TWO))
        rows.append((k, [(a, b, "i" if a is None else "d" if b is None else "=" if a == b else "s") for a, b in pairs]))
    df = spark.createDataFrame([*rows, (200, [])], "k int, ops array<struct<ref: string, hyp: string, op: string>>")
    got = {x.k: x.c.asDict() for x in df.select("k", A.error_counts(F.col("ops")).alias("c")).collect()}
    assert got == {k: plain_counts([tuple(p) for p in ops]) for k, ops in [*rows, (200, [])]}


def groups_of(sub, asr, **k):
    tracks = A.Aligned([t.split() for *_, t in sub], [t.split() for *_, t in asr])
    return A.group_spans(tracks, len(sub), [(s, e) for s, e, _ in asr], **k)


def test_groups_cover_both_tracks():
    sub = [(i * 3000, i * 3000 + 2000, f"word{i} and word{i}b then") for i in range(6)]
    assert [g[:4] for g in groups_of(sub, sub)] == [(i, i + 1, i, i + 1) for i in range(6)]
    assert [g[:4] for g in groups_of(sub, [])] == [(0, 6, 0, 0)] and [g[:4] for g in groups_of([], sub)] == [(0, 0, 0, 6)]
    assert groups_of([], []) == []
    # Nothing is equal, but a long silence parts the rows.
    other = [(0, 1000, "x y"), (30_000, 31_000, "u v")]
    assert [g[:4] for g in groups_of([(0, 1, "a b"), (2, 3, "c d")], other)] == [(0, 1, 0, 1), (1, 2, 1, 2)]
    # Ten equal steps at the beginning of a group's own steps, not of those before it.
    sub = [(0, 1, "a b c d e f g h i j k l m n"), (2, 3, "p q r s")]
    asr = [(0, 1, "a b c d e f g h i j k l m n"), (2, 3, "t u v w")]
    assert [g[:4] for g in groups_of(sub, asr)] == [(0, 1, 0, 1), (1, 2, 1, 2)]


def test_group_times():
    sub, asr = [(0, 1000), (5000, 6000)], [(500, 1500), (2500, 3000), (9000, 9500)]
    spans = [(0, 1, 0, 1, 0, 0), (1, 2, 1, 1, 0, 0), (2, 2, 1, 3, 0, 0)]
    assert A.group_times(spans, sub, asr) == [(0, 1000, 500, 2000), (5000, 6000, 2000, 2500), (6000, 8000, 2500, 9500)]


def test_self_alignment_has_no_errors(spark, data):
    s = segments(spark, data)
    got = A.align(s, s)
    assert got.where("wer > 0").count() == 0
    assert got.agg(F.sum(F.col("sub_hi") - F.col("sub_lo"))).first()[0] == s.count()
    other = A.align(s, hypothesis(spark, data))
    assert other.agg(F.sum(F.col("asr_hi") - F.col("asr_lo"))).first()[0] == s.count()
    turns = A.best_first(other).groupBy("doc_id").agg(F.max("turn").alias("m"), F.count("*").alias("n")).where("m + 1 <> n")
    assert turns.count() == 0


def test_long_tracks_fit_a_bounded_table(spark):
    r = random.Random(6)
    a = [r.choice(("one", "two", "three", "four")) + str(r.randrange(400)) for _ in range(9000)]
    b = [w for w in a if r.random() > 0.1]
    assert sum(o != "=" for *_, o in ops_of(a, b)) == len(a) - len(b)


def test_transfer_times_moves_forward():
    ref = [(1000, 3000, "hello world this is a test"), (5000, 8000, "another line of words here"), (9000, 9500, "hello world again")]
    rows = [(0, 1, ["hello world this is a test", "hello world this"]), (0, 1, ["nothing like it"]), (0, 1, ["hello world"])]
    assert S.transfer_times(rows, ref) == [(1000, 0, True), (1000, 8000, False), (9000, 500, True)]
    assert S.transfer_times([(5, 9, ["x"])], []) == [(5, 0, False)]
    assert S.transfer_times([(20_000, 20_700, ["no such words"])], ref) == [(20_000, 700, False)]
    assert S.transfer_times([(20_000, 20_020, ["no such words"])], ref) == [(20_000, 100, False)]


def plain_blocks(rows, least=10, chars=20, reach=300, ms=300_000):
    """All maximal runs of equal words by comparing every two places, then the longest ones that share no word."""
    words = [(w, k) for k, (_, _, t) in enumerate(rows) for w in t.lower().split()]
    n, runs = len(words), []
    for gap in range(1, min(reach, n - 1) + 1):
        a = 0
        while a + gap < n:
            k = 0
            while a + gap + k < n and words[a + k][0] == words[a + gap + k][0]:
                k += 1
            if k >= least and sum(len(w) for w, _ in words[a : a + k]) >= chars and abs(rows[words[a + gap][1]][0] - rows[words[a][1]][0]) <= ms:
                runs.append((k, a, a + gap))
            a += max(k, 1)
    taken, out = set(), []
    for k, a, b in sorted(runs, key=lambda x: (-x[0], x[1], x[2])):
        span = {*range(a, a + k), *range(b, b + k)}
        if span & taken:
            continue
        taken |= span
        first, second = (words[a][1], words[a + k - 1][1]), (words[b][1], words[b + k - 1][1])
        if first != second:
            out.append((*first, *second, k))
    return sorted(out)


def frame(spark, docs):
    rows = [(d, i, s, e, t) for d, track in docs.items() for i, (s, e, t) in enumerate(track)]
    return spark.createDataFrame(rows, "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string")


def test_duplicate_blocks(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(0, 1000, text), (2000, 3000, "some words between these two blocks stand alone here now"), (5000, 5500, text), (7000, 8000, "the end of it all with more words")]
    chinese = "我刚刚把它做成了主动式的所以我添加了一个提示词最初只是一个提示词每半小时给我一个惊喜"
    parallel = "这使得GPT-4o能够接受文本、音频和图像的任意组合作为输入，并生成文本、音频和图像的任意组合的输出。"
    docs = {
        1: rows,
        2: rows[:2],
        3: [rows[0], (400_000, 401_000, text), rows[3]],
        4: [(0, 5, chinese), (5, 8, "这是一段过渡文字"), (8, 12, chinese), (12, 17, "结束语在这里")],
        5: [(0, 5, "这是开头的一段话用来填充"), (5, 15, parallel), (15, 20, "是兼具了听觉视觉的多模态模型")],
        6: [(0, 5, "Some context before it"), (5, 10, "Claude spelled with a W-C-L-A-U-D-E."), (10, 13, "A bridge between"), (13, 20, "Versus C-L-A-U-D-E from there.")],
        7: [(0, 1, None), (1, 2, "")],
    }
    got = {}
    for r in D.dup_blocks(frame(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.first_lo, r.first_hi, r.second_lo, r.second_hi, r.matched_words, r.time_gap_ms))
    assert got.pop(1) == [(0, 0, 2, 2, 12, 5000)]
    assert [x[:4] for x in got.pop(4)] == [(0, 0, 2, 2)] and not got
    kept = {(r.doc_id, r.seg_idx) for r in D.deduplicated(frame(spark, docs)).collect()}
    assert (1, 0) in kept and (1, 2) not in kept  # the second copy is shorter in time
    assert (4, 2) not in kept and sum(d == 3 for d, _ in kept) == 3


def test_duplicate_blocks_against_every_two_places(spark):
    r, docs = random.Random(9), {}
    for d in range(25):
        vocabulary = [f"w{i}x" for i in range(6 if d % 5 == 0 else 300)]
        lines = [" ".join(r.choices(vocabulary, k=r.randint(1, 15))) for _ in range(30)]
        for _ in range(4):
            a = r.randrange(20)
            lines.insert(r.randrange(len(lines)), " ".join(lines[a : a + r.randint(1, 4)]))
        docs[d] = [(i * 1000, i * 1000 + 900, t) for i, t in enumerate(lines)]
    got = {}
    for x in D.dup_blocks(frame(spark, docs)).collect():
        got.setdefault(x.doc_id, []).append((x.first_lo, x.first_hi, x.second_lo, x.second_hi, x.matched_words))
    assert {d: sorted(v) for d, v in got.items()} == {d: p for d, t in docs.items() if (p := plain_blocks(t))}


def test_duplicate_blocks_of_one_line_over_and_over(spark):
    """Each word comes again at every distance: neither words nor their pairs become rows, and results stay those of comparing every two places."""
    docs = {d: [(i * 1000, i * 1000 + 900, "over and over again") for i in range(90)] + [(200_000 * d, 200_000 * d + 900, "over and over again")] for d in (1, 2, 3)}
    docs[4] = [(0, 1, "only a few words")]
    found = D.dup_blocks(frame(spark, docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan, plan
    got = {}
    for x in found.collect():
        got.setdefault(x.doc_id, []).append((x.first_lo, x.first_hi, x.second_lo, x.second_hi, x.matched_words))
    assert {d: sorted(v) for d, v in got.items()} == {d: p for d, t in docs.items() if (p := plain_blocks(sorted(t)))}
    untimed = frame(spark, docs).selectExpr("doc_id", "seg_idx", "if(seg_idx < 200, null, start_ms) start_ms", "end_ms", "text")
    assert D.dup_blocks(untimed).count() == 0  # copies whose times aren't known aren't near each other


def test_chunk_text():
    text = "\n".join(f"line {i:03d}" for i in range(100))
    parts = S.chunk_text(text, 100, 30, 50)
    assert all(len(p) <= 100 for p in parts) and parts[0].startswith("line 000") and parts[-1].endswith("line 099")
    for a, b in zip(parts, parts[1:]):
        assert b.split("\n")[:3] == a.split("\n")[-3:]
    assert len(S.chunk_text(text, 100, 30, 4)) == 4
    assert S.chunk_text("x" * 500, 100) == ["x" * 500] and S.chunk_text(None) == [""]


def test_chunks_hold_all_lines_of_a_long_text(spark):
    """A text of some forty chunks: put together without what they repeat they are the text again."""
    lines = [f"line {i:05d}" for i in range(5000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")
    parts = [x.chunk.split("\n") for x in S.chunks(docs, size=2000, overlap=400).orderBy("chunk_idx").collect()]
    whole = parts[0][:]
    for part in parts[1:]:
        whole += part[part.index(whole[-1]) + 1 :]
    assert len(parts) > 30 and whole == lines


def group(start, status, rows=(), source=()):
    return {"start": start, "end": start + 10, "status": status, "rows": list(rows), "source": list(source)}


def test_merge_retry_directions_and_fallback():
    calls = []

    def align(start, end, rows):
        calls.append((start, end, tuple(rows)))
        return [f"ok{len(rows)}"] if len(rows) == 3 else None

    out = S.merge_retry([group(0, "fail", source="a"), group(20, "skip", ["s"]), group(40, "ok", ["b"], "b"), group(60, "ok", ["c"], "c")], align)
    assert calls == [(0, 50, ("a", "b")), (0, 70, ("a", "b", "c"))]
    assert [(g["status"], g["rows"]) for g in out] == [("ok", ["ok3"]), ("skip", ["s"]), ("ok", []), ("ok", [])]
    back = S.merge_retry([group(0, "ok", ["x"], "x"), group(20, "ok", ["y"], "y"), group(40, "fail", source="z")], align)
    assert [g["rows"] for g in back] == [["ok3"], [], []]
    none = S.merge_retry([group(0, "fail", source="a"), group(20, "ok", ["b"], "b")], lambda *_: None)
    assert [(g["status"], g["rows"]) for g in none] == [("raw", ["a"]), ("ok", ["b"])]


def test_model_map_repeats_and_fills(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(7)], "doc_id bigint, seg_idx int, text string").coalesce(1)
    out = map_model(rows, lambda texts: [t.upper() for t in texts][: 2 if len(texts) == 3 else None], "up", size=3).orderBy("seg_idx").collect()
    assert [r.up for r in out] == ["T0", "T1", "t2", "T3", "T4", "t5", "T6"]
    assert fit(["a", "b", "c"], ["x", "y"]) == ["a", "b"]


def test_windows_reject_full_overlap(spark):
    with pytest.raises(ValueError):
        sample_windows(F.lit(10), 5, 5)
    cut_ = split_long(spark.createDataFrame([(1, 0, 2500), (2, 5, 5)], "doc_id bigint, start_ms bigint, end_ms bigint"), 1000).orderBy("doc_id", "piece").collect()
    assert [(r.start_ms, r.end_ms) for r in cut_] == [(0, 1000), (1000, 2000), (2000, 2500), (5, 5)]


TEXTS = {
    "Hello世界": ["Hello", "世", "界"],
    "I'm fine": ["I'm", "fine"],
    "up $1,234.5M and 25% of 100,000 [APPLAUSE].": ["up", "$1,234.5M", "and", "25%", "of", "100,000", "[APPLAUSE]", "."],
    "Kühl ß €42": ["Kühl", "ß", "€42"],
    "a\nb": ["a", "b"],
}


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.tokens(F.col("t")).alias("x"), T.attach_punctuation(T.tokens(F.col("t"), True)).alias("y"))
    got = {r.t: r for r in df.collect()}
    assert {t: r.x for t, r in got.items()} == TEXTS
    assert got["up $1,234.5M and 25% of 100,000 [APPLAUSE]."].y[-1] == "[APPLAUSE]."


def test_text_rules(spark):
    def one(expr):
        return spark.range(1).select(expr.alias("x")).first().x

    lit = F.lit
    assert one(T.normalize(lit("<i>it&#39;s</i>  a &amp; b’s"))) == "it's a & b's"
    assert one(T.match_keys(lit("one two three four"))) == ["one two three", "one two thre", "one tw"]
    assert one(T.asr_tag(lit("language English<asr_text>Hi </asr_text>"))) == ("English", "Hi")
    assert one(T.asr_tag(lit("<|de|> Hallo"))) == ("de", "Hallo") and one(T.asr_tag(lit(" x "))) == (None, "x")
    assert one(T.json_payload(lit('<think>{</think>```json\n[{"a":1}{"b":2,}]\n```'))) == '[{"a":1},{"b":2}]'
    assert one(T.json_payload(lit('[{"a":1},{"b"'))) == '[{"a":1}]'
    assert one(T.clean_role(lit("head of design, and"))) == "head of design"
    assert one(T.looks_like_person(lit("Blaise Agüera y Arcas"))) and not one(T.looks_like_person(lit("EWTN News")))
    assert one(T.ends_sentence(lit("好。"))) and one(T.ends_sentence(lit("مرحبا؟"))) and not one(T.ends_sentence(lit("")))
    assert one(T.is_punctuation(lit("—"))) and not one(T.is_punctuation(lit("é")))
    assert one(T.yaml_escape(lit('a"b\\'))) == 'a\\"b\\\\'


# Long tracks: anchors


def plain_cost(x, y):
    """Edit distance in which a mark meets no word."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            pair = row[j] + (0 if a == b else 3 if A.MARK in (a, b) else 1)
            new.append(min(pair, row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def track_of(words, lengths, doc=1):
    rows, at, k = [], 0, 0
    while at < len(words):
        n = lengths[k % len(lengths)]
        rows.append((doc, k, at * 100, (at + n) * 100, " ".join(words[at : at + n])))
        at, k = at + n, k + 1
    return rows


SEGS = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string"


def steps_by_document(spark, sides, stretch):
    tracks = A._placed(spark.createDataFrame(sides[0], SEGS), 0).unionByName(A._placed(spark.createDataFrame(sides[1], SEGS), 1))
    out = {}
    for r in sorted(A.long_steps(tracks, stretch=stretch).collect(), key=lambda r: (r.doc_id, r.part)):
        out.setdefault(r.doc_id, []).append(np.frombuffer(r.steps, np.int8))
    return out


def test_anchored_steps_cost_as_little_as_the_plain_method(spark):
    rng = np.random.default_rng(11)
    ref, hyp, plain = [], [], {}
    for doc in range(8):
        words = [f"w{x}" for x in rng.integers(0, 60 if doc % 2 else 400, 260)]
        other = [w if rng.random() > 0.15 else f"x{rng.integers(0, 9)}" for w in words if rng.random() > 0.08]
        a, b = track_of(words, [7, 4, 9], doc), track_of(other, [5, 8], doc)
        ref, hyp = ref + a, hyp + b
        flat = lambda rows: [w for r in rows for w in (*r[4].split(), A.MARK)]
        plain[doc] = flat(a), flat(b)
    got = steps_by_document(spark, (ref, hyp), 40)
    assert set(got) == set(plain)
    assert sum(len(parts) for parts in got.values()) > 30
    for doc, parts in got.items():
        x, y = plain[doc]
        i = j = cost = 0
        for s in np.concatenate(parts):
            if s == A.PAIR:
                assert (x[i] == A.MARK) == (y[j] == A.MARK)
                cost += x[i] != y[j]
            else:
                cost += 1
            i, j = i + (s != A.INSERTED), j + (s != A.DELETED)
        assert (i, j) == (len(x), len(y)) and cost == plain_cost(x, y)


def test_documents_without_anchors_or_without_a_second_track_are_whole_parts(spark):
    same = track_of(["ja"] * 90, [9])
    alone = track_of([f"w{k}" for k in range(90)], [9], 2)
    got = steps_by_document(spark, (same + alone, track_of(["ja"] * 80, [8])), 40)
    assert {d: len(p) for d, p in got.items()} == {1: 1, 2: 1}
    assert (got[2][0] == A.DELETED).all() and len(got[2][0]) == 100
    assert not steps_by_document(spark, (same, same), 1000)


def test_groups_of_cut_documents_equal_those_of_whole_ones(spark):
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 5000, 900)]
    other = [w for w in words if rng.random() > 0.05]
    a, b = spark.createDataFrame(track_of(words, [8]), SEGS), spark.createDataFrame(track_of(other, [6, 11]), SEGS)
    errors = F.size(F.flatten(F.collect_list(F.filter("ops", lambda o: o["op"] != "="))))
    show = lambda stretch: A.grouped_ops(a, b, stretch=stretch).agg(errors.alias("n"), F.sum(F.size("ops")) > 0).collect()
    assert show(60) == show(10**6)
    assert A.grouped_ops(a, a, stretch=60).agg(F.sum(F.size(F.filter("ops", lambda o: o["op"] != "=")))).first()[0] == 0


def test_tokens_of_long_tracks_are_never_rows(spark):
    """Segments travel once, as they are: rows of tokens took many times the room of the texts."""
    words = [f"w{k}" for k in range(3000)]
    a, b = spark.createDataFrame(track_of(words, [9]), SEGS), spark.createDataFrame(track_of(words[::2], [7]), SEGS)
    got = A.grouped_ops(a, b, stretch=100)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "ReusedExchange" in plan, plan


def test_rising_chain_is_longest():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 40):
        for _ in range(20):
            y = rng.permutation(n)
            got = A.rising_chain(np.arange(n), y)
            best = [1] * n
            for i in range(n):
                best[i] += max((best[j] for j in range(i) if y[j] < y[i]), default=0)
            assert len(got) == max(best, default=0) and (np.diff(y[got]) > 0).all() and (np.diff(got) > 0).all()


def test_equal_endings_need_no_table_and_steps_stay_least():
    """Words that both tracks end in are pairs at once; ties still prefer a pair, then a deletion, from the end on."""

    same = np.arange(1, 200_001) % 1999
    assert not A.edit_steps(same, same, cells=len(same) ** 2 + 1).any()  # a table would take 160 GB
    x, y = np.array([1, 1, 0, 2, 0]), np.array([1, 0, 3, 0])
    assert A.edit_steps(x, y).tolist() == [1, 0, 0, 0, 0]


def test_chunks_leave_a_worker_few_texts_at_a_time():
    """Whatever a batch holds, the chunks of at most so many texts are held at once."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "text": [None, *["one line\nanother"] * 119]})
    parts = list(S.chunks(Rows(), size=9, overlap=0)(iter([batch])))
    assert [len(set(p["doc_id"].to_pylist())) for p in parts] == [50, 50, 20]
    assert [len(p) for p in parts] == [99, 100, 40] and parts[0]["chunk"].to_pylist()[:3] == ["", "one line", "another"]
