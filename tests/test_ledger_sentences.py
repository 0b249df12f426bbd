"""Model calls that are interrupted and resumed; sentences that slice word timings."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cuelake.operators import chunks, ledger


def test_waits_and_tries():
    slept, said = [], ["503 busy", "UNAVAILABLE", None]

    def model(texts):
        if fault := said.pop(0):
            raise ValueError(fault)
        return [t.upper() for t in texts]

    assert ledger.asked(model, ["a"], sleep=slept.append) == (["A"], 3, None) and slept == [2, 4]
    slept.clear()
    said[:] = ["429"] * 9
    assert ledger.asked(model, ["a"], sleep=slept.append) == (None, 5, "ValueError: 429") and slept == [2, 4, 8, 16]
    said[:] = ["401 not allowed"]
    assert ledger.asked(model, ["a"], sleep=slept.append)[:2] == (None, 1)
    counts = iter([["x"], ["x", "y", "z", "w"], ["x"]])
    assert ledger.asked(lambda t: next(counts), ["a", "b"]) == (["x", "b"], 3, None)


ROWS = "doc_id bigint, seg_idx int, text string, batch string"


def logging(folder, fail=None):
    """A model that notes its calls in files, and fails as told for texts that hold ``fail``."""

    def model(texts):
        with open(os.path.join(folder, "calls"), "a") as f:
            f.write(f"{texts[0]}\n")
        if fail and any(fail in t for t in texts) and not os.path.exists(os.path.join(folder, "mended")):
            if fail == "kill":
                os._exit(1)
            raise RuntimeError("403 not allowed")
        return [t + "!" for t in texts]

    return model


@pytest.mark.parametrize("fail", ["bad", "kill"])
def test_a_stopped_run_is_resumed_without_asking_twice(spark, tmp_path, fail):
    texts = [(d, k, f"{d}-{k}" if (d, k) != (2, 5) else fail, "x") for d in range(4) for k in range(9)]
    rows = spark.createDataFrame([*texts, (5, 0, None, None), (None, 0, "none", None)], ROWS)
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    model = logging(str(tmp_path), fail)
    with pytest.raises(ledger.LedgerError if fail == "bad" else Exception):
        book.fill(rows, model, size=3, per_round=2)
    first = book.done().count()
    assert 0 < first < 14 and (fail == "kill" or first == 13)
    before = (tmp_path / "calls").read_text().split("\n")[:-1]
    (tmp_path / "mended").write_text("")
    assert book.fill(rows, model, size=3, per_round=5) == 14 - first
    after = (tmp_path / "calls").read_text().split("\n")[:-1][len(before) :]
    assert len(after) == 14 - first and book.fill(rows, model, size=3) == 0
    if fail == "bad":
        assert after == ["2-3"] and sorted(before).count("2-3") == 1
    got = {(r.doc_id, r.seg_idx): (r.text, r.answer, r.batch) for r in book.answers(rows, "answer", size=3).collect()}
    assert len(got) == 38 and all(a == (t or "") + "!" for t, a, _ in got.values())


def test_an_empty_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([(1, 0, "a", None)], ROWS)
    assert book.done().count() == 0 and book.fill(rows.limit(0), str) == 0
    assert [r.answer for r in book.answers(rows, "answer").collect()] == [None]


WORDS = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string, words array<struct<symbol: string, start_ms: bigint, end_ms: bigint>>"


def test_each_word_belongs_to_one_sentence(spark):
    w = lambda *s: [(x, 100 * k, 100 * k + 90) for k, x in enumerate(s)]
    rows = [
        (1, 0, 0, 1000, "One two. Three! Four five", w("One", "two", ".", "Three", "!", "Four", "five")),
        (1, 1, 0, 1000, "Was it? Yes", None),
        (1, 2, 0, 1000, "It's 3.5 now. Go on", w("“", "It's", "3.5", "now.", "Go on")),
        (1, 3, 0, 1000, "A. B. C", w("ABC")),
        (1, 4, 0, 1000, "你好。 再见", w("你", "好", "再", "见", "!")),
        (1, 5, 0, 1000, None, w("x")),
        (1, 6, 0, 1000, "", []),
    ]
    got = {(r.seg_idx, r.part): (r.text, r.start_ms, r.end_ms, [x.symbol for x in r.words or []]) for r in chunks.sliced_sentences(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {
        (0, 0): ("One two.", 0, 290, ["One", "two", "."]),
        (0, 1): ("Three!", 300, 490, ["Three", "!"]),
        (0, 2): ("Four five", 500, 690, ["Four", "five"]),
        (1, 0): ("Was it?", 0, 700, []),
        (1, 1): ("Yes", 700, 1000, []),
        (2, 0): ("It's 3.5 now.", 0, 390, ["“", "It's", "3.5", "now."]),
        (2, 1): ("Go on", 400, 490, ["Go on"]),
        (3, 0): ("A.", 0, 90, ["ABC"]),
        (3, 1): ("B.", 400, 800, []),
        (3, 2): ("C", 800, 1000, []),
        (4, 0): ("你好。", 0, 190, ["你", "好"]),
        (4, 1): ("再见", 200, 490, ["再", "见", "!"]),
    }


def test_words_of_sentences_are_shuffled_and_made_once(spark):
    segs = spark.createDataFrame([(1, 0, 0, 1000, "One. Two", None)], WORDS)
    made = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("symbol"), F.col("start_ms"), F.col("end_ms")))
    plan = chunks.sliced_sentences(segs.withColumn("words", made))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the sentences for their times, and both together
    assert not re.search(r"Filter .*size\(transform", plan), plan


def test_words_of_random_texts_are_all_kept_in_order(spark):
    import random

    r = random.Random(6)
    rows = []
    for i in range(60):
        symbols = [r.choice(["ab", "c", "def", "gh1"]) + r.choice(["", "", ".", "!", ","]) for _ in range(r.randint(1, 12))]
        rows.append((i, 0, 0, 5000, " ".join(symbols), [(s, 10 * k, 10 * k + 5) for k, s in enumerate(symbols)]))
    got = {}
    for x in chunks.sliced_sentences(spark.createDataFrame(rows, WORDS)).orderBy("doc_id", "part").collect():
        got.setdefault(x.doc_id, []).append((x.text, [w.symbol for w in x.words], x.start_ms, x.end_ms))
    for i, _, _, _, text, words in rows:
        want = re.split(r"(?<=[.!?])\s+", text)
        assert [t for t, *_ in got[i]] == want and [s for _, s, *_ in got[i]] == [t.split() for t in want]
        assert [x for _, _, *x in got[i]][-1][1] == words[-1][2]
