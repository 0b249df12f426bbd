"""Results that earlier versions cut short: each against brute force or fixed rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cuelake.llm import decontaminate, paragraphs, pii, simhash
from test_corpus_operators import plain_components, prose


def roots_of(spark, rows, **options):
    return {x.doc_id: x.root for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()}


def test_near_duplicates_with_block_edits(spark):
    """Appended, truncated and block-edited copies at a similarity of 0.80 to 0.85."""
    r, rows, pairs = random.Random(11), [], []
    for g in range(150):
        n = r.choice((200, 400, 1000))
        base = prose(7000 + g, n).split()
        other = prose(9000 + g, n).split()
        cut = r.randrange(n - n // 11)
        copy = (base + other[: n * 22 // 100], base[: n * 83 // 100], base[:cut] + other[: n * 9 // 100] + base[cut + n * 9 // 100 :])[g % 3]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        s, t = (set(simhash.shingle_set(x, 5)) for _, x in rows[-2:])
        if len(s & t) >= 0.8 * len(s | t):
            pairs.append((2 * g, 2 * g + 1))
    got = roots_of(spark, rows)
    assert len(pairs) > 120
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_near_duplicates_in_a_crowd(spark):
    """Pairs of near copies among 800 texts that share most of a passage and crowd its band values; 40 texts of blanks."""
    base, rows = prose(1, 200).split(), []
    for g in range(400):
        own, other = prose(20000 + g, 20).split(), prose(30000 + g, 14).split()
        words = base[:50] + own + base[70:]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:120] + other + words[134:]))]
    sets = {i: frozenset(simhash.shingle_set(t, 5)) for i, t in rows}
    want = plain_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = roots_of(spark, [*rows, *[(1000 + k, " " * k) for k in range(40)]])
    groups = lambda of: {frozenset(i for i in sets if of[i] == r) for r in {of[i] for i in sets}}
    assert groups(got) == groups(want) and 300 < len(groups(want)) < 500
    assert len({got[1000 + k] for k in range(40)}) == 1


def test_items_that_many_documents_leak(spark):
    """An item in two documents of five, and one in a corpus of six documents."""
    item = [" ".join(f"{w}{j}" for j in range(40)) for w in ("some", "other")]
    items = spark.createDataFrame(list(enumerate(item)), "item_id bigint, text string")
    for n, every in ((200, 5), (6, 6)):
        rows = [(i, f"{prose(i + 1000, 60)} {item[0] if i % every in (0, 3) else ''} {prose(i + 5000, 37)}") for i in range(n)]
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
        assert got == {(i, 0) for i in range(n) if i % every in (0, 3)}


def test_the_space_is_fitted_on_all_documents(spark):
    """3,000 documents and the benchmark: the space equals that of all their passages, from dense products."""
    r, n, rank = random.Random(5), 14, 6  # no more words than directions are tried: nothing is left to chance
    vocabulary = {f"w{k}": k for k in range(n)}
    some = lambda size: " ".join(f"w{min(int(r.expovariate(0.3)), n + 9)}" for _ in range(size))
    texts, items = [some(r.randint(0, 90)) for _ in range(3000)], [decontaminate.Item(k, " ".join(r.choices(list(vocabulary), k=20))) for k in range(5)]
    for item in items:
        item.index(vocabulary, np.ones(n, np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    numbers = decontaminate.numbered(docs, vocabulary, ["doc_id"])
    assert (decontaminate.document_frequencies(numbers, n) == [sum(w in set(t.split()) for t in texts) for w in vocabulary]).all()
    weights, share = 1 + np.arange(n) / n, 0.5

    def square(words):
        total = np.zeros((n, n))
        for t in words:
            for at in range(0, max(1, len(t)), 16):
                row = np.bincount([vocabulary[w] for w in t[at : at + 32] if w in vocabulary], minlength=n).astype(float)
                total += np.outer(row, row)
        return total

    whole = square([i.words for i in items]) + share * square([t.split() for t in texts])
    best = np.linalg.eigh(weights[:, None] * whole * weights)[1][:, -rank:]
    got = decontaminate.latent_space(numbers, items, weights, share, rank) / weights[:, None]
    assert np.abs(got @ got.T - best @ best.T).max() < 1e-3


def test_paraphrases_at_any_place(spark):
    """Items of which 62 % of the words are kept, put into texts that use the same words."""
    r, items, rows = random.Random(8), [], []
    words = [f"{a}{b}{c}" for a in ("bar", "do", "kil", "lu", "men") for b in ("ta", "ro", "si", "ne") for c in range(20)]
    for k in range(120):
        item = [r.choice(words) for _ in range(r.randint(20, 55))]
        drop = set(r.sample(range(len(item)), int(0.38 * len(item))))
        answer = [w for i, w in enumerate(item) if i not in drop][-2:]
        items.append((k, " ".join([*item, "answer:", *answer])))
        about = [r.choice(words) for _ in range(150)]
        at = r.randrange(150)
        kept = [r.choice(words) if i in drop else w for i, w in enumerate(item)]
        rows.append((k, " ".join([*about[:at], *kept, "answer:", *answer, *about[at:]])))
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert sum((k, k) in got for k in range(120)) >= 0.98 * 120


@pytest.mark.parametrize(
    "text, masked",
    [
        ("jane@mail.exаmple.com", "<EMAIL>"),
        ("jаne@example.com", "<EMAIL>"),
        ("jane@mail.ex\u200bample.com", "<EMAIL>"),
        ("+1 555 one two three four five six", "<PHONE>"),
        ("call +1 five five five five five five five five five five", "call <PHONE>"),
        ("one nine two dot one six eight dot one dot one", "<IP>"),
        ("192.168.one.one", "<IP>"),
        ("at (four)-one-one-one 1111 1111 1111 one", "at (four)-one-one-one 1111 1111 1111 one"),
        ("card four 111 1111 1111 111 one", "card <CARD>"),
        ("mail one two@x.org or 555 five", "mail one <EMAIL> or 555 five"),
        ("one\tdot\ttwo dot three dot four", "<IP>"),
    ],
)
def test_disguises_beside_base_spans(text, masked):
    base, every = pii.spans(text)
    assert set(base) <= set(every) and pii.redact(text, every) == masked


def test_scratch_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """A file below Spark's broadcast limit may hold rows that the driver can't: joins of such tables are shuffled, and the settings come back."""
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter
    from cuelake.llm import common

    some = common.scratch(spark.range(400_000).select("id", F.xxhash64("id").alias("h")), "grows")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "10m")
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    try:
        assert common.scratch(some.join(some.select("h", F.col("id").alias("other")), "h"), "joined").count() == 400_000
        assert spark.conf.get(setting) == "10m"
    finally:
        spark.conf.unset(setting)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    assert [common.in_bytes(x) for x in ("10485760b", "10m", "1 KB", "-1", "7")] == [10 << 20, 10 << 20, 1024, -1, 7]


def test_scores_of_many_pairs_equal_those_of_each():
    """Owners with and without shingles that repeat, and shorter ones than a paragraph."""
    r = np.random.default_rng(3)
    sides = [[], []]
    for k in range(120):
        x = r.integers(1, 30 if k % 5 == 0 else 10**9, r.integers(5, 130))
        y = np.concatenate((x[: len(x) * (k % 4) // 3], r.integers(1, 10**9, r.integers(5, 60))))
        for side, words in zip(sides, (x, y)):
            side.append(np.concatenate((words, words[:9])) if k % 7 == 0 else words)
    want = []
    for pair in zip(*sides):
        u, v = (paragraphs.shingle_hashes(w.astype(np.uint64)) for w in pair)
        want.append(sum(int(paragraphs.best_scores_with_repeats(np.isin(a, b)[None], paragraphs.place_before(a))[0]) for a, b in ((u, v), (v, u))))
    got = paragraphs.scores_of_pairs([pa.array(side, pa.list_(pa.int64())) for side in sides])
    assert got.tolist() == want and min(want) < -(1 << 30) < max(want) and max(want) > 0
    assert len(paragraphs.scores_of_pairs([pa.array([], pa.list_(pa.int64()))] * 2)) == 0
