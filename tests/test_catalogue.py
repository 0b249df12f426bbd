"""Every registered query against its SQL in DuckDB, and the registry itself."""

import duckdb
import pytest

from cuelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, oracle, name):
    df = catalogue.QUERIES[name](spark, data)
    want = oracle.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_frame_scores_need_no_range_join(spark, data):
    plan = catalogue.QUERIES["frame_score_join"](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_frames_are_never_broadcast(spark, data):
    """A small table yields very many frames, which its size in bytes doesn't tell."""
    for name in ("frame_score_join", "word_score_join"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan
