"""Hosts and guests from contexts, rule by rule."""

import pytest

from cuelake.operators import names

CASES = [
    (None, {}),
    ("", {}),
    ("Channel/Host: Zhang San\nTitle: Some Episode", {"host": ["Zhang San"]}),
    ("Channel/Host: Tech Podcast\n", {}),
    ("Channel/Host: MLST\n", {}),
    ("Channel/Host: Old Harbour Street Talk\n", {}),
    ("Channel/Host: The Notes Of A Cook\n", {}),
    ("Channel/Host: Nomade\n", {}),
    ("Channel/Host: Max Keller Clips\n", {"host": ["Max Keller"]}),
    ("Channel/Host: Birch Capital\n", {}),
    ("Channel/Host: Drago Nilsen\n", {"host": ["Drago Nilsen"]}),
    ("Title: Li Si — Boats of the North\n", {"guest": ["Li Si"]}),
    ("Title: #42 Wang Wu — New Boats\n", {"guest": ["Wang Wu"]}),
    ("Title: How things are made - Ann Lee Podcast #3\n", {"guest": ["Ann Lee"]}),
    ("Title: A Long Evening About Boats\n", {}),
    ("Title: Ted's 90% Day — Jon Park & Lea Stone\n", {"guest": ["Ted's 90% Day"]}),  # the conjoined names are none
    ("【主播】张三\n【嘉宾】李四\n", {"host": ["张三"], "guest": ["李四"]}),
    ("【主播】\n张三\n\n其他内容", {"host": ["张三"]}),
    ("【嘉宾】\n王五，AI研究员\n赵六，数据科学家\n\n", {"guest": ["王五", "赵六"]}),
    ("[主持]\n陈七\n\n", {"host": ["陈七"]}),
    ("Nina Berg and Olaf Dahl are joined by Pia Falk in this episode.", {"host": ["Nina Berg", "Olaf Dahl"], "guest": ["Pia Falk"]}),
    ("【嘉宾】\n教授陈伟\n\n", {"guest": ["陈伟"]}),
    ("【嘉宾】\nDr. Smith\n\n", {"guest": ["Smith"]}),
    ("【嘉宾】\n陈伟教授\n\n", {"guest": ["陈伟"]}),
    ("【嘉宾】\nCEO\n\n", {}),
    ("【嘉宾】\n创始管理合伙人\n\n", {}),
    ("【嘉宾】\n陈伟（教授）\n\n", {"guest": ["陈伟"]}),
    ("【嘉宾】\nA\n\n", {}),
    ("Jane Doe, head of design, spoke here.", {"guest": ["Jane Doe"]}),
    ("Channel/Host: Zhang San\nJane Doe, head of design, was there.", {"host": ["Zhang San"]}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, c) for i, (c, _) in enumerate(CASES)]
    out = {}
    for r in names.candidates(spark.createDataFrame(rows, "doc_id bigint, context string")).orderBy("doc_id", "kind", "rank").collect():
        out.setdefault(r.doc_id, {}).setdefault(r.kind, []).append(r)
    return out


def test_names_by_rule(found):
    got = {i: {k: [r.name for r in v] for k, v in found.get(i, {}).items()} for i in range(len(CASES))}
    assert {CASES[i][0]: g for i, g in got.items() if g != CASES[i][1]} == {}


def test_roles_aliases_affiliations_and_bios(spark, found):
    assert found[26]["guest"][0].role == "教授" and found[28]["guest"][0].role == "head of design"
    context = """Title: How bridges are built
Channel/Host: Mira Olsen
Speakers:
- Mira Olsen (host) @ Example Works (research engineer)
- Tom Reed (guest) @ Small Works
  aliases: Reedy, reedy
  bio: writes and
  speaks

I talk with Nora Quist (@nq), head of product for the platform, and Ida Holm (@k), head of engineering, about work. Later we chatted with Tom Reed, editor of notes."""
    df = spark.createDataFrame([(1, context)], "doc_id bigint, context string")
    rows = {(r.kind, r.rank): r for r in names.candidates(df).collect()}
    assert [(k, r.name, r.role, r.affiliation, r.aliases, r.bio) for k, r in sorted(rows.items())] == [
        (("guest", 1), "Tom Reed", "guest", "Small Works", ["Reedy", "reedy"], "writes and speaks"),
        (("guest", 2), "Nora Quist", "head of product for the platform", None, None, None),
        (("guest", 3), "Ida Holm", "head of engineering", None, None, None),
        (("host", 1), "Mira Olsen", "host", "Example Works (research engineer)", None, None),
    ]
    assert names.candidates(df.limit(0)).count() == 0
