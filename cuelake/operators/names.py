"""Names of hosts and guests from the context of a talk: eight rules in order, with roles, affiliations, aliases and bios.

Every rule is a column that yields mentions; all are drawn together in rule order, cleaned alike, and grouped by
kind and name, so that the first mention that has a role (an affiliation, ...) gives it.  The last rule speaks only where
the others found nobody.

Input cases: a null or empty context has no names.  What is too short, too long, or nothing but a title is no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import text as T
from cuelake.operators import speakers

# Patterns.
SHOW = r"(?i)(?:podcast|show|radio|channel|talk|street|clips|shorts|highlights|播客|节目|频道|Priors|Space|MLST)"
SHOW_END = r"(?i)\s+(?:Clips|Shorts|Highlights|Podcast|Show|Channel|Radio|TV)$"
EPISODE, EPISODE_END = r"^(?:#?\d+\.?\s*|E\d+[｜|]?\s*)", r"(?i)\s*(?:Podcast|Episode|EP|节目|播客)\s*#?\d*$"
LEADING, TRAILING = r"^(.+?)\s*[—–|]\s*", r"(?:[—–]|\s-\s)\s*([^—–|]+)$"
HOST_BLOCK = r"(?s)[【\[](?:主播|主持)[】\]]\s*(.+?)(?=\n[【\[]|\n\n|\z)"
GUEST_BLOCK = r"(?si)[【\[](?:嘉宾|guest)[】\]]\s*(.+?)(?=\n[【\[]|\n\n|\z)"
JOINED = r"(?U)(\b[A-Z]\w+(?:\s+[A-Z]\w+)+(?:\s+and\s+[A-Z]\w+(?:\s+[A-Z]\w+)+)?)\s+(?:are\s+)?joined\s+by\s+(\b[A-Z]\w+(?:\s+[A-Z]\w+)+)"
VERB = (
    r"(?:talk(?:s|ing|ed)?\s+with|interview(?:s|ing|ed)?\s+(?:with\s+)?|joined\s+by|chat(?:s|ting|ted)?\s+with"
    r"|sit(?:s|ting|s\s+down)?\s+(?:down\s+)?with|sat\s+down\s+with|spoke?\s+with|speak(?:s|ing)?\s+with)"
)
INTRODUCED = rf"(?i)\b{VERB}\s+(?=([\s\S]{{0,400}}))"
NAME_ROLE = r"^([A-Z][a-z'\-]+(?:\s+[A-Z][a-z'\-]+){1,3})(?:\s*\([^)]{1,60}\))?(?:\s*[,，—–:-]\s*([^,，.\n()]{4,80}?))?(?=\s*(?:,|，|\.|\n|$|\s+and\s+|\s+about\s+|\s+on\s+))"
ROLE_WORDS = (
    r"(?i)\b([A-Z][a-z'\-]+(?:\s+[A-Z][a-z'\-]+){1,3})\s*[,，]?\s*((?:head|chief|director|vp|cto|ceo|founder|co-?founder|president"
    r"|engineer|engineering manager|product manager|senior|staff|principal|lead|host|guest)\b[^.,()\n]{0,60})"
)
TITLE_ALONE = r"(?i)^(?:创始.+|管理.+|执行.+|联合.+|高级.+|首席.+|CEO|CTO|COO|CFO|总监|主席|顾问|合伙人|总裁|总经理|Director|Founder|President|Chairman|Advisor)$"
HOSTING = ["host", "moderator", "co-host"]
ROLE_CHARS, AFFILIATION_CHARS, BIO_CHARS = 80, 120, 400

MENTION = "rule int, pos int, kind string, name string, role string, affiliation string, aliases array<string>, bio string"


def labelled(context: Column, label: str) -> Column:
    """The rest of the first line behind a label; empty if there is none."""
    return F.trim(F.regexp_extract(context, rf"{label}:\s*(.+?)(?:\n|$)", 1))


def _channel(context: Column) -> Column:
    channel = labelled(context, "Channel/Host")
    cut = F.trim(F.regexp_replace(channel, SHOW_END, ""))
    return F.when(~channel.rlike(SHOW), channel).when((cut != channel) & (cut != ""), cut)


def _title(context: Column) -> Column:
    title = F.regexp_replace(labelled(context, "Title"), EPISODE, "")
    leading = F.trim(F.regexp_extract(title, LEADING, 1))
    leads = (leading != "") & ~leading.rlike(r"^\d") & T.looks_like_person(leading)
    return F.when(leads, leading).otherwise(F.trim(F.regexp_replace(F.trim(F.regexp_extract(title, TRAILING, 1)), EPISODE_END, "")))


def _before_comma(line: Column) -> Column:
    return F.trim(F.element_at(F.split(line, "[，,]"), 1))


def mentions(contexts: DataFrame) -> DataFrame:
    """doc_id and ``MENTION`` for everything that a rule finds, not yet cleaned."""
    c = F.col("context")
    lines = contexts.select("doc_id", F.posexplode(F.split("context", "\n")).alias("line_no", "line"))
    block = speakers.parse_block(lines)
    role = F.when(F.col("role") != "", F.col("role"))
    kind = F.when(F.lower("role").isin(HOSTING), "host").otherwise("guest")
    found = block.select("doc_id", F.lit(0).alias("rule"), F.col("entry").cast("int").alias("pos"), kind.alias("kind"), "name", role.alias("role"), "affiliation", "aliases", "bio")

    def some(rule: int, kind: str, names: Column, roles: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        one = lambda n, i: F.struct(F.lit(rule).alias("rule"), i.alias("pos"), F.lit(kind).alias("kind"), n.alias("name"), (none if roles is None else F.get(roles, i)).alias("role"))
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), one)

    every = lambda pattern, group=1: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    person = lambda name: F.filter(F.array(name), lambda n: T.looks_like_person(n))
    hosts = F.transform(every(HOST_BLOCK), lambda b: _before_comma(F.element_at(F.split(F.trim(b), "\n"), 1)))
    guests = F.transform(F.filter(F.flatten(F.transform(every(GUEST_BLOCK), lambda b: F.split(b, "\n"))), lambda x: F.trim(x) != ""), _before_comma)
    pair = F.regexp_extract(c, JOINED, 1), F.regexp_extract(c, JOINED, 2)
    joined = [some(4, "host", F.split(pair[0], r"\s+and\s+")), some(5, "guest", F.array(pair[1]))]
    tails = F.flatten(F.transform(every(INTRODUCED), lambda t: F.split(t, r"(?i)\s+and\s+(?=[A-Z])")))
    tails = F.filter(F.transform(tails, lambda t: F.regexp_replace(t, r"^[, \n]+|\s+$", "")), lambda t: T.looks_like_person(F.regexp_extract(t, NAME_ROLE, 1)))
    told = F.transform(tails, lambda t: F.regexp_extract(t, NAME_ROLE, 1)), F.transform(tails, lambda t: F.regexp_extract(t, NAME_ROLE, 2))
    parts = F.concat(some(1, "host", person(_channel(c))), some(2, "guest", person(_title(c))), some(3, "host", hosts), some(3, "guest", guests), *joined, some(6, "guest", *told))
    last = some(7, "guest", every(ROLE_WORDS), every(ROLE_WORDS, 2))
    last = F.filter(last, lambda m: T.looks_like_person(m["name"]))
    rows = contexts.select("doc_id", F.explode(F.concat(parts, last)).alias("m")).select("doc_id", "m.*")
    return found.unionByName(rows, allowMissingColumns=True)


def cleaned(rows: DataFrame) -> DataFrame:
    """Mentions with bare names: without titles and brackets; a bracket is a role where none is told."""
    name = F.regexp_replace(F.trim("name"), "[。.，,]+$", "")
    bracket = F.trim(F.regexp_extract(name, r"\s*[（(](.+?)[)）]$", 1))
    bracket = F.when((bracket != "") & ~bracket.startswith("@") & ~bracket.contains("/") & ~bracket.startswith("http"), bracket)
    for pattern in (r"\s*[（(].+?[)）]$", r"^(?:教授|博士)", r"(?i)^(?:Dr\.?|Prof\.?)\s+", r"(?:教授|博士|老师)$"):
        name = F.trim(F.regexp_replace(name, pattern, ""))
    role = F.coalesce(F.when(F.col("role") != "", F.col("role")), bracket)
    role = F.regexp_replace(F.regexp_replace(F.trim(role), r"[.,;:\s]+$", ""), r"(?i)\s+(?:and|or)$", "")
    out = rows.withColumns({"name": name, "role": F.substring(role, 1, ROLE_CHARS)})
    return out.where(F.length("name").between(2, 30) & ~F.col("name").rlike(TITLE_ALONE))


def candidates(contexts: DataFrame) -> DataFrame:
    """doc_id, kind (host or guest), rank, name, role, affiliation, aliases, bio of ``contexts`` (doc_id, context)."""
    rows = cleaned(mentions(contexts.select("doc_id", F.coalesce("context", F.lit("")).alias("context"))))
    rows = rows.withColumn("early", F.min("rule").over(W.partitionBy("doc_id"))).where("rule < 7 or early = 7")
    order = F.struct("rule", "pos")
    others = F.filter(F.transform(F.coalesce("aliases", F.array()), lambda a: F.trim(a)), lambda a: (a != "") & (a != F.col("name")))
    rows = rows.withColumn("aliases", F.when(F.size(others) > 0, others)).withColumn("order", order)
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("order")))
    # What is told of a name holds for it whether it is found as a host or as a guest.
    facts = rows.groupBy("doc_id", "name").agg(*[first(c).alias(c) for c in ("role", "affiliation", "aliases", "bio")])
    kinds = rows.groupBy("doc_id", "kind", "name").agg(F.min("order").alias("order"))
    rank = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("order", "name"))
    met = kinds.withColumn("rank", rank).join(facts, ["doc_id", "name"])
    blank = lambda c, n: F.when(F.trim(c) != "", F.substring(F.trim(c), 1, n)).alias(c)
    return met.select("doc_id", "kind", "rank", "name", blank("role", ROLE_CHARS), blank("affiliation", AFFILIATION_CHARS), "aliases", blank("bio", BIO_CHARS))
