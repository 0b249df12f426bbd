"""Speakers from page metadata: the speakers block, description filters, contexts.

Lines are rows (``doc_id, line_no, line``), so an entry of the block is a run of lines under its bullet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuelake.functions import text as T

MAX_ALIASES, ALIAS_CHARS, BIO_CHARS = 8, 40, 300
# Roles in brackets; any other bracket behind a name is an alias.
ROLES = r"host|co-host|guest|moderator|panelist|speaker|interviewer|interviewee|audience"


def parse_block(lines: DataFrame) -> DataFrame:
    """doc_id, entry, name, role, affiliation, aliases, bio of the entries under a ``Speakers:`` line.

    The block ends at the first line that is neither blank, nor indented, nor a bullet.
    """
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head, blank = F.col("line").rlike(r"^Speakers:\s*$"), F.trim("line") == ""
    inside = lines.withColumn("head_no", F.first(F.when(head, F.col("line_no")), True).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    inside = inside.where(F.col("line_no") > F.col("head_no"))
    ends = ~blank & ~F.col("line").startswith("- ") & ~F.col("line").startswith("  ")
    inside = inside.withColumn("ended", F.max(ends.cast("int")).over(w)).where("ended = 0")
    bullet = F.col("line").startswith("- ")
    # A blank line closes an entry: indented lines behind it belong to none.
    inside = inside.withColumn("entry", F.sum(bullet.cast("int")).over(w)).withColumn("gap", F.max(blank.cast("int")).over(W.partitionBy("doc_id", "entry").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    rows = inside.where((F.col("entry") > 0) & (F.col("gap") == 0))
    sub = F.trim("line")
    kind = F.when(bullet, "name").when(F.lower(sub).startswith("aliases:"), "aliases").when(F.lower(sub).startswith("bio:"), "bio").otherwise("more")
    value = F.when(kind == "name", F.trim(F.expr("substring(line, 3)"))).when(kind.isin("aliases", "bio"), F.trim(F.regexp_replace(sub, r"^[^:]*:", ""))).otherwise(sub)
    rows = rows.withColumn("kind", kind).withColumn("value", value)
    bio = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("bio", "more"), F.struct("line_no", "value")))), lambda x: x["value"]), " ")
    has_bio = F.max((F.col("kind") == "bio").cast("int")) == 1
    out = rows.groupBy("doc_id", "entry").agg(F.max(F.when(F.col("kind") == "name", F.col("value"))).alias("head"), F.max(F.when(F.col("kind") == "aliases", F.col("value"))).alias("named"), F.when(has_bio, bio).otherwise("").alias("bio"))
    left = F.trim(F.regexp_replace("head", r" @ .*$", ""))
    role = F.lower(F.regexp_extract(left, rf"(?i)\(({ROLES})\)\s*$", 1))
    plain = F.trim(F.regexp_replace(left, rf"(?i)\s*\(({ROLES})\)\s*$", ""))
    bracket = F.regexp_extract(plain, r"\(([^)]+)\)\s*$", 1)
    alias = F.when(bracket.rlike(r"^(@|http)") | bracket.contains("/"), "").otherwise(bracket)
    listed = F.filter(F.transform(F.split(F.concat_ws(",", alias, "named"), "[，,]"), lambda a: F.trim(a)), lambda a: a != "")
    cols = [F.trim(F.regexp_replace(plain, r"\s*\([^)]+\)\s*$", "")).alias("name"), role.alias("role"), F.trim(F.regexp_extract("head", r" @ (.*)$", 1)).alias("affiliation"), F.array_distinct(listed).alias("aliases")]
    return out.select("doc_id", "entry", *cols, "bio").where("name <> ''")


def format_block(speakers: DataFrame) -> DataFrame:
    """doc_id, block: the block that ``parse_block`` reads, with caps on aliases and bios."""
    head = F.concat(F.lit("- "), "name", F.when(F.col("role") != "", F.concat(F.lit(" ("), F.lower("role"), F.lit(")"))).otherwise(""), F.when(F.col("affiliation") != "", F.concat(F.lit(" @ "), "affiliation")).otherwise(""))
    some = F.transform(F.slice("aliases", 1, MAX_ALIASES), lambda a: F.substring(a, 1, ALIAS_CHARS))
    alias = F.when(F.size("aliases") > 0, F.concat(F.lit("  aliases: "), F.array_join(some, ", ")))
    one = F.trim(F.regexp_replace("bio", r"\s+", " "))
    bio = F.when(one != "", F.concat(F.lit("  bio: "), F.substring(one, 1, BIO_CHARS)))
    rows = speakers.where("name <> ''").select("doc_id", F.struct("entry", F.concat_ws("\n", head, alias, bio).alias("text")).alias("x"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Speakers:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n")).alias("block"))


SIGNAL = r"(?i)\b(guests?|hosts?|speakers?|interview(?:s|ed)?|joined by|featuring|conversation with|talks? (?:to|with))\b|嘉宾|主持"
SKIP = r"^(?:https?://|\d{1,2}:\d{2}|[*#\-•►▶]\s*https?://|@)"


def speaker_description(description: Column, budget: int = 1500, intro: int = 600) -> Column:
    """The first paragraph, then paragraphs that speak of speakers, without links and times, up to ``budget`` characters."""
    parts = F.transform(F.split(description, "\n\n"), lambda p: F.trim(p))
    first = F.element_at(parts, 1)
    first = F.when(F.length(first) > intro, F.concat(F.substring(first, 1, intro), F.lit("..."))).otherwise(first)
    told = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(SIGNAL))
    kept = F.transform(told, lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(SKIP)), "\n"))
    kept = F.filter(kept, lambda p: p != "")
    start = F.struct(F.array(first).alias("out"), F.length(first).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, p: Column) -> Column:
        full = acc["full"] | (acc["used"] + F.length(p) > budget)
        return F.struct(F.when(full, acc["out"]).otherwise(F.concat(acc["out"], F.array(p))).alias("out"), F.when(full, acc["used"]).otherwise(acc["used"] + F.length(p)).alias("used"), full.alias("full"))

    return F.array_join(F.aggregate(kept, start, add, lambda a: a["out"]), "\n\n")


SKIP_PREFIXES = ("http", "@", "#", "*SPONSORS", "►", "▶")


def filter_lines(lines: DataFrame, cap: int = 800) -> DataFrame:
    """doc_id, text: meaningful lines up to ``cap`` characters; the line that exceeds it is cut and ends in an ellipsis, if over 20 remain."""
    line = F.trim("line")
    plain = lines.where((line != "") & ~line.rlike("^(" + "|".join(p.replace("*", r"\*") for p in SKIP_PREFIXES) + r"|\d{1,2}:\d{2})")).withColumn("line", line)
    w = W.partitionBy("doc_id").orderBy("line_no")
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = plain.withColumn("before", before).withColumn("over", F.col("before") + F.length("line") + 1 > cap)
    rows = rows.withColumn("earlier", F.coalesce(F.max(F.col("over").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("earlier = 0")
    room = F.lit(cap - 1) - F.col("before")
    rows = rows.withColumn("kept", F.when(~F.col("over"), F.col("line")).when(room > 20, F.concat(F.rtrim(F.expr(f"substring(line, 1, {cap - 1} - before)")), F.lit("…")))).where("kept is not null")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "kept"))), lambda x: x["kept"]), "\n").alias("text"))


def context_block(title: Column, channel: Column, description: Column, topics: Column, prior: Column, max_topics: int = 20, max_prior: int = 5) -> Column:
    """What is known of a talk, as labelled lines; parts that are missing are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    many = lambda name, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(c, 1, n), "; ")))
    return F.concat_ws("\n", part("Title", title), part("Channel", channel), part("Description", description), many("Topics", topics, max_topics), many("Earlier episodes", prior, max_prior))


def candidate_names(docs: DataFrame) -> DataFrame:
    """doc_id, name, kind (guest or host), rank from ``title, channel, description``: the first rule that yields a name wins.

    In order: names behind "with", "featuring" and the like in the title; a name before a colon or dash in the title; names
    behind introducing words in the description; a channel that is a person's name is the host.
    """
    name = r"((?:\p{Lu}[\p{L}.'’-]+)(?:\s+(?:(?:de|van|von|y|der|la)\s+)?\p{Lu}[\p{L}.'’-]+){1,3}|[一-鿿]{2,4})"
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    rules = [found(F.col("title"), rf"(?:\bwith|\bfeaturing|\bft\.?|\bfeat\.?|对话|专访)\s*{name}"), found(F.col("title"), rf"^{name}\s*[:：–—|-]"), found(F.col("description"), rf"(?:joined by|guest is|guests? (?:are|include)|interview with|conversation with|talks? (?:to|with)|嘉宾[:：]?)\s*{name}")]
    rows = None
    for rank, rule in enumerate(rules):
        part = docs.select("doc_id", F.posexplode(F.array_distinct(rule)).alias("pos", "name"), F.lit("guest").alias("kind"), F.lit(rank).alias("rule"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(T.looks_like_person(F.col("name"))).withColumn("first", F.min("rule").over(W.partitionBy("doc_id"))).where("rule = first")
    host = docs.where(T.looks_like_person(F.col("channel"))).select("doc_id", F.lit(0).alias("pos"), F.col("channel").alias("name"), F.lit("host").alias("kind"))
    both = rows.select("doc_id", "pos", "name", "kind").unionByName(host)
    rank = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("pos", "name"))
    return both.withColumn("rank", rank).select("doc_id", "name", "kind", "rank")
