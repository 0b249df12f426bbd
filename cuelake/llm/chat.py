"""Chat formatting of typed content parts, in DataFrame functions only.

A turn is a role and an array of parts: text, image, audio or document.  A visitor flattens the parts in order: texts are
escaped, other parts become numbered placeholders, and each placeholder's reference, place and expanded token count is
recorded.  A conversation's turns are laid out by one template,

    <|role|>
    content</s>

with a line break after each end mark.  Spans of the assistant's texts, in code points of the layout, are the loss mask.

Escaping.  A control string in a text gets one backslash behind its first character.  Whether a control string
stands somewhere is decided as if there were no backslashes, so escaped texts are escaped once more and
every text is got back exactly.  Control strings themselves may hold no backslash.

Input cases: null texts and null parts are empty, a null role is the empty role, and null numbers count as 0 (a size or length
that isn't known costs one token).  A part of an unknown kind is laid out as a document.  Turns with equal numbers are
ordered by role and parts; null turns come first.  A null conv_id is one conversation.  Other columns are ignored.
A conversation is one row, so it must fit into a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Control strings of common chat templates, and of this one.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: A role also ends its own mark.
ROLE_CONTROLS = [*CONTROLS, "|>"]
LOSS_ROLES = ["assistant"]
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that a placeholder stands for: one for each tile of an image, for each 40 ms of sound, and so many for a page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
END = "</s>\n"


def _rules(controls: list[str]) -> list[tuple[str, str]]:
    """First characters, and a pattern of what must follow: the rest of a control string, with any backslashes in it."""
    if any("\\" in c or len(c) < 2 for c in controls):
        raise ValueError("control strings have two characters or more, and no backslash")
    rules: dict[str, list[str]] = {}
    for c in controls:
        rules.setdefault(c[0], []).append(r"\\*".join(re.escape(x) for x in c[1:]))
    return [(first, "|".join(rest)) for first, rest in rules.items()]


def escaped(text: Column, controls: list[str] = CONTROLS) -> Column:
    for first, rest in _rules(controls):
        text = F.regexp_replace(text, rf"({re.escape(first)})(\\*)(?={rest})", r"$1\\$2")
    return text


def unescaped(text: Column, controls: list[str] = CONTROLS) -> Column:
    for first, rest in _rules(controls):
        text = F.regexp_replace(text, rf"({re.escape(first)})\\(\\*)(?={rest})", "$1$2")
    return text


def text_part(text: Column) -> Column:
    """An array of one text part."""
    part = "struct('text' as kind, '' as text, null as ref, null as width, null as height, null as seconds, null as pages)"
    one = F.expr(f"cast(array({part}) as {PARTS})")
    return F.transform(one, lambda p: p.withField("text", F.coalesce(text, F.lit(""))))


def parts_of_json(content: Column) -> Column:
    """Parts of a JSON array such as [{"kind": "text", "text": "..."}, {"kind": "image", "ref": "...", "width": 640, "height": 480}];
    content that isn't one is a text part."""
    parsed = F.from_json(content, PARTS)
    return F.when(F.trim(content).startswith("[") & parsed.isNotNull() & (F.size(parsed) > 0) & F.forall(parsed, lambda p: p["kind"].isNotNull()), parsed).otherwise(text_part(content))


def tokens_of(part: Column) -> Column:
    """How many tokens a placeholder is expanded to."""
    number = lambda c: F.coalesce(part[c], F.lit(0))
    tiles = F.ceil(number("width") / TILE) * F.ceil(number("height") / TILE)
    audio = F.ceil(number("seconds") * AUDIO_RATE)
    pages = number("pages").cast("long") * PAGE_TOKENS
    found = F.when(part["kind"] == "image", tiles).when(part["kind"] == "audio", audio).otherwise(pages)
    return F.greatest(found.cast("long"), F.lit(1).cast("long"))


def flattened(turns: DataFrame, loss_roles: list[str]) -> DataFrame:
    """The visitor, turn by turn: conv_id, turn, role, parts, mark, learned, texts (one more than attachments, escaped), found (attachments)."""
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    plain = F.when(F.col("parts").isNull(), F.array().cast(PARTS)).otherwise(F.filter("parts", lambda p: p.isNotNull()))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), plain.alias("parts"))
    # Texts between two attachments are one text: a control string may reach from one part into the next.
    places = F.filter(F.transform("parts", lambda p, i: F.when(~is_text(p), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("cuts", F.concat(F.array(F.lit(-1)), places, F.array(F.size("parts"))))
    said = lambda c: F.transform(F.slice("parts", F.element_at("cuts", c) + 2, F.element_at("cuts", c + 1) - F.element_at("cuts", c) - 1), lambda p: F.coalesce(p["text"], F.lit("")))
    texts = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda c: escaped(F.array_join(said(c), "")))
    kind = lambda p: F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise("document")
    found = F.transform(F.filter("parts", lambda p: ~is_text(p)), lambda p: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    mark = F.concat(F.lit("<|"), escaped(F.col("role"), ROLE_CONTROLS), F.lit("|>\n"))
    return rows.select("conv_id", "turn", "role", "parts", mark.alias("mark"), F.col("role").isin(loss_roles).alias("learned"), texts.alias("texts"), found.alias("found"))


def formatted(turns: DataFrame, loss_roles: list[str] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, starts, loss, attachments of each conversation.

    ``turns``: conv_id, turn, role, parts.  ``starts`` tells where each turn's mark begins, ``loss`` is an array of
    (turn, start, end), ``attachments`` one of (number, kind, ref, turn, at, tokens): turns and numbers count from 0, ``at`` is where
    the placeholder begins.  All places are code points of ``formatted``.  Work is linear in turns and texts, and grows with
    the square of the attachments of one turn.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    rows = flattened(turns, loss_roles)
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("number", F.coalesce(F.sum(F.size("found")).over(past), F.lit(0)))
    held = F.transform("found", lambda a, i: F.concat(F.lit("<|"), a["kind"], F.lit(":"), (F.col("number") + i).cast("string"), F.lit("|>")))
    rows = rows.withColumn("held", held).drop("parts", "role", "turn")
    # The first text follows the mark; each further one follows a placeholder.
    later = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    rest = F.zip_with("held", later(F.col("texts")), lambda h, t: F.concat(h, t))
    rows = rows.withColumn("body", F.concat("mark", F.element_at("texts", 1), F.array_join(rest, ""), F.lit(END)))
    lengths = F.zip_with("held", F.slice("texts", 1, F.size("held")), lambda h, t: F.char_length(t) + F.char_length(h))  # of a text and the placeholder behind it
    sums = F.aggregate(lengths, F.array(F.char_length("mark")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    rows = rows.withColumn("text_at", sums)  # where each text begins, from the turn's start
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("body")).over(W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    turn = F.col("k").cast("int").alias("turn")
    spans = F.zip_with("texts", "text_at", lambda t, at: F.struct(turn, (F.col("start") + at).alias("start"), (F.col("start") + at + F.char_length(t)).alias("end")))
    loss = F.when(F.col("learned"), F.filter(spans, lambda s: s["end"] > s["start"])).otherwise(F.slice(spans, 1, 0))
    at = lambda i: F.col("start") + F.element_at("text_at", i + 1) + F.char_length(F.element_at("texts", i + 1))
    found = F.transform("found", lambda a, i: F.struct((F.col("number") + i).alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), turn, at(i).alias("at"), a["tokens"].alias("tokens")))
    laid = rows.select("conv_id", F.struct("k", "body", "start", loss.alias("loss"), found.alias("found")).alias("t"))
    whole = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.array_join("t.body", "").alias("formatted"), F.col("t.start").alias("starts"), F.flatten("t.loss").alias("loss"), F.flatten("t.found").alias("attachments"))


def read_turns(layout: Column) -> Column:
    """Turns of a layout again: array of role and content, texts unescaped and placeholders as they stand."""

    def turn(piece):
        role = F.regexp_extract(piece, r"(?s)^<\|(.*?)\|>\n", 1)
        return F.struct(unescaped(role, ROLE_CONTROLS).alias("role"), unescaped(F.regexp_replace(piece, r"(?s)^<\|.*?\|>\n", "")).alias("content"))

    return F.transform(_pieces(layout), turn)


def _pieces(layout: Column) -> Column:
    """Turns without their end marks; nothing follows the last one."""
    pieces = F.split(layout, END)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def read_loss(layout: Column, starts: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, joined."""
    pieces = _pieces(layout)
    part = lambda s: F.substring(F.element_at(pieces, s["turn"] + 1), (s["start"] - F.element_at(starts, s["turn"] + 1) + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(loss, lambda s: unescaped(part(s))), "")


def digests(rows: DataFrame) -> DataFrame:
    """What the layouts say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments."""
    turns = rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    laid = formatted(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", read_loss(F.col("formatted"), F.col("starts"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return laid.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two texts consist of control strings."""
    spark = conversations.sparkSession
    kinds = {c: conversations.schema[c].dataType for c in ("conv_id", "turn", "role", "text")}
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select(*kinds).unionByName(probe.select(*[F.col(c).cast(t) for c, t in kinds.items()]))
