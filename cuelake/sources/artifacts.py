"""Several files for each document in one pass: drafts, critiques, analyses and metadata pages beside the text itself.

All kinds of a document are rows of one table that is written once, partitioned by kind, into a new folder below the target; the folder
appears under its final name when every file is there.  A run that dies leaves nothing that a reader would take for a result.

Input cases: null parts are left out; a document without any part of a kind has no file of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F


def _or_none(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- None")


def analysis(docs: DataFrame) -> DataFrame:
    """doc_id, kind, value from ``style, register, terminology array<struct<source, translation, context>>, metaphors array<struct<source, intent, strategy>>, notes``."""
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    style = F.concat_ws("\n", *[F.when(told(F.col(c)), F.concat(F.lit(f"- {name}: "), c)) for name, c in (("Style", "style"), ("Register", "register"))])
    term = lambda t: F.concat(F.lit('- "'), F.coalesce(t["source"], F.lit("")), F.lit('"'), F.when(told(t["translation"]), F.concat(F.lit(' -> "'), t["translation"], F.lit('"'))).otherwise(""), F.when(told(t["context"]), F.concat(F.lit(" ("), t["context"], F.lit(")"))).otherwise(""))
    image = lambda m: F.concat_ws("\n", F.concat(F.lit('- "'), F.coalesce(m["source"], F.lit("")), F.lit('"')), *[F.when(told(m[c]), F.concat(F.lit(f"  - {c}: "), m[c])) for c in ("intent", "strategy")])
    terms, images = _or_none(F.transform(F.coalesce("terminology", F.array()), term)), _or_none(F.transform(F.coalesce("metaphors", F.array()), image))
    notes = F.when(told(F.col("notes")), F.concat(F.lit("## Notes\n"), "notes"))
    parts = [F.lit("# Analysis"), F.nullif(style, F.lit("")), F.concat(F.lit("## Terminology\n"), terms), F.concat(F.lit("## Metaphor Map\n"), images), notes]
    return docs.select("doc_id", F.lit("analysis").alias("kind"), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("value"))


def _segments(rows: DataFrame, kind: str, title: str, *lines: Column) -> DataFrame:
    part = F.concat_ws("\n", *lines)
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", part.alias("part")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("## Segment "), (i + 1).cast("string"), F.lit("\n"), x["part"])), "\n\n")
    return whole.select("doc_id", F.lit(kind).alias("kind"), F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n")).alias("value"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(value, F.lit("")))


def draft(rows: DataFrame, title: str = "Draft Translation") -> DataFrame:
    """doc_id, kind, value: source and translation of each segment (doc_id, seg_idx, text, translation)."""
    return _segments(rows, "draft", title, _line("Source", F.col("text")), _line("Translation", F.col("translation")))


def critique(rows: DataFrame) -> DataFrame:
    """doc_id, kind, value: what a review changed (doc_id, seg_idx, text, draft, revised, note)."""
    changed = F.when(F.col("draft").eqNullSafe(F.col("revised")), "no").otherwise("yes")
    note = F.coalesce(F.nullif("note", F.lit("")), F.lit("No issue found."))
    return _segments(rows, "critique", "Critique", _line("Source", F.col("text")), _line("Draft", F.col("draft")), _line("Revised", F.col("revised")), _line("Changed", changed), _line("Note", note))


def write(target: str, *kinds: DataFrame) -> str:
    """Write all kinds (doc_id, kind, value) below ``target`` as kind=.../doc_id=... in one job; the folder of this run."""
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    spark = rows.sparkSession
    run = uuid.uuid4().hex
    staged, final = f"{target}/_run-{run}", f"{target}/run-{run}"
    rows.repartition("kind", "doc_id").write.partitionBy("kind", "doc_id").text(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path(staged), path(final)):
        raise OSError(f"{staged} can't be renamed to {final}")
    return final


def read(spark, folder: str) -> DataFrame:
    """doc_id, kind, value of a written folder."""
    files = spark.read.text(folder, wholetext=True)
    return files.select("doc_id", "kind", F.regexp_replace("value", r"\n\z", "").alias("value"))
