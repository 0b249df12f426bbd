"""Whole commands over caption files: convert, normalise, shift, diff.  Each is a composition of readers, operators and renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.functions import text as T
from cuelake.operators import alignment, chunks, gates, sequential
from cuelake.sources import captions, writers


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Segments of caption files; ``doc_id`` is a hash of the file's name without its extension."""
    rows = captions.read(spark, path, kind)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return rows.select(F.xxhash64(name).alias("doc_id"), "seg_idx", "start_ms", "end_ms", "text", *[c for c in ("speaker",) if c in rows.columns])


def sentences(segs: DataFrame) -> DataFrame:
    """Segments cut at sentence ends and numbered anew."""
    cut = chunks.split_sentences(segs)
    number = F.row_number().over(gates.W.partitionBy("doc_id").orderBy("start_ms", "seg_idx", "part")) - 1
    return cut.select("doc_id", number.alias("seg_idx"), "start_ms", "end_ms", "text")


def convert(segs: DataFrame, normalize: bool = False, shift_ms: int = 0, split: bool = False, standardize: bool = False) -> DataFrame:
    """Segments ready for a renderer: texts normalised, times moved (never below 0), sentences split, layout standardised, as asked."""
    out = sentences(segs) if split else segs
    if normalize:
        out = out.withColumn("text", T.normalize(F.col("text")))
    if shift_ms:
        for c in ("start_ms", "end_ms"):
            out = out.withColumn(c, F.greatest(F.col(c) + shift_ms, F.lit(0)))
    return gates.standard(out) if standardize else out


def retimed(segs: DataFrame, reference: DataFrame) -> DataFrame:
    """Segments with the times of a reference track of the same document, found by their texts; documents without one keep theirs."""
    norm = T.match_normalize(F.col("text"))
    moved = sequential.transfer(segs.withColumn("keys", T.match_keys(norm)), reference.withColumn("norm", norm))
    moved = moved.select("doc_id", "seg_idx", F.col("start_ms").alias("new_ms"), "duration_ms")
    known = reference.select("doc_id").distinct().withColumn("known", F.lit(True))
    met = segs.join(moved, ["doc_id", "seg_idx"], "left").join(known, "doc_id", "left")
    start = F.when(F.col("known"), F.col("new_ms")).otherwise(F.col("start_ms"))
    end = F.when(F.col("known"), F.col("new_ms") + F.col("duration_ms")).otherwise(F.col("end_ms"))
    return met.withColumns({"start_ms": start, "end_ms": end}).select(*segs.columns)


def convert_files(spark: SparkSession, source: str, target: str, kind: str, source_kind: str | None = None, timing: str | None = None, **options) -> None:
    """Read caption files, convert them, and write them in another format below ``target``; ``timing`` names files of the same names that give the times."""
    rows = load(spark, source, source_kind)
    rows = retimed(rows, load(spark, timing)) if timing else rows
    writers.write(convert(rows, **options), kind, target)


def diff(reference: DataFrame, hypothesis: DataFrame, split: bool = True) -> DataFrame:
    """Aligned groups of two tracks with their counts, as ``alignment.align`` gives them, after sentences are split if asked."""
    sides = [sentences(s) if split else s for s in (reference, hypothesis)]
    return alignment.align(*sides)
