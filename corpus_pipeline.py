"""The corpus pipeline: quality classifier, near-dedup, decontamination, PII masking, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a DataFrame; all but
the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.llm import bpe, decontaminate, pii, quality_model, simhash
from cuelake.llm.common import scratch, table
from cuelake.llm.queries import tokenizer_path


def packed(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one, whatever their names."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def unpacked(rows: DataFrame, columns: list[str], **put) -> DataFrame:
    return rows.select(*[(put.get(c) if c in put else F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score reaches the cut."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.predict(packed(docs), model, columns=("row", "text"))
    return unpacked(scored.where("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: the one with the least id, then with the least hash of its text.

    Groups are made of rows, whatever their ids: rows that share an id but not a text are judged apart, and
    rows without an id take part (one stays if the whole group has none).  Of rows equal in id and text the one
    with the least hash of all columns stays.
    """
    key = ["doc_id", *simhash.TEXT_KEY]
    groups = scratch(simhash.near_duplicates(docs), "groups")
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("k"))
    chosen = least.select(*[F.col("k")[c].alias(f"k_{c}") for c in key])
    repeated = groups.groupBy(*key).count().where("count > 1").select(*[F.col(c).alias(f"k_{c}") for c in key])
    repeated = scratch(repeated, "repeated")

    def same():
        return F.expr(" and ".join(f"{c} <=> k_{c}" for c in key))

    rows = packed(docs).select("row", "text", F.col("row.doc_id").alias("doc_id"), *simhash.text_key())
    kept = rows.join(chosen, same(), "left_semi")
    once = kept.join(repeated, same(), "left_anti").select("row", "text")
    # Copies that share their id too are thinned in a grouping, which combines before its shuffle.
    several = kept.join(repeated, same(), "left_semi").groupBy(*key).agg(F.min_by(F.struct("row", "text"), F.xxhash64("row")).alias("one")).select("one.*")
    return unpacked(once.unionByName(several), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that leak a benchmark item.  Each row is judged by its own text, so null and repeated ids do no harm."""
    return unpacked(decontaminate.without_leaks(packed(docs), table(spark, sf_dir, "benchmark"), ("row",)), docs.columns)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows the new text."""
    masked = pii.mask(packed(docs), ("row",)).withColumnRenamed("masked", "text")
    put = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(masked, docs.columns, **put)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digest of the decoded text."""
    return bpe.encode_checked(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_masking", pii_masking),
    ("bpe_encoding", bpe_encoding),
]

#: No stage but the last can be put in SQL; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
