"""Model calls that survive interruption: batches with stable numbers, answers in a ledger, waits between tries.

Batches are numbered by a document's rows, not by partitions, so the same rows make the same batches in every run.  They are
asked for in rounds; a round's answers are appended to a Parquet ledger when the round is over, as one commit.  A batch
that is in the ledger is never asked for again; after a kill only the round under way is lost.  A batch that fails for
good is reported when all others are in the ledger.

Input cases: null texts are asked for as empty ones.  Rows that share doc_id and seg_idx are asked for once each.  An empty table
makes an empty ledger.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .chunks import Model, fit

# What a passing failure says, the tries, and the seconds to wait behind try 0, 1, ...
PASSING = ("429", "503", "500", "UNAVAILABLE")
TRIES, MISCOUNTS = 5, 2
LEDGER = "doc_id bigint, batch bigint, answers array<string>, tries int, error string"


def wait_seconds(attempt: int) -> int:
    return 2 ** (attempt + 1)


def asked(model: Model, texts: list[str], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str] | None, int, str | None]:
    """Answers, calls made, error.  Passing failures are repeated after a wait, others end it; wrong numbers of answers are asked for twice more, then padded."""
    calls = miscounts = failures = 0
    while True:
        calls += 1
        try:
            answers = list(model(texts))
        except Exception as e:  # what a model raises is its own affair: the text tells whether it passes
            if not any(code in str(e) for code in PASSING) or failures == tries - 1:
                return None, calls, f"{type(e).__name__}: {e}"
            sleep(wait_seconds(failures))
            failures += 1
            continue
        if len(answers) == len(texts) or miscounts == MISCOUNTS:
            return fit(answers, texts), calls, None
        miscounts += 1


def numbered(rows: DataFrame, size: int = 30) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` in it: ``size`` rows of a document each, in the order of seg_idx and text."""
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("seg_idx", "text")) - 1
    return rows.withColumn("at", at.cast("long")).withColumn("batch", F.floor(F.col("at") / size)).withColumn("place", (F.col("at") % size).cast("int")).drop("at")


class LedgerError(RuntimeError):
    pass


class Ledger:
    """A Parquet folder of answers, on storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def done(self) -> DataFrame:
        """Committed batches: doc_id, batch, answers, tries, error (null)."""
        return self.told().where("error is null")

    def told(self) -> DataFrame:
        """All outcomes so far, failures included."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def pending(self, rows: DataFrame, size: int = 30) -> DataFrame:
        """doc_id, batch, texts of what has no answers yet."""
        texts = F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
        batches = numbered(rows, size).groupBy("doc_id", "batch").agg(texts.alias("texts"))
        known = self.done().select(F.col("doc_id").alias("d"), F.col("batch").alias("b")).distinct()
        return batches.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("batch") == F.col("b")), "left_anti")

    def fill(self, rows: DataFrame, model: Model, size: int = 30, per_round: int = 10_000, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> int:
        """Ask for all pending batches, ``per_round`` of them between commits; how many were committed.  Raises ``LedgerError`` if some failed."""
        waiting = self.pending(rows, size)
        count = waiting.count()
        rounds = -(-count // per_round)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for doc, batch, texts in zip(pdf.doc_id, pdf.batch, pdf.texts):
                    answers, calls, error = asked(model, list(texts), tries, sleep)
                    yield pd.DataFrame({"doc_id": [doc], "batch": [batch], "answers": [answers], "tries": [calls], "error": [error]})

        for k in range(rounds):
            # The round of a batch depends on its number alone, so what is committed meanwhile moves no batch to another round.
            part = waiting.where(F.pmod(F.xxhash64("doc_id", "batch"), F.lit(rounds)) == k)
            # One write for answers and failures, so that no batch is asked for twice; readers of the ledger skip the failures.
            part.mapInPandas(run, LEDGER).write.mode("append").parquet(self.folder)
        failed = [f"{r.doc_id}/{r.batch}: {r.error}" for r in self.told().where("error is not null").join(self.pending(rows, size).select("doc_id", "batch"), ["doc_id", "batch"]).limit(5).collect()]
        if failed:
            raise LedgerError(f"batches failed, the others are in the ledger: {'; '.join(failed[:5])}")
        return count

    def answers(self, rows: DataFrame, out: str, size: int = 30) -> DataFrame:
        """``rows`` with ``out``: the committed answer to each text, null where there is none yet."""
        told = self.done().dropDuplicates(["doc_id", "batch"]).select(F.col("doc_id").alias("d"), F.col("batch").alias("b"), F.posexplode("answers").alias("p", out))
        met = numbered(rows, size).join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("batch") == F.col("b")) & (F.col("place") == F.col("p")), "left")
        return met.select(*rows.columns, out)
