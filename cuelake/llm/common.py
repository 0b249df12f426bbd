"""Helpers shared by the text-corpus operators: scratch tables, the fold rule, row-wise Arrow maps.

Scratch tables.  Intermediate results that are read more than once, or that would carry a long
lineage, are written as Parquet below the folder named in ``spark.checkpoint.dir``.  All executors and
the driver see that folder, so a lost executor costs a task retry and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FOLDS, HELD_OUT_FOLD = 4, 2
#: Rows that go to a Python worker at a time while a scratch table is written: texts can be long.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
#: Bytes up to which a side is broadcast while a scratch table is written.  The driver builds what is broadcast, and a scratch table is judged by
#: its file, which is several times smaller than its rows in memory: what grows with the data is shuffled instead.
BROADCAST_SETTING, BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold", 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session; a local one only where none is set and all work is done on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cuelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def in_bytes(size: str) -> int:
    """A size as Spark's settings write it: ``10485760``, ``10485760b``, ``10m``, ``10MB``, ``-1``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuelake-{name}-{uuid.uuid4().hex}"
    before = {c: spark.conf.get(c) for c in (BATCH_SETTING, BROADCAST_SETTING)}
    rows, most = int(before[BATCH_SETTING]), in_bytes(before[BROADCAST_SETTING])
    spark.conf.set(BATCH_SETTING, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set(BROADCAST_SETTING, str(min(most, BROADCAST_BYTES)))
    try:
        df.write.parquet(path)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold no model may learn from.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def map_rows(df: DataFrame, make, schema: str, columns: list[str], texts: str = "text") -> DataFrame:
    """Run a text function inside tasks over Arrow batches.

    ``make()`` is called once per task and gives a function from a list of texts (None where null) to
    a list of result tuples, one per text.  ``columns`` are carried through unchanged in front of them.
    Only the named columns travel to Python, so other columns of ``df`` can't clash with anything;
    ``texts`` may be one of the columns.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    added = _parse_datatype_string(schema)
    at = columns.index(texts) if texts in columns else len(columns)
    src = df.select(*columns) if texts in columns else df.select(*columns, texts)
    out = StructType([*df.select(*columns).schema.fields, *added.fields])
    names = [f.name for f in added.fields]
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def mapped(work, batch: pa.RecordBatch) -> pa.RecordBatch:
        done = work(batch.column(at).to_pylist())
        flat = zip(*done) if done else ([] for _ in names)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *(pa.array(v, type=k) for v, k in zip(flat, kinds))], names=[*columns, *names])

    def run(batches):
        work = make()
        for batch in batches:
            yield mapped(work, batch)
            # Workers are kept between tasks and stages: what the last batch took goes back to the machine.
            del batch
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, out)
