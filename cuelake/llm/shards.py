"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a hash of the text and then by a hash of id and row number, so equal texts lie together.  The bytes of all
rows are counted below candidate boundaries, which are prefixes of the key.  The prefix that holds a
splitter's target is refined by the next bits until it holds less than the tolerance or a single
key; a key with many bytes (a group of copies) is refined by the second key.  Then the rows are exchanged once.

The row number is given when the keys are written, before anything is counted, so lost executors don't change it.  It
spreads rows that share text and id, or have no id, over the second key: no group of rows is too large to part.

Input cases: a null text has size 1 like an empty one.  Null and repeated ids are rows like any other.
A table with fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import scratch

SHARDS = 16
#: How far a splitter may lie from its target, as a share of a shard's bytes.
TOLERANCE = 0.001
#: A group of equal texts up to this share of a shard stays whole.
WHOLE = 0.05
#: Bits by which a counting round refines a boundary: 4096 probes for each splitter.
BITS = 12
#: Stretches of the key space that rows are numbered in, and the most rows that one may hold unsplit.
STRETCH_BITS, STRETCH_ROWS = 12, 1_000_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two sort keys; the texts stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash_key"), F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()).alias("id_key"))


def nearest_edges(rows: DataFrame, key: str, targets: dict[int, int], slack: float) -> dict[int, tuple]:
    """For each target (bytes below it): (lowest key that lies beyond, None), or (key, (start, end)) of a single key that reaches across.

    ``rows`` are counted by growing prefixes of ``key``; each round brings at most 4096 counts for a
    splitter to the driver, whatever the number of rows.
    """
    open_, found = {t: (None, 64, 0) for t in targets.values()}, {}  # target -> prefix, bits below it, bytes before it
    while open_:
        shifts = sorted({s for _, s, _ in open_.values()}, reverse=True)
        shift = shifts[0]
        wanted = {t: v for t, v in open_.items() if v[1] == shift}
        low = max(0, shift - BITS)
        prefixes = sorted({p for p, _, _ in wanted.values() if p is not None})
        part = rows.where(F.shiftright(key, shift).isin(prefixes)) if prefixes else rows
        counts = part.groupBy(F.shiftright(key, low).alias("probe")).agg(F.sum("size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        counts.sort()
        for target, (prefix, _, below) in wanted.items():
            del open_[target]
            at = below
            for probe, size, least, most in counts:
                if prefix is not None and probe >> (shift - low) != prefix:
                    continue
                if target < at + size:
                    if least == most:
                        found[target] = (least, (at, at + size))
                    elif size <= slack:
                        found[target] = (least, None) if target - at <= size / 2 else (most + 1, None)
                    else:
                        open_[target] = (probe, low, at)
                    break
                at += size
            else:
                found[target] = (None, None)
    return found


def splitters(rows: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE, whole: float = WHOLE) -> list[tuple[int, int | None]]:
    """Lower bounds (hash key, id key) of the shards 1 to n - 1; an id of None stands for all ids."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    targets = {k: k * total // n for k in range(1, n)}
    edges = nearest_edges(rows, "hash_key", targets, tolerance * total / n)
    bounds: dict[int, tuple[int, int | None]] = {}
    parted: dict[int, dict[int, int]] = {}  # hash key of a large group -> splitter -> bytes of the group below it
    for k, target in targets.items():
        key, group = edges[target]
        if key is None:
            continue
        if group is None:
            bounds[k] = (key, None)
        elif group[1] - group[0] > whole * total / n:
            parted.setdefault(key, {})[k] = target - group[0]
        elif target - group[0] <= (group[1] - group[0]) / 2:
            bounds[k] = (key, None)
        else:
            bounds[k] = (key + 1, None)
    for key, inner in parted.items():
        ids = nearest_edges(rows.where(F.col("hash_key") == key), "id_key", inner, tolerance * total / n)
        for k, target in inner.items():
            at, group = ids[target]
            near = group is None or target - group[0] <= (group[1] - group[0]) / 2
            bounds[k] = (key, at if near else at + 1)
    return [bounds[k] for k in sorted(bounds)]


def shard_of(bounds: list[tuple[int, int | None]]) -> Column:
    """How many lower bounds a row has reached."""
    out = F.lit(0)
    for key, at in bounds:
        beyond = F.col("hash_key") >= F.lit(key) if key < 1 << 63 else F.lit(False)
        if at is not None:
            beyond = (F.col("hash_key") > F.lit(key)) | ((F.col("hash_key") == F.lit(key)) & (F.col("id_key") >= F.lit(at) if at < 1 << 63 else F.lit(False)))
        out = out + beyond.cast("int")
    return out


def assign(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; slots follow the sort order."""
    rows = scratch(measured(docs), "sizes")
    placed = rows.withColumn("shard", shard_of(splitters(rows, n)))
    # Numbers are given within stretches of a shard, so that no task has to see a whole shard.
    counts = placed.groupBy("shard", F.shiftright("hash_key", 64 - STRETCH_BITS).alias("stretch")).agg(F.count("*").alias("n"))
    stats = counts.agg(F.sum("n").alias("all"), F.count("*").alias("parts")).first()
    most = min(STRETCH_ROWS, max(64, 4 * (stats["all"] or 0) // max(1, stats["parts"])))
    crowded = {r["stretch"]: r["n"] for r in counts.groupBy("stretch").agg(F.max("n").alias("n")).where(F.col("n") > most).collect()}  # 4096 stretches exist
    fine = F.lit(0).cast("long")
    if crowded:
        # Cells of about a quarter of the rows that a task may number.
        bits = max(0, 64 - max(1, (4 * max(crowded.values()) // most).bit_length()))
        fine = F.when(F.shiftright("hash_key", 64 - STRETCH_BITS).isin(list(crowded)), F.shiftright("id_key", bits)).otherwise(fine)
    placed = placed.withColumn("stretch", F.shiftright("hash_key", 64 - STRETCH_BITS)).withColumn("fine", fine)
    cell = ["shard", "stretch", "fine"]
    offsets = placed.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(W.partitionBy("shard").orderBy("stretch", "fine").rowsBetween(W.unboundedPreceding, -1)))
    numbered = placed.withColumn("row", F.row_number().over(W.partitionBy(*cell).orderBy("hash_key", "id_key", "size")))
    out = numbered.join(offsets.select(*cell, F.coalesce("offset", F.lit(0)).alias("offset")), cell)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
