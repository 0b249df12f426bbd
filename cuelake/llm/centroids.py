"""k-means over integer vectors with block-norm screening.

A vector x is kept beside a compressed form that is computed once: a coarse code y of one signed digit (-7 to 7) a component with a
step h, a power of two, and the norms of what the code drops, r = x - h y, over segments of a few components.
Cauchy-Schwarz on each segment s bounds the inner product with a centroid c, and so the distance:

    <x, c> = h <y, c> + <r, c> <= h <y, c> + sum |r_s| |c_s|
    |x - c|^2 >= |x|^2 + |c|^2 - 2 h <y, c> - 2 sum |r_s| |c_s|

In a task these bounds are two small matrix products.  The centroid with the lowest bound gets an exact
distance first; the others get theirs only where the bound does not exceed it.  Stored norms are rounded up and bounds
lowered by more than the rounding of floats, so screening never changes an assignment: distances are whole numbers.

Vectors stay where they are: a round brings k sums of each task together, and the driver sees k * (dims + 1) totals.

Input cases: vectors of another length, or with a null, NaN or infinite component, are left out.  So are vectors with
a component beyond +-524287, whose squared distances a long could not hold.  Repeated ids are rows like any other.  A null
id takes part but is no starting centroid.  Fewer vectors than k give fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import scratch

DIMS, SCALE, K, ROUNDS, SALT = 64, 256, 40, 5, "2:"
#: Components of a segment, and the largest digit of a coarse code.
BLOCK, DIGIT = 4, 7
#: Largest whole component: 64 squares of twice this fit a long.
LARGEST = 1 << 27
#: Pairs of vector and centroid whose exact distances are computed at a time.
PAIRS = 1 << 14


def block_norms(v: np.ndarray) -> np.ndarray:
    """Norms of all segments, never below the true ones (float32)."""
    parts = v.astype(np.int64).reshape(len(v), -1, BLOCK)
    return np.nextafter(np.sqrt((parts * parts).sum(axis=2).astype(np.float64)).astype(np.float32), np.float32(np.inf))


def compress(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The step, the coarse code and the segment norms of what the code drops, of each row."""
    q = q.astype(np.int64)
    most = np.abs(q).max(axis=1, initial=0)
    step = np.left_shift(1, np.ceil(np.log2(np.maximum(most, DIGIT) / DIGIT)).astype(np.int64))
    code = np.clip((2 * q + step[:, None]) // (2 * step[:, None]), -DIGIT, DIGIT)
    return step, code, block_norms(q - step[:, None] * code)


def nearest(q: np.ndarray, form: tuple[np.ndarray, np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number on ties), its squared distance, and how many exact distances were taken."""
    step, code, norms = form
    q = q.astype(np.int64)
    rows = np.arange(len(q))

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            d = q[i[at : at + PAIRS]] - centroids[j[at : at + PAIRS]]
            out[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
        return out

    squares = (q * q).sum(axis=1).astype(np.float64)[:, None] + (centroids * centroids).sum(axis=1).astype(np.float64)
    coarse = step[:, None] * (code.astype(np.float64) @ centroids.astype(np.float64).T)
    dropped = norms.astype(np.float64) @ block_norms(centroids).astype(np.float64).T
    low = squares - 2 * (coarse + dropped) - (1 + 1e-12 * squares)
    first = low.argmin(axis=1)
    least = exact(rows, first)
    open_ = low <= least[:, None]
    open_[rows, first] = False
    i, j = np.nonzero(open_)
    found = np.full(low.shape, np.iinfo(np.int64).max)
    found[rows, first] = least
    found[i, j] = exact(i, j)
    best = found.argmin(axis=1)
    return best, found[rows, best], 1 + open_.sum(axis=1)


FORM = "step bigint, code array<tinyint>, norms array<float>"
COLUMNS = ["q", "step", "code", "norms"]


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), kind))


def components(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole components and compressed form of the rows of a batch with ``COLUMNS``."""
    q, step, code, norms = (batch.column(batch.schema.get_field_index(c)) for c in COLUMNS)
    return components(q, DIMS), (step.to_numpy(zero_copy_only=False), components(code, DIMS), components(norms, DIMS // BLOCK))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, q (whole components), step, code and norms of the vectors that are kept, as a scratch table."""
    limit = LARGEST // SCALE - 1
    kept = vectors.where(f"size(embedding) = {DIMS} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= {limit})")
    whole = kept.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({SCALE}D * cast(x as double)) as int))").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step, code, norms = compress(components(b.column(1), DIMS))
            columns = [b.column(0), b.column(1), pa.array(step, pa.int64()), lists(code.astype(np.int8), pa.int8()), lists(norms, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *COLUMNS])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return scratch(whole.mapInArrow(run, f"vec_id {kind}, q array<int>, {FORM}"), "vectors")


def starting(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose salted id has the smallest SHA-256, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    chosen = rows.where("vec_id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in chosen], np.int64).reshape(-1, DIMS)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Assign all vectors and return the floors of the clusters' means; empty clusters stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, DIMS + 1), np.int64)  # the last one counts
        for b in batches:
            q, form = unpacked(b)
            best, _, _ = nearest(q, form, centroids)
            order = np.argsort(best, kind="stable")
            numbers, starts = np.unique(best[order], return_index=True)
            if len(numbers):
                sums[numbers, :DIMS] += np.add.reduceat(q[order].astype(np.int64), starts, axis=0)
                sums[numbers, DIMS] += np.diff(np.append(starts, len(order)))
        used = np.nonzero(sums[:, DIMS])[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = rows.select(*COLUMNS).mapInArrow(run, "cluster int, sums array<bigint>")
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
    totals = parts.select("cluster", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(total).collect()  # k * (dims + 1) rows
    by = {(r["cluster"], r["at"]): int(r["total"]) for r in totals}
    out = centroids.copy()
    for c in range(k):
        if by.get((c, DIMS)):
            out[c] = [by[c, d] // by[c, DIMS] for d in range(DIMS)]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, exact_distances (how many centroids screening left) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance, taken = nearest(*unpacked(b), centroids)
            columns = [b.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64()), pa.array(taken, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "exact_distances"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", *COLUMNS).mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint, exact_distances int")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Assignments (see ``assigned``) after ``rounds`` rounds, as a scratch table, and the final centroids."""
    rows = compressed(vectors)
    centroids = starting(rows, k)
    if not len(centroids):
        return assigned(rows.limit(0), centroids), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return scratch(assigned(rows, centroids), "assigned"), centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector; a sum beyond a long is null."""
    rows, centroids = cluster(vectors)
    spark = rows.sparkSession
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = sum((r["s"] for r in inertia), 0)
    fits = lambda x: int(x) if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    table = [(r["cluster"], fits(r["s"]), fits(whole), digest(r["cluster"])) for r in inertia]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = rows.join(F.broadcast(facts), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
