"""Merkle manifest of a dataset by parent-preimage paths.

Every row is a leaf: the hash of its fields, each with its length in front.  The leaves of a group (a source)
stand in a fixed order; runs of three nodes become one parent until a single node, the subroot, remains.  The
subroots form one more tree, whose top is the root.

A parent is stored as its *preimage*: the concatenated hashes of its children, 64 characters each.  A node's
path holds the preimages of all its ancestors with the node's own slot in each.  Siblings are what is left of
a preimage when the own slot is cut out; a changed leaf is folded by putting its hash into the slot, hashing,
and putting the result into the slot one level up.

Order and size.  Rows are numbered in a range-partitioned sort, by the counts of the partitions before: no task
sees a whole group, however many rows it has.  Levels are built from below, each with a third of the rows of the
level before, and paths are handed down from above: a level meets only its parents, so each leaf is joined once.

Input cases: nulls in any field are ``-`` (an empty text is ``0:``).  Null groups and null ids are ordered first.
Rows with equal ids are ordered by their leaf hash; rows equal in all fields are leaves of their own.  An empty
table has no leaves and no root.  A group of one row has its leaf as subroot.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import drop_scratch, scratch

FANOUT, DIGEST = 3, 64
#: Fields of a document's leaf, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels that a tree may have: more rows than a long can count.
DEEPEST = 40


@dataclass
class Manifest:
    """The root (None for an empty table) and, for each leaf, its subroot and path (array of preimage, slot; lowest first)."""

    root: str | None
    leaves: DataFrame


def field_text(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def proof_text(path: str = "path") -> Column:
    """Hashes of all siblings, from the lowest level to the root, left to right within a level."""
    return F.expr(f"array_join(transform({path}, p -> overlay(p.preimage PLACING '' FROM {DIGEST} * p.slot + 1 FOR {DIGEST})), '')")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that follows from a leaf's hash and the preimages on its path, with the leaf's side computed anew."""
    return F.expr(f"aggregate({path}, {leaf}, (h, p) -> sha2(overlay(p.preimage PLACING h FROM {DIGEST} * p.slot + 1 FOR {DIGEST}), 256))")


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``part`` and ``rank``: their number from 0 in the order of ``keys``, nulls first.

    Rows equal in all keys are numbered in any order.
    """
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = scratch(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("part", F.shiftright("at", 33))
    # A row for each partition of the sort: small, whatever the number of rows.
    counts = at.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = at.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return numbered.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "before")


def parents(nodes: DataFrame) -> DataFrame:
    """One level up.  ``nodes``: tree, pos, hash, n (nodes of the tree on this level); trees of one node are done."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    runs = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("up")).agg(kids.alias("kids"), F.first("n").alias("n"))
    preimage = runs.select("tree", F.col("up").alias("pos"), F.array_join("kids.hash", "").alias("preimage"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
    return preimage.withColumn("hash", F.sha2("preimage", 256))


def depth_of(n: int) -> int:
    return next(d for d in range(DEEPEST) if FANOUT**d >= n)


def grown(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and all levels above them; ``most`` is the size of the largest tree."""
    levels = [nodes]
    for level in range(depth_of(most)):
        levels.append(scratch(parents(levels[-1].select("tree", "pos", "hash", "n")), f"level{level + 1}"))
    return levels


def tops(levels: list[DataFrame], depths: set[int]) -> DataFrame:
    """tree, level, hash of the last node of each tree."""
    found = [levels[d].where("n = 1").select("tree", F.lit(d).alias("level"), "hash") for d in sorted(depths)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def with_paths(levels: list[DataFrame], above: DataFrame, depths: set[int]) -> DataFrame:
    """The lowest level with ``path`` and ``subroot``.  ``above``: tree, level, subroot, path of each tree's last node."""
    out = None
    for d in range(len(levels) - 1, -1, -1):
        nodes, found = levels[d], []
        if d in depths:
            found.append(nodes.where("n = 1").join(above.where(F.col("level") == d).select("tree", "subroot", "path"), "tree"))
        if out is not None:
            up = out.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), "preimage", "subroot", F.col("path").alias("rest"))
            if "preimage" in nodes.columns:
                up = up.withColumnRenamed("preimage", "up_preimage")
            own = F.struct(F.col("up_preimage" if "preimage" in nodes.columns else "preimage").alias("preimage"), F.expr(f"cast(pos % {FANOUT} as int)").alias("slot"))
            met = nodes.where("n > 1").join(up, (F.col("tree") == F.col("up_tree")) & (F.expr(f"pos div {FANOUT}") == F.col("up_pos")))
            found.append(met.select(*nodes.columns, "subroot", F.concat(F.array(own), F.col("rest")).alias("path")))
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out


NO_PATH = "cast(array() as array<struct<preimage:string,slot:int>>)"


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", leaf: str = "leaf", tie: str | None = None) -> Manifest:
    """Order the rows by group, ``order`` and leaf hash, and hash them up to one root; all columns are carried along.

    ``tie`` may name a column of row numbers, by which the sort can part very many rows that are equal in everything else; as such rows are
    equal leaves, their order changes no hash.
    """
    lined = ranked(rows, group, order, leaf, *([tie] if tie else []))
    # The first rank of a group names its tree.  Its counts come from each partition of the sort, not from each row.
    pieces = lined.groupBy("part", group).agg(F.count("*").alias("rows"), F.min("rank").alias("least"))
    of = W.partitionBy(group)
    pieces = pieces.select("part", F.col(group).alias("g"), F.min("least").over(of).alias("tree"), F.sum("rows").over(of).alias("n"))
    pieces = scratch(pieces, "groups")
    deep = F.lit(0)
    for d in range(DEEPEST - 1):
        deep = deep + F.when(F.col("n") > F.lit(FANOUT**d), 1).otherwise(0)
    sizes = pieces.groupBy(deep.alias("depth")).agg(F.max("n").alias("n")).collect()  # a row for each depth
    if not sizes:
        return Manifest(None, rows.limit(0).select("*", F.lit(None).cast("string").alias("subroot"), F.expr(f"{NO_PATH}").alias("path")))
    nodes = lined.withColumnRenamed("part", "p").join(pieces, (F.col("p") == F.col("part")) & F.col(group).eqNullSafe(F.col("g"))).drop("p", "part", "g")
    nodes = nodes.select(*rows.columns, "tree", (F.col("rank") - F.col("tree")).alias("pos"), "n", F.col(leaf).alias("hash"))
    depths = {r["depth"] for r in sizes}
    levels = grown(nodes, max(r["n"] for r in sizes))

    groups = ranked(tops(levels, depths), "tree")
    count = groups.count()
    low = groups.select(F.col("tree").alias("of"), "level", F.lit(0).alias("tree"), F.col("rank").alias("pos"), "hash", F.lit(count).cast("long").alias("n"))
    upper = grown(low, count)
    root = upper[-1].where("n = 1").select("hash").first()[0]
    end = upper[0].sparkSession.range(1).select(F.lit(0).alias("tree"), F.lit(len(upper) - 1).alias("level"), F.lit(root).alias("subroot"), F.expr(NO_PATH).alias("path"))
    above = with_paths(upper, end, {len(upper) - 1})
    above = scratch(above.select(F.col("of").alias("tree"), "level", F.col("hash").alias("subroot"), "path"), "subroots")
    return Manifest(root, with_paths(levels, above, depths).select(*rows.columns, "subroot", "path"))


def verify(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document.

    Where ``changed`` holds, the root is recomputed as if the text were ``changed_text``; ``verified`` tells whether it is still the root.
    """
    columns = [F.col(c) for c in FIELDS]
    told = leaf_hash(columns)
    if changed is None:
        given = told
    else:
        given = F.when(F.coalesce(changed, F.lit(False)), leaf_hash([changed_text if c == "text" else F.col(c) for c in FIELDS])).otherwise(told)
    leaves = scratch(docs.select("doc_id", "source", told.alias("leaf"), given.alias("given"), F.monotonically_increasing_id().alias("row")), "leaves")
    made = manifest(leaves, tie="row")
    drop_scratch(leaves)
    root = F.lit(made.root).cast("string")
    out = made.leaves.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(proof_text(), 256).alias("proof_sha256"), folded("given").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> DataFrame:
    """``verify`` with the line breaks deleted from the texts whose id has an even CRC-32."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return verify(docs, even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
