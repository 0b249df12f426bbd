"""Search for a key at any depth of JSON documents, by exploding variants level by level.

The depth of the deepest document is one number, found in one pass; the search is then a plan of that many lateral explosions, each of
which only carries the objects and arrays of its level.

Input cases: a null or invalid document has no keys.  A key whose value is null is found with a null value.  Members of an object are
visited in the order of their names, as variants keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STRING = r'"(?:[^"\\]++|\\.)*+"'


def depth(json: Column) -> Column:
    """How deep objects and arrays lie in one another in a JSON text; 0 for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(json, STRING, ""), r"[^\[\]{}]+", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), zero, step)["most"]


def find_key(docs: DataFrame, key: str, json: str = "value", by: str = "doc_id") -> DataFrame:
    """``by``, path, place, found (the value as JSON text) of each member named ``key``, at any depth.

    ``place`` holds the positions on the way to the object that has the member; in its order objects come before what lies in them.
    """
    docs = docs.select(F.col(by).alias("doc"), F.try_parse_json(F.col(json)).alias("v"), F.col(json).alias("j"))
    levels = docs.where("v is not null").agg(F.max(depth(F.col("j")))).first()[0] or 0
    level = docs.select("doc", F.lit("$").alias("path"), F.array().cast("array<int>").alias("place"), "v")
    found = level.where("false").select("doc", "path", "place", F.lit("").alias("found"))
    for _ in range(levels):
        parents = level.select("doc", F.col("path").alias("up"), F.col("place").alias("at"), F.col("v").alias("holder"))
        inner = parents.lateralJoin(parents.sparkSession.tvf.variant_explode(F.col("holder").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        inner = inner.select("doc", F.concat("up", step).alias("path"), F.concat("at", F.array("pos")).alias("place"), "at", "key", F.col("value").alias("v"))
        hits = inner.where(F.col("key") == key).select("doc", "path", F.col("at").alias("place"), F.to_json("v").alias("found"))
        found = found.unionByName(hits)
        level = inner.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).select("doc", "path", "place", "v")
    return found.withColumnRenamed("doc", by)


def first_found(docs: DataFrame, key: str, json: str = "value", by: str = "doc_id") -> DataFrame:
    """``by``, found: the value of the first member named ``key`` that isn't null, in the order of ``find_key``."""
    hits = find_key(docs, key, json, by).where("found is not null and found <> 'null'")
    return hits.groupBy(by).agg(F.min_by("found", "place").alias("found"))
