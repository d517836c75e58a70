"""Recursive walks over VARIANT documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import child_path
from .closure import Tables


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, path, depth, key, pos, kind, value VARIANT): every value of every document, the root included, at any depth.

    Each level is opened from the one above, which is written once, until a level is empty; so the work follows the
    documents' size and depth, and none is too deep.
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1).alias("kind")
    level = docs.where("doc IS NOT NULL").select("doc_id", F.lit("$").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("pos"), kind("doc"), F.col("doc").alias("value"))
    out, spark, depth, tables = level, docs.sparkSession, 0, Tables(docs.sparkSession)
    while True:
        depth += 1
        e = level.where("kind IN ('OBJECT', 'ARRAY')").select("doc_id", F.col("path").alias("up"), F.col("value").alias("v")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        path = F.when(F.col("key").isNotNull(), child_path("up", "key")).otherwise(F.concat("up", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = tables.put(e.select("doc_id", path.alias("path"), F.lit(depth).alias("depth"), "key", "pos", kind("value"), "value"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, path, key, kind, text) of all values that hold no others."""
    n = nodes(docs).where(~F.col("kind").isin("OBJECT", "ARRAY"))
    return n.select("doc_id", "path", "key", "kind", F.try_variant_get("value", "$", "string").alias("text"))


def references(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, path, id): strings under any of the keys at any depth, alone or in an array."""
    n = nodes(docs)
    own = n.where(F.col("key").isin(*keys))
    single = own.where("kind = 'STRING'").select("doc_id", "path", F.try_variant_get("value", "$", "string").alias("id"))
    many = own.where("kind = 'ARRAY'").select("doc_id", "path", F.explode(F.try_variant_get("value", "$", "array<string>")).alias("id"))
    return single.unionByName(many).where("id IS NOT NULL")
