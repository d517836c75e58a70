"""Documents put together again from their nodes, from the leaves to the root."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import Tables


def _quoted(key: Column) -> Column:
    """A member's name as JSON writes it: the short escapes, other control characters by number, all else as it is."""
    out = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    every = out
    for code in range(32):
        every = F.replace(every, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.concat(F.lit('"'), F.when(key.rlike(r"[\x00-\x1f]"), every).otherwise(out), F.lit('"'))


def rebuilt(nodes: DataFrame, *, drop: Column | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, text): the canonical JSON of each document without the nodes for which `drop` holds, and all below them.

    nodes: doc_id, node, parent, depth, key, pos, kind, text as json_nodes gives them; other columns are for `drop`, for which null
    is no.  Members come by key, items by place; what loses all of its members stays as an empty one.  A document whose root
    is dropped has a null text; documents with a fault are left out; document ids must be unique.  With `whole` there is a column
    `whole` as well: the canonical JSON of all nodes, put together in the same rounds.

    The deepest level is grouped by parent and put into the level above, and so on: each node is shuffled once by its parent and
    once by itself, and a level is a table that is dropped as soon as the next one is written.
    """
    tables = Tables(nodes.sparkSession)
    gone = F.coalesce(drop, F.lit(False)) if drop is not None else F.lit(False)
    rows = tables.put(nodes.where("node IS NOT NULL").select("doc_id", "node", "parent", "depth", "key", "pos", "kind", "text", gone.alias("gone"), *[F.col("text").alias("whole")] * whole))
    texts = ["text", *["whole"] * whole]
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    level = tables.put(rows.where(F.col("depth") == deepest))
    # a container with no children left was never filled; at the deepest level all containers are empty
    made = lambda t: F.coalesce(t, F.when(F.col("kind") == "OBJECT", "{}").otherwise("[]"))
    named = lambda t: F.when(F.col("key").isNotNull(), F.concat(_quoted(F.col("key")), F.lit(":"), made(t))).otherwise(made(t))
    for depth in range(deepest, 0, -1):
        kept = {t: named(t) if t == "whole" else F.when(~F.col("gone"), named(t)) for t in texts}
        children = level.select("doc_id", F.col("parent").alias("node"), F.struct("key", "pos", *[m.alias(t) for t, m in kept.items()]).alias("c"))
        listed = children.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list("c")).alias("c"))
        inside = lambda t: F.array_join(F.transform("c", lambda c: c[t]), ",")  # noqa: B023, E731
        joined = listed.select("doc_id", "node", *[inside(t).alias(f"in_{t}") for t in texts])
        above = rows.where(F.col("depth") == depth - 1)
        held = above.where(F.col("text").isNull()).join(joined, ["doc_id", "node"], "left")
        ends = lambda t: F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), F.coalesce(f"in_{t}", F.lit("")), F.lit("}"))).otherwise(F.concat(F.lit("["), F.coalesce(f"in_{t}", F.lit("")), F.lit("]")))
        filled = held.select(*[ends(c).alias(c) if c in texts else F.col(c) for c in rows.columns])
        after = tables.put(filled.unionByName(above.where(F.col("text").isNotNull())))
        tables.drop(level)
        level = after
    out = tables.put(level.select("doc_id", F.when(~F.col("gone"), made("text")).alias("text"), *[made("whole").alias("whole")] * whole))
    tables.drop(rows, level)
    return out
