"""Trees as relations: intervals from tags, structural joins, typed records of subtrees, products along paths.

A node is (tree columns, node, last): `node` is its number in document order and `last` the number of its subtree's last node, so
one node lies within another if its number lies in the other's interval.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import Tables


def intervals(tags: DataFrame, tree: list[str], at: str, step: str) -> DataFrame:
    """The nodes of trees given as tags in order: tags' columns but `step`, and node, last, depth, parent, size.

    step: 1 opens a node, -1 closes the innermost open one, 0 is a node without children.  node is the tag's `at`; last the `at`
    of the last tag before the one that closes it, or of the tree if nothing does; depth starts at 1; parent is null at the top;
    size is the largest `at` of the tree.  Closing tags that close nothing are left out.  Tags with a null `at` or step are no tags.

    Two neighbours among the tags of one depth open and close one node, and the last opening of the depth above is the parent:
    both are one ordered pass over the tree's tags, and nothing is joined.
    """
    w, whole = Window.partitionBy(*tree).orderBy(at), Window.partitionBy(*tree)
    t = tags.where(F.col(at).isNotNull() & F.col(step).isNotNull()).withColumn("__run", F.sum(step).over(w)).withColumn("size", F.max(at).over(whole))
    # closings below the top close nothing and lift the ground
    ground = F.least(F.min("__run").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    t = t.withColumn("__ground", ground).withColumn("__before", F.coalesce(F.lag("__ground").over(w), F.lit(0)))
    t = t.where((F.col(step) >= 0) | (F.col("__ground") == F.col("__before")))
    depth = F.col("__run") - F.col("__ground") + F.when(F.col(step) == 1, 0).otherwise(1)
    t = t.withColumn("depth", depth.cast("int")).drop("__run", "__ground", "__before")
    same = Window.partitionBy(*tree, "depth", F.col(step) == 0).orderBy(at)
    end = F.when(F.col(step) == 0, F.col(at)).otherwise(F.coalesce(F.when(F.lead(step).over(same) == -1, F.lead(at).over(same) - 1), F.col("size")))
    nodes = t.withColumn("last", end).where(F.col(step) >= 0)
    # a node is listed under its own depth, and if it can have children, under the next one as a parent
    own = F.struct(F.col("depth").alias("d"), F.lit(None).cast(tags.schema[at].dataType).alias("p"))
    seen = F.when(F.col(step) == 1, F.array(own, F.struct((F.col("depth") + 1).alias("d"), F.col(at).alias("p")))).otherwise(F.array(own))
    listed = nodes.withColumn("__s", F.explode(seen)).withColumn("__d", F.col("__s.d")).withColumn("__p", F.col("__s.p"))
    up = F.last("__p", ignorenulls=True).over(Window.partitionBy(*tree, "__d").orderBy(at, F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = listed.withColumn("parent", up).where("__p IS NULL").drop("__s", "__d", "__p", step)
    return out.withColumn("node", F.col(at))


def _blocks(low: Column, high: Column) -> Column:
    """The whole numbers from low to high as blocks (level, number) of 2^level numbers each, at most two of a level."""
    state = F.struct(low.cast("long").alias("lo"), (high.cast("long") + 1).alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        some, lo, hi = s["lo"] < s["hi"], s["lo"], s["hi"]
        block = lambda n: F.array(F.struct(level.alias("level"), n.alias("block")))
        left, right = some & (lo % 2 == 1), some & (hi % 2 == 1)
        out = F.concat(s["out"], F.when(left, block(lo)).otherwise(F.slice(block(lo), 1, 0)), F.when(right & (hi - 1 >= lo + F.when(left, 1).otherwise(0)), block(hi - 1)).otherwise(F.slice(block(lo), 1, 0)))
        return F.struct(F.shiftright(lo + F.when(left, 1).otherwise(0), 1).alias("lo"), F.shiftright(hi - F.when(right, 1).otherwise(0), 1).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), state, step, lambda s: s["out"])


def within(outer: DataFrame, inner: DataFrame, tree: list[str]) -> DataFrame:
    """Pairs of an outer and an inner node of one tree, the inner strictly below the outer: tree, o struct, i struct.

    An interval is parted into blocks of powers of two, at most two of a size, and a node lies in one block of each size up to the
    tree's; so a pair meets under exactly one block, by equality, however deep trees are.  inner must have `size`.
    """
    rest = lambda df: F.struct(*[c for c in df.columns if c not in tree])
    a = outer.where("last > node").select(*tree, rest(outer).alias("o"), F.inline(_blocks(F.col("node") + 1, F.col("last"))))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("size"), F.lit(1)) + 1)).cast("int"))
    b = inner.select(*tree, rest(inner).alias("i"), F.explode(levels).alias("level")).withColumn("block", F.expr("shiftright(CAST(i.node AS BIGINT), level)"))
    return a.join(b, [*tree, "level", "block"]).drop("level", "block")


def children(outer: DataFrame, inner: DataFrame, tree: list[str]) -> DataFrame:
    """As within, for inner nodes whose parent the outer is: a join by number."""
    rest = lambda df: F.struct(*[c for c in df.columns if c not in tree])
    a = outer.select(*tree, F.col("node").alias("__n"), rest(outer).alias("o"))
    return a.join(inner.select(*tree, F.col("parent").alias("__n"), rest(inner).alias("i")), [*tree, "__n"]).drop("__n")


def along(nodes: DataFrame, tree: list[str], value: str, product: Callable[[Column, Column], Column], *, node: str = "node", parent: str = "parent", max_rounds: int = 40) -> DataFrame:
    """nodes with `value` multiplied along the path from the root: product(product(root, .., parent's), own).

    product must be associative; it need not commute, and may have absorbing values.  Every round doubles the part of its path
    that a node has behind it: a node takes the product of the ancestor it stands at and goes on to where that one
    stands.  A parent that is null or unknown makes a root; numbers must be unique in a tree; a cycle is an error.
    """
    tables = Tables(nodes.sparkSession)
    known = nodes.select(*tree, F.col(node).alias("__up"), F.lit(True).alias("__known")).distinct()
    state = nodes.withColumn("__up", F.col(parent)).join(known, [*tree, "__up"], "left")
    state = tables.put(state.select(*nodes.columns, F.when(F.col("__known"), F.col("__up")).alias("__up")))
    for _ in range(max_rounds):
        if state.where("__up IS NOT NULL").isEmpty():
            return state.drop("__up")
        top = state.select(*tree, F.col(node).alias("__up"), F.col("__up").alias("__next"), F.col(value).alias("__v"), F.lit(True).alias("__met"))
        met = state.join(top, [*tree, "__up"], "left")
        moved = met.select(*[F.when(F.col("__met"), product(F.col("__v"), F.col(value))).otherwise(F.col(value)).alias(c) if c == value else F.col(c) for c in nodes.columns], F.col("__next").alias("__up"))
        after = tables.put(moved)
        tables.drop(state)
        state = after
    raise RuntimeError("the parents form a cycle")


@dataclass(frozen=True)
class Field:
    """A field of a record: what `of` gives of the nodes at `path` under the record's root ("" the root itself).

    path names tags from the root's child down, joined by "/"; "//x" is any x below.  take: "first" in document order,
    "count", or "list" of all in document order.
    """

    path: str
    of: Column | None = None
    take: str = "first"


def records(roots: DataFrame, nodes: DataFrame, tree: list[str], fields: dict[str, Field], *, tag: str = "tag", path: str = "path", kinds: list[str] | None = None) -> DataFrame:
    """One typed row for each root: tree columns, node, and the fields.

    roots: rows of nodes; nodes: with `path`, their tags from the tree's root joined by "/" (see paths); `of` is an expression over
    nodes' columns.  kinds: the tags that roots have, if that is known.  A missing field is null, 0 or an empty list.

    The path of a field tells at which depth its root stands, and the root is the last one before the node at that depth, if its subtree
    reaches to the node; "//x" looks at each depth above, or at those where the path has one of `kinds`.  So a node is listed once for each
    such depth, with the values of its own fields only, and all fields of all roots come from one ordered pass, grouped where it stands.
    Nodes that no field asks for are left out before it.
    """
    depth = lambda: F.char_length(path) - F.char_length(F.replace(F.col(path), F.lit("/"), F.lit(""))) + 1
    own = {f"__f{k}": (f, f.of if f.of is not None else F.lit(1)) for k, f in enumerate(fields.values())}
    exact = {p: p.count("/") + 1 for p in dict.fromkeys(f.path for f in fields.values()) if p and not p.startswith("//")}
    deep = list(dict.fromkeys(f.path[2:] for f in fields.values() if f.path.startswith("//")))
    ends = lambda p: F.col(path).endswith(f"/{p}")
    levels = [F.array().cast("array<int>")]
    for k in sorted(set(exact.values())):
        levels.append(F.when(reduce(Column.__or__, [ends(p) for p, n in exact.items() if n == k]), F.array(F.col("__depth") - k)).otherwise(F.array().cast("array<int>")))
    if deep:
        up = F.sequence(F.lit(1), F.col("__depth") - 1)
        if kinds is not None:
            up = F.filter(up, lambda d: F.element_at(F.split(F.col(path), "/"), d).isin(kinds))
        levels.append(F.when(F.col(tag).isin(deep) & (F.col("__depth") > 1), up).otherwise(F.array().cast("array<int>")))
    tags = [p.rsplit("/", 1)[-1] for p in exact] + deep
    below = nodes.where(F.col(tag).isin(tags)).withColumn("__depth", depth()).withColumn("__level", F.explode(F.array_distinct(F.concat(*levels))))

    def met(f: Field) -> Column:
        if not f.path:
            return F.lit(False)
        return F.col(tag) == f.path[2:] if f.path.startswith("//") else (F.col("__depth") - F.col("__level") == exact[f.path]) & ends(f.path)

    below = below.select(*tree, "__level", "node", F.lit(None).cast(roots.schema["last"].dataType).alias("__last"), *[F.when(met(f), of).alias(n) for n, (f, of) in own.items()])
    tops = roots.dropna(subset=tree).select(*tree, depth().alias("__level"), "node", F.col("last").alias("__last"), *[F.when(F.lit(not f.path), of).alias(n) for n, (f, of) in own.items()])
    # at one level no node is both a root and below one
    order = Window.partitionBy(*tree, "__level").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    root = F.last(F.when(F.col("__last").isNotNull(), F.struct("node", F.col("__last").alias("last"))), ignorenulls=True)
    pairs = tops.unionByName(below).withColumn("__root", root.over(order)).where("node <= __root.last").withColumn("__root", F.col("__root.node"))
    aggs = []
    for (name, f), n in zip(fields.items(), own):
        some = F.col(n).isNotNull()
        if f.take == "count":
            aggs.append(F.count(n).alias(name))
        elif f.take == "list":
            aggs.append(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct(F.col("node").alias("n"), F.col(n).alias("v"))))), lambda s: s["v"]).alias(name))
        else:
            aggs.append(F.min_by(F.col(n), F.when(some, F.col("node"))).alias(name))
    return pairs.groupBy(*tree, "__level", "__root").agg(*aggs).drop("__level").withColumnRenamed("__root", "node")


def paths(nodes: DataFrame, tree: list[str], *, tag: str = "tag", out: str = "path") -> DataFrame:
    """nodes with `out`: the tags from the tree's root down to each node, joined by "/"."""
    return along(nodes.withColumn(out, F.col(tag)), tree, out, lambda up, own: F.concat(up, F.lit("/"), own))
