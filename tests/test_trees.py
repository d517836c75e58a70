"""Trees: intervals, structural joins, records and products along paths, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import trees


def random_tags(rng, n, loose):
    """(at, step, tag): mostly nested tags; loose ones also close what is not open."""
    out, open_ = [], 0
    for i in range(n):
        step = rng.choice([1, 1, 0, -1, -1])
        if step < 0 and not open_ and not loose:
            step = 0
        open_ = max(0, open_ + step)
        out.append((3 * i, step, rng.choice("abc")))
    return out


def slow_nodes(tags):
    stack, out, top = [], {}, max((t[0] for t in tags), default=None)
    for at, step, tag in tags:
        if step >= 0:
            out[at] = {"tag": tag, "last": at if step == 0 else top, "depth": len(stack) + 1, "parent": stack[-1] if stack else None, "path": "/".join([*(out[s]["tag"] for s in stack), tag])}
            if step:
                stack.append(at)
        elif stack:
            out[stack.pop()]["last"] = at - 1
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(5)
    trees_ = {f"t{k}": random_tags(rng, rng.choice([0, 1, 2, 30, 120]), k % 2) for k in range(12)} | {"deep": [(i, 1, "a") for i in range(70)], "flat": [(i, 0, "b") for i in range(50)]}
    rows = [(t, *x, 1, 2) for t, tags in trees_.items() for x in tags] + [(None, 0, 1, "a", 1, 2), ("nulls", None, 1, "a", 1, 2), ("nulls", 1, None, "a", 1, 2)]
    nodes = trees.intervals(spark.createDataFrame(rows, "tree string, at int, step int, tag string, o int, i int"), ["tree"], "at", "step")
    return trees.paths(nodes, ["tree"]).cache(), {t: slow_nodes(tags) for t, tags in trees_.items()}


def test_intervals(forest):
    got = {(r["tree"], r["node"]): (r["tag"], r["last"], r["depth"], r["parent"], r["path"]) for r in forest[0].where("tree IS NOT NULL").collect()}
    assert got == {(t, n): (v["tag"], v["last"], v["depth"], v["parent"], v["path"]) for t, nodes in forest[1].items() for n, v in nodes.items()}


def test_within_and_children(forest):
    nodes = forest[0].where("tree IS NOT NULL")
    pairs = [(r["tree"], r["o"]["node"], r["i"]["node"]) for r in trees.within(nodes.where("tag = 'a'"), nodes.where("tag <> 'c'"), ["tree"]).collect()]
    want = [(t, a, b) for t, x in forest[1].items() for a, v in x.items() for b, w in x.items() if v["tag"] == "a" and w["tag"] != "c" and a < b <= v["last"]]
    assert sorted(pairs) == sorted(want) and len(want) > 2000
    kids = [(r["tree"], r["o"]["node"], r["i"]["node"]) for r in trees.children(nodes.where("tag = 'a'"), nodes, ["tree"]).collect()]
    assert sorted(kids) == sorted((t, w["parent"], b) for t, x in forest[1].items() for b, w in x.items() if w["parent"] is not None and x[w["parent"]]["tag"] == "a")


def test_records(forest):
    nodes = forest[0].where("tree IS NOT NULL")
    at = F.col("node").cast("string")
    fields = {"own": trees.Field("", F.col("tag")), "kid": trees.Field("b", at), "grand": trees.Field("b/c", at), "n": trees.Field("//c", take="count"), "all": trees.Field("//b", at, "list"), "none": trees.Field("x", at)}
    got = {(r["tree"], r["node"]): tuple(r[f] for f in fields) for r in trees.records(nodes.where("tag = 'a'"), nodes, ["tree"], fields).collect()}
    want = {}
    for t, x in forest[1].items():
        for a, v in x.items():
            if v["tag"] == "a":
                below = [(b, w) for b, w in sorted(x.items()) if a < b <= v["last"]]
                first = lambda p: next((str(b) for b, w in below if w["path"] == f"{v['path']}/{p}"), None)  # noqa: B023, E731
                want[t, a] = ("a", first("b"), first("b/c"), sum(w["tag"] == "c" for _, w in below), [str(b) for b, w in below if w["tag"] == "b"], None)
    assert got == want


def test_records_list_a_node_once_whatever_the_size_of_its_tree(spark):
    # 400 roots of two fields each in one tree: a node below a root is shuffled once, not once for each block size of the tree
    rows = [("t", 0, None, 1200, 1200, "r", "r")] + [r for k in range(400) for r in (("t", 3 * k + 1, 0, 3 * k + 3, 1200, "s", "r/s"), ("t", 3 * k + 2, 3 * k + 1, 3 * k + 2, 1200, "a", "r/s/a"), ("t", 3 * k + 3, 3 * k + 1, 3 * k + 3, 1200, "t", "r/s/t"))]
    nodes = spark.createDataFrame(rows, "tree string, node int, parent int, last int, size int, tag string, path string")
    fields = {"a": trees.Field("a", F.col("node")), "texts": trees.Field("//t", F.col("node"), "list"), "own": trees.Field("", F.col("parent"))}
    for kinds in (None, ["s"]):
        got = trees.records(nodes.where("tag = 's'"), nodes, ["tree"], fields, kinds=kinds)
        assert {(r["node"], r["a"], tuple(r["texts"]), r["own"]) for r in got.collect()} == {(3 * k + 1, 3 * k + 2, (3 * k + 3,), 0) for k in range(400)}
    plan = trees.records(nodes.where("tag = 's'"), nodes, ["tree"], fields, kinds=["s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_along_does_not_commute_and_absorbs(spark):
    rng = random.Random(2)
    rows = [("t", n, rng.randrange(n) if n and n != 7 else (99 if n == 7 else None), float(rng.choice([1, 2, -1])), float(rng.randint(-3, 3)), rng.random() < 0.1) for n in range(60)]
    df = spark.createDataFrame(rows, "tree string, node int, parent int, s double, o double, lost boolean").withColumn("v", F.when(~F.col("lost"), F.struct("s", "o")))
    both = lambda up, own: F.when(up.isNotNull() & own.isNotNull(), F.struct((up["s"] * own["s"]).alias("s"), (up["o"] + up["s"] * own["o"]).alias("o")))
    got = {r["node"]: r["v"] and tuple(r["v"]) for r in trees.along(df, ["tree"], "v", both).collect()}
    want = {}
    for _, n, p, s, o, lost in rows:
        up = want[p] if p in want else (1.0, 0.0)
        want[n] = None if lost or up is None else (up[0] * s, up[1] + up[0] * o)
    assert got == want
    cycle = spark.createDataFrame([("t", 1, 2, "a"), ("t", 2, 1, "b")], "tree string, node int, parent int, v string")
    with pytest.raises(RuntimeError):
        trees.along(cycle, ["tree"], "v", F.concat, max_rounds=4)
    assert trees.along(cycle.limit(0), ["tree"], "v", F.concat).count() == 0
