"""Free names against going through the rows one after another."""

import random
from pathlib import PurePosixPath

import pytest

from plumbline.operators import keys


def slow(rows, taken, suffixes=False):
    """rows: (order, folder, name)."""
    used, out = {(f, n) for f, n in taken if n is not None}, {}
    for at, folder, name in sorted(rows, key=lambda r: r[0]):
        got = name
        if name is not None and (folder, name) in used:
            end = "".join(PurePosixPath(name).suffixes) if suffixes else ""
            stem, k = name[: len(name) - len(end)], 2
            while (folder, got := f"{stem}-{k}{end}") in used:
                k += 1
        used.add((folder, got))
        out[at] = got
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    stems = ["a", "a", "a", "b", "a-2", "a-3", "a-2-2", "a-5", "a-02", "a-1", "a-1-2", "", "-2", "c-10", "c", "a-3-2", "a-2-2-2", "a-99999999999999999999"]
    name = lambda: rng.choice([None, *[s + (rng.choice(["", ".xml", ".b.xml"]) if seed == 2 else "") for s in stems * 3]])
    rows = [(i, rng.choice(["x", "y", None]), name()) for i in range(180)]
    taken = [(rng.choice(["x", None]), name()) for _ in range(14)] + [("x", "a-4"), ("x", "a-4"), ("x", "c-3"), ("x", "c")]
    rng.shuffle(rows)
    new = spark.createDataFrame(rows, "at int, folder string, name string").selectExpr("*", "1 AS stem", "2 AS k", "3 AS nth")
    old = spark.createDataFrame(taken, "folder string, name string")
    got = {r["at"]: r["unique_name"] for r in keys.free_names(new, old, "name", ["at"], folder=["folder"], suffixes=seed == 2).collect()}
    assert got == slow(rows, taken, seed == 2)


def test_hot_name_and_edges(spark):
    rows = [(i, None, "slide" if i % 3 else f"slide-{i}") for i in range(400)]
    new = spark.createDataFrame([(i, n) for i, _, n in rows], "at int, name string")
    assert {r["at"]: r["unique_name"] for r in keys.unique_names(new, "name", ["at"]).collect()} == slow(rows, [])
    assert [r["unique_name"] for r in keys.unique_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2")], "at int, name string"), "name", ["at"]).orderBy("at").collect()] == ["a", "a-2", "a-2-2"]
    assert keys.unique_names(new.limit(0), "name", ["at"]).count() == 0
    assert keys.unique_names(new.selectExpr("at", "CAST(NULL AS STRING) AS name"), "name", ["at"]).where("unique_name IS NULL").count() == 400
