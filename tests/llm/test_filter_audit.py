"""Operator 13 against a simulation of every order, and its edge cases."""

import re
from itertools import permutations

import pytest

from plumbline.llm import filter_audit

LABELS = "doc_id long, quality long, toxic long"


def slow(docs, labels):
    """docs: (doc_id, text, source)."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, _ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails.append(f + "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in docs))
    out, shapley = {}, {}
    for part in {s or "" for *_, s in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
                out[part, order, step] = (len(left), len(removed), sum(x in f for _, f in mine) - len(removed), sum(f == x for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed))
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS n", "4 AS __least", "5 AS same", "6 AS quality")
    return [tuple(r) for r in filter_audit.audit(df, spark.createDataFrame(labels, LABELS)).collect()]


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = [(1, None, "a"), (2, "", "a"), (3, long, "a"), (4, long, None), (4, long, ""), (3, long, "a"), (None, long, "b"), (None, long, "b"), (7, long + " #", "a"), (8, "SHOUT " * 50, "b"),
            (9, "x " * 30_000, "b"), (10, "É é \x0b one\x1ctwo", "b"), (11, long + " #", "b"), (-5, long + " #", "b")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, None), (7, None, 1), (99, 1, 1), (None, 1, 1), (2, 0, 0)]
    got = run(spark, docs, labels)
    assert len(got) == len(set(got)) == 3 * 600
    assert set(got) == slow(docs, labels)


def test_hot_text(spark):
    docs = [(i, "same " * 60, f"s{i % 3}") for i in range(300)] + [(1000 + i, f"{i} " * i, "s0") for i in range(60)]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 300, 3)]
    assert set(run(spark, docs, labels)) == slow(docs, labels)


def test_empty(spark):
    assert run(spark, [], []) == []
    assert len(run(spark, [(1, "x", "a")], [])) == 600


@pytest.mark.parametrize("names", ["A", "AB", "ABC"])
def test_any_number_of_filters(spark, names):
    n = len(names)
    rows = [("p", m, (m * 7) % 5 + 1, m % 2) for m in range(1 << n)] + [(None, None, None, None), ("p", 0, 2, None)]
    counts = spark.createDataFrame(rows, "part string, mask int, n long, good int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.interactions(counts, names, part_col="part", labels={"good_lost": "good"}).collect()}
    for order in map("".join, permutations(names)):
        left = [(m or 0, c or 0, g or 0) for p, m, c, g in rows if p == "p"]
        for step, x in enumerate(order, 1):
            bit = 1 << names.index(x)
            gone, left = [r for r in left if r[0] & bit], [r for r in left if not r[0] & bit]
            r = got["p", order, step]
            assert (r["kept"], r["removed"], r["good_lost"]) == (sum(c for _, c, _ in left), sum(c for _, c, _ in gone), sum(c * g for _, c, g in gone))
    assert {got[None, o, s]["kept"] for p, o, s in got if p is None} == {0}


def test_refusals(spark):
    counts = spark.createDataFrame([("p", 4, 1)], "part string, mask int, n long")
    with pytest.raises(Exception, match="no such filter"):
        filter_audit.interactions(counts, "AB", part_col="part").collect()
    with pytest.raises(ValueError):
        filter_audit.interactions(counts, "ABCDEFGH", part_col="part")
