"""Operator 1: consistent weighted sampling."""

import hashlib
from collections import Counter

import numpy as np

from plumbline.llm import fingerprints
from plumbline.llm import queries as q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    low = sum(min(n, b[w]) for w, n in a.items())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def expected(rows):
    """id -> (n_chars, sha256 of the edited text, likeness to it and to the next text)"""
    rows, out = sorted(((i, t or "") for i, t in rows), reverse=True), {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(t, edited), jaccard(t, after))
    return out


def test_query_estimates_generalised_jaccard(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, got = expected(rows), {r["doc_id"]: r for r in q.op1_fingerprints(spark, SF).collect()}
    assert set(got) == set(want)
    assert all((r["n_chars"], r["edited_sha256"]) == want[i][:2] for i, r in got.items())
    off = np.array([[r["near_edited"] - want[i][2], r["near_next"] - want[i][3]] for i, r in got.items()])
    assert np.abs(off.mean(axis=0)).max() < 0.02 and off.std(axis=0).max() < 0.09
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) == len({r["fingerprint"] for r in got.values()})


def test_likeness_follows_weights(spark):
    """Collisions estimate similarity where only the counts differ, and where many slots can be compared."""
    rows = [(i, " ".join([f"w{i}"] * 6 + [f"v{i}"] * 4), " ".join([f"w{i}"] * 2 + [f"v{i}"] * 8)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    a = fingerprints.signatures(fingerprints.terms(df, "a", "t"), ["id"], "t", "fa")
    b = fingerprints.signatures(fingerprints.terms(df, "b", "t"), ["id"], "t", "fb")
    mean = a.join(b, "id").select(F.avg(fingerprints.likeness(F.col("fa"), F.col("fb")))).first()[0]
    assert abs(mean - 6 / 14) < 0.02


def test_successors_need_no_single_partition(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)]
    df = spark.createDataFrame(rows, "id long, t string")
    dealt, run, copy, window = fingerprints.with_next(df, "id")
    got = {r["id"]: r["n"] for r in dealt.withColumn("n", F.lead("id").over(window)).where(F.col(copy) == 0).collect()}
    assert got == {i: (i - 1) % 101 for i in range(101)}
    assert dealt.select(run).distinct().count() > 4


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "é"), (5, "one two three"), (6, "x " * 20_000), (7, "one two three"), (8, "𝄞𝄞𝄞a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edited", F.lit(1)).withColumn("__run", F.lit(2))
    got, want = {r["doc_id"]: r for r in fingerprints.edited_likeness(df).collect()}, expected(rows)
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] == "0" * (fingerprints.SLOTS * fingerprints.DIGITS)
    assert got[5]["fingerprint"] == got[7]["fingerprint"]
    assert got[2]["near_next"] == 1.0 and got[4]["near_edited"] <= 1.0
    assert fingerprints.edited_likeness(df.limit(0)).count() == 0
    alone = fingerprints.edited_likeness(df.where("doc_id = 5")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"one two" + b"one tw").hexdigest() and alone["near_next"] == 1.0
    assert fingerprints.edited_likeness(df.union(df)).count() == 16
