"""Documents flattened, put together again, and projected, against Python's JSON."""

import copy
import hashlib
import json
import random

from pyspark.sql import functions as F

from plumbline.operators import fold
from plumbline.plans import projection
from plumbline.sources.documents import json_nodes, json_values


def canonical(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def value(rng, depth=0):
    kind = rng.choice("osnblfe" if depth < 5 else "snbf")
    if kind == "o":
        return {rng.choice(["a", "b", "A", "é", "a b", 'q"', "\\", "\n", "\x1f", "", "𝄞", "drop"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind in "le":
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 12 if kind == "l" else 1))]
    return {"s": rng.choice(["", "x", 'a"b\\', "\x01\x1f\n", "é𝄞", "drop"]), "n": rng.randint(-9, 10**20), "b": rng.choice([True, False, None]), "f": rng.choice([1.0, 0.1, -2.5e-7, 1e22, 1e16])}[kind]


def without(v, key):
    if isinstance(v, dict):
        return {k: without(x, key) for k, x in v.items() if k != key}
    return [without(x, key) for x in v if x != "drop"] if isinstance(v, list) else v


def test_rebuilt_equals_python(spark):
    rng = random.Random(4)
    docs = [value(rng) for _ in range(150)] + [{}, [], "", 0, None, [[[[[[]]]]]], {"a": {"drop": {"x": [1]}}}]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)]
    odd = [(1000, None), (1001, ""), (1002, "{"), (1003, '{"a": NaN}'), (1004, "1e999"), (1005, "[" * 100_000 + "]" * 100_000), (1006, '{"a": 1, "a": 2}')]
    nodes = json_nodes(spark.createDataFrame(rows + odd, "doc_id int, raw string")).cache()
    got = {r["doc_id"]: r["text"] for r in fold.rebuilt(nodes).collect()}
    assert got == {i: canonical(d) for i, d in enumerate(docs)} | {1006: '{"a":2}'}
    drop = (F.col("key") == "drop") | (F.col("pos").isNotNull() & (F.col("text") == '"drop"'))
    got = {r["doc_id"]: r["text"] for r in fold.rebuilt(nodes, drop=drop).where("doc_id < 1000").collect()}
    assert got == {i: canonical(without(d, "drop")) for i, d in enumerate(docs)}
    assert {r["doc_id"]: r["fault"] for r in nodes.where("fault IS NOT NULL").collect()} == {1000: "invalid", 1001: "invalid", 1002: "invalid", 1003: "non_finite", 1004: "non_finite", 1005: "invalid"}
    assert fold.rebuilt(nodes, drop=F.col("node") == 0).where("text IS NOT NULL").count() == 0
    assert fold.rebuilt(nodes.limit(0)).count() == 0


def test_identities(spark):
    base = {"page_id": "page-001", "x": 1.0, "modules": {"typography": {"items": [{"text": "a", "n": 2}, 7]}, "icons": {"icons": [{"id": 1}]}}, "activated_modules": ["typography", "icons"]}
    full = copy.deepcopy(base) | {"delivery_status": "p", "runtime_preflight": {"path": "/a"}, "visual_gate": [], "editability_gate": None}
    full["modules"]["high_risk"] = {"items": [1]}
    full["modules"]["typography"]["items"][0]["font_declaration_verified"] = True
    full["modules"]["icons"]["icons"][0]["selectable_picture_verified"] = {"deep": [1, {"er": 2}]}
    full["activated_modules"].insert(1, "high_risk")
    kept = {"modules": {"typography": {"items": {"font_declaration_verified": 1}}, "other": {"high_risk": 1}}, "high_risk": 2, "activated_modules": "high_risk"}  # not in those places
    rows = [("base", json.dumps(base)), ("full", json.dumps(full)), ("kept", json.dumps(kept)), ("array", "[1]"), ("none", None)]
    got = {r["doc_id"]: (r["input_sha256"], r["content_sha256"]) for r in projection.identities(spark.createDataFrame(rows, "doc_id string, raw string")).collect()}
    sha = lambda d: hashlib.sha256(canonical(d).encode()).hexdigest()
    assert got == {"base": (sha(base), sha(base)), "full": (sha(full), sha(base)), "kept": (sha(kept), sha(kept)), "array": (None, None), "none": (None, None)}


def test_whole_and_dropped_in_the_same_rounds(spark):
    rng = random.Random(9)
    docs = [value(rng) for _ in range(60)] + [{"drop": [1, {"x": 2}]}, ["drop"], {}]
    nodes = json_nodes(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, raw string"))
    drop = (F.col("key") == "drop") | (F.col("pos").isNotNull() & (F.col("text") == '"drop"'))
    got = {r["doc_id"]: (r["text"], r["whole"]) for r in fold.rebuilt(nodes, drop=drop, whole=True).collect()}
    assert got == {i: (canonical(without(d, "drop")), canonical(d)) for i, d in enumerate(docs)}


def test_values_are_those_of_nodes(spark):
    rows = [(1, '{"a": [1, {"b": null}], "a": [2]}'), (2, "[" + ",".join(["[]"] * 70_000) + "]"), (3, "7"), (4, None), (5, "{"), (6, "[NaN]"), (7, "[1e999]"), (8, "[" * 100_000)]
    texts = spark.createDataFrame(rows, "doc_id int, raw string")
    count = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "fault").agg(F.count("*"), F.min("node"), F.max("node"), F.count_distinct("node")).collect())
    assert count(json_values(texts)) == count(json_nodes(texts))
