"""Files that documents name: listed, hashed, looked at again, and held against references."""

import hashlib
import json
import os

from plumbline.plans import rules
from plumbline.sources import inventory
from plumbline.sources.documents import documents


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_files_and_changes(spark, tmp_path):
    for name in ("a/one.bin", "a/two.bin", "a/unnamed.bin", "b/three.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    here = lambda n: str(tmp_path / n)
    paths = spark.createDataFrame([(here(n),) for n in ("a/one.bin", "a/one.bin", "a/two.bin", "b/three.bin", "a/gone.bin", "nowhere/x.bin", "a")] + [(None,)], "path string")
    first = inventory.hashed(spark, inventory.listing(spark, paths, block=1), block=2).cache()
    assert {r["path"]: (r["length"], r["sha256"]) for r in first.collect()} == {here(n): (len(n), sha(n.encode())) for n in ("a/one.bin", "a/two.bin", "b/three.bin")}
    (tmp_path / "a/one.bin").write_bytes(b"other")
    os.utime(tmp_path / "a/two.bin", (1, 1))
    (tmp_path / "b/three.bin").unlink()
    (tmp_path / "a/gone.bin").write_bytes(b"new")
    now = inventory.look_again(spark, first, inventory.listing(spark, paths)).cache()
    assert {r["path"]: r["status"] for r in inventory.changes(first, now).collect()} == {here("a/one.bin"): "changed", here("a/two.bin"): "touched", here("b/three.bin"): "removed", here("a/gone.bin"): "added"}
    # a file of the same size and time is not opened again: what was known of it stays
    trusted = first.selectExpr("path", "length", "modified", "'known' AS sha256")
    assert {r["sha256"] for r in inventory.look_again(spark, trusted, first.select("path", "length", "modified")).collect()} == {"known"}
    assert inventory.changes(first.limit(0), first.limit(0)).count() == 0
    assert inventory.listing(spark, paths.limit(0)).count() == 0


def test_references(spark):
    ref = lambda p, d: {"path": p, "sha256": d}
    doc = {"content_reference": ref("/x", "A" * 64), "clean_visual_reference": ref("/gone", "b" * 64), "runtime_preflight": ref("relative", "c" * 64), "session_reuse": {"artifacts": [7, ref("/x", "d" * 64), ref("/x", "short")]}}
    docs = documents(spark.createDataFrame([("1", json.dumps(doc)), ("2", "[]"), ("3", None)], "doc_id string, raw string"))
    files = spark.createDataFrame([("/x", "a" * 64), ("/x", "a" * 64), ("/y", None)], "path string, sha256 string")
    got = {(r["code"], r["path"]) for r in rules.reference_files(rules.references_of(docs), files).collect()}
    assert got == {("SPEC_REFERENCE_NOT_FOUND", "clean_visual_reference.path"), ("SPEC_REFERENCE_HASH_MISMATCH", "session_reuse.artifacts[1].sha256")}
