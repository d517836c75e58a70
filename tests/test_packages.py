"""Packages: read from ZIP bytes, audited as relations."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import issues
from plumbline.plans import packages
from plumbline.sources import documents as src
from plumbline.streaming import intake

TYPES = '<Types xmlns="t"><Default Extension="xml" ContentType="x"/><Default Extension="rels" ContentType="r"/><Override PartName="/ppt/slide1.xml" ContentType="s"/><Override PartName="/gone.xml" ContentType="s"/></Types>'
RELS = '<Relationships xmlns="r"><Relationship Id="1" Type="t" Target="../media/a.bin"/><Relationship Id="1" Type="t" Target="slide9.xml"/><Relationship Id="2" Type="t" Target="http://x" TargetMode="External"/><Relationship Id="3" Type="t" Target="../../../x"/></Relationships>'


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pkg")
    with zipfile.ZipFile(buf := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("ppt/slide1.xml", '<p:sld xmlns:p="u"><p:a n="1"><p:b>t</p:b></p:a><p:c/></p:sld>')
        z.writestr("ppt/_rels/slide1.xml.rels", RELS)
        z.writestr("media/a.bin", b"\0" * 200_000)
        z.writestr("ppt/dtd.xml", "<!DOCTYPE a><a/>")
        z.writestr("ppt/../x.xml", "<a")
    (folder / "one.pptx").write_bytes(buf.getvalue())
    (folder / "two.pptx").write_bytes(b"nothing")
    members = src.package_members(src.read_files(spark, str(folder), "*.pptx")).withColumn("pkg", F.regexp_extract("pkg", "([^/]*)$", 1)).cache()
    nodes = src.xml_nodes(members.where("part LIKE '%.xml' OR part LIKE '%.rels'")).cache()
    return members, nodes


def codes(df):
    return sorted((r["doc_id"], r["code"], r["path"]) for r in df.collect())


def test_inventory(package):
    assert codes(packages.inventory(package[0])) == [("one.pptx", "PPTX_RESOURCE_LIMIT", "media/a.bin"), ("one.pptx", "ZIP_PART_NAME_INVALID", "ppt/../x.xml"), ("two.pptx", "PPTX_ZIP_INVALID", "$")]


def test_nodes_in_document_order(package):
    rows = package[1].where("part = 'ppt/slide1.xml'").orderBy("node").collect()
    assert [(r["tag"], r["parent"], r["ord"], r["text"]) for r in rows] == [("{u}sld", None, 0, None), ("{u}a", 0, 0, None), ("{u}b", 1, 0, "t"), ("{u}c", 0, 1, None)]
    assert {r["part"]: r["fault"] for r in package[1].where("fault IS NOT NULL").collect()} == {"ppt/dtd.xml": "dtd", "ppt/../x.xml": "invalid"}


def test_relationships(package):
    rels = src.relationships(package[1])
    assert {(r["rel_id"], r["target"]) for r in rels.collect()} == {("1", "media/a.bin"), ("1", "ppt/slide9.xml"), ("2", None), ("3", None)}
    got = codes(packages.relationship_audit(rels, package[0]))
    assert [c for _, c, _ in got] == ["DUPLICATE_RELATIONSHIP_ID", "EXTERNAL_RELATIONSHIP_FORBIDDEN", "MISSING_RELATIONSHIP_TARGET", "RELATIONSHIP_TARGET_INVALID"]


def test_content_types(package):
    got = codes(packages.content_type_coverage(package[0], src.content_types(package[1])))
    assert got == [("one.pptx", "CONTENT_TYPES_INVALID", "gone.xml"), ("one.pptx", "CONTENT_TYPE_MISSING", "media/a.bin")]


def test_bindings_and_reports(spark):
    box = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
    objects = spark.createDataFrame(
        [("p", "ia:a", True, (0, 0, 100, 100), "t", None, "sp", 0.0), ("p", "ia:a:b:1", True, (5, 0, 100, 100), "x", "h", "sp", 0.0), ("q", "ia:a:b", True, (0, 0, 9, 9), None, None, "sp", 0.0), ("p", "ia:c", False, (0, 0, 1, 1), None, None, "sp", 0.0)],
        f"pkg string, object_name string, visible boolean, b {box}, text string, media string, object_type string, rotation double",
    )
    elements = spark.createDataFrame([("p", "a", (0, 0, 100, 100), "t", None), ("p", "a:b", (0, 0, 100, 100), None, "g"), ("p", "c", (0, 0, 1, 1), None, None), ("q", "a", (0, 0, 900, 9), None, None)], f"pkg string, element_id string, b {box}, text string, media string")
    bound = {(r["pkg"], r["object_name"]): r["element_id"] for r in packages.bound_objects(objects, elements).collect()}
    assert bound == {("p", "ia:a"): "a", ("p", "ia:a:b:1"): "a:b", ("q", "ia:a:b"): "a", ("p", "ia:c"): "c"}
    assert codes(packages.element_bindings(objects, elements, 1000, 1000)) == [("p", "ELEMENT_MEDIA_HASH_MISMATCH", "a:b"), ("p", "ELEMENT_OBJECT_MISSING", "c"), ("q", "ELEMENT_BBOX_MISMATCH", "a")]
    report = objects.where("object_name <> 'ia:c'").withColumn("rotation", F.when(F.col("pkg") == "q", 90.0).otherwise(F.col("rotation")))
    assert codes(packages.report_bindings(report, objects)) == [("p", "REPORT_OBJECT_UNLISTED", "ia:c"), ("q", "REPORT_OBJECT_MISMATCH", "ia:a:b")]
    assert packages.snapshot_closure(objects, objects.orderBy(F.desc("object_name")), ["object_name", "text"]).count() == 0
    assert codes(packages.snapshot_closure(objects, objects.union(objects.where("pkg = 'q'")), ["object_name", "text"])) == [("q", "BACKGROUND_SNAPSHOT_MISMATCH", "$")]
    assert codes(packages.object_ids(objects.selectExpr("pkg", "'s' AS slide_part", "'0' AS object_id"))) [0][1] == "SLIDE_OBJECT_ID_INVALID"


def test_merge_batch(spark):
    pages = spark.createDataFrame([("b", "1", "rapid", "r", "h", "c", "s"), ("b", "1", "reviewed", "r", "h", "c", "s"), ("ok", "1", "rapid", "r", None, "c", "s"), ("ok", "2", "rapid", "r", None, "c", "s")], "batch string, page_id string, profile string, renderer string, runtime_sha256 string, capabilities_sha256 string, size string")
    assert codes(packages.merge_batch(pages)) == [("b", "PAGE_ID_DUPLICATE", "$"), ("b", "VERIFICATION_PROFILE_MISMATCH", "$")]


def test_media_and_counts(package, spark):
    want = spark.createDataFrame([("one.pptx", "0" * 64)], "pkg string, sha256 string")
    found = packages.media_inventory(want, package[0])
    assert codes(found) == [("one.pptx", "REPORT_MEDIA_MISSING", "0" * 64)]
    assert [tuple(r) for r in issues.counts(found).collect()] == [("REPORT_MEDIA_MISSING", 1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text('{"schema_version": 2}' if i else "no json")
    intake.validate_stream(intake.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "issues"), str(tmp_path / "verdicts"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "verdicts"))
    assert got.count() == 3 and got.where("valid").count() == 0
    assert {r["first_code"] for r in got.collect()} == {"SPEC_JSON_INVALID", "UNSUPPORTED_CAPABILITY"}
