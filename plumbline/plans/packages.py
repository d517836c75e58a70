"""Rules over office packages: inventory limits, relationships, content types, object snapshots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import keys, matching
from ..operators.issues import check, gathered, issue
from . import catalog as cat


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("pkg", "doc_id")


def inventory(members: DataFrame) -> DataFrame:
    """Limits on members' number, sizes and ratios; unsafe and repeated names; files that are no packages."""
    m = _doc(members)
    media = F.col("part").rlike(r"(^|/)media/")
    unsafe = F.col("part").rlike(r"^/|\\|(^|/)\.\.?(/|$)|//|\x00") | (F.col("part") == "")
    per = m.where("part IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("file_size").alias("total"))
    twice = m.where("part IS NOT NULL").groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    limit = lambda text: issue("PPTX_RESOURCE_LIMIT", F.col("part"), text)
    ratio = F.when(F.col("compress_size") > 0, F.col("file_size") / F.col("compress_size")).otherwise(F.when(F.col("file_size") > 0, float("inf")))
    return gathered([
        check(
            m,
            (F.col("part").isNull(), issue("PPTX_ZIP_INVALID", "$", "not a ZIP package")),
            (unsafe, issue("ZIP_PART_NAME_INVALID", F.col("part"), "unsafe name")),
            (F.col("file_size") > cat.MAX_MEMBER, limit("the member is too large")),
            (media & (F.col("file_size") > cat.MAX_MEDIA), limit("the picture is too large")),
            (ratio > cat.MAX_RATIO, limit("the compression ratio is too high")),
        ),
        check(per, (F.col("n") > cat.MAX_MEMBERS, issue("PPTX_RESOURCE_LIMIT", "$", "too many members")), (F.col("total") > cat.MAX_TOTAL, issue("PPTX_RESOURCE_LIMIT", "$", "the members are too large together"))),
        check(twice, (F.col("n") > 1, issue("DUPLICATE_ZIP_PART", F.col("part"), "the part occurs more than once"))),
    ])


def relationship_audit(rels: DataFrame, members: DataFrame) -> DataFrame:
    """External and dangling targets, unresolvable ones, and ids used twice in one source."""
    r = _doc(rels)
    parts = members.where("part IS NOT NULL").select(F.col("pkg").alias("doc_id"), F.col("part").alias("target")).distinct()
    dangling = r.where("NOT external AND target IS NOT NULL").join(parts, ["doc_id", "target"], "left_anti")
    twice = keys.duplicate_keys(r, "doc_id", "source_part", "rel_id")
    return gathered([
        check(r, (F.col("external"), issue("EXTERNAL_RELATIONSHIP_FORBIDDEN", F.col("source_part"), F.col("raw_target"))), (~F.col("external") & F.col("target").isNull(), issue("RELATIONSHIP_TARGET_INVALID", F.col("source_part"), F.coalesce("raw_target", F.lit(""))))),
        check(dangling, (F.lit(True), issue("MISSING_RELATIONSHIP_TARGET", F.col("source_part"), F.col("target")))),
        check(twice, (F.lit(True), issue("DUPLICATE_RELATIONSHIP_ID", F.col("source_part"), F.col("rel_id")))),
    ])


def content_type_coverage(members: DataFrame, types: DataFrame) -> DataFrame:
    """Parts that no override and no default gives a content type, and overrides without a part."""
    m = _doc(members.where("part IS NOT NULL AND part <> '[Content_Types].xml'")).select("doc_id", "part", F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1)).alias("ext")).distinct()
    t = _doc(types)
    over = t.where("kind = 'override'").select("doc_id", F.col("key").alias("part"))
    base = t.where("kind = 'default'").select("doc_id", F.col("key").alias("ext"))
    bare = m.join(over, ["doc_id", "part"], "left_anti").join(base, ["doc_id", "ext"], "left_anti")
    stray = over.join(m.select("doc_id", "part"), ["doc_id", "part"], "left_anti")
    twice = keys.duplicate_keys(t, "doc_id", "kind", "key")
    return gathered([
        check(bare, (F.lit(True), issue("CONTENT_TYPE_MISSING", F.col("part"), "the part has no content type"))),
        check(stray, (F.lit(True), issue("CONTENT_TYPES_INVALID", F.col("part"), "an override names no part"))),
        check(twice, (F.lit(True), issue("CONTENT_TYPES_INVALID", F.col("key"), "declared twice"))),
    ])


def object_ids(objects: DataFrame) -> DataFrame:
    """Object ids: positive, and once a slide."""
    o = _doc(objects)
    n = F.col("object_id").try_cast("bigint")
    return gathered([
        check(o, (n.isNull() | (n <= 0), issue("SLIDE_OBJECT_ID_INVALID", F.col("slide_part"), F.col("object_id")))),
        check(keys.duplicate_keys(o, "doc_id", "slide_part", "object_id"), (F.lit(True), issue("SLIDE_OBJECT_ID_INVALID", F.col("slide_part"), F.col("object_id")))),
    ])


def bound_objects(objects: DataFrame, elements: DataFrame, lead: str = "ia:") -> DataFrame:
    """objects (pkg, object_name, ..) with the element_id whose name they carry: the longest of those that fit.

    The package's id is made part of either side's text, so one equality join serves all packages.
    """
    tag = lambda c: F.concat(F.col("pkg"), F.lit("\x01"), c)
    o = objects.withColumn("__n", tag(F.when(F.col("object_name").startswith(lead), F.substring("object_name", len(lead) + 1, 2**31 - 1))))
    e = elements.select(tag(F.col("element_id")).alias("__e"))
    return matching.longest_prefix(o, e, "__n", "__e").withColumn("element_id", F.split("__e", "\x01")[1]).drop("__n", "__e")


def element_bindings(objects: DataFrame, elements: DataFrame, width: int, height: int) -> DataFrame:
    """Every element must have a visible object, and one of its objects must have its box (within 1% of the page), text and picture.

    objects: pkg, object_name, visible, b (box), text, media; elements: pkg, element_id, b, text, media (null: not asked).
    """
    bound = bound_objects(objects.where("visible"), elements).where("element_id IS NOT NULL")
    o = bound.select("pkg", "element_id", F.col("b").alias("ob"), F.col("text").alias("otext"), F.col("media").alias("omedia"))
    j = elements.join(o, ["pkg", "element_id"], "left")
    asked = lambda want, ok: F.bool_or(F.col(want).isNull() | F.coalesce(ok, F.lit(False)))
    per = j.groupBy("pkg", "element_id").agg(
        F.count("ob").alias("n"), F.bool_or(boxes.within("ob", "b", F.lit(width), F.lit(height))).alias("box_ok"),
        asked("text", F.col("otext") == F.col("text")).alias("text_ok"), asked("media", F.col("omedia") == F.col("media")).alias("media_ok"),
    )
    some = F.col("n") > 0
    at = F.col("element_id")
    return check(
        _doc(per),
        (~some, issue("ELEMENT_OBJECT_MISSING", at, "no visible object")),
        (some & ~F.coalesce("box_ok", F.lit(False)), issue("ELEMENT_BBOX_MISMATCH", at, "no object has the element's box")),
        (some & ~F.col("text_ok"), issue("ELEMENT_TEXT_MISMATCH", at, "no object has the element's text")),
        (some & ~F.col("media_ok"), issue("ELEMENT_MEDIA_HASH_MISMATCH", at, "no object has the element's picture")),
    )


def report_bindings(report: DataFrame, objects: DataFrame) -> DataFrame:
    """The build report's objects against the package's, by name: the same names, once each, with the same facts."""
    fields = ["object_type", "b", "rotation", "media", "text"]
    on = ["pkg", "object_name"]
    twice = keys.duplicate_keys(objects, *on).unionByName(keys.duplicate_keys(report, *on))
    single = lambda df: df.join(twice.select(*on).distinct(), on, "left_anti")
    diff = _doc(matching.field_mismatches(single(report), single(objects), on, fields))
    return gathered([
        check(diff, (F.col("status") == "left_only", issue("REPORT_OBJECT_MISSING", F.col("object_name"), "not in the package")), (F.col("status") == "right_only", issue("REPORT_OBJECT_UNLISTED", F.col("object_name"), "not in the report")), (F.col("status") == "differs", issue("REPORT_OBJECT_MISMATCH", F.col("object_name"), F.col("field")))),
        check(_doc(twice), (F.lit(True), issue("REPORT_OBJECT_AMBIGUOUS", F.col("object_name"), "the name is not unique"))),
    ])


def media_inventory(expected: DataFrame, members: DataFrame) -> DataFrame:
    """Hashes (pkg, sha256) that no media member has."""
    have = members.where(F.col("part").rlike(r"(^|/)media/") & F.col("bytes").isNotNull()).select("pkg", F.sha2("bytes", 256).alias("sha256")).distinct()
    gone = keys.missing_references(expected.select("pkg", "sha256").distinct(), have, ["pkg", "sha256"])
    return check(_doc(gone), (F.lit(True), issue("REPORT_MEDIA_MISSING", F.col("sha256"), "no such picture in the package")))


def snapshot_closure(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Two snapshots of the same packages must be equal as multisets of object facts, whatever their order."""
    surplus = keys.multiset_difference(a, b, ["pkg", *fields]).groupBy("pkg").agg(F.count("*").alias("n"))
    return check(_doc(surplus), (F.lit(True), issue("BACKGROUND_SNAPSHOT_MISMATCH", "$", F.concat(F.col("n").cast("string"), F.lit(" facts differ")))))


def merge_batch(pages: DataFrame, batch: str = "batch") -> DataFrame:
    """Pages of a batch must share profile, renderer, runtime, capabilities and size, and have distinct ids."""
    h = keys.homogeneity(pages, batch, "profile", "renderer", "runtime_sha256", "capabilities_sha256", "size", key="page_id").withColumnRenamed(batch, "doc_id")
    mixed = lambda c: F.col(f"n_{c}") > 1
    return check(
        h,
        (mixed("profile"), issue("VERIFICATION_PROFILE_MISMATCH", "$", "mixed profiles")),
        (mixed("renderer"), issue("RENDER_RUNTIME_MIXED", "$", "mixed renderers")),
        (mixed("runtime_sha256"), issue("RUNTIME_PREFLIGHT_MIXED", "$", "mixed runtimes")),
        (mixed("capabilities_sha256"), issue("CAPABILITY_MANIFEST_MIXED", "$", "mixed capabilities")),
        (mixed("size"), issue("SLIDE_SIZE_MISMATCH", "$", "mixed page sizes")),
        (F.col("n_keys") < F.col("n_rows"), issue("PAGE_ID_DUPLICATE", "$", "a page id occurs twice")),
    )
