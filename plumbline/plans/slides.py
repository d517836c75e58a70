"""Objects of slides from XML nodes: groups' transforms composed, placeholders' places inherited, texts put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes
from ..operators import matching, trees
from ..operators.closure import Tables
from ..operators.issues import check, issue
from ..operators.trees import Field

TREE = ["pkg", "part"]
#: Fixed names of the format: an object's kind, its identity and its transform, below the object.
IDENTITY = {"sp": "nvSpPr/cNvPr", "pic": "nvPicPr/cNvPr", "graphicFrame": "nvGraphicFramePr/cNvPr", "grpSp": "nvGrpSpPr/cNvPr", "cxnSp": "nvCxnSpPr/cNvPr"}
TRANSFORM = {"sp": "spPr/xfrm", "pic": "spPr/xfrm", "graphicFrame": "xfrm", "grpSp": "grpSpPr/xfrm", "cxnSp": "spPr/xfrm"}
PLACE = r"^[^/]+/cSld/spTree(/grpSp)*/(sp|pic|graphicFrame|grpSp|cxnSp)$"
ROTATION_UNITS = 60_000


def _whole(name: str) -> Column:
    return F.col("attrs")[name].try_cast("bigint")


def _by_kind(table: dict[str, str], suffix: str, of: Column, name: str) -> dict[str, Field]:
    return {f"{name}_{p.replace('/', '_')}": Field(p + suffix, of) for p in dict.fromkeys(table.values())}


def _own(table: dict[str, str], name: str) -> Column:
    out = F.lit(None)
    for kind, p in table.items():
        out = F.when(F.col("kind") == kind, F.col(f"{name}_{p.replace('/', '_')}")).otherwise(out)
    return out


def local(nodes: DataFrame) -> DataFrame:
    """Readable nodes with tags without their namespace."""
    return nodes.where("fault IS NULL").withColumn("tag", F.regexp_replace("tag", r"^\{[^}]*\}", ""))


def shapes(nodes: DataFrame) -> DataFrame:
    """The objects of slides, layouts and masters as they are written: TREE, node, parent, kind, id, name, hidden, x, y, cx, cy,
    rot, child frame of groups, placeholder's kind and idx, texts of paragraphs in order, and whether there is a table.

    Objects are those in the shape tree and in its groups at any depth; what stands elsewhere is none.
    """
    n = local(nodes)
    roots = n.where(F.col("path").rlike(PLACE))
    a = F.col("attrs")
    own = {"last": Field("", F.col("last")), "parent": Field("", F.col("parent")), "size": Field("", F.col("size")), "path": Field("", F.col("path")), "kind": Field("", F.col("tag"))}
    point = lambda x, y: F.struct(_whole(x).alias("x"), _whole(y).alias("y"))

    def place(kinds: list[str]) -> dict[str, Field]:
        some = lambda table: {k: v for k, v in table.items() if k in kinds}
        return {
            **own,
            **_by_kind(some(IDENTITY), "", F.struct(a["id"].alias("id"), a["name"].alias("name"), a["hidden"].isin("1", "true").alias("hidden")), "identity"),
            **_by_kind(some(TRANSFORM), "", a["rot"].try_cast("bigint"), "rot"),
            **_by_kind(some(TRANSFORM), "/off", point("x", "y"), "off"),
            **_by_kind(some(TRANSFORM), "/ext", point("cx", "cy"), "ext"),
        }

    child = {"child_off": Field("grpSpPr/xfrm/chOff", point("x", "y")), "child_ext": Field("grpSpPr/xfrm/chExt", point("cx", "cy"))}
    content = {
        "ph": Field("nvSpPr/nvPr/ph", F.struct(a["type"].alias("kind"), a["idx"].alias("idx"))),
        "texts": Field("//t", F.coalesce("text", F.lit("")), "list"),
        "tables": Field("//tbl", take="count"),
    }
    # a group's own record needs nothing of what it holds but its identity and its transform
    plain = [k for k in IDENTITY if k != "grpSp"]
    o = trees.records(roots.where("tag <> 'grpSp'"), n, TREE, {**place(plain), **content}, kinds=plain)
    groups = trees.records(roots.where("tag = 'grpSp'"), n, TREE, {**place(["grpSp"]), **child}, kinds=["grpSp"])
    o = o.unionByName(groups.withColumns({"texts": F.array().cast("array<string>"), "tables": F.lit(0).cast("long")}), allowMissingColumns=True)
    identity, off, ext = _own(IDENTITY, "identity"), _own(TRANSFORM, "off"), _own(TRANSFORM, "ext")
    return o.select(
        *TREE, "node", "last", "parent", "size", "path", "kind", identity["id"].alias("id"), identity["name"].alias("name"), F.coalesce(identity["hidden"], F.lit(False)).alias("hidden"),
        off["x"].alias("x"), off["y"].alias("y"), ext["x"].alias("cx"), ext["y"].alias("cy"), F.coalesce(_own(TRANSFORM, "rot").cast("double") / ROTATION_UNITS, F.lit(0.0)).alias("rotation"),
        "child_off", "child_ext", "ph", "texts", "tables",
    )


def group_frames(objects: DataFrame) -> DataFrame:
    """TREE, node and `frame` of each group: what it does to its members' places, with all groups around it, and whether they hide.

    A frame is (hidden, sx, sy, tx, ty).  A group without a whole transform, or with a child frame of no size, hides its members
    and moves nothing; one that is hidden, by itself or by a group around it, hides them too.
    """
    g = objects.where("kind = 'grpSp'")
    values = [F.col(c) for c in ("x", "y", "cx", "cy")] + [F.col(f"{c}.{v}") for c in ("child_off", "child_ext") for v in "xy"]
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    known = F.coalesce(known & (F.col("child_ext.x") != 0) & (F.col("child_ext.y") != 0), F.lit(False))
    part = lambda a, b: F.when(known, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))).otherwise(1.0)
    sx, sy = part("cx", "child_ext.x"), part("cy", "child_ext.y")
    move = lambda at, child, s: F.when(known, F.col(at).cast("double") - F.col(child).cast("double") * s).otherwise(0.0)
    frame = F.struct((F.col("hidden") | ~known).alias("hidden"), sx.alias("sx"), sy.alias("sy"), move("x", "child_off.x", sx).alias("tx"), move("y", "child_off.y", sy).alias("ty"))

    def both(up: Column, own: Column) -> Column:
        return F.struct(
            (up["hidden"] | own["hidden"]).alias("hidden"), (up["sx"] * own["sx"]).alias("sx"), (up["sy"] * own["sy"]).alias("sy"),
            (up["tx"] + up["sx"] * own["tx"]).alias("tx"), (up["ty"] + up["sy"] * own["ty"]).alias("ty"),
        )

    return trees.along(g.select(*TREE, "node", "parent", frame.alias("frame")), TREE, "frame", both).select(*TREE, "node", "frame")


def ancestors(rels: DataFrame) -> DataFrame:
    """(pkg, part, distance, source): the layout (1) and the master (2) that a slide takes after; the first relationship counts."""
    first = lambda kind: rels.where(~F.col("external") & F.col("target").isNotNull() & F.col("type").endswith(kind)).groupBy("pkg", "source_part").agg(F.min_by("target", "ord").alias("to"))
    layout = first("/slideLayout").select("pkg", F.col("source_part").alias("part"), F.lit(1).alias("distance"), F.col("to").alias("source"))
    master = first("/slideMaster").select("pkg", F.col("source_part").alias("source"), F.col("to").alias("master"))
    return layout.unionByName(layout.join(master, ["pkg", "source"]).select("pkg", "part", F.lit(2).alias("distance"), F.col("master").alias("source")))


def inherited(objects: DataFrame, rels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """objects with `values` of placeholders, taken from the nearest of layout and master whose matching shape has them.

    A shape of the layout or master matches by idx, or else by kind; of several the better match counts, then the first.  values:
    an output column and what it is of the matching shape's columns; null is not inherited, and each value is
    inherited for itself.  What a part's placeholders of one kind and idx take is the same, so each is looked up once: candidates
    are found by equality of idx and of kind, one grouped pass takes the best of each source, a second the nearest source.  Slides without a
    layout, placeholders without a match and other objects have nulls.
    """
    key = [*TREE, "own_kind", "own_idx"]
    asked = objects.where("kind = 'sp' AND (ph.kind IS NOT NULL OR ph.idx IS NOT NULL)").select(*TREE, F.col("ph.kind").alias("own_kind"), F.col("ph.idx").alias("own_idx")).distinct()
    own = asked.join(ancestors(rels), TREE)
    top = objects.where("kind = 'sp' AND ph IS NOT NULL AND path LIKE '%/spTree/sp'")
    source = top.select("pkg", F.col("part").alias("source"), F.col("node").alias("at"), F.col("ph.kind").alias("kind"), F.col("ph.idx").alias("idx"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("v"))
    by_idx = own.join(source.where("idx IS NOT NULL").withColumnRenamed("idx", "own_idx"), ["pkg", "source", "own_idx"])
    by_kind = own.join(source.withColumnRenamed("kind", "own_kind"), ["pkg", "source", "own_kind"])
    keep = lambda df, rank: df.select(*key, "distance", F.lit(rank).alias("rank"), "at", "v")
    met = keep(by_idx, 0).unionByName(keep(by_kind, 1))
    best = met.groupBy(*key, "distance").agg(F.min_by("v", F.struct("rank", "at")).alias("v"))
    best = best.groupBy(*key).agg(*[F.min_by(F.col("v")[k], F.when(F.col("v")[k].isNotNull(), F.col("distance"))).alias(k) for k in values])
    best = best.select(*[F.col(c).alias(f"__{c}") for c in key], *values)
    same = (F.col("kind") == "sp") & (F.col("pkg") == F.col("__pkg")) & (F.col("part") == F.col("__part")) & F.col("ph.kind").eqNullSafe(F.col("__own_kind")) & F.col("ph.idx").eqNullSafe(F.col("__own_idx"))
    return objects.join(best, same, "left").select(*objects.columns, *values)


def table_texts(nodes: DataFrame) -> DataFrame:
    """TREE, node of a table's frame, text: its cells' texts in order, a line each; cells merged into others are left out."""
    n = local(nodes)
    merged = F.coalesce(F.col("attrs")["hMerge"].isin("1", "true"), F.lit(False)) | F.coalesce(F.col("attrs")["vMerge"].isin("1", "true"), F.lit(False))
    cells = n.where((F.col("tag") == "tc") & F.col("path").rlike("/tbl/tr/tc$") & ~merged)
    text = trees.records(cells, n, TREE, {"size": Field("", F.col("size")), "texts": Field("//t", F.coalesce("text", F.lit("")), "list")}, kinds=["tc"])
    text = text.select(*TREE, "node", "size", F.array_join("texts", "").alias("text"))
    frames = n.where((F.col("tag") == "graphicFrame") & F.col("path").rlike(PLACE)).select(*TREE, "node", "last")
    pairs = trees.within(frames, text, TREE).groupBy(*TREE, "o.node").agg(F.array_sort(F.collect_list(F.struct("i.node", "i.text"))).alias("c"))
    return pairs.select(*TREE, "node", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("text"))


def slide_objects(nodes: DataFrame, rels: DataFrame, width: int, height: int, *, slides: str = r"^ppt/slides/[^/]+\.xml$") -> DataFrame:
    """Every object of every slide in slide space: pkg, slide_part, layer, object_type, object_id, object_name, hidden, b (box),
    geometry_known, visible, rotation, text.

    layer counts a slide's objects in document order.  A box goes through the transforms of all groups around it, halves to
    even; a shape without a whole place of its own takes the layout's or the master's.  A hidden object is not visible; of one
    without a place it is not known (null); others are if they have an area on the slide.  Text is a shape's runs put together, or a
    table's cells; null where there is none.  Unreadable parts have no objects.

    Parts are parsed once, into a table if they do not come from one, and so are their shapes; both are dropped when the result is written.
    """
    tables = Tables(nodes.sparkSession)
    held = [] if hasattr(nodes, "plumbline_path") else [tables.put(nodes.where("fault IS NULL"))]
    nodes = held[0] if held else nodes
    objects = tables.put(shapes(nodes))
    whole = boxes.box("x", "y", "cx", "cy")
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull(), whole)
    frames = group_frames(objects.where(F.col("part").rlike(slides))).withColumnRenamed("node", "parent")
    o = inherited(objects, rels, {"given": place}).where(F.col("part").rlike(slides)).withColumn("place", place)
    o = o.join(frames, [*TREE, "parent"], "left").join(table_texts(nodes).withColumnRenamed("text", "cells"), [*TREE, "node"], "left")
    place = F.coalesce("place", F.when(F.col("kind") == "sp", F.col("given")))
    f = F.col("frame")
    moved = F.when(f.isNull(), boxes.scaled(place, F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(boxes.scaled(place, f["sx"], f["sy"], f["tx"], f["ty"]))
    b = F.when(place.isNotNull(), moved)
    hidden = F.col("hidden") | F.coalesce(f["hidden"], F.lit(False))
    text = F.when((F.col("kind") == "sp") & (F.size("texts") > 0), F.array_join("texts", "")).when((F.col("kind") == "graphicFrame") & (F.col("tables") > 0), F.coalesce("cells", F.lit("")))
    layer = F.row_number().over(Window.partitionBy(*TREE).orderBy("node"))
    out = o.select("pkg", F.col("part").alias("slide_part"), layer.alias("layer"), F.col("kind").alias("object_type"), F.col("id").alias("object_id"), F.col("name").alias("object_name"), hidden.alias("hidden"), b.alias("b"), "rotation", text.alias("text"))
    shows = (F.col("b.w") > 0) & (F.col("b.h") > 0) & boxes.on_page("b", F.lit(width), F.lit(height))
    out = tables.put(out.withColumns({"geometry_known": F.col("b").isNotNull(), "visible": F.when(F.col("hidden"), F.lit(False)).otherwise(shows)}))
    tables.drop(*held, objects)
    return out


def text_bindings(expected: DataFrame, objects: DataFrame, width: int, height: int, *, lead: str = "ia:") -> DataFrame:
    """Issues of expected texts (pkg, ord, element_id, b, text) against text objects (pkg, slide_part, object_id, object_name, b, text).

    An object may be an item's if it carries its element's name, alone or before a colon, and each side of its box is within 1%
    of the slide of the item's.  Items go by `ord`, and each takes the only such object that no earlier one took; without any it
    is missing, with several ambiguous.  Of a pair the texts must be equal.  A null box fits nothing; a null text is not compared.
    """
    names = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("object_name", ":"))), lambda n: F.array_join(F.slice(F.split("object_name", ":"), F.lit(1), n), ":")), lambda x: x.startswith(lead))
    o = objects.where("object_name IS NOT NULL AND b IS NOT NULL").select("pkg", F.struct("slide_part", "object_id").alias("key"), F.col("b").alias("ob"), F.col("text").alias("otext"), F.explode(names).alias("name"))
    e = expected.withColumn("name", F.concat(F.lit(lead), "element_id"))
    met = e.join(o, ["pkg", "name"]).where(boxes.within("ob", "b", F.lit(width), F.lit(height)))
    turns = matching.take_in_turn(expected.select("pkg", "ord"), met.select("pkg", "ord", "key"), "pkg", "ord", "key")
    pairs = expected.join(turns, ["pkg", "ord"]).join(o.select("pkg", F.col("key").alias("took"), "otext").distinct(), ["pkg", "took"], "left")
    at = F.col("element_id")
    return check(
        pairs.withColumnRenamed("pkg", "doc_id"),
        (F.col("state") == "missing", issue("TYPOGRAPHY_TEXTBOX_MISSING", at, "no free text object")),
        (F.col("state") == "ambiguous", issue("TYPOGRAPHY_TEXTBOX_AMBIGUOUS", at, "several free text objects")),
        ((F.col("state") == "taken") & F.col("text").isNotNull() & ~F.col("text").eqNullSafe(F.col("otext")), issue("TEXT_RUN_TEXT_MISMATCH", at, "its text is another")),
    )
