"""Kernels and functions against plain Python, with the cases that a naive mapping gets wrong."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import boxes, hashing, numbers, pixels, texts
from plumbline.operators import closure, keys, matching, ranges, rasters


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_numbers(spark):
    lit = F.lit
    assert one(spark, *[numbers.half_even(lit(x)) for x in (2.5, 3.5, -2.5)]) == (2, 4, -2)
    assert one(spark, numbers.wrap_rotation(lit(-90)), numbers.canonical_rotation(lit(360)), numbers.canonical_rotation(lit(0))) == (270, False, True)
    assert one(spark, numbers.storable_rotation(lit(-360.0)), numbers.storable_rotation(lit(1e-6)), numbers.storable_rotation(lit(0.0))) == (False, False, True)
    assert one(spark, numbers.near(lit(1.0), lit(1.005)), numbers.near(lit(1.0), lit(1.02)), numbers.near(lit(None), lit(None)), numbers.near(lit(1.0), lit(None))) == (True, False, True, False)
    assert one(spark, numbers.round_rect_allowed(lit(0.5)), numbers.round_rect_allowed(lit(0.000001)), numbers.round_rect_allowed(lit(0.51))) == (True, False, False)
    assert one(spark, numbers.is_finite(lit(float("nan"))), numbers.is_finite(lit(float("inf"))), numbers.is_finite(lit(None).cast("double"))) == (False, False, False)
    assert one(spark, numbers.percent_units(lit(0.000015)), numbers.angle_units(lit(90.0)), numbers.font_size_allowed(lit(0.5))) == (2, 5_400_000, False)


def test_boxes(spark):
    b = lambda *v: boxes.box(*map(F.lit, v))
    assert one(spark, boxes.contains(b(0, 0, 10, 10), b(0, 0, 10, 10)), boxes.overlaps(b(0, 0, 5, 5), b(5, 0, 5, 5)), boxes.overlaps(b(0, 0, 6, 5), b(5, 0, 5, 5))) == (True, False, True)
    assert one(spark, boxes.near_full_page(b(8, 6, 98, 98), b(7, 5, 100, 100)), boxes.near_full_page(b(-9, -9, 200, 200), b(0, 0, 100, 100)), boxes.near_full_page(b(3, 0, 97, 100), b(0, 0, 100, 100))) == (True, True, False)
    assert one(spark, boxes.clamped(F.lit(-3.5), F.lit(2.5), F.lit(8.5), F.lit(99), F.lit(10), F.lit(20)))[0].asDict() == {"x": 0, "y": 2, "w": 8, "h": 18}
    assert one(spark, boxes.clamped(F.lit(11), F.lit(0), F.lit(12), F.lit(1), F.lit(10), F.lit(10))) == (None,)
    assert one(spark, boxes.same_aspect(F.lit(16), F.lit(9), F.lit(1600), F.lit(900)), boxes.fit_crop(F.lit("cover"), F.lit(200), F.lit(100), F.lit(100), F.lit(100))["left"]) == (True, 0.25)
    assert one(spark, boxes.scaled(b(1, 1, 3, 3), F.lit(-2), F.lit(0.5), F.lit(0), F.lit(0)))[0].asDict() == {"x": -2, "y": 0, "w": 6, "h": 2}


def test_texts_and_paths(spark):
    lit = F.lit
    assert one(spark, texts.scripts_in_order(lit("ab 漢 א")), texts.script_counts(lit("ab 漢字")))[0] == ["latin", "ea", "cs"]
    assert one(spark, texts.scripts_in_order(lit("--")), texts.scripts_in_order(lit("，א。 b")), texts.safe_name(lit("../"))) == (["latin"], ["ea", "cs", "latin"], "region")
    assert one(spark, texts.safe_name(lit("-.a b/ç..")), texts.font_key(lit("ABCDEF+My Font-1")), texts.family_listed(lit("B"), lit("A, B,C"))) == ("a-b", "myfont1", True)
    assert one(spark, texts.child_path(lit("$"), lit("a_1")), texts.child_path(lit("$"), lit('a"b')), texts.child_path(lit("$"), lit("a\n"))) == ("$.a_1", '$["a\\"b"]', '$["a\n"]')
    cases = [("ppt/slides/s.xml", "../media/a.png", "ppt/media/a.png"), ("s.xml", "/x/./y", "x/y"), ("a/b.xml", "../../c", None), ("a/b.xml", "http://x", None), ("a/b.xml", "c?d", None), ("a/b.xml", "%2e%2E/c", None), ("a/b.xml", "", None), ("a/b.xml", "c\\d", None)]
    got = spark.createDataFrame(cases, "s string, t string, want string").select(texts.resolve_target("s", "t").alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert one(spark, texts.rels_part(lit("a/b.xml")), texts.source_of_rels(lit("a/_rels/b.xml.rels"))) == ("a/_rels/b.xml.rels", "a/b.xml")
    rng, parts = random.Random(1), []
    for _ in range(60):
        parts.append(tuple("/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(2)))
    for r in spark.createDataFrame(parts, "p string, s string").select("p", "s", texts.relative_target("p", "s").alias("t")).collect():
        assert posixpath.normpath(posixpath.join(posixpath.dirname(r["s"]), r["t"])) == r["p"]


def test_pixels_and_hashes(spark):
    lit = F.lit
    assert one(spark, pixels.luma(lit(255), lit(255), lit(255)), pixels.luma(lit(255), lit(0), lit(0)), pixels.rgba_hex(lit(1), lit(171), lit(0), lit(255)), pixels.near_white(lit(208), lit(250), lit(256))) == (255, 76, "#01AB00FF", True)
    docs = spark.createDataFrame([('{"b": 1.0, "a": "é"}',), ('{"a":"é","b":1.0}',), ('{"a":"é","b":1}',), ("{",), ('{"a": NaN}',), (None,)], "d string")
    h = [r[0] for r in docs.select(hashing.canonical_sha256("d")).collect()]
    assert h[0] == h[1] != h[2] and h[3:] == [None, None, None]


def test_covering_and_splits(spark):
    rng = random.Random(2)
    for _ in range(3):
        outer = [(i, a, a + rng.randrange(1, 9)) for i in range(3) for a in rng.sample(range(20), 4)]
        inner = [(i, a, a + rng.randrange(1, 9)) for i in range(3) for a in rng.sample(range(20), 4)]
        df = lambda r: spark.createDataFrame(r, "k long, s long, e long")
        got = {tuple(r) for r in ranges.split_intervals(df(outer), df(inner), "k", "s", "e").collect()}
        want = set()
        for k in range(3):
            cuts = sorted({x for i, a, b in outer + inner if i == k for x in (a, b)})
            want |= {(k, a, b) for a, b in zip(cuts, cuts[1:]) if any(i == k and s <= a and b <= e for i, s, e in outer)}
        assert got == want


def test_dense_points_and_grid(spark):
    p = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", 0, 1.0), ("b", 1, None)], "k string, i int, v double")
    assert {r["k"]: (r["values"], r["contiguous"]) for r in ranges.dense_points(p, "k", "i", "v").collect()} == {"a": ([1.0, None, 3.0], False), "b": ([1.0, None], True)}


def test_longest_prefix_and_merge(spark):
    names = spark.createDataFrame([("ia:a",), ("ia:a:b",), ("ia:a:bc",), ("x:a",), (None,)], "name string")
    ids = spark.createDataFrame([("a",), ("a:b",)], "id string")
    got = {r["name"]: r["id"] for r in matching.longest_prefix(names, ids, "name", "id", lead="ia:").collect()}
    assert got == {"ia:a": "a", "ia:a:b": "a:b", "ia:a:bc": "a", "x:a": None, None: None}
    d = spark.createDataFrame([(1, "s.w", "1"), (1, "s.c.x", "2"), (1, "n", "3"), (1, "m", "4")], "k int, path string, value string")
    o = spark.createDataFrame([(1, "s.c", "9"), (1, "n.z", "8"), (1, "m", "7")], "k int, path string, value string")
    assert {(r["path"], r["value"]) for r in matching.deep_merge(d, o, ["k"]).collect()} == {("s.w", "1"), ("s.c", "9"), ("n.z", "8"), ("m", "7")}


def test_closures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, None)], "a int, b int")
    got = {(r["root"], r["node"]): r["depth"] for r in closure.reachable(edges, spark.createDataFrame([(1,), (4,)], "r int"), "a", "b", "r").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (4, 4): 0}
    tree = spark.createDataFrame([(1, None, 10), (2, 1, 1), (3, 2, 1), (9, 77, 5)], "n int, p int, v int")
    assert {r["node"]: (r["depth"], r["total_v"]) for r in closure.accumulate(tree, node="n", parent="p", values=["v"]).collect()} == {1: (0, 10), 2: (1, 11), 3: (2, 12), 9: (0, 5)}
    with pytest.raises(RuntimeError):
        closure.accumulate(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "n int, p int, v long"), node="n", parent="p", values=["v"], max_rounds=4)


def test_flood_fill_equals_python(spark):
    rng = random.Random(3)
    size = 12
    dark = {(y, x) for y in range(size) for x in range(size) if rng.random() < 0.35 and 0 < y < size - 1 and 0 < x < size - 1 and (2 < y < size - 3 or 2 < x < size - 3)}
    rows = [("i", y, x, *((0, 0, 0) if (y, x) in dark else (250, 250, 250)), 255) for y in range(size) for x in range(size)]
    got = {(r["y"], r["x"]) for r in rasters.background(spark.createDataFrame(rows, "image string, y long, x long, r int, g int, b int, a int")).collect()}
    todo, want = [(y, x) for y in range(size) for x in range(size) if (y in (0, size - 1) or x in (0, size - 1))], set()
    while todo:
        p = todo.pop()
        if p in want or p in dark or not (0 <= p[0] < size and 0 <= p[1] < size):
            continue
        want.add(p)
        todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert got == want and len(want) < size * size - len(dark)


def test_raster_rules_of_alpha_borders_and_palettes(spark):
    px = lambda rows: spark.createDataFrame(rows, "image string, y long, x long, r int, g int, b int, a int")
    # clear pixels touch no side; the corners' median is cut to a whole number
    rows = [("i", y, x, 200 if (y, x) == (0, 1) else 0, 0, 0, 0 if x == 1 else 255) for y in range(3) for x in range(3)] + [("j", 0, 0, 1, 1, 1, 255), ("j", 0, 1, 14, 14, 14, 255)]
    got = {r["image"]: (r["top"], r["right"], r["bottom"], r["left"]) for r in rasters.edge_contact(px(rows)).collect()}
    assert got == {"i": (False,) * 4, "j": (False,) * 4}
    # borders are edges by their own value, the inside by its neighbours
    flat = spark.createDataFrame([("i", y, x, 30 if y == 1 == x else 24 if y == 0 else 3) for y in range(3) for x in range(3)], "image string, y long, x long, l int")
    assert {(r["y"], r["x"]) for r in rasters.edges(flat).collect() if r["edge"]} == {(0, 0), (0, 1), (0, 2), (1, 1)}
    # a palette that suffices is exact; one that does not is made of boxes' means
    few = rasters.dominant(px([("i", 0, x, x % 3 * 100, 0, 7, 255) for x in range(10)])).collect()
    assert {(r["color"], r["n"]) for r in few} == {(7, 4), (100 << 16 | 7, 3), (200 << 16 | 7, 3)}
    many = rasters.dominant(px([("i", 0, x, x, 0, 0, 255) for x in range(64)]), top=2).collect()
    assert {(r["color"], r["n"]) for r in many} == {(16 << 16, 32), (48 << 16, 32)}
    # an outline's background: clear, or coloured like the border, never near white
    ring = [("i", y, x, *((250, 250, 250) if 0 < y < 4 and 0 < x < 4 and (y, x) != (2, 2) else (10, 90, 200)), 255) for y in range(5) for x in range(5)]
    back = {(r["y"], r["x"]) for r in rasters.outline_background(px(ring)).collect()}
    assert back == {(y, x) for _, y, x, r, *_ in ring if r == 10}
    box = rasters.foreground_box(px(ring), rasters.background(px(ring))).first()
    assert (box["visible"], box["x"], box["y"], box["w"], box["h"], box["top"]) == (9, 1, 1, 3, 3, False)


def test_empty_masks(spark):
    df = spark.createDataFrame([(1, False, False), (2, True, False)], "k int, a boolean, b boolean")
    assert {r["k"]: r["f"] for r in df.groupBy("k").agg(rasters.f1(F.col("a"), F.col("b")).alias("f")).collect()} == {1: 1.0, 2: 0.0}


def test_numbered_without_one_partition(spark):
    # several times as many rows as the ranges' sample holds
    df = spark.range(0, 50_000, 1, 4).withColumn("k", (F.col("id") * 37) % 50_000)
    assert {r["k"]: r["row_no"] for r in keys.numbered(df, ["k"]).collect()} == {i: i + 1 for i in range(50_000)}


def test_overlap_pairs_across_tiles(spark):
    rng = random.Random(5)
    rows = [(k, k % 3, rng.randrange(-200, 900), rng.randrange(-100, 400), rng.randrange(0, 600), rng.randrange(0, 200)) for k in range(150)]
    df = spark.createDataFrame(rows, "k long, p long, x long, y long, w long, h long").selectExpr("k", "p", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS b")
    over = lambda a, b: max(a[2], b[2]) < min(a[2] + a[4], b[2] + b[4]) and max(a[3], b[3]) < min(a[3] + a[5], b[3] + b[5])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and over(a, b))
    assert sorted(map(tuple, matching.overlap_pairs(df, "k", "p", "b").collect())) == want
    assert any(rows[a][3] // 40 != rows[b][3] // 40 for a, b in want)


def test_overlap_pairs_of_copies_are_dealt_to_tasks(spark):
    rng = random.Random(6)
    kinds = [(rng.randrange(-200, 900), rng.randrange(-100, 400), rng.randrange(0, 400), rng.randrange(0, 200)) for _ in range(12)]
    rows = [(k, rng.randrange(2), *rng.choice(kinds)) for k in range(120)] + [(k, None, 0, 0, 9, 9) for k in (200, 201)]
    df = spark.createDataFrame(rows, "k long, p long, x long, y long, w long, h long").selectExpr("k", "p", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS b").coalesce(1)
    over = lambda a, b: max(a[2], b[2]) < min(a[2] + a[4], b[2] + b[4]) and max(a[3], b[3]) < min(a[3] + a[5], b[3] + b[5])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and over(a, b))
    pairs = matching.overlap_pairs(df, "k", "p", "b")
    assert sorted(map(tuple, pairs.collect())) == want
    # what comes out is far more than what is read, so the size of the input may not put it all into one task
    assert pairs.rdd.getNumPartitions() >= 16 and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    for crowd in (1, 3):
        assert sorted(map(tuple, matching.overlap_pairs(df, "k", "p", "b", crowd=crowd, shares=2).collect())) == want


def test_overlap_pairs_of_a_key_come_one_after_another(spark):
    rows = [(k, 1, 2 * (k % 20), k % 5, 40, 30) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, p long, x long, y long, w long, h long").selectExpr("k", "p", "named_struct('x', x, 'y', y, 'w', w, 'h', h) AS b")
    parts = [[tuple(r) for r in part] for part in matching.overlap_pairs(df, "k", "p", "b").rdd.glom().collect()]
    pairs = [pair for part in parts for pair in part]
    assert sorted(pairs) == [(a, b) for a in range(200) for b in range(a + 1, 200)]
    # all boxes lie in one tile, so a key has one run: columns of runs are stored in little room
    assert sum(i == 0 or part[i - 1][0] != pair[0] for part in parts for i, pair in enumerate(part)) == len({a for a, _ in pairs})


def slow_palette(counts, n):
    """counts: colour -> pixels.  Boxes are parted at the median pixel of the side that weighs most, the fullest first."""
    boxes = [sorted(counts.items())]
    while len(boxes) < n:
        able = [b for b in boxes if len(b) > 1]
        if not able:
            break
        box = max(able, key=lambda b: sum(k for _, k in b))
        sides = [(max(c[i] for c, _ in box) - min(c[i] for c, _ in box)) * w for i, w in enumerate((0.299, 0.587, 0.114))]
        axis = sides.index(max(sides))
        boxes.remove(box)
        box = sorted(box, key=lambda x: x[0][axis])
        half, seen, at = sum(k for _, k in box) / 2, 0, 0
        for at, (_, k) in enumerate(box):
            seen += k
            if seen >= half:
                break
        at = min(max(at + 1, 1), len(box) - 1)
        boxes += [sorted(box[:at]), sorted(box[at:])]
    return boxes


def test_palette_parts_hold_all_pixels(spark):
    import collections
    import random

    rng = random.Random(6)
    images = {i: [tuple(rng.choice(range(0, 256, 17)) for _ in range(3)) for _ in range(rng.choice([3, 40, 300]))] for i in range(6)}
    df = spark.createDataFrame([(i, 0, x, *c, 255) for i, px in images.items() for x, c in enumerate(px)], "image int, y int, x int, r int, g int, b int, a int")
    got = {}
    for r in rasters.dominant(df).collect():
        got.setdefault(r["image"], []).append((r["color"], r["n"]))
    for i, px in images.items():
        counts = collections.Counter(px)
        boxes = slow_palette(counts, 5)
        assert sum(n for _, n in got[i]) == len(px) and len(got[i]) == min(5, len(counts)) == len(boxes)
        error = lambda palette: sum(min(sum((a - b) ** 2 for a, b in zip(c, p)) for p in palette) for c in px) / len(px)  # noqa: B023, E731
        mine = error([(c >> 16, c >> 8 & 255, c & 255) for c, _ in got[i]])
        other = error([tuple(sum(c[k] * n for c, n in b) / sum(n for _, n in b) for k in range(3)) for b in boxes])
        assert mine <= 1.5 * other + 3  # as near to the pixels as a plain median cut


def test_rounds_of_a_closure_send_nothing_through_the_driver(spark, monkeypatch):
    plans, cut = [], closure.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(closure, "cut", seen)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "a int, b int")
    got = {(r["root"], r["node"]): r["depth"] for r in closure.reachable(edges, spark.createDataFrame([(1,), (4,)], "r int"), "a", "b", "r").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (4, 4): 0}
    assert "SortMergeJoin" in plans[1] and not any("BroadcastHashJoin" in p for p in plans)
