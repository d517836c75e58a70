"""Raster metrics over pixel relations (image, y, x, r, g, b, a)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pixels import luma, near_palette, near_white


def joined(left: DataFrame, right: DataFrame, key: list[str] = ("image", "y", "x")) -> DataFrame:
    """The pixels of two images of equal size, as columns r, g, b and r2, g2, b2, with luma l and l2."""
    a = left.select(*key, "r", "g", "b")
    b = right.select(*key, *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return a.join(b, list(key)).withColumn("l", luma("r", "g", "b")).withColumn("l2", luma("r2", "g2", "b2"))


def f1(a: Column, b: Column) -> Column:
    """Aggregate: F1 of two masks; 1 if both are empty, 0 if they share nothing."""
    both, na, nb = F.count_if(a & b), F.count_if(a), F.count_if(b)
    return F.when((na == 0) & (nb == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (na + nb))


def metrics(pixels: DataFrame, by: str = "image", *, threshold: int = 8, foreground: int = 245) -> DataFrame:
    """Comparison of joined pixels: one partial aggregate a task, whatever the images' sizes; rounded to 6 digits."""
    error = F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("g") - F.col("g2")) + F.abs(F.col("b") - F.col("b2"))
    delta = luma(*[F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"])  # the luma of the differences, not the difference of lumas
    front = (F.col("l") < foreground) | (F.col("l2") < foreground)
    out = pixels.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(error / 3.0).alias("mae"),
        F.avg((delta > threshold).cast("double")).alias("changed_ratio"),
        (1.0 - F.coalesce(F.avg(F.when(front, delta)), F.lit(0.0)) / 255.0).alias("foreground_similarity"),
        F.avg((F.col("l") < foreground).cast("double")).alias("foreground_ratio"),
    )
    out = out.withColumn("similarity", 1.0 - F.col("mae") / 255.0)
    return out.select(by, "n", *[F.bround(c, 6).alias(c) for c in ("mae", "similarity", "changed_ratio", "foreground_similarity", "foreground_ratio")])


def edges(pixels: DataFrame, key: str = "image", value: str = "l", *, threshold: int = 24) -> DataFrame:
    """(key, y, x, edge boolean): whether 8 times a pixel less its eight neighbours reaches the threshold.

    Every pixel adds its value to its neighbours in one grouped sum, combined before the shuffle.  Border pixels, which
    lack neighbours, are edges if their own value reaches it.
    """
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(8 if dy == dx == 0 else -1).alias("k")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = pixels.select(key, "y", "x", F.col(value).alias("v"), F.explode(moves).alias("m"))
    own = F.max(F.when(F.col("m.k") == 8, F.col("v")))
    sums = spread.groupBy(key, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).agg(F.sum(F.col("v") * F.col("m.k")).alias("s"), F.count("*").alias("n"), own.alias("own"))
    return sums.where("own IS NOT NULL").select(key, "y", "x", (F.when(F.col("n") == 9, F.col("s")).otherwise(F.col("own")) >= threshold).alias("edge"))


def region_presence(pixels: DataFrame, regions: DataFrame, *, key: str = "image", tile: int = 64, least: float = 0.02, gone: float = 0.002, share: float = 0.1, foreground: int = 245) -> DataFrame:
    """(key, region, source_ratio, preview_ratio, missing) for regions x0, y0, x1, y1 (ends excluded) of joined pixels.

    Regions are exploded into the tiles that they touch and pixels meet them by tile, so no pixel is compared with
    all regions.  A region with less than `least` foreground in the source is not judged (missing is null); one is missing
    if the preview has less than `gone` and less than `share` of the source's.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    tiles = regions.where("x1 > x0 AND y1 > y0").withColumn("__tx", F.explode(span("x0", "x1"))).withColumn("__ty", F.explode(span("y0", "y1")))
    at = pixels.withColumn("__tx", F.floor(F.col("x") / tile)).withColumn("__ty", F.floor(F.col("y") / tile))
    inside = at.join(tiles, [key, "__tx", "__ty"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    ratios = inside.groupBy(key, "region").agg(F.avg((F.col("l") < foreground).cast("double")).alias("source_ratio"), F.avg((F.col("l2") < foreground).cast("double")).alias("preview_ratio"))
    missing = F.when(F.col("source_ratio") >= least, (F.col("preview_ratio") < gone) & (F.col("preview_ratio") < share * F.col("source_ratio")))
    return ratios.withColumn("missing", missing)


def median_cut(colors: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The palette entry, 0 to n - 1, of each distinct colour (rows r, g, b; increasing).

    The box with the most pixels that can be parted is cut at the median pixel of its longest side, sides weighted by what
    they add to luma, until there are n boxes or nothing can be parted.
    """
    boxes = [np.arange(len(colors))]
    while len(boxes) < n:
        wide = [b for b in boxes if len(b) > 1]
        if not wide:
            break
        box = max(wide, key=lambda b: (counts[b].sum(), -b[0]))
        side = int(((colors[box].max(axis=0) - colors[box].min(axis=0)) * np.array([299, 587, 114])).argmax())
        order = box[np.argsort(colors[box, side], kind="stable")]
        values, cum = colors[order, side], np.cumsum(counts[order])
        low = values <= values[min(int(np.searchsorted(cum, cum[-1] / 2)), len(order) - 1)]
        low = low if not low.all() else values < values[-1]
        at = next(i for i, b in enumerate(boxes) if b is box)
        boxes[at : at + 1] = [np.sort(order[low]), np.sort(order[~low])]
    out = np.empty(len(colors), dtype=np.int64)
    for i, b in enumerate(boxes):
        out[b] = i
    return out


def dominant(pixels: DataFrame, key: str = "image", *, top: int = 5) -> DataFrame:
    """(key, color, n) of each image's palette of at most `top` colours, fitted to the image by median cut; color 0xRRGGBB.

    An entry is the mean colour of its pixels.  Pixels are counted by colour before the shuffle.  An image with no more colours than
    the palette keeps them as they are; of others the distinct colours are in one task, which the colour space bounds.
    """
    kind = pixels.schema[key].dataType.simpleString()
    counts = pixels.groupBy(key, "r", "g", "b").agg(F.count("*").alias("n"))
    counts = counts.withColumn("colors", F.count("*").over(Window.partitionBy(key)))
    few = counts.where(F.col("colors") <= top).select(key, (F.shiftleft(F.col("r").cast("long"), 16) + F.shiftleft(F.col("g").cast("long"), 8) + F.col("b")).alias("color"), "n")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "g", "b"])
        colors, n = pdf[["r", "g", "b"]].to_numpy(dtype=np.int64), pdf["n"].to_numpy()
        entry = median_cut(colors, n, top)
        size = np.bincount(entry, n).astype(np.int64)
        mean = np.stack([np.floor(np.bincount(entry, n * colors[:, c]) / size + 0.5).astype(np.int64) for c in range(3)])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(size), "color": mean[0] << 16 | mean[1] << 8 | mean[2], "n": size})

    return few.unionByName(counts.where(F.col("colors") > top).groupBy(key).applyInPandas(fit, f"`{key}` {kind}, color long, n long"))


def alpha_measures(pixels: DataFrame, key: str = "image") -> DataFrame:
    """Alpha range, share of clear pixels, and the corner and centre samples of each image."""
    size = pixels.groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    at = pixels.join(size, key)
    sample = lambda y, x: F.max(F.when((F.col("y") == y) & (F.col("x") == x), F.struct("r", "g", "b", "a")))
    mx, my, zero = F.col("mx"), F.col("my"), F.lit(0)
    return at.groupBy(key).agg(
        F.min("a").alias("alpha_min"), F.max("a").alias("alpha_max"), F.avg((F.col("a") == 0).cast("double")).alias("clear_ratio"),
        F.array(sample(zero, zero), sample(zero, mx), sample(my, zero), sample(my, mx)).alias("corners"), sample(F.floor((my + 1) / 2), F.floor((mx + 1) / 2)).alias("centre"),
    )


def edge_contact(pixels: DataFrame, key: str = "image", tolerance: int = 12) -> DataFrame:
    """(key, top, right, bottom, left): sides where a pixel that is not clear differs from the corners' median, cut to a whole number."""
    size = pixels.groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    border = pixels.join(size, key).where("x = 0 OR y = 0 OR x = mx OR y = my")
    # an image of one row or column has the same pixel in two corners, and it counts twice
    corners = F.explode(F.array(*[F.struct(F.col(y).alias("cy"), F.col(x).alias("cx")) for y in ("zero", "my") for x in ("zero", "mx")]))
    corner = border.withColumn("zero", F.col("mx") * 0).withColumn("c", corners).where("y = c.cy AND x = c.cx").groupBy(key).agg(*[F.floor(F.median(c)).alias(f"m{c}") for c in "rgb"])
    far = (F.col("a") > 0) & (F.greatest(*[F.abs(F.col(c) - F.col(f"m{c}")) for c in "rgb"]) > tolerance)
    side = lambda where: F.coalesce(F.bool_or(F.expr(where) & F.col("far")), F.lit(False))
    return border.join(corner, key).withColumn("far", far).groupBy(key).agg(side("y = 0").alias("top"), side("x = mx").alias("right"), side("y = my").alias("bottom"), side("x = 0").alias("left"))


def border_palette(pixels: DataFrame, key: str = "image") -> DataFrame:
    """(key, palette): the distinct colours of each image's border that are neither clear nor near white."""
    size = pixels.groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    border = pixels.join(size, key).where("x = 0 OR y = 0 OR x = mx OR y = my").where((F.col("a") > 0) & ~near_white("r", "g", "b"))
    return border.groupBy(key).agg(F.collect_set(F.struct("r", "g", "b")).alias("palette"))


def corner_palette(pixels: DataFrame, key: str = "image") -> DataFrame:
    """(key, palette): the distinct colours of each image's four corner patches, up to 3 x 3 pixels and a quarter of its sides."""
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    at = pixels.join(size.withColumn("patch", F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("w") / 4), F.floor(F.col("h") / 4)))), key)
    return at.where("(x < patch OR x >= w - patch) AND (y < patch OR y >= h - patch)").groupBy(key).agg(F.collect_set(F.struct("r", "g", "b")).alias("palette"))


def outline_background(pixels: DataFrame, *, key: str = "image", tolerance: int = 24) -> DataFrame:
    """(key, y, x) of what lies around a white outline: clear pixels, and others not near white but like a border colour."""
    rows = pixels.join(border_palette(pixels, key), key, "left")
    like = ~near_white("r", "g", "b") & near_palette("r", "g", "b", "palette", tolerance)
    return rows.where((F.col("a") == 0) | F.coalesce(like, F.lit(False))).select(key, "y", "x")


def flooded(open_: np.ndarray) -> np.ndarray:
    """Of a mask, what hangs together, side by side, with the border."""
    seen = np.zeros_like(open_)
    seen[0], seen[-1], seen[:, 0], seen[:, -1] = open_[0], open_[-1], open_[:, 0], open_[:, -1]
    stack = list(zip(*np.nonzero(seen)))
    height, width = open_.shape
    while stack:
        y, x = stack.pop()
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < height and 0 <= u < width and open_[v, u] and not seen[v, u]:
                seen[v, u] = True
                stack.append((v, u))
    return seen


def background(pixels: DataFrame, *, key: str = "image", tolerance: int = 24) -> DataFrame:
    """(key, y, x) of the background: clear pixels and those like a corner's colour that hang together with the border.

    Candidates are found pixel by pixel in the JVM; then each image's are filled by themselves in one task, for an image is
    one file and bounded by what a reader can decode.
    """
    kind = pixels.schema[key].dataType.simpleString()
    rows = pixels.join(corner_palette(pixels, key), key)
    like = rows.where((F.col("a") == 0) | near_palette("r", "g", "b", "palette", tolerance)).select(key, "y", "x")
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((pdf["h"].iloc[0], pdf["w"].iloc[0]), dtype=bool)
        mask[pdf["y"], pdf["x"]] = True
        y, x = np.nonzero(flooded(mask))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(y), "y": y, "x": x})

    return like.join(size, key).groupBy(key).applyInPandas(fill, f"`{key}` {kind}, y long, x long")


def foreground_box(pixels: DataFrame, background: DataFrame, key: str = "image") -> DataFrame:
    """(key, visible, x, y, w, h, top, right, bottom, left): what is left of each image without its background.

    Pixels that are clear or in the background are not visible.  The last four tell which sides of the image the visible
    part touches; an image with nothing visible has no box.
    """
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("iw"), (F.max("y") + 1).alias("ih"))
    seen = pixels.where("a > 0").select(key, "y", "x").join(background.select(key, "y", "x"), [key, "y", "x"], "left_anti")
    box = seen.groupBy(key).agg(F.count("*").alias("visible"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") + 1 - F.min("x")).alias("w"), (F.max("y") + 1 - F.min("y")).alias("h"))
    out = size.join(box, key, "left")
    return out.select(key, F.coalesce("visible", F.lit(0).cast("long")).alias("visible"), "x", "y", "w", "h", (F.col("y") == 0).alias("top"), (F.col("x") + F.col("w") == F.col("iw")).alias("right"), (F.col("y") + F.col("h") == F.col("ih")).alias("bottom"), (F.col("x") == 0).alias("left"))


def weights(sizes: DataFrame, inside: str, outside: str, *, lobes: int = 3) -> DataFrame:
    """(inside, outside, i, o, w): what pixel i of a line of `inside` pixels adds to pixel o of one of `outside` pixels.

    A windowed sinc of `lobes` lobes, widened by the ratio where a line shrinks; the weights of each o add up to 1.
    """
    s = sizes.select(inside, outside).distinct().where(f"{inside} > 0 AND {outside} > 0")
    scale = F.col(inside) / F.col(outside)
    wide = F.greatest(scale, F.lit(1.0))
    s = s.select(inside, outside, scale.alias("s"), wide.alias("f"), F.explode(F.sequence(F.lit(0), F.col(outside) - 1)).alias("o")).withColumn("c", (F.col("o") + 0.5) * F.col("s"))
    low = F.greatest(F.lit(0), F.floor(F.col("c") - lobes * F.col("f") + 0.5).cast("int"))
    high = F.least(F.col(inside), F.floor(F.col("c") + lobes * F.col("f") + 0.5).cast("int"))
    sinc = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(np.pi * x) / F.when(x == 0, 1.0).otherwise(np.pi * x))
    kernel = lambda x: F.when((x >= -lobes) & (x < lobes), sinc(x) * sinc(x / lobes)).otherwise(0.0)
    s = s.withColumn("t", F.transform(F.sequence(low, high - 1), lambda i: F.struct(i.alias("i"), kernel((i - F.col("c") + 0.5) / F.col("f")).alias("k"))))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["k"])
    return s.withColumn("__total", total).select(inside, outside, "o", "__total", F.inline("t")).select(inside, outside, "i", "o", (F.col("k") / F.col("__total")).alias("w"))


def resampled(pixels: DataFrame, sizes: DataFrame, *, key: str = "image") -> DataFrame:
    """(key, y, x, r, g, b) of images in another size; sizes: key, w, h, to_w, to_h, one row an image.

    Two weighted grouped sums, along the lines and then down, each combined before its shuffle and rounded to a whole level
    from 0 to 255 (sums to six digits first, so that halves do not hang on the order of adding); the weights are one small relation for each pair of lengths, so a pixel is taken as often as the kernel is
    wide and no two pixels are paired.  Imaging libraries that sum in fixed point may differ by one level.  Images without a size,
    and pixels outside theirs, are left out.
    """
    level = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(F.sum(F.col(c) * F.col("w")), 6) + 0.5))).cast("int").alias(c)
    s = sizes.select(key, F.col("w").alias("__w"), F.col("h").alias("__h"), F.col("to_w").alias("__tw"), F.col("to_h").alias("__th"))
    along = weights(s, "__w", "__tw").withColumnRenamed("i", "x")
    across = pixels.join(s, key).join(along, ["__w", "__tw", "x"]).groupBy(key, "__h", "__th", "y", F.col("o").alias("x")).agg(*map(level, "rgb"))
    down = weights(s, "__h", "__th").withColumnRenamed("i", "y")
    return across.join(down, ["__h", "__th", "y"]).groupBy(key, F.col("o").alias("y"), "x").agg(*map(level, "rgb"))


def contained_size(w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct<w, h>: the largest size of the same shape within width and height, or the own size if that fits."""
    shape = w / h
    best = lambda x, off: F.greatest(F.lit(1), F.when(off(F.floor(x)) <= off(F.ceil(x)), F.floor(x)).otherwise(F.ceil(x)))
    tall = best(height * shape, lambda n: F.abs(shape - n / height))
    flat = best(width / shape, lambda n: F.when(n == 0, 0.0).otherwise(F.abs(shape - width / F.greatest(n, F.lit(1)))))
    by_height = width / height >= shape
    size = lambda a, b: F.struct(a.cast("int").alias("w"), b.cast("int").alias("h"))
    return F.when((width >= w) & (height >= h), size(w, h)).when(by_height, size(tall, height)).otherwise(size(width, flat))


def aligned(preview: DataFrame, sizes: DataFrame, *, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """Previews in their references' sizes: pixels (key, y, x, r, g, b), and (key, mode).

    sizes: key, w, h (preview), width, height (reference).  Equal sizes stay ("same_dimensions"); of a shape within 0.001 a preview
    is resized ("resized_to_reference"); others are made to fit inside and stand in the middle of a white page
    ("contained_to_reference").
    """
    same = (F.col("w") == F.col("width")) & (F.col("h") == F.col("height"))
    near = F.abs(F.col("width") / F.col("height") - F.col("w") / F.col("h")) <= 0.001
    mode = F.when(same, "same_dimensions").when(near, "resized_to_reference").otherwise("contained_to_reference")
    fit = contained_size(F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    s = sizes.withColumns({"mode": mode, "fit": fit})
    whole = F.col("mode") != "contained_to_reference"
    s = s.withColumns({"to_w": F.when(whole, F.col("width")).otherwise(F.col("fit.w")), "to_h": F.when(whole, F.col("height")).otherwise(F.col("fit.h"))})
    moved = resampled(preview, s, key=key).join(s.select(key, F.floor((F.col("width") - F.col("to_w")) / 2).cast("int").alias("dx"), F.floor((F.col("height") - F.col("to_h")) / 2).cast("int").alias("dy")), key)
    moved = moved.select(key, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "r", "g", "b")
    page = s.select(key, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select(key, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return page.join(moved, [key, "y", "x"], "left").select(key, "y", "x", *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"]), s.select(key, "mode")
