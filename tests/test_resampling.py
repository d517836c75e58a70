"""Resampling and alignment against plain numpy."""

import math

import numpy as np
import pytest

from plumbline.operators import rasters


def slow_line(n, m):
    scale = n / m
    f, out = max(scale, 1.0), np.zeros((m, n))
    for o in range(m):
        c = (o + 0.5) * scale
        for i in range(max(0, int(c - 3 * f + 0.5)), min(n, int(c + 3 * f + 0.5))):
            x = (i - c + 0.5) / f
            out[o, i] = np.sinc(x) * np.sinc(x / 3) if -3 <= x < 3 else 0.0
        out[o] /= out[o].sum()
    return out


def slow(image, w, h):
    level = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    across = level(np.einsum("oi,yic->yoc", slow_line(image.shape[1], w), image))
    return level(np.einsum("oy,yxc->oxc", slow_line(image.shape[0], h), across)).astype(int)


def slow_fit(w, h, width, height):
    if width >= w and height >= h:
        return w, h
    shape = w / h
    best = lambda x, off: max(min(math.floor(x), math.ceil(x), key=off), 1)
    if width / height >= shape:
        return best(height * shape, lambda n: abs(shape - n / height)), height
    return width, best(width / shape, lambda n: 0 if n == 0 else abs(shape - width / n))


SIZES = [(8, 6, 8, 6), (8, 6, 16, 12), (40, 30, 8, 6), (9, 5, 12, 30), (50, 7, 20, 20), (3, 40, 20, 10), (1, 1, 5, 5), (30, 20, 15, 10), (200, 1, 10, 10)]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    return [rng.integers(0, 256, (h, w, 3)) if k % 2 else np.full((h, w, 3), [0, 128, 255]) for k, (w, h, _, _) in enumerate(SIZES)]


def frame(spark, images):
    rows = [(k, y, x, *map(int, p)) for k, im in enumerate(images) for y, line in enumerate(im) for x, p in enumerate(line)]
    return spark.createDataFrame(rows, "image int, y int, x int, r int, g int, b int").selectExpr("*", "255 AS a", "1 AS w")


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    return out


def test_resampled(spark, images):
    sizes = spark.createDataFrame([(k, *s) for k, s in enumerate(SIZES)] + [(99, 5, 5, 2, 2)], "image int, w int, h int, to_w int, to_h int")
    got = collected(rasters.resampled(frame(spark, images).drop("w"), sizes))
    assert set(got) == set(range(len(SIZES)))
    for k, (_, _, w, h) in enumerate(SIZES):
        want = slow(images[k], w, h)
        assert len(got[k]) == w * h
        assert all(max(abs(np.array(got[k][y, x]) - want[y, x])) <= 1 for y in range(h) for x in range(w))
        assert np.mean([tuple(want[y, x]) == got[k][y, x] for y in range(h) for x in range(w)]) > 0.98


def test_aligned(spark, images):
    sizes = spark.createDataFrame([(k, *s) for k, s in enumerate(SIZES)], "image int, w int, h int, width int, height int")
    pixels, modes = rasters.aligned(frame(spark, images).drop("w"), sizes)
    got, modes = collected(pixels), {r["image"]: r["mode"] for r in modes.collect()}
    for k, (w, h, width, height) in enumerate(SIZES):
        if (w, h) == (width, height):
            mode, want = "same_dimensions", images[k]
        elif abs(width / height - w / h) <= 0.001:
            mode, want = "resized_to_reference", slow(images[k], width, height)
        else:
            mode, (fw, fh) = "contained_to_reference", slow_fit(w, h, width, height)
            want = np.full((height, width, 3), 255)
            x, y = (width - fw) // 2, (height - fh) // 2
            want[y : y + fh, x : x + fw] = slow(images[k], fw, fh)
        assert modes[k] == mode and len(got[k]) == width * height
        assert all(max(abs(np.array(got[k][y, x]) - want[y][x])) <= 1 for y in range(height) for x in range(width))


def test_no_images(spark, images):
    empty = frame(spark, images).drop("w").limit(0)
    assert rasters.resampled(empty, spark.createDataFrame([], "image int, w int, h int, to_w int, to_h int")).count() == 0
