"""Raster operators: images stay apart by their keys, and kernels against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import rasters as R
from tessera.operators import tiles as T

RNG = np.random.default_rng(8)


def long_rows(spark, images):
    rows = [(k, int(y), int(x), float(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image string, row int, col int, v double")


IMAGES = {"a": RNG.uniform(1, 50, (14, 12)), "b": RNG.uniform(100, 250, (14, 12))}


@pytest.mark.parametrize("name,operator", [
    ("sobel", lambda df, by: R.sobel(df, by)),
    ("shadow", lambda df, by: R.shadow_mask(df, 0.1, 1, by=by)),
    ("seams", lambda df, by: R.feather_seams(df.withColumnRenamed("col", "sample"), 7, by=[*by, "sample"])),
    ("flat", lambda df, by: R.flat_field(df.withColumn("k", F.col("row") % 7), by=by)),
    ("difference", lambda df, by: R.absolute_difference(df, df.withColumn("row", F.col("row") - 1), by)),
    ("colour", lambda df, by: R.false_colour(df, df.withColumn("row", F.col("row") - 1), by)),
])
def test_images_stay_apart(spark, name, operator):
    """Two images in one table give what each gives alone."""
    rows = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    both = operator(long_rows(spark, IMAGES), ["image"])
    alone = [operator(long_rows(spark, {k: a}).drop("image"), []).withColumn("image", F.lit(k)) for k, a in IMAGES.items()]
    want = rows(alone[0].select(both.columns).unionByName(alone[1].select(both.columns)))
    got = rows(both)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def test_unsharp_by_loops():
    image = RNG.uniform(0, 255, (9, 11))
    w = np.array([np.exp(-(d * d) / 2.88) for d in range(-5, 6)])
    w /= w.sum()
    blurred = np.array([[sum(w[i + 5] * w[j + 5] * image[mirrored(y + i, 9), mirrored(x + j, 11)] for i in range(-5, 6) for j in range(-5, 6)) for x in range(11)] for y in range(9)])
    assert (K.unsharp(image) == np.clip(1.4 * image - 0.4 * blurred, 0, 255).astype(np.uint8)).all()


def test_clahe_by_loops():
    image = RNG.integers(0, 256, (16, 16)).astype(np.uint8)
    got, grid, size = K.clahe(image, 2.0, 4), 4, 4
    limit, tables = max(1.0, 2.0 * size * size / 256), {}
    for ty in range(grid):
        for tx in range(grid):
            values = image[ty * size : ty * size + size, tx * size : tx * size + size].ravel().tolist()
            counts = [values.count(v) for v in range(256)]
            extra, up = sum(max(c - limit, 0) for c in counts) / 256, 0.0
            for v in range(256):
                up += min(counts[v], limit) + extra
                tables[ty, tx, v] = min(255.0, up * 255 / (size * size))
    for y in range(16):
        for x in range(16):
            gy, gx = (y + 0.5) / size - 0.5, (x + 0.5) / size - 0.5
            fy, fx, total = gy - np.floor(gy), gx - np.floor(gx), 0.0
            for dy in (0, 1):
                for dx in (0, 1):
                    at = tuple(int(np.clip(np.floor(g) + d, 0, grid - 1)) for g, d in ((gy, dy), (gx, dx)))
                    total += tables[at[0], at[1], int(image[y, x])] * (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
            assert got[y, x] == round(total)


def test_phase_congruency_by_definition():
    """Against sums over scales written out, without the kernel's arrays of scales."""
    image = RNG.uniform(0, 255, (24, 20))
    a, b = K.phase_congruency(image), K.phase_congruency(3 * image + 7)
    assert np.allclose(a, b, atol=1e-6) and 0 <= a.min() and a.max() <= 1
    edge = np.where(np.arange(64)[None, :] < 32, 20.0, 200.0) + np.zeros((64, 1))
    pc = K.phase_congruency(edge)
    assert pc[32, 28:36].max() == pytest.approx(pc[32, 8:56].max())


def test_cubic_splines_reproduce_cubics():
    """Inside an image of a cubic the spline is that cubic."""
    f = lambda y, x: 0.002 * y**3 - 0.05 * y * x + 0.3 * x**2 + 5
    yy, xx = np.mgrid[0:60, 0:60].astype(float)
    y, x = RNG.uniform(20, 40, 50), RNG.uniform(20, 40, 50)
    assert np.allclose(K.sample(f(yy, xx), y, x, 3), f(y, x), atol=1e-5)


def test_warped_blocks_are_the_whole_image_warped(spark):
    image = RNG.uniform(1, 250, (150, 90))
    tiles = T.tiles_of(spark, "a", image, 40)
    shift = lambda p: p + np.array([1.5, -0.25])
    got = T.array_of(T.warp(tiles, shift, 150, 90, block=64, order=3), 150, 90)
    yy, xx = np.mgrid[0:150, 0:90].astype(float)
    want = K.cast_pixels(K.sample(image, yy - 0.25, xx + 1.5, 3), "|u1")
    assert (np.abs(got.astype(int) - want.astype(int)) <= 1).mean() > 0.99


def test_refine_rejects_and_falls_back():
    flat, rough = np.full((64, 64), 9.0), K.gaussian(RNG.normal(size=(64, 64)), 1.0) * 100 + 100
    assert K.refine(flat, rough, 0.5) is None and K.refine(rough, flat, 0.5) is None
    moved = np.roll(rough, (1, 2), (0, 1))
    found = K.refine(rough, moved, 1.1)  # no correlation reaches this: both ways refuse
    assert found is None
    dx, dy, score = K.refine(rough, moved, 0.45)
    assert (dx, dy) == (pytest.approx(2, abs=0.3), pytest.approx(1, abs=0.3)) and score >= 0.45


def test_cross_validation_by_loops(spark):
    p = RNG.uniform(0, 100, (30, 2))
    v = np.column_stack([np.sin(p[:, 0] / 15), np.cos(p[:, 1] / 20)])
    df = spark.createDataFrame(np.column_stack([p, v]).tolist(), "sx double, sy double, dx double, dy double")
    got = {r["fold"]: (r["n"], r["sum_sq"]) for r in T.cross_validated(df).collect()}
    rows = np.array(sorted(np.column_stack([p, v]).tolist(), key=lambda r: (r[1], r[0])))
    part = K.folds(30)
    for f in range(part.max() + 1):
        spline = K.ThinPlate(rows[part != f, :2], rows[part != f, 2:], K.tps_smoothing(0.01, 30))
        assert got[f] == (int((part == f).sum()), pytest.approx(((spline(rows[part == f, :2]) - rows[part == f, 2:]) ** 2).sum()))


def test_ncc_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    v = RNG.normal(size=(40, 8))
    v[11] = v[30]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, e array<double>")
    for others in (False, True):
        got = {r[0]: (r[1], r[2]) for r in R.ncc_argmax(df.where("id % 5 = 0").selectExpr("id patch_id", "e p"), df.selectExpr("id cand_id", "e c"), others).collect()}
        s = v @ v.T
        if others:
            np.fill_diagonal(s, -np.inf)
        assert {k: x[0] for k, x in got.items()} == {k: int(s[k].argmax()) for k in range(0, 40, 5)}
        assert all(x[1] == pytest.approx(s[k].max()) for k, x in got.items())
