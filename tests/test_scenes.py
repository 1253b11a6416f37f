"""Whole rasters in tiles against kernels on the whole array, whatever the cut."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.operators import circles as C
from tessera.operators import scenes as S
from tessera.operators import tiles as T


@pytest.fixture(scope="module")
def rasters():
    rng = np.random.default_rng(0)
    a = np.clip(K.gaussian(rng.normal(0, 1, (203, 187)), 2) * 200 + 120, 0, None)
    a[20:40, 30:60] = 0
    return {"a": a, "b": rng.integers(0, 255, (100, 90)).astype(float), "dark": np.zeros((40, 30))}


@pytest.fixture(scope="module")
def tiles(spark, rasters):
    return T.tiles_of(spark, "a", rasters["a"], 64).unionByName(T.tiles_of(spark, "b", rasters["b"], 37)).unionByName(T.tiles_of(spark, "dark", rasters["dark"], 20)).cache()


def arrays(df, rasters):
    df = df.cache()
    return {k: T.array_of(df.where(df["image_id"] == k), *v.shape) for k, v in rasters.items()}


def test_percentiles(spark, tiles, rasters):
    got = {r["image_id"]: (r["n"], r["q"]) for r in S.percentiles(tiles, [0.02, 0.5, 0.98]).collect()}
    assert set(got) == {"a", "b"}  # the dark one has no valid pixel
    for k in got:
        ok = rasters[k][rasters[k] > 0]
        assert got[k][0] == len(ok) and got[k][1] == np.percentile(ok, [2, 50, 98]).tolist()


def test_percentiles_of_any_numbers(spark):
    v = np.array([[np.nan, np.inf, -np.inf, -5.0], [0.0, -0.0, 1e-310, 1e308], [3.0, 3.0, 3.0, -1e308]])
    (row,) = S.percentiles(T.tiles_of(spark, "x", v, 2), [0.0, 0.5, 1.0], positive=False).collect()
    ok = v[np.isfinite(v)]
    assert row["n"] == len(ok) and row["q"] == np.percentile(ok, [0, 50, 100]).tolist()


def test_equalised(spark, tiles, rasters):
    base = S.stretched(tiles)
    for k, v in arrays(base, rasters).items():
        assert (v == K.stretched(rasters[k])).all()
    for k, v in arrays(S.equalised(base, 3.0), rasters).items():
        assert (v == K.clahe(K.stretched(rasters[k]), 3.0)).all(), k


@pytest.mark.parametrize("size", [32, 512])
def test_filters_over_borders(spark, tiles, rasters, size):
    sharp, slope, free = arrays(S.sharpened(tiles, size), rasters), arrays(S.gradient(tiles, size), rasters), arrays(S.shadow_free(tiles, size=size), rasters)
    for k, v in rasters.items():
        assert (sharp[k] == K.unsharp(v)).all()
        assert np.abs(slope[k] - K.gradient(v)).max() < 1e-12
        assert (free[k] == K.shadow_free(v)).all()


def test_structural(spark, tiles, rasters):
    for k, v in arrays(S.structural(tiles, "gradient", size=64), rasters).items():
        assert np.abs(v - K.structural(rasters[k], "gradient")).max() < 1e-9
    with pytest.raises(ValueError):
        S.structural(tiles, "unknown")


def test_phase_congruency_depends_on_no_cut(spark, tiles, rasters):
    """Tiles of 48 and of the whole agree; finite kernels stay near the transform of the whole image."""
    base = S.stretched(tiles.where("image_id = 'a'"))
    few = {"a": rasters["a"]}
    small, whole = (arrays(S.phase_congruency(base, radius=96, size=size), few)["a"] for size in (48, 512))
    assert np.abs(small - whole).max() < 1e-9
    assert np.corrcoef(whole.ravel(), K.phase_congruency(K.stretched(rasters["a"])).ravel())[0, 1] > 0.98


def test_kernels_have_no_mean():
    for k in S.log_gabor(4, 6.0, 2.1, 0.55, 40):
        assert abs(k.sum()) < 1e-12 and abs(k[0]).max() < 1e-4 and np.allclose(k, k[::-1]) and np.allclose(k, k.T)


def test_circles_over_tiles(spark):
    """Each ring once, on one tile or on four, as the kernel finds them in the whole array; flat rasters have none."""
    yy, xx = np.mgrid[0:300, 0:340]
    image, rings = np.zeros((300, 340)), [(128, 128, 30), (60, 250, 18), (230, 60, 22), (220, 256, 26), (40, 60, 16), (250, 180, 16), (150, 300, 20), (60, 170, 18), (270, 310, 15), (140, 50, 18)]
    for y, x, r in rings:
        image[np.abs(np.hypot(xx - x, yy - y) - r) < 2] = 200.0
    want = sorted((int(y), int(x), int(r)) for x, y, r in K.circles(image, 15, 36, 25))
    tiles = T.tiles_of(spark, "a", image, 128).unionByName(T.tiles_of(spark, "flat", np.full((50, 50), 9.0), 32))
    assert len(want) == len(rings)
    for size in (64, 512):
        assert sorted((r["cy"], r["cx"], r["r"]) for r in C.circles(tiles, 15, 36, 25, size=size).collect()) == want


def test_strongest_is_the_sorted_pass(spark):
    rng = np.random.default_rng(5)
    rows = [("i", 15, int(x), int(y), float(s)) for x, y, s in zip(rng.integers(0, 120, 300), rng.integers(0, 120, 300), rng.integers(0, 9, 300))]
    rows = list({(r[2], r[3]): r for r in rows}.values())
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[3], r[2])):
        if all(np.hypot(r[2] - k[2], r[3] - k[3]) >= 20 for k in kept):
            kept.append(r)
    got = C.strongest(spark.createDataFrame(rows, "image_id string, r int, cx int, cy int, score double"), 20.0).collect()
    assert sorted((r["cx"], r["cy"]) for r in got) == sorted((k[2], k[3]) for k in kept)
