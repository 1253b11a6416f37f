from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from tessera import registration as R
from tessera.functions import kernels as K
from tessera.operators import tiles as T


@pytest.mark.parametrize("bad", [{"method": "sparse"}, {"coarse_method": "x"}, {"structural_method": "canny"}])
def test_unknown_methods_are_refused(bad):
    with pytest.raises(ValueError):
        R.RunConfig(**bad)


def scene(h, w, seed=3):
    base = K.gaussian(np.random.default_rng(seed).normal(size=(h, w)), 2.5)
    return ((base - base.min()) / np.ptp(base) * 200 + 30).astype(np.uint8)


def cut(image, y, x, h, w):
    return np.ascontiguousarray(image[y : y + h, x : x + w])


@pytest.mark.parametrize("config", [R.RunConfig(coarse_method="fft"), R.RunConfig(coarse_method="fft", structural_method="gradient"), R.RunConfig(coarse_method="auto")])
def test_shifts_wider_than_a_strip_are_found(spark, config):
    """The reference lies 150 columns and 90 rows away, the patches are 128 pixels wide: the anchor brings them together."""
    base = scene(900, 700)
    a, b = cut(base, 200, 180, 600, 400), cut(base, 110, 30, 600, 400)
    drift = R.coarse(T.tiles_of(spark, "a", a, 256), T.tiles_of(spark, "b", b, 256), 600, 400, config, strips=5, patch=128)
    assert drift.method == ("thumbnail" if config.coarse_method == "auto" else "fourier")
    assert (drift.dx, drift.dy) == (pytest.approx(150, abs=2), pytest.approx(90, abs=2))


def test_craters_vote_for_the_drift(spark):
    yy, xx = np.mgrid[0:420, 0:420]
    rng = np.random.default_rng(5)
    base = np.full((420, 420), 60.0) + rng.normal(0, 2, (420, 420))
    for cx, cy, r in ((80, 90, 18), (300, 70, 22), (210, 200, 26), (90, 320, 20), (330, 320, 30), (200, 60, 16), (60, 210, 24), (340, 200, 18)):
        base += 120.0 * (np.abs(np.hypot(xx - cx, yy - cy) - r) < 2.5)
    a, b = cut(base, 20, 20, 390, 390), cut(base, 8, 11, 390, 390)
    found = R.strip_offsets(T.tiles_of(spark, "a", a, 200), T.tiles_of(spark, "b", b, 200), 390, 390, (0.0, 0.0), R.RunConfig(coarse_method="crater"), 1, 390).first()
    assert found["method_used"] == "votes" and found["votes"] >= 4
    assert (found["dx"], found["dy"]) == (pytest.approx(9, abs=4), pytest.approx(12, abs=4))


def test_strips_without_data_are_left_out(spark):
    base = scene(400, 300)
    base[:200] = 0
    tiles = T.tiles_of(spark, "a", base, 100)
    rows = R.strip_offsets(tiles, tiles, 400, 300, (0.0, 0.0), R.RunConfig(coarse_method="fft"), 4, 100).orderBy("strip_idx").collect()
    assert [r["strip_idx"] for r in rows] == [2, 3] and all(abs(r["dx"]) < 0.1 for r in rows)


def test_boxes_stay_inside(spark):
    box = R.strip_boxes(spark, 500, 300, (400.0, -900.0), 3, 128).orderBy("strip_idx").collect()
    assert all((r["x0"], r["x1"], r["rx0"], r["rx1"]) == (86, 214, 172, 300) and r["ry0"] == 0 and r["y1"] - r["y0"] == 128 for r in box)


def test_structural_maps_are_matched(spark):
    """A reference with its light reversed: pixels don't match where structure does."""
    base = scene(300, 300)
    a, b = cut(base, 20, 20, 260, 260), 255 - cut(base, 20, 20, 260, 260)
    drift, found = R.Coarse(0.0, 0.0, 1.0), {}
    for method in ("none", "gradient"):
        config = R.RunConfig(structural_method=method, tile_size=260, step_size=200)
        points = R.match(T.tiles_of(spark, "a", a, 128), T.tiles_of(spark, "b", b, 128), a.shape, b.shape, drift, config).toPandas()
        found[method] = int((np.hypot(points["rx"] - points["sx"], points["ry"] - points["sy"]) < 1).sum())
    assert found["gradient"] > found["none"]


def test_an_inverse_has_a_spline_from_25_points_on():
    rng = np.random.default_rng(0)
    for n, has in ((24, False), (25, True)):
        s = rng.uniform(0, 1000, (n, 2))
        model = R.Model([[1.0, 0.0, 3.0], [0.0, 1.0, -2.0]], source=s.tolist(), reference=(s + [3, -2]).tolist(), spline_active=True)
        assert model.inverse().spline_active is has


@pytest.mark.parametrize("confidence,dx,height,want", [(0.01, 0, 100, 700), (0.1, 0, 100, 500), (0.5, 900, 100, 600), (0.5, 0, 20_000, 800), (0.5, 0, 100, 64)])
def test_padding_has_one_rule(spark, confidence, dx, height, want):
    assert R.search_padding(spark, R.Coarse(dx, 0.0, confidence, intercept=(dx, 0.0)), R.RunConfig(), height) == want


def test_manual_drift_counts():
    assert R.coarse(None, None, 10, 10, replace(R.RunConfig(), manual_dx=4.0, manual_dy=-1.0)).method == "manual"


def test_rasters_of_two_scales_meet_on_one_grid(spark):
    """One scene seen with pixels of 4 and 8 metres, from corners apart: on the common grid they are the same image."""
    fine = K.gaussian(np.random.default_rng(9).normal(size=(320, 320)), 6.0)
    fine = (fine - fine.min()) / np.ptp(fine) * 200 + 20
    wide = fine.reshape(160, 2, 160, 2).mean((1, 3))
    at, ref_at = R.Place(4.0, 1000.0, -4.0, 5000.0, 300, 280), R.Place(8.0, 1160.0, -8.0, 4920.0, 140, 140)
    one = R.on_one_grid(T.tiles_of(spark, "a", fine[:300, :280], 128), at, T.tiles_of(spark, "b", wide[10:150, 20:160], 64), ref_at)
    assert (one.grid.gsd, one.grid.left, one.grid.top, one.method, one.native) == (8.0, 1160.0, 4920.0, "lanczos", None)
    a, b = (T.array_of(x, one.grid.height, one.grid.width).astype(float)[5:-5, 5:-5] for x in (one.source, one.reference))
    assert np.abs(a - b).mean() < 2 and np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.99
    crop = R.on_one_grid(T.tiles_of(spark, "a", fine[:300, :280], 128), R.Place(2.0, 1000.0, -2.0, 5000.0, 300, 280), T.tiles_of(spark, "b", wide, 64), ref_at, wide_angle=True)
    assert crop.native[1].gsd == 2.0 and crop.native[1].width == 4 * crop.grid.width
    with pytest.raises(ValueError):
        R.on_one_grid(None, at, None, R.Place(8.0, 9e6, -8.0, 4920.0, 10, 10))


def test_active_area(spark):
    """A scene of which a quarter has data in both: share and cells of that alone, and a verdict that is not the whole scene's."""
    import numpy as np

    from tessera import registration as R
    from tessera.operators import tiles as T

    a, b = np.zeros((80, 120), np.uint8), np.full((80, 120), 9, np.uint8)
    a[:40, :60] = 5
    b[:, :10] = 0
    config = R.RunConfig(grid_rows=4, grid_cols=4)
    got = R.active_area(T.tiles_of(spark, "a", a, 32), T.tiles_of(spark, "b", b, 50), (80, 120), config)
    assert got.cells == 4 and got.share == ((a > 0) & (b > 0)).mean()
    assert R.active_area(T.tiles_of(spark, "a", a * 0, 32), T.tiles_of(spark, "b", b, 50), (80, 120), config) is None
    s = np.stack(np.meshgrid(np.arange(12, 58, 5.0), np.arange(2, 38, 5.0)), -1).reshape(-1, 2)
    model = R.Model([[1, 0, 0], [0, 1, 0]], source=s.tolist(), reference=s.tolist())
    whole, part = (R.verify(spark, model, (80, 120), config, x).first() for x in (None, got))
    assert part["hull"] > 3 * whole["hull"] and part["score"] > whole["score"] and part["entropy"] == whole["entropy"]


def test_wide_angle_band(spark):
    import numpy as np

    from tessera import registration as R
    from tessera.operators import rasters
    from tessera.operators import tiles as T

    lines = spark.range(78 * 4 * 20).selectExpr("cast(id / 20 as int) as line", "cast(id % 20 as int) as sample", "cast(id as double) as v")
    for band, rows in ((7, 56), (1, 16)):
        got = T.array_of(R.wide_angle_tiles(lines, R.RunConfig(wac_band=band), size=16), rows, 20)
        want = np.zeros((rows, 20))
        for r in rasters.deinterleave(lines, band).collect():
            want[r["row"], r["sample"]] = r["v"]
        assert (got == want).all()


def test_descriptors_as_the_run_s_matcher(spark):
    """A reference that is turned by a degree and a half."""
    import numpy as np

    from tessera import registration as R
    from tessera.functions import kernels as K
    from tessera.operators import tiles as T

    base = sum(K.gaussian(np.random.default_rng(3).normal(size=(420, 420)), s) * s for s in (1.5, 3, 6))
    base = (base - base.min()) / np.ptp(base) * 200 + 30
    turn, c = np.deg2rad(1.5), 209.5
    yy, xx = np.mgrid[0:420, 0:420] - c
    ref = K.sample(base, -np.sin(turn) * xx + np.cos(turn) * yy + c, np.cos(turn) * xx + np.sin(turn) * yy + c, 3)
    src, ref = (np.clip(x[40:380, 40:380], 1, 255).astype(np.uint8) for x in (base, ref))
    out = R.register(T.tiles_of(spark, "a", src, 200), T.tiles_of(spark, "b", ref, 200), src.shape, ref.shape, R.RunConfig(method="descriptors", tile_size=260, step_size=200))
    report, got = out.report.first(), T.array_of(out.registered, *ref.shape)
    assert report["inliers"] >= 10 and report["rmse"] < 0.5
    assert np.corrcoef(got[30:-30, 30:-30].ravel(), ref[30:-30, 30:-30].ravel())[0, 1] > 0.95
