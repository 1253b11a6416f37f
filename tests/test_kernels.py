from __future__ import annotations

import numpy as np
import pytest

from tessera import registration as R
from tessera.functions import kernels as K
from tessera.operators import tiles as T

RNG = np.random.default_rng(42)


def blob(dx=0.0, dy=0.0, n=200):
    yy, xx = np.mgrid[0:n, 0:n]
    return sum(a * np.exp(-((xx - cx - dx) ** 2 + (yy - cy - dy) ** 2) / (2 * s * s)) for a, cx, cy, s in ((200, 100, 100, 15), (100, 60, 80, 10)))


def test_phase_correlation_of_rolled_noise():
    a = K.gaussian(RNG.normal(size=(512, 512)), 1.0)
    dx, dy, response = K.phase_correlation(a, np.roll(a, (-17, 23), (0, 1)))
    assert dx == pytest.approx(23, abs=2) and dy == pytest.approx(-17, abs=2) and response > 0.1
    assert K.phase_correlation(np.zeros((8, 8)), np.zeros((8, 8))) == (0.0, 0.0, 0.0)


def test_ecc_of_blobs():
    dx, dy, rho = K.ecc_translation(blob()[68:132, 68:132], blob(0.3, -0.4)[68:132, 68:132])
    assert dx == pytest.approx(0.3, abs=0.05) and dy == pytest.approx(-0.4, abs=0.05) and rho > 0.9
    assert K.refine(np.full((64, 64), 9.0), blob()[:64, :64], 0.5) is None


def test_phase_congruency_ignores_brightness():
    yy, xx = np.mgrid[0:256, 0:256]
    ring = 100 + 80.0 * (np.abs(np.hypot(xx - 128, yy - 128) - 50) < 3) + RNG.normal(0, 2, (256, 256))
    a, b = K.phase_congruency(ring), K.phase_congruency(ring * 0.5 + 80)
    assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.3 and 0 <= a.min() and a.max() <= 1
    with pytest.raises(ValueError):
        K.structural(ring, "canny")


def test_shadow_mask_of_half_shadow():
    image = np.full((100, 100), 128.0)
    image[:30] = 0
    assert K.shadow_free(image)[:20].mean() < 0.5


def test_circles_are_found():
    yy, xx = np.mgrid[0:200, 0:200]
    image = sum(200.0 * (np.abs(np.hypot(xx - cx, yy - cy) - r) < 2) for cx, cy, r in ((60, 60, 20), (130, 140, 30)))
    got = K.circles(image)
    for cx, cy in ((60, 60), (130, 140)):
        assert np.hypot(got[:, 0] - cx, got[:, 1] - cy).min() < 4


def test_ransac_and_firewall():
    s = RNG.uniform(0, 1000, (80, 2))
    m = np.array([[1.0, 0.02, 5.0], [-0.02, 1.0, -3.0]])
    r = K.applied(m, s) + RNG.normal(0, 0.1, s.shape)
    r[:20] += RNG.uniform(40, 90, (20, 2))
    for affine in (True, False):
        model, ok = K.ransac(s, r, 1.0, affine)
        assert ok[20:].all() and not ok[:20].any() and np.allclose(model, m, atol=0.5)
    assert K.ransac(s[:2], r[:2], 1.0)[0] is None


def test_thin_plate_interpolates_and_smooths():
    p = RNG.uniform(0, 100, (50, 2))
    v = np.column_stack([np.sin(p[:, 0] / 20), p[:, 1] * 0.1])
    assert np.allclose(K.ThinPlate(p, v)(p), v, atol=1e-6)
    assert not np.allclose(K.ThinPlate(p, v + RNG.normal(0, 1, v.shape), 10.0)(p), v, atol=1e-6)


@pytest.mark.parametrize("n,folds", [(8, 8), (40, 40), (41, 5)])
def test_folds(n, folds):
    k = K.folds(n)
    assert len(np.unique(k)) == folds and np.ptp(np.bincount(k)) <= 1


def test_sampling_at_pixels_gives_pixels():
    image = RNG.uniform(0, 255, (40, 50))
    yy, xx = np.mgrid[0:40, 0:50].astype(float)
    for order in (0, 1, 3):
        assert np.allclose(K.sample(image, yy, xx, order), image)
    assert K.sample(image, np.array([-9.0]), np.array([0.0]))[0] == 0
    assert K.cast_pixels(np.array([254.6, 300.0, -4.0]), "u1").tolist() == [255, 255, 0] and K.cast_pixels(np.array([2.9]), "i2")[0] == 2


@pytest.mark.parametrize("points,area", [([], 0), ([(0, 0), (1, 1)], 0), ([(0, 0), (2, 0), (1, 0)], 0), ([(0, 0), (2, 0), (2, 3), (0, 3), (1, 1), (2, 0)], 6)])
def test_hull(points, area):
    assert K.hull_area(np.array(points, float).reshape(-1, 2)) == area


def test_clahe_and_stretch_of_degenerate_patches():
    assert K.clahe(np.full((50, 50), 7, np.uint8)).shape == (50, 50)
    assert K.stretched(np.zeros((20, 20))).max() == 0
    assert (K.structural(np.zeros((32, 32))) == 0).all()


def test_hull_shares_meet_as_corners(spark):
    p = RNG.uniform(0, 100, (3000, 2))
    df = spark.createDataFrame([(1, *map(float, x)) for x in p], "g int, x double, y double")
    assert T.hull_shares(df, "x", "y", 10_000.0, ["g"]).first()["share"] == pytest.approx(K.hull_share(p, 10_000.0))


def test_deformed_grid_fit():
    yy, xx = np.mgrid[0:10, 0:10] * 1000 / 9.0
    s = np.column_stack([xx.ravel(), yy.ravel()])
    c, q = np.cos(0.02), np.sin(0.02)
    r = s @ np.array([[c, q], [-q, c]]) + [10, -5]
    r[:, 1] += 5e-5 * s[:, 1] ** 2
    r += 5 * np.exp(-((s - 500) ** 2).sum(1) / (2 * 150**2))[:, None] + RNG.normal(0, 0.1, s.shape)
    model = R.fit(np.column_stack([s, r]), (1000, 1000), R.RunConfig(ransac_threshold=5.0))
    assert model.spline_active and model.stats["rmse_final"] < 0.5
    assert np.abs(model.predict(s) - r).mean() < 1
    back = model.inverse()
    assert np.abs(back.predict(model.predict(s)) - s).mean() < 1.0
    again = R.Model.from_json(model.to_json())
    assert np.allclose(again.predict(s), model.predict(s))
    assert np.allclose(model.scaled(2.0).predict(2 * s, spline=False), 2 * model.predict(s, spline=False))


def test_fallbacks():
    drift = R.Coarse(3.0, -2.0, 0.5)
    none = np.zeros((0, 4))
    model = R.model_or_shift(none, none, drift, (100, 100), R.RunConfig())
    assert model.predict(np.array([[1.0, 1.0]])).tolist() == [[4.0, -1.0]]
    assert model.inverse().predict(np.array([[4.0, -1.0]])).tolist() == [[1.0, 1.0]]
    for bad in ({"poly_degree": 5}, {"wac_band": 0}, {"ransac_threshold": 0}, {"structural_method": "x"}):
        with pytest.raises(ValueError):
            R.RunConfig(**bad)


def test_registration_end_to_end(spark):
    base = K.gaussian(np.random.default_rng(0).normal(size=(420, 420)), 2)
    base = (base - base.min()) / np.ptp(base) * 200 + 30
    src, ref = base[20:380, 20:380].astype(np.uint8), base[17:377, 25:385].astype(np.uint8)
    out = R.register(T.tiles_of(spark, "a", src, 200), T.tiles_of(spark, "b", ref, 200), src.shape, ref.shape, R.RunConfig(tile_size=260, step_size=200))
    report = out.report.first()
    assert report["verdict"] == "VERIFIED_SUCCESS" and report["rmse"] < 0.2 and report["provenance"] == "tie_point_model_residuals"
    got = T.array_of(out.registered, *ref.shape)
    assert np.corrcoef(got[10:-10, 10:-10].ravel(), ref[10:-10, 10:-10].ravel())[0, 1] > 0.9


def test_no_points_no_numbers(spark):
    row = R.verify(spark, R.Model([[1, 0, 0], [0, 1, 0]]), (10, 10), R.RunConfig()).first()
    assert row["verdict"].startswith("UNCERTAIN") and row["rmse"] is None and row["provenance"] == "fallback_estimate"
