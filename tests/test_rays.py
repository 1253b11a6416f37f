"""Ground points against numpy, in gaps, at samples' times and beyond them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import rays as R

LEFT, RIGHT, AXES, MERIDIAN, RATE = (-0.05, 0.0, -1.0), (0.06, 0.01, -1.0), (1738.1, 1737.4, 1736.0), 0.3, 2.6e-3


def slerp(a, b, f):
    dot = a @ b
    b, dot = (b, dot) if dot >= 0 else (-b, -dot)
    angle = np.arccos(min(1.0, dot))
    v = (1 - f) * a + f * b if angle < 1e-8 else (np.sin((1 - f) * angle) * a + np.sin(f * angle) * b) / np.sin(angle)
    return v / np.linalg.norm(v)


def rotated(q, v):
    w, u = q[0], q[1:]
    return v + 2 * np.cross(u, np.cross(u, v) + w * v)


def bracket(times, t, gap):
    k = np.searchsorted(times, t, "right") - 1
    k = k - 1 if k == len(times) - 1 and t == times[-1] else k
    if 0 <= k < len(times) - 1 and times[k + 1] - times[k] <= gap:
        return k
    return k - 1 if k > 0 and t == times[k] and times[k] - times[k - 1] <= gap else None


def ground(att, pos, t, share, gap):
    k, m = bracket(att[:, 0], t, gap), bracket(pos[:, 0], t, gap)
    if k is None:
        return None, None, "no attitude"
    if m is None:
        return None, None, "no position"
    q = slerp(att[k, 1:], att[k + 1, 1:], (t - att[k, 0]) / (att[k + 1, 0] - att[k, 0]))
    span = pos[m + 1, 0] - pos[m, 0]
    f = (t - pos[m, 0]) / span
    p = (2 * f**3 - 3 * f**2 + 1) * pos[m, 1:4] + (f**3 - 2 * f**2 + f) * span * pos[m, 4:] + (3 * f**2 - 2 * f**3) * pos[m + 1, 1:4] + (f**3 - f**2) * span * pos[m + 1, 4:]
    look = np.array(LEFT) + (np.array(RIGHT) - LEFT) * share
    d, light = rotated(q, look / np.linalg.norm(look)), 0.0
    for step in range(4):
        a = MERIDIAN + RATE * (t - light)
        turn = np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
        u, v = turn @ p / AXES, turn @ d / AXES
        disc = (u @ v) ** 2 - (v @ v) * (u @ u - 1)
        if disc < 0 or -(u @ v) - np.sqrt(disc) <= 0:
            return None, None, "misses"
        far = (-(u @ v) - np.sqrt(disc)) / (v @ v)
        if step < 3:
            light = far / R.LIGHT
    g = turn @ p + far * (turn @ d)
    return np.degrees(np.arctan2(g[1], g[0])), np.degrees(np.arctan2(g[2], np.hypot(g[0], g[1]))), None


@pytest.fixture(scope="module")
def kernels():
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 20, 70))
    t = t[(t < 8) | (t > 10.5)]  # a gap
    q = np.column_stack([np.cos(0.02 * t), 0.01 * np.sin(t), np.sin(0.02 * t), 0.005 * t]) * rng.choice([-1, 1], len(t))[:, None]
    att = np.column_stack([t, q / np.linalg.norm(q, axis=1, keepdims=True)])
    s = np.arange(-1, 19, 0.7)
    pos = np.column_stack([s, 20 * np.sin(s / 9), 10 * s, 1840 + np.cos(s), 20 / 9 * np.cos(s / 9), 10 + 0 * s, -np.sin(s)])
    return att, pos


def frames(spark, att, pos):
    a = spark.createDataFrame([("x", *map(float, r)) for r in att] + [("y", 0.0, 1.0, 0.0, 0.0, 0.0)], "craft string, t double, w double, x double, y double, z double")
    p = spark.createDataFrame([("x", *map(float, r)) for r in pos], "craft string, t double, px double, py double, pz double, vx double, vy double, vz double")
    return a, p


def test_ground_points(spark, kernels):
    """Random times, times of samples, ends of coverage, gaps, a craft without kernels, null times, looks past the limb."""
    att, pos = kernels
    rng = np.random.default_rng(1)
    times = [*rng.uniform(-2, 21, 60), *att[:6, 0], att[-1, 0], *pos[[0, 3, -1], 0], 8.5, 9.9]
    rows = [("x", float(t), float(s), n) for n, t in enumerate(times) for s in (0.0, 0.37, 1.0)] + [("y", 0.0, 0.5, 900), ("z", 5.0, 0.5, 901), ("x", None, 0.5, 902), ("x", 5.0, 60.0, 903), ("x", 3.0, -60.0, 904)]
    a, p = frames(spark, att, pos)
    pixels = spark.createDataFrame(rows, "craft string, t double, share double, line int").withColumn("w", F.lit("own"))
    got = R.ground_points(pixels, a.repartition(3), p, LEFT, RIGHT, AXES, MERIDIAN, RATE, gap=1.0).collect()
    assert len(got) == len(rows) and {r["error"] for r in got} == {None, "no attitude", "no position", "misses"}
    for r in got:
        if r["craft"] != "x" or r["t"] is None:
            assert r["error"] == "no attitude" and r["lon"] is None
            continue
        lon, lat, error = ground(att, pos, r["t"], r["share"], 1.0)
        assert r["error"] == error and r["w"] == "own"
        if error is None:
            assert r["lon"] == pytest.approx(lon, abs=1e-9) and r["lat"] == pytest.approx(lat, abs=1e-9)


def test_a_gap_fails_a_strict_run(spark, kernels):
    a, p = frames(spark, *kernels)
    pixels = spark.createDataFrame([("x", 9.0, 0.5)], "craft string, t double, share double")
    with pytest.raises(Exception, match="no attitude at 9.0"):
        R.ground_points(pixels, a, p, LEFT, RIGHT, AXES, strict=True).collect()


def test_a_sphere_below(spark):
    """Straight down from above a point of a sphere that doesn't turn."""
    a = spark.createDataFrame([("x", t, 1.0, 0.0, 0.0, 0.0) for t in (0.0, 1.0)], "craft string, t double, w double, x double, y double, z double")
    p = spark.createDataFrame([("x", t, 0.0, 0.0, 2000.0, 0.0, 0.0, 0.0) for t in (0.0, 1.0)], "craft string, t double, px double, py double, pz double, vx double, vy double, vz double")
    pixels = spark.createDataFrame([("x", 0.5, 0.5)], "craft string, t double, share double")
    (r,) = R.ground_points(pixels, a, p, (-0.1, 0.0, -1.0), (0.1, 0.0, -1.0), (1737.4,) * 3).collect()
    assert r["lat"] == pytest.approx(90.0) and r["light_s"] == pytest.approx((2000 - 1737.4) / R.LIGHT)
