from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels as K
from tessera.operators import georeference as G
from tessera.operators import tiles as T
from tessera.streaming import telemetry

PER = 180 / np.pi / 1_737_400.0


def points(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "col double, row double, lon double, lat double")


@pytest.mark.parametrize("n", [2, 3])
def test_control_points_map_pixels(spark, n):
    image = np.random.default_rng(0).integers(1, 255, (60, 80)).astype(np.uint8)
    tiles = T.tiles_of(spark, "a", image, 32)
    gcps = points(spark, [(x, y, x * PER, -y * PER) for x in np.linspace(0, 80, n) for y in np.linspace(0, 60, n)])
    got = T.array_of(G.by_control_points(tiles, gcps, G.Grid(0.0, 0.0, 1.0, 80, 60), block=40), 60, 80)
    assert (got[1:-1, 1:-1] == image[1:-1, 1:-1]).mean() > 0.99


def test_control_points_must_fix_a_map(spark):
    tiles = T.tiles_of(spark, "a", np.ones((8, 8), np.uint8))
    for rows in ([(0, 0, 0, 0)], [(k, k, k * PER, -k * PER) for k in range(4)]):
        with pytest.raises(ValueError):
            G.by_control_points(tiles, points(spark, rows), G.Grid(0, 0, 1, 8, 8))


def test_average_of_blocks(spark):
    image = np.kron(np.arange(1, 26).reshape(5, 5) * 10, np.ones((4, 4))).astype(np.uint8)
    out = G.harmonised(T.tiles_of(spark, "a", image, 7), (1.0, 0.0, -1.0, 20.0), G.Grid(0.0, 20.0, 4.0, 5, 5), "average")
    assert (T.array_of(out, 5, 5) == np.arange(1, 26).reshape(5, 5) * 10).all()
    assert G.common_grid((0, 0, 100, 51), 10.0) == G.Grid(0, 51, 10.0, 10, 5) and G.orientation() == "normal"


def test_thumbnail(spark):
    rng = np.random.default_rng(1)
    s = rng.uniform(0, 250, (40, 2))
    r = s + np.column_stack([5 + 0.05 * s[:, 1], np.full(40, -3.0)])
    r[:6] += 90
    frame = lambda rows: spark.createDataFrame(rows.tolist(), "sx double, sy double, rx double, ry double, score double")
    t = G.thumbnail_drift(frame(np.column_stack([s, r, np.full(40, 0.5)])), 0.25, 1000)
    assert t.inliers == 34 and t.dx == pytest.approx(20, abs=0.5) and t.dy == pytest.approx(-12, abs=0.5) and t.slope[0] == pytest.approx(0.05, abs=0.01)
    assert G.thumbnail_accepted(t, 20_000) and not G.thumbnail_accepted(t, 20_000, "fft") and not G.thumbnail_accepted(None, 10)
    assert G.thumbnail_drift(frame(np.column_stack([s, r, np.full(40, 0.1)])), 0.25, 1000) is None
    assert G.thumbnail_drift(frame(np.column_stack([s, r, np.full(40, 0.5)])[:4]), 0.25, 1000) is None
    assert G.anchor(2.0, 4.0, 0.05, 0.5) == (4.0, 8.0) and G.anchor(2.0, 4.0, 0.01, 0.5) == (0.0, 0.0)


def test_traps_are_rejected(spark):
    got = {r["trap"]: r for r in G.judged_traps(spark).collect()}
    assert set(got) == set(G.TRAPS) and all(r["verdict"].startswith("REJECTED") for r in got.values())
    assert got["twin_craters"]["entropy"] == pytest.approx(2.0, abs=0.1) and got["clustered_boulders"]["entropy"] == 0


def test_global_inliers(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 900, (200, 2))
    r = K.applied(np.array([[1, 0.01, 4], [-0.01, 1, 2]]), s)
    r[:50] += 200
    df = spark.createDataFrame(np.column_stack([s, r]).tolist(), "sx double, sy double, rx double, ry double")
    assert G.global_inliers(df, 900, 1.2).count() == 150


def test_events_are_appended(spark, tmp_path):
    for k in range(2):
        telemetry.emit(spark, f"{tmp_path}/events", 7, k, f"stage {k}")
    rows = spark.read.parquet(f"{tmp_path}/events").orderBy("event_id").collect()
    assert [r["progress_pct"] for r in rows] == [5, 18]
    telemetry.emit(spark, "no-such-scheme://x", 7, 0, "lost")


def test_lanczos_of_a_window_is_that_of_the_whole(spark):
    import numpy as np

    from tessera.functions import kernels as K

    y, x = np.mgrid[0:60:7j, 0:50:9j]
    flat, wave = np.full((70, 64), 5.0), np.add.outer(np.sin(np.arange(70) / 6), np.cos(np.arange(64) / 5))
    assert np.allclose(K.lanczos(flat, y, x, 2.5), 5.0)
    assert np.abs(K.lanczos(wave, y, x) - (np.sin(y / 6) + np.cos(x / 5)))[1:-1, 1:-1].max() < 5e-3
    assert np.allclose(K.lanczos(wave, *np.mgrid[3:9, 4:8].astype(float)), wave[3:9, 4:8])
    assert K.lanczos(wave, np.array([-0.6]), np.array([0.0])).tolist() == [0.0]
    stripes = np.tile([0.0, 10.0], (40, 20))  # finer than the new pixel: averaged away
    assert np.abs(K.lanczos(stripes, *np.mgrid[10:30:4, 10:30:4].astype(float) + 0.5, 4.0) - 5).max() < 0.1


def test_corners_alone(spark):
    import numpy as np

    from tessera.operators import georeference as G
    from tessera.operators import tiles as T

    per = 180 / np.pi / 1_737_400.0
    a = np.arange(20 * 30, dtype=np.uint8).reshape(20, 30)
    names = [f"{k}_{v}" for k in ("ul", "ur", "ll", "lr") for v in ("lat", "lon")]
    corners = [0.0, 0.0, 0.0, 30 * per, -20 * per, 0.0, -20 * per, 30 * per]
    schema = "width int, height int, " + ", ".join(f"{n} double" for n in names)
    tiles, grid = T.tiles_of(spark, "a", a, 16), G.Grid(0.0, 0.0, 1.0, 30, 20)
    assert (T.array_of(G.by_corners(tiles, spark.createDataFrame([(30, 20, *corners)], schema), grid), 20, 30) == a).all()
    assert G.by_corners(tiles, spark.createDataFrame([(30, 20, None, *corners[1:])], schema), grid) is None
    assert G.by_corners(tiles, spark.createDataFrame([], schema), grid) is None


def test_coverage_and_crop(spark):
    from pyspark.sql import functions as F

    from tessera.operators import points as P
    from tessera.operators import rasters as R
    from tessera.operators import tiles as T

    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 0.0), (1, 0.0, 20.0), (2, 5.0, 5.0)], "g int, sx double, sy double").withColumn("height", F.lit(40))
    got = {r["g"]: (r["hull_pct"], r["span_pct"]) for r in P.image_coverage(points, T.hull_shares(points, "sx", "sy", 400.0, ["g"]), F.col("height"), ["g"]).collect()}
    assert got == {1: (25.0, 50.0), 2: (0.0, 0.0)}
    px = spark.range(35).selectExpr("cast(id / 7 as int) as row", "cast(id % 7 as int) as col", "id as v")
    assert sorted(map(tuple, R.centre_crop(px, 3, 5, 7).collect())) == [(i, j, (i + 1) * 7 + j + 2) for i in range(3) for j in range(3)]
    assert R.centre_crop(px, 99, 5, 7).count() == 35
