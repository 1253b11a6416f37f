from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.operators import tiles as T
from tessera.sources import diagnostics as D


def decoded(data):
    """A PNG of this package as an array."""
    h, w, kind = *reversed(struct.unpack(">II", data[16:24])), data[25]
    size = struct.unpack(">I", data[33:37])[0]
    raw = zlib.decompress(data[41 : 41 + size])
    n = 3 if kind == 2 else 1
    rows = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * n)[:, 1:]
    return rows.reshape(h, w, n) if n == 3 else rows


def test_lines_and_panels():
    a, b = np.full((4, 5), 9, np.uint8), np.full((6, 3), 7, np.uint8)
    both = D.beside(a, b)
    assert both.shape == (6, 8, 3) and both[3, 4, 0] == 9 and both[5, 7, 2] == 7 and both[5, 0].sum() == 0
    drawn = D.with_lines(both, np.array([[0, 0, 7, 0], [-5, 2, 2, 2], [0, 90, 1, 91]]))
    assert (drawn[0] == (0, 255, 0)).all() and (drawn[2, :3] == (0, 255, 0)).all() and drawn[1, 0, 0] == 9
    four = D.panels([a, b, a, b], 2)
    assert four.shape == (14, 12, 3) and (four[6:8] == 255).all() and four[0, 0, 0] == 9 and four[8, 7, 0] == 7


def test_heat_counts_points(spark):
    points = spark.createDataFrame([(0.0, 0.0, 5.0, 5.0)] * 4 + [(0.0, 0.0, 95.0, 5.0)] * 2 + [(0.0, 0.0, 95.0, 95.0)], "sx double, sy double, rx double, ry double")
    warm = D.heat(points, 100, 100, 2, 2, 3)
    assert warm.shape == (6, 6, 3) and warm[0, 0].tolist() == [255, 255, 0] and warm[0, 5].tolist() == [255, 0, 0] and warm[5, 0].tolist() == [0, 0, 0] and warm[5, 5].tolist() == [128, 0, 0]


def test_pictures_of_a_run(spark):
    image = np.random.default_rng(1).integers(30, 220, (90, 70)).astype(np.uint8)
    tiles = T.tiles_of(spark, "a", image, 40)
    points = spark.createDataFrame([(10.0 * k, 8.0 * k, 10.0 * k, 8.0 * k) for k in range(7)], "sx double, sy double, rx double, ry double")
    made = {n: decoded(p) for n, p in D.pictures(tiles, tiles, points, (90, 70)).items()}
    assert made["overview_side_by_side.png"].shape == (90, 140, 3) and (made["difference_heatmap.png"] == 0).all()
    assert (made["overview_false_color.png"].std(axis=2) == 0).all() and (made["matches.png"] == (0, 255, 0)).all(2).sum() > 200
    small, k = D.preview(tiles, 90, 70, 30)
    assert k == 3 and small.shape == (30, 24)
