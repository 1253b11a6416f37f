"""RANSAC by rows where few points are copied many times, and where the best model's inliers are few in the sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import tiles


def test_hot_points_leave_hypotheses(spark):
    rng = np.random.default_rng(1)
    s = rng.uniform(0, 1000, (40, 2)).round(2)
    rows = [(float(x), float(y), float(x + 3), float(y - 2)) for x, y in s] + [(5.0, 5.0, 90.0, 90.0)]
    points = spark.createDataFrame(rows, "sx double, sy double, rx double, ry double").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2500))))
    model, ok = tiles.ransac_by_rows(points, 0.8)
    assert np.allclose(model, [[1, 0, 3], [0, 1, -2]], atol=1e-6) and ok.count() == 40 * 2500


def test_hot_groups_by_chunks(spark, monkeypatch):
    """A group that is dealt out in chunks keeps the members that it keeps in one task; small groups, null keys and groups of two points too."""
    rng = np.random.default_rng(2)
    rows = []
    for g, n in ((1, 900), (2, 60), (None, 300), (3, 2)):
        s = rng.uniform(0, 500, (n, 2))
        r = s @ np.array([[1.0, 0.02], [-0.02, 1.0]]) + [3 * (g or 5), -4]
        bad = rng.random(n) < 0.3
        r[bad] += rng.uniform(50, 90, (bad.sum(), 2))
        rows += [(g, k, *map(float, (*a, *b)), bool(x)) for k, (a, b, x) in enumerate(zip(s, r, bad))]
    points = spark.createDataFrame(rows, "g int, k int, sx double, sy double, rx double, ry double, bad boolean")
    want = {(g, k) for g, k, *_, bad in rows if not bad and g != 3}
    chunked = tiles.robust_by_rows(points.where("g is null or g <> 3"), "g", 0.5, hypotheses=50, chunk=100)
    assert {(x["g"], x["k"]) for x in chunked.collect()} == want
    assert {(x["g"], x["k"]) for x in tiles.robust_inliers(points, "g", 0.5, most=250).collect()} == want
    assert {(x["g"], x["k"]) for x in tiles.robust_inliers(points, "g", 0.5).collect()} == want


def test_no_model_without_points(spark):
    none = spark.createDataFrame([], "g int, sx double, sy double, rx double, ry double")
    assert tiles.ransac_by_rows(none, 1.0)[0] is None and tiles.robust_inliers(none, "g", 1.0).count() == 0
    same = spark.createDataFrame([(1, 5.0, 5.0, 6.0, 6.0)] * 50, "g int, sx double, sy double, rx double, ry double")
    assert tiles.ransac_by_rows(same, 1.0)[0] is None
