"""Circles of whole rasters: what is written, and what a task reads of it, is edge pixels; neither pixels nor votes are rows."""

from __future__ import annotations

import numpy as np

from tessera.functions import kernels as K
from tessera.operators import circles as C
from tessera.operators import tiles as T


def rings():
    yy, xx = np.mgrid[0:300, 0:340]
    image = np.zeros((300, 340))
    for y, x, r in ((128, 128, 30), (60, 250, 18), (230, 60, 22), (220, 256, 26), (250, 180, 16), (40, 60, 16)):
        image[np.abs(np.hypot(xx - x, yy - y) - r) < 2] = 200.0
    return image


def test_no_table_holds_pixels_or_votes(spark, monkeypatch):
    held = {}

    def noted(df, name, *rest):
        out = written(df, name, *rest)
        values = [sum(len(v) for v in r if isinstance(v, (bytes, bytearray))) for r in out.collect()]
        held.setdefault(name, []).append((len(values), max(values, default=0), sum(values)))
        return out

    written = C.written
    monkeypatch.setattr(C, "written", noted)
    image = rings()
    want = sorted((int(x), int(y), int(r)) for x, y, r in K.circles(image, 15, 36, 25))
    got = C.circles(T.tiles_of(spark, "a", image, 128), 15, 36, 25, size=256)
    assert sorted((r["cx"], r["cy"], r["r"]) for r in got.collect()) == want and len(want) == 6
    for name, tables in held.items():
        for rows, largest, total in tables:
            assert rows < image.size // 100 and largest <= 4096 * 24 and total < image.nbytes // 2, name


def test_edges_in_many_rows_and_batches(spark, monkeypatch):
    """A tile's edge pixels fill many rows, and cells' rows many batches; no pixel is lost, whatever the cut."""
    image = np.clip(K.gaussian(np.random.default_rng(3).normal(size=(210, 190)), 2.0) * 50, 0, None)
    tiles = T.tiles_of(spark, "a", image, 100)

    def found(size):
        return sorted((r["r"], r["cy"], r["cx"], round(r["score"], 9)) for r in C.centres(C.edges(tiles, size=size), range(5, 16, 2), 20, size).collect())

    want = found(512)
    assert len(want) > 20
    monkeypatch.setattr(C, "_ROW_EDGES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for size in (64, 512):
            assert found(size) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_raster_with_a_blank_spot(spark):
    """As the kernel has it, a raster with a pixel that is no number has no circles, whichever tile that is in; others have theirs."""
    image = rings()
    tiles = T.tiles_of(spark, "whole", image, 128)
    image[290:, 300:] = np.nan
    got = C.circles(tiles.unionByName(T.tiles_of(spark, "blank", image, 128)), 15, 36, 25, size=128).collect()
    assert len(K.circles(image, 15, 36, 25)) == 0
    assert sorted(r["image_id"] for r in got) == ["whole"] * 6
