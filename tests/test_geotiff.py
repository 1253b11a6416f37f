"""GeoTIFF files: codecs, hand-made files of other writers' layouts, round trips through Spark, windows, failures."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import tiles as T
from tessera.sources import geotiff as G
from tessera.sources import tiffs as X
from tessera.sources.raw import load_raster


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"a", b"ab", b"\0" * 50]), max_size=400).map(b"".join)))
def test_lzw_round_trip(data):
    code = X.lzw_encoded(data)
    assert X.lzw_decoded(code) == data and len(code) <= X.most_bytes(len(data), X.LZW)


def test_lzw_long_and_known():
    data = np.random.default_rng(0).integers(0, 200, 70_000, dtype=np.uint8).tobytes()  # the table fills many times
    assert X.lzw_decoded(X.lzw_encoded(data)) == data
    # The format's own example: codes 256 7 258 8 8 258 6 6 257 of 9 bits.
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert X.lzw_decoded(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and X.lzw_encoded(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


def _strips(path, a, order, rows, compression, predictor, encode):
    """A classic file in strips, pixels of all bands side by side."""
    h, w, bands = a.shape
    raw, offsets, counts = b"", [], []
    for y in range(0, h, rows):
        code = encode(a[y : y + rows])
        offsets.append(8 + len(raw))
        counts.append(len(code))
        raw += code
    raw += b"\0" * (len(raw) % 2)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags, at = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * a.itemsize] * bands), (259, 3, [compression]), (262, 3, [1]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [rows]), (279, 4, counts), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [kind] * bands)], 8 + len(raw)
    rest, entries, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, form, values in tags:
        data = struct.pack(f"{order}{len(values)}{'H' if form == 3 else 'I'}", *values)
        if len(data) > 4:
            where, rest = struct.pack(order + "I", free + len(rest)), rest + data + b"\0" * (len(data) % 2)
        else:
            where = data.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, form, len(values)) + where
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + raw + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + rest)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [X.NONE, X.LZW, X.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_of_others(spark, tmp_path, order, compression, predictor):
    """Strips, either byte order, bands side by side, the last strip short."""
    a = np.random.default_rng(1).integers(-500, 500, (37, 21, 3)).astype("i2")

    def encode(part):
        d = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1) if predictor == 2 else part
        data = d.astype(np.dtype("i2").newbyteorder(order)).tobytes()
        return {X.NONE: bytes, X.LZW: X.lzw_encoded, X.DEFLATE: zlib.compress}[compression](data)

    _strips(tmp_path / "a.tif", a, order, 8, compression, predictor, encode)
    read = G.read_geotiff(spark, str(tmp_path / "a.tif"), band="all")
    for band in (1, 2, 3):
        assert (T.array_of(read.where(F.col("band") == band), 37, 21) == a[..., band - 1]).all()
    assert (T.array_of(load_raster(spark, str(tmp_path / "a.tif")), 37, 21) == a[..., 0]).all()


def test_floating_predictor(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(20, 15, 1)).astype("f4")

    def encode(part):
        planes = np.frombuffer(part.astype(">f4").tobytes(), np.uint8).reshape(part.shape[0], 15, 4).swapaxes(1, 2).reshape(part.shape[0], 60)
        return zlib.compress(np.concatenate([planes[:, :1], np.diff(planes, axis=1)], 1).astype(np.uint8).tobytes())

    _strips(tmp_path / "f.tif", a, "<", 6, X.DEFLATE, 3, encode)
    assert (T.array_of(G.read_geotiff(spark, str(tmp_path / "f.tif")), 20, 15) == a[..., 0]).all()


@pytest.mark.parametrize("compression,predictor,dtype", [("deflate", 1, "<f8"), ("deflate", 2, "<u2"), ("lzw", 2, "|u1"), ("none", 1, "<i4")])
def test_round_trip(spark, tmp_path, compression, predictor, dtype):
    """Blocks of a cut that isn't the file's; tags; a whole file beside nothing else."""
    a = np.random.default_rng(3).integers(0, 250, (150, 130)).astype(dtype)
    path, g = str(tmp_path / "w.tif"), (100.5, 2.0, 0.0, 50.25, 0.0, -2.0)
    G.write_geotiff(T.tiles_of(spark, "x", a, 57), path, 150, 130, dtype, tile=64, compression=compression, predictor=predictor, nodata=0, geotransform=g, radius=1737400.0)
    layout = G.layout_of(path)
    assert (layout.chunk_h, layout.grid, layout.nodata, layout.geotransform, layout.projected) == (64, (3, 3), 0.0, g, True)
    assert layout.keys[X.RADIUS_A] == 1737400.0 and layout.keys[X.PROJECTION] == X.EQUIRECTANGULAR
    assert (T.array_of(G.read_geotiff(spark, path), 150, 130) == a).all() and os.listdir(tmp_path) == ["w.tif"]


def test_bands_gaps_and_rotation(spark, tmp_path):
    """Bands in planes of their own, a tile that nobody has, a rotated place, an older file replaced."""
    a = np.random.default_rng(4).integers(1, 255, (3, 70, 70), dtype=np.uint8)
    path, g = str(tmp_path / "rgb.tif"), (10.0, 1.5, 0.5, 20.0, 0.25, -1.5)
    bands = T.tiles_of(spark, "x", a[0], 32).withColumn("band", F.lit(1))
    for k in (1, 2):
        bands = bands.unionByName(T.tiles_of(spark, "x", a[k], 32).withColumn("band", F.lit(k + 1)))
    for _ in range(2):
        G.write_geotiff(bands.where("not (band = 2 and row_off = 32 and col_off = 32)"), path, 70, 70, bands=3, tile=32, nodata=7, geotransform=g)
    assert G.layout_of(path).geotransform == g and not G.layout_of(path).projected
    a[1, 32:64, 32:64] = 7
    read = G.read_geotiff(spark, path, band="all")
    for k in range(3):
        assert (T.array_of(read.where(F.col("band") == k + 1), 70, 70) == a[k]).all()


def test_a_window_reads_its_tiles_only(spark, tmp_path):
    path = str(tmp_path / "w.tif")
    G.write_geotiff(T.tiles_of(spark, "x", np.arange(200 * 160, dtype="<u4").reshape(200, 160), 50), path, 200, 160, "<u4", tile=32)
    reader = G._Reader({"path": path, "row_off": "40", "col_off": "70", "height": "60", "width": "20", "partition_bytes": "1"})
    parts = reader.partitions()
    assert [p.indices for p in parts] == [[7], [12], [17]]
    assert {(t[1], t[2]) for p in parts for t in reader.read(p)} == {(32, 64), (64, 64), (96, 64)}
    # Bytes of other tiles may be anything.
    data, layout = bytearray(open(path, "rb").read()), G.layout_of(path)
    for k in set(range(len(layout.offsets))) - {7, 12, 17}:
        data[layout.offsets[k] : layout.offsets[k] + layout.counts[k]] = b"\xff" * int(layout.counts[k])
    open(path, "wb").write(data)
    assert G.read_geotiff(spark, path, (40, 70, 60, 20)).count() == 3
    assert G.read_geotiff(spark, path, (500, 500, 5, 5)).count() == 0


def test_failures_leave_no_file(spark, tmp_path):
    a = np.ones((64, 64), np.uint8)
    path, tiles = str(tmp_path / "x.tif"), T.tiles_of(spark, "x", a, 32)
    bad = tiles.withColumn("dtype", F.when(F.col("row_off") == 32, "<u2").otherwise(F.col("dtype"))).withColumn("px", F.when(F.col("row_off") == 32, F.concat("px", "px")).otherwise(F.col("px")))
    with pytest.raises(Exception, match="pixels of"):
        G.write_geotiff(bad, path, 64, 64, tile=32)
    assert os.listdir(tmp_path) == []
    spark.dataSource.register(G.GeoTiff)
    options = {"path": path, "height": 64, "width": 64, "dtype": "|u1", "bands": 1, "tile": 32, "compression": "none", "predictor": 1}
    with pytest.raises(Exception, match="written 2 times"):
        tiles.unionByName(tiles.limit(1)).write.format("geotiff").options(**options).mode("overwrite").save()
    assert os.listdir(tmp_path) == []
    G.write_geotiff(tiles, path, 64, 64, tile=32)
    with pytest.raises(Exception, match="x.tif"):
        G.write_geotiff(tiles, path, 64, 64, tile=32, overwrite=False)
    assert os.listdir(tmp_path) == ["x.tif"]
    with pytest.raises(ValueError):
        G.write_geotiff(tiles, path, 64, 64, tile=33)
    with pytest.raises(ValueError, match="shared file system"):
        G._local("s3://bucket/x.tif")


def test_described(spark, tmp_path):
    path = str(tmp_path / "x.tif")
    G.write_geotiff(T.tiles_of(spark, "x", np.ones((40, 50), np.uint8), 32), path, 40, 50, tile=32, geotransform=(1.0, 2.0, 0.0, 3.0, 0.0, -2.0))
    (tmp_path / "no.tif").write_bytes(b"nothing")
    files = spark.createDataFrame([(path,), (str(tmp_path / "no.tif"),), (str(tmp_path / "gone.tif"),)], "path string")
    rows = {os.path.basename(r["path"]): r for r in G.described(files).collect()}
    assert (rows["x.tif"]["height"], rows["x.tif"]["chunks"], rows["x.tif"]["geotransform"], rows["x.tif"]["error"]) == (40, 4, [1.0, 2.0, 0.0, 3.0, 0.0, -2.0], None)
    assert rows["no.tif"]["error"].startswith("ValueError") and rows["gone.tif"]["error"] and rows["gone.tif"]["height"] is None
