"""Tiled and striped GeoTIFF as a Spark data source, both ways.

Reading plans partitions from the directory: runs of neighbouring chunks of some bytes, only those that a window touches, each read
by byte ranges. Writing gives every tile a place of its own that its largest code fits into, so tasks write codes into one file
without waiting for each other or passing anything through the driver; the commit adds the directory and renames the file, and an
abort leaves none. Gaps take no disk on file systems with sparse files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.operators.tiles import TILE, pixels_of
from tessera.sources import tiffs as X

BANDED = TILE + ", band int"
COMPRESSIONS = {"none": X.NONE, "lzw": X.LZW, "deflate": X.DEFLATE}
#: Bytes of codes that a partition reads, about.
PART_BYTES = 16 << 20


def _reading(path: str):
    """(file, read(offset, length)) of a path in any store that pyarrow opens."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    f = store.open_input_file(at)
    return f, lambda offset, length: f.read_at(length, offset)


def layout_of(path: str) -> X.Layout:
    f, read = _reading(path)
    with f:
        return X.read_layout(read)


class _Chunks(InputPartition):
    def __init__(self, indices: list[int]):
        super().__init__(indices)
        self.indices = indices


class _Reader(DataSourceReader):
    """Options: path, image_id, band (from 1; or "all", a row for each band), row_off, col_off, height and width of a window,
    partition_bytes. Chunks that were never written are rows of nodata, or zeros."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.image = options.get("image_id") or self.path.rstrip("/").rsplit("/", 1)[-1]
        self.layout = layout_of(self.path)
        asked = str(options.get("band", "1"))
        self.bands = list(range(self.layout.bands)) if asked == "all" else [int(asked) - 1]
        if not all(0 <= b < self.layout.bands for b in self.bands):
            raise ValueError(f"band {asked} of {self.layout.bands}")
        y, x = int(options.get("row_off", 0)), int(options.get("col_off", 0))
        self.window = y, x, y + int(options.get("height", self.layout.height)), x + int(options.get("width", self.layout.width))
        self.most = int(options.get("partition_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        a, (rows, cols) = self.layout, self.layout.grid
        y0, x0, y1, x1 = self.window
        ys = np.arange(max(0, y0 // a.chunk_h), min(rows, -(-y1 // a.chunk_h)))
        xs = np.arange(max(0, x0 // a.chunk_w), min(cols, -(-x1 // a.chunk_w)))
        plane = (ys[:, None] * cols + xs[None, :]).ravel()
        at = np.concatenate([b * rows * cols + plane for b in (self.bands if a.planar else [0])]) if len(plane) else plane
        part = (np.cumsum(a.counts[at]) - a.counts[at]) // self.most if len(at) else at
        return [_Chunks(at[part == k].tolist()) for k in np.unique(part)] or [_Chunks([])]

    def read(self, part: _Chunks) -> Iterator[tuple]:
        a, (rows, cols) = self.layout, self.layout.grid
        f, read = _reading(self.path)
        with f:
            for k in part.indices:
                plane, place = divmod(k, rows * cols)
                y, x = place // cols * a.chunk_h, place % cols * a.chunk_w
                h, w = min(a.chunk_h, a.height - y), min(a.chunk_w, a.width - x)
                if a.counts[k]:
                    pixels = X.decoded(read(int(a.offsets[k]), int(a.counts[k])), a)[:h, :w]
                    if pixels.shape[0] < h:
                        raise ValueError(f"{self.path}: chunk {k} has {pixels.shape[0]} rows of {h}")
                else:
                    pixels = np.full((h, w, 1 if a.planar else a.bands), a.nodata or 0, np.dtype(a.dtype).newbyteorder("="))
                for band in [plane] if a.planar else self.bands:
                    own = np.ascontiguousarray(pixels[..., 0 if a.planar else band])
                    yield (self.image, y, x, h, w, own.dtype.str, own.tobytes(), band + 1)


@dataclass
class _Written(WriterCommitMessage):
    index: list[int]
    offset: list[int]
    count: list[int]


def _local(path: str) -> str:
    """The path in a file system with writes at any place; object stores and HDFS have none."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: one file written by many tasks needs a shared file system that takes writes at any place; write tiles as a table there")
    return unquote(url.path) if url.scheme else path


class _Writer(DataSourceArrowWriter):
    """Rows (row_off, col_off, h, w, dtype, px[, band]) of whole tiles; options as write_geotiff has them."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        import uuid

        o = options
        self.path, self.overwrite, self.names = _local(o["path"]), overwrite, names
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.height, self.width, self.bands, self.tile = (int(o[k]) for k in ("height", "width", "bands", "tile"))
        self.dtype, self.compression, self.predictor = np.dtype(o["dtype"]), COMPRESSIONS[o["compression"]], int(o["predictor"])
        self.nodata = float(o["nodata"]) if "nodata" in o else None
        self.geotransform = tuple(float(v) for v in o["geotransform"].split(",")) if "geotransform" in o else None
        self.radius = float(o["radius"]) if "radius" in o else None
        self.cols = -(-self.width // self.tile)
        self.tiles = -(-self.height // self.tile) * self.cols
        self.slot = X.most_bytes(self.tile * self.tile * self.dtype.itemsize, self.compression)
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, at = _Written([], [], []), {n: k for k, n in enumerate(self.names)}
        os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        # Opened by all tasks, truncated by none. Another attempt writes the same bytes to the same places.
        f = os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    row = {n: r[batch.schema.names[k]] for n, k in at.items()}
                    index = self._index(row)
                    a = np.full((self.tile, self.tile), self.nodata or 0, self.dtype)
                    a[: row["h"], : row["w"]] = pixels_of(row["h"], row["w"], row["dtype"], row["px"])
                    code = X.encoded(a, self.compression, self.predictor)
                    os.pwrite(f, code, 16 + index * self.slot)
                    done.index.append(index)
                    done.offset.append(16 + index * self.slot)
                    done.count.append(len(code))
            os.fsync(f)
        finally:
            os.close(f)
        return done

    def _index(self, row: dict) -> int:
        y, x, h, w, band = row["row_off"], row["col_off"], row["h"], row["w"], row.get("band") or 1
        whole = y % self.tile == 0 and x % self.tile == 0 and h == min(self.tile, self.height - y) and w == min(self.tile, self.width - x)
        if not whole or not 1 <= band <= self.bands:
            raise ValueError(f"({y}, {x}) of {h} x {w} in band {band} is no tile of {self.tile} in {self.height} x {self.width} x {self.bands}")
        if np.dtype(row["dtype"]) != self.dtype:
            raise ValueError(f"pixels of {row['dtype']} in a file of {self.dtype.str}")
        return (band - 1) * self.tiles + y // self.tile * self.cols + x // self.tile

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """16 bytes a tile come here. A tile that nobody wrote has length 0; one that two rows wrote is an error."""
        offsets, counts = np.zeros(self.bands * self.tiles, np.int64), np.zeros(self.bands * self.tiles, np.int64)
        seen = np.zeros(self.bands * self.tiles, np.int64)
        for m in messages:
            if m is not None and m.index:
                offsets[m.index], counts[m.index] = m.offset, m.count
                np.add.at(seen, m.index, 1)
        if (seen > 1).any():
            self.abort(messages)
            raise ValueError(f"tile {int(np.argmax(seen))} was written {int(seen.max())} times")
        os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        end = 16 + self.bands * self.tiles * self.slot
        end += -end % 8
        f = os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            os.pwrite(f, X.directory(end, self.height, self.width, self.bands, self.dtype, self.tile, self.compression, self.predictor, offsets, counts, self.nodata, self.geotransform, self.radius), end)
            os.pwrite(f, X.header(end), 0)
            os.fsync(f)
        finally:
            os.close(f)
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        os.replace(self.part, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class GeoTiff(DataSource):
    """format("geotiff"): see _Reader and write_geotiff for the options."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return BANDED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, list(schema.names), overwrite)


def read_geotiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, band: int | str = 1, image_id: str | None = None, **options) -> DataFrame:
    """Tiles of a GeoTIFF, with their band; those that a window (row, column, height, width) touches, and no bytes of others."""
    spark.dataSource.register(GeoTiff)
    named = {} if window is None else dict(zip(("row_off", "col_off", "height", "width"), window, strict=True))
    more = named | {"band": band} | ({"image_id": image_id} if image_id else {}) | options
    return spark.read.format("geotiff").options(path=path, **{k: str(v) for k, v in more.items()}).load()


def retiled(tiles: DataFrame, tile: int, height: int, width: int, fill: float = 0) -> DataFrame:
    """Tiles or blocks of any cut as tiles of one size: a block is cut where the grid's lines cross it, before anything is shuffled, and
    pieces meet by tile. What no block covers within a tile that some block touches is fill; where blocks overlap, the one that begins
    further down and right wins."""
    banded = tiles if "band" in tiles.columns else tiles.withColumn("band", F.lit(1))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                a = pixels_of(t.h, t.w, t.dtype, t.px)
                y1, x1 = min(t.row_off + t.h, height), min(t.col_off + t.w, width)
                for gy in range(max(0, t.row_off) // tile, -(-y1 // tile)):
                    for gx in range(max(0, t.col_off) // tile, -(-x1 // tile)):
                        y, x = max(t.row_off, gy * tile), max(t.col_off, gx * tile)
                        piece = np.ascontiguousarray(a[y - t.row_off : min(y1, (gy + 1) * tile) - t.row_off, x - t.col_off : min(x1, (gx + 1) * tile) - t.col_off])
                        if piece.size:
                            out.append((t.band, gy, gx, t.row_off, t.col_off, y, x, *piece.shape, piece.dtype.str, piece.tobytes()))
            yield pd.DataFrame(out, columns=["band", "gy", "gx", "top", "left", "y", "x", "h", "w", "dtype", "px"])

    def pasted(pdf: pd.DataFrame) -> pd.DataFrame:
        gy, gx, band = (int(pdf[c].iloc[0]) for c in ("gy", "gx", "band"))
        out = np.full((min(tile, height - gy * tile), min(tile, width - gx * tile)), fill, pdf["dtype"].iloc[0])
        for p in pdf.sort_values(["top", "left"]).itertuples(index=False):
            y, x = p.y - gy * tile, p.x - gx * tile
            out[y : y + p.h, x : x + p.w] = pixels_of(p.h, p.w, p.dtype, p.px)
        return pd.DataFrame({"row_off": [gy * tile], "col_off": [gx * tile], "h": [out.shape[0]], "w": [out.shape[1]], "dtype": [out.dtype.str], "px": [out.tobytes()], "band": [band]})

    pieces = banded.select("row_off", "col_off", "h", "w", "dtype", "px", "band").mapInPandas(cut, "band int, gy int, gx int, top int, left int, y int, x int, h int, w int, dtype string, px binary")
    return pieces.groupBy("band", "gy", "gx").applyInPandas(pasted, "row_off int, col_off int, h int, w int, dtype string, px binary, band int")


def write_geotiff(
    tiles: DataFrame, path: str, height: int, width: int, dtype: str = "|u1", bands: int = 1, tile: int = 256, compression: str = "deflate", predictor: int = 1,
    nodata: float | None = None, geotransform: X.Geotransform | None = None, radius: float | None = None, overwrite: bool = True,
) -> None:
    """One tiled file of blocks of any cut, written by the tasks that have them (see _Writer). compression: deflate, lzw or none;
    predictor: 1, or 2 for differences of whole numbers along rows; radius: of the sphere of an equirectangular reference system.
    Tiles without any block are left out of the file and read as nodata. A run that fails leaves the file as it was, or none."""
    if compression not in COMPRESSIONS or predictor not in (1, 2) or predictor == 2 and np.dtype(dtype).kind == "f" or tile % 16:
        raise ValueError(f"{compression}, predictor {predictor} for {dtype}, tiles of {tile}: tiles are of multiples of 16, predictor 2 is for whole numbers")
    tiles.sparkSession.dataSource.register(GeoTiff)
    more = {"nodata": nodata, "radius": radius, "geotransform": None if geotransform is None else ",".join(repr(float(v)) for v in geotransform)}
    options = {"path": path, "height": height, "width": width, "dtype": np.dtype(dtype).str, "bands": bands, "tile": tile, "compression": compression, "predictor": predictor} | {k: v for k, v in more.items() if v is not None}
    rows = retiled(tiles, tile, height, width, nodata or 0)
    rows.write.format("geotiff").options(**{k: str(v) for k, v in options.items()}).mode("overwrite" if overwrite else "append").save()


def write_window(tiles: DataFrame, path: str, window: tuple[int, int, int, int], dtype: str = "|u1", nodata: float | None = 0, geotransform: X.Geotransform | None = None, **options) -> None:
    """A window (row, column, height, width) of a raster as a file of its own, LZW-coded and without a reference system unless options say
    otherwise; geotransform is the whole raster's, and is moved to the window's corner."""
    y, x, height, width = window
    inside = tiles.where((F.col("row_off") < y + height) & (F.col("row_off") + F.col("h") > y) & (F.col("col_off") < x + width) & (F.col("col_off") + F.col("w") > x))
    moved = inside.withColumns({"row_off": F.col("row_off") - y, "col_off": F.col("col_off") - x})
    g = geotransform
    at = None if g is None else (g[0] + x * g[1] + y * g[2], g[1], g[2], g[3] + x * g[4] + y * g[5], g[4], g[5])
    write_geotiff(moved, path, height, width, dtype, **({"compression": "lzw", "nodata": nodata, "geotransform": at} | options))


#: What `described` says of a file.
DESCRIBED = "path string, height int, width int, bands int, dtype string, chunk_h int, chunk_w int, chunks long, compression int, nodata double, projected boolean, geotransform array<double>, error string"


def described(files: DataFrame, path: str = "path") -> DataFrame:
    """A row for each file (DESCRIBED), its directory read by a task; error says why a file could not be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf[path]:
                try:
                    a = layout_of(p)
                    out.append((p, a.height, a.width, a.bands, a.dtype, a.chunk_h, a.chunk_w, len(a.offsets), a.compression, a.nodata, a.projected, None if a.geotransform is None else list(a.geotransform), None))
                except (OSError, ValueError, TypeError, KeyError) as e:
                    out.append((p, *[None] * 11, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DESCRIBED.split(", ")]).astype(object)

    return files.select(path).mapInPandas(run, DESCRIBED)
