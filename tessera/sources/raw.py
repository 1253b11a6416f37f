"""Raw rasters as a Spark data source: a label's dimensions, offset and pixel type say where rows lie in a file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.tiles import TILE


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        super().__init__((path, first, n))
        self.path, self.first, self.n = path, first, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.image = json.loads(options["paths"]) if "paths" in options else [options["path"]], options.get("image_id")
        self.lines, self.samples, self.offset = (int(options.get(k, 0)) for k in ("lines", "samples", "offset"))
        self.dtype, self.block = np.dtype(options.get("pixel_type", "u1")), int(options.get("block_rows", 512))
        if self.lines <= 0 or self.samples <= 0:
            raise ValueError("lines and samples must be given")

    def partitions(self) -> list[InputPartition]:
        return [_Rows(p, y, min(self.block, self.lines - y)) for p in self.paths for y in range(0, self.lines, self.block)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(part.path) if "://" in part.path else (fs.LocalFileSystem(), part.path)
        row = self.samples * self.dtype.itemsize
        with store.open_input_file(path) as f:
            data = f.read_at(part.n * row, self.offset + part.first * row)
        if len(data) < part.n * row:
            raise ValueError(f"{part.path} is too short: {len(data)} bytes instead of {part.n * row} from row {part.first}")
        a = np.frombuffer(data, self.dtype).reshape(part.n, self.samples)
        for x in range(0, self.samples, self.block):
            t = np.ascontiguousarray(a[:, x : x + self.block])
            yield (self.image or part.path.rsplit("/", 1)[-1], part.first, x, t.shape[0], t.shape[1], t.dtype.str, t.tobytes())


class RawRaster(DataSource):
    """format("raw_raster"): options path (or paths, a JSON list of files of one layout), lines, samples, offset, pixel_type, block_rows, image_id; a partition for each block
    of rows, read by byte range."""

    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_raw(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    spark.dataSource.register(RawRaster)
    where = {"path": path} if isinstance(path, str) else {"paths": json.dumps(path)}
    return spark.read.format("raw_raster").options(**where, **{k: str(v) for k, v in options.items()}).load()


def write_raw(patches: DataFrame, folder: str, key: str, header: int = 0) -> DataFrame:
    """Patches (key, h, w, dtype, px) as raw files of a folder, one each, after header bytes of zeros; (key, path), written by the
    executors. A file written twice is the same."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for pdf in batches:
            for k, px in zip(pdf[key], pdf["px"], strict=True):
                with store.open_output_stream(f"{at}/{k}.img") as f:
                    f.write(bytes(header) + px)
            yield pd.DataFrame({key: pdf[key], "path": [f"{folder}/{k}.img" for k in pdf[key]]})

    return patches.mapInPandas(run, f"{key} {patches.select(key).dtypes[0][1]}, path string")


def load_raster(spark: SparkSession, path: str, label: dict | None = None) -> DataFrame:
    """Tiles of a product by its suffix: a tile table (Parquet), a GeoTIFF's first band, or raw pixels that a label's row describes."""
    low = path.lower()
    if low.endswith((".tif", ".tiff")):
        from tessera.sources.geotiff import read_geotiff

        return read_geotiff(spark, path).drop("band")
    if low.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".h5", ".hdf5")):
        raise NotImplementedError("HDF5 cubes need h5py; convert the cube to a tile table first")
    if label is None:
        raise ValueError(f"{path} needs a label with lines, samples, offset and dtype")
    return read_raw(spark, path, lines=label["lines"], samples=label["samples"], offset=label["offset"], pixel_type=label["dtype"])


def band_axis_first(d0: int, d1: int) -> bool:
    """A cube is band-first if its first axis is the shorter of the first two."""
    return d0 < d1


def decimated(tiles: DataFrame, k: int) -> DataFrame:
    """(row, col, v): averages of k x k blocks of valid pixels over the whole scene, summed per tile before they are shuffled."""
    import pandas as pd

    from tessera.operators.tiles import pixels_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a = pixels_of(t.h, t.w, t.dtype, t.px).astype(float)
                yy, xx = (np.arange(t.h) + t.row_off) // k, (np.arange(t.w) + t.col_off) // k
                h, w = int(yy[-1] - yy[0]) + 1, int(xx[-1] - xx[0]) + 1
                at = ((yy - yy[0])[:, None] * w + (xx - xx[0])[None, :]).ravel()
                ok = (a > 0).ravel()
                n = np.bincount(at, ok, h * w)
                s = np.bincount(at, np.where(ok, a.ravel(), 0), h * w)
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"row": (y + yy[0]).astype(np.int32), "col": (x + xx[0]).astype(np.int32), "s": s, "n": n})

    parts = tiles.mapInPandas(run, "row int, col int, s double, n double")
    return parts.groupBy("row", "col").agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("v"))
