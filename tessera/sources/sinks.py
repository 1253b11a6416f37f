"""Where results go: tie points as CSV, models and reports as JSON, tiles as Parquet, previews as PNG, single bands as TIFF."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.buckets import BucketedTable


def write_points(points: DataFrame, path: str, decimals: int) -> None:
    """Tie points as CSV with fixed decimals: 2 for candidates, 4 for refined ones. An empty table is written too."""
    names = {"sx": "src_x", "sy": "src_y", "rx": "ref_x", "ry": "ref_y"}
    out = points.select(*(F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(n) for c, n in names.items()), *([F.format_string(f"%.{decimals}f", "score").alias("ecc_rho")] if "score" in points.columns else []))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles clustered by place, so that a window's read skips other row groups by their statistics."""
    tiles.repartitionByRange("image_id", "row_off").sortWithinPartitions("image_id", "row_off", "col_off").write.mode("overwrite").partitionBy("image_id").parquet(path)


def read_window(spark: SparkSession, path: str, image_id: str, row_off: int, col_off: int, height: int, width: int) -> DataFrame:
    """The tiles that a window touches: image by partition, places by pushed-down predicates. How far above the window a tile may
    begin is the image's greatest tile height, which comes from one column."""
    t = spark.read.parquet(path).where(F.col("image_id") == image_id)
    tallest = t.agg(F.max("h")).first()[0] or 0
    return t.where((F.col("row_off") < row_off + height) & (F.col("row_off") > row_off - tallest) & (F.col("col_off") < col_off + width) & (F.col("row_off") + F.col("h") > row_off) & (F.col("col_off") + F.col("w") > col_off))


def upsert(spark: SparkSession, path: str, updates: DataFrame, key: str, version: int) -> DataFrame:
    """A version of a table, with updates in place of the rows with their keys; only the buckets of those keys are written again, and
    nothing if the version is there already."""
    held = BucketedTable(spark, path, key)
    held.upsert(updates, version)
    return held.read(version)


#: Tables of the dashboard, by key.
DASHBOARD = {"observations": "id", "correspondences": "id", "correspondence_evidence": "id", "registration_experiments": "id"}


def dashboard(report: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's four tables of run reports; a measure that a report lacks is null, not made up."""
    c = set(report.columns)
    get = lambda n, t="double": (F.col(n) if n in c else F.lit(None)).cast(t).alias(n)
    side = lambda s: report.select(F.concat_ws(":", F.lit(s), "run_id").alias("id"), get(f"{s}_name", "string").alias("name"), F.lit(s).alias("side"))
    return {
        "observations": side("source").unionByName(side("reference")),
        "correspondences": report.select(F.concat(F.lit("c:"), "run_id").alias("id"), F.concat(F.lit("source:"), "run_id").alias("source_id"), F.concat(F.lit("reference:"), "run_id").alias("reference_id"), get("verdict", "string")),
        "correspondence_evidence": report.select(F.concat(F.lit("e:"), "run_id").alias("id"), F.concat(F.lit("c:"), "run_id").alias("correspondence_id"), get("rmse"), get("inliers", "long"), get("entropy"), get("hull")),
        "registration_experiments": report.select(F.concat(F.lit("x:"), "run_id").alias("id"), F.concat(F.lit("c:"), "run_id").alias("correspondence_id"), get("score")),
    }


def png(image: np.ndarray) -> bytes:
    """8-bit grey or RGB."""
    a = np.ascontiguousarray(image, np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(image: np.ndarray) -> bytes:
    """One deflated strip of a single band."""
    a = np.ascontiguousarray(image)
    data = zlib.compress(a.astype(a.dtype.newbyteorder("<")).tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, 8 * a.itemsize), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, a.shape[0]), (279, 4, len(data)), (339, 3, kind)]
    data += b"\0" * (len(data) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd
