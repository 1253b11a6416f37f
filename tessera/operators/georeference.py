"""Rasters onto map grids: by ground control points, by a common scale, and by a thumbnail's drift."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.functions.numeric import SPHERE_RADIUS_M
from tessera.operators import footprints
from tessera.operators import points as P
from tessera.operators import tiles as T

#: Control points of one image that the driver holds.
MOST_POINTS = 20_000


@dataclass(frozen=True)
class Grid:
    """A north-up grid in metres: upper left corner, pixel size, and numbers of pixels."""

    left: float
    top: float
    gsd: float
    width: int
    height: int

    def metres(self, p: np.ndarray) -> np.ndarray:
        return np.column_stack([self.left + (p[:, 0] + 0.5) * self.gsd, self.top - (p[:, 1] + 0.5) * self.gsd])


def control_points(gcps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(places (col, row), metres) of one image's control points."""
    rows = gcps.select("col", "row", "lon", "lat").limit(MOST_POINTS + 1).toPandas().to_numpy(float)
    if not 3 <= len(rows) <= MOST_POINTS:
        raise ValueError(f"{len(rows)} control points; 3 to {MOST_POINTS} are needed")
    return rows[:, :2], np.radians(rows[:, 2:]) * SPHERE_RADIUS_M


def by_control_points(tiles: DataFrame, gcps: DataFrame, grid: Grid, order: int = 1, block: int = 512) -> DataFrame:
    """The image on a grid: by a least-squares affine of its control points, and by a thin-plate spline beyond six of them.
    Unlike a warp that goes on without a map, points that fix none are an error."""
    places, metres = control_points(gcps)
    if np.linalg.matrix_rank(np.column_stack([metres - metres.mean(0), np.ones(len(metres))]), tol=1e-6) < 3:
        raise ValueError("the control points lie on a line")
    back = K.fit_affine(metres, places)
    inverse = lambda p: K.applied(back, grid.metres(p)) - 0.5
    spline = None
    if len(places) > 6:
        bend = K.ThinPlate(metres, places - K.applied(back, metres))
        spline = lambda p: bend(grid.metres(p))
    return T.warp(tiles, inverse, grid.height, grid.width, block, order, "|u1", spline=spline)


def by_corners(tiles: DataFrame, labels: DataFrame, grid: Grid, block: int = 512) -> DataFrame | None:
    """The image on a grid by its label's four corners alone (width, height and ul, ur, ll, lr with _lat, _lon), where nothing better is
    known; none if the label lacks a corner or there is no label."""
    row = labels.limit(1).collect()
    if not row or any(row[0][f"{k}_{v}"] is None for k in ("ul", "ur", "ll", "lr") for v in ("lat", "lon")):
        return None
    return by_control_points(tiles, footprints.corner_points(labels.limit(1)), grid, block=block)


def common_grid(box: tuple[float, float, float, float], gsd: float) -> Grid:
    left, bottom, right, top = box
    return Grid(left, top, gsd, max(1, round((right - left) / gsd)), max(1, round((top - bottom) / gsd)))


def harmonised(tiles: DataFrame, geotransform: tuple[float, float, float, float], grid: Grid, method: str = "bilinear", block: int = 512) -> DataFrame:
    """The image (a, c, e, f: its pixel sizes and origin) on a grid. average first takes means of whole blocks of pixels, as many
    as fit the grid's pixel, and then bilinear values of those; lanczos has lobes of the grid's pixel, where that is the larger one."""
    from tessera.sources.raw import decimated

    a, c, e, f = geotransform
    k = max(1, int(grid.gsd / abs(a))) if method == "average" else 1
    if k > 1:
        small = decimated(tiles, k).select(F.floor(F.col("row") / 512).cast("int").alias("gr"), F.floor(F.col("col") / 512).cast("int").alias("gc"), "row", "col", "v")
        tiles = _packed(small)
        a, e = a * k, e * k
    inverse = lambda p: np.column_stack([(grid.metres(p)[:, 0] - c) / a - 0.5, (grid.metres(p)[:, 1] - f) / e - 0.5])
    if method == "lanczos":
        stretch = max(1.0, grid.gsd / abs(a))
        return T.warp(tiles, inverse, grid.height, grid.width, block, margin=int(np.ceil(3 * stretch)) + 2, sampler=lambda image, y, x: K.lanczos(image, y, x, stretch))
    return T.warp(tiles, inverse, grid.height, grid.width, block, 1)


def _packed(rows: DataFrame, size: int = 512) -> DataFrame:
    """Long rows as tiles: a task holds one tile."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["gr"].iloc[0]) * size, int(pdf["gc"].iloc[0]) * size
        h, w = int(pdf["row"].max()) - y0 + 1, int(pdf["col"].max()) - x0 + 1
        a = np.zeros((h, w))
        a[pdf["row"] - y0, pdf["col"] - x0] = pdf["v"]
        return pd.DataFrame({"image_id": ["decimated"], "row_off": [y0], "col_off": [x0], "h": [h], "w": [w], "dtype": ["<f8"], "px": [a.tobytes()]})

    return rows.groupBy("gr", "gc").applyInPandas(pack, T.TILE)


def orientation() -> str:
    """Relative orientation isn't checked: every image counts as normal."""
    return "normal"


@dataclass
class Thumbnail:
    dx: float
    dy: float
    slope: tuple[float, float]
    inliers: int
    span: float
    confidence: float


def thumbnail_drift(points: DataFrame, scale: float, height: int, least: int = 5, cap: float = 0.20, least_confidence: float = 0.15) -> Thumbnail | None:
    """The drift of matched thumbnails (sx, sy, rx, ry, score; scale: thumbnail pixels of a pixel): an affine's inliers, else a
    similarity's, else those near the median; a line through them where they are enough and span 15 % of the rows, else the
    median; none if they are few or doubtful. All points count: models are scored and lines fitted by sums."""
    full = points.select(*((F.col(c).cast("double") / scale).alias(c) for c in ("sx", "sy", "rx", "ry")), F.col("score").cast("double").alias("score"))
    full = full.withColumns({"dx": F.col("rx") - F.col("sx"), "dy": F.col("ry") - F.col("sy")})
    if len(full.take(least)) < least:
        return None
    for affine in (True, False):
        ok = T.ransac_by_rows(full, 5.0 / scale, affine=affine)[1]
        if len(ok.take(least)) == least:
            break
    else:
        ok = P.mad_inliers(full, ["dx", "dy"], floor=50.0)
    m = ok.agg(F.count("*").alias("n"), F.avg("score").alias("score"), (F.max("sy") - F.min("sy")).alias("span"), F.regr_slope("dx", "sy").alias("a"), F.regr_slope("dy", "sy").alias("b")).first()
    if m["n"] < least or m["score"] < least_confidence:
        return None
    span, slope = float(m["span"] / max(1, height)), (m["a"], m["b"])
    if span < 0.15 or any(x is None or not np.isfinite(x) or abs(x) > cap for x in slope):
        slope = (0.0, 0.0)
    at = ok.select((F.col("dx") - slope[0] * F.col("sy")).alias("dx"), (F.col("dy") - slope[1] * F.col("sy")).alias("dy"))
    d = P.medians(at, ["dx", "dy"]).first()
    return Thumbnail(float(d[0]), float(d[1]), (float(slope[0]), float(slope[1])), int(m["n"]), span, float(m["score"]))


def thumbnail_accepted(t: Thumbnail | None, height: int, method: str = "auto") -> bool:
    """Whether a thumbnail's drift stands alone, without strips."""
    return t is not None and method == "auto" and (height <= 8000 or (t.span >= 0.20 and (any(t.slope) or t.inliers >= 15)))


def anchor(dx: float, dy: float, response: float, scale: float, least: float = 0.04) -> tuple[float, float]:
    """A decimated shift in full pixels, or none if its response is low."""
    return (dx / scale, dy / scale) if response > least else (0.0, 0.0)


def global_inliers(points: DataFrame, height: int, threshold: float, most: float = 12.0) -> DataFrame:
    """Points that one affine explains, over all tiles; the threshold grows by half, up to most, while it halves the rows that
    the points span."""
    span = lambda df: (lambda r: (r[1] or 0) - (r[0] or 0))(df.agg(F.min("sy"), F.max("sy")).first())
    whole, t = span(points), max(threshold, min(5.5, 0.00033 * height)) if height > 5000 else threshold
    while True:
        model, ok = T.ransac_by_rows(points, t)
        if model is None:
            return points
        if span(ok) >= 0.5 * whole or t >= most:
            return ok
        t = min(most, 1.5 * t)


#: Fixed values of the trap sets, in a scene of 1600 x 1600: points (x, y) that look like registrations and aren't (24 on a ring, 25
#: in a heap, 3 in a plain), and the sun's azimuths of both images where those are the trap.
TRAP_SIDE = 1600
TRAPS = ("twin_craters", "shadow_inversion", "clustered_boulders", "featureless_plain")
RING, HEAP, PLAIN = (800.0, 150.0, 24), (500.0, 3.0, 5), ((200.0, 300.0), (450.0, 600.0), (800.0, 1200.0))
AZIMUTHS = {"shadow_inversion": (45.0, 225.0)}
#: Degrees between the sun's azimuths from which shadows fall the other way.
OPPOSITE = 120.0


def trap_points(name: str) -> np.ndarray:
    if name == "twin_craters":
        a = np.linspace(0, 2 * np.pi, RING[2], endpoint=False)
        return np.column_stack([RING[0] + RING[1] * np.cos(a), RING[0] + RING[1] * np.sin(a)])
    if name == "clustered_boulders":
        return np.array([(HEAP[0] + HEAP[1] * i, HEAP[0] + HEAP[1] * j) for i in range(HEAP[2]) for j in range(HEAP[2])])
    return np.array(PLAIN if name == "featureless_plain" else []).reshape(-1, 2)


def azimuth_gap(a, b):
    """Degrees between two azimuths, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def judged_traps(spark, scenes: DataFrame | None = None) -> DataFrame:
    """(trap, inliers, entropy, hull, gap, verdict) of the trap sets, for each of scenes (scene, mirrored: whether left is right), or once: opposite light is a veto, else the gates that judge every run
    decide. No residuals are made up: RMSE and score are null."""
    traps = spark.createDataFrame([(t, *AZIMUTHS.get(t, (None, None))) for t in TRAPS], "trap string, source_azimuth double, reference_azimuth double")
    points = spark.createDataFrame([(t, float(x), float(y)) for t in TRAPS for x, y in trap_points(t)], "trap string, x double, y double")
    by = ["trap"]
    if scenes is not None:
        scenes = T.dealt(scenes, "scene", 4096)
        by, each = ["scene", "trap"], lambda rows: F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, rows.columns, strict=True))) for r in rows.collect())))
        points = scenes.select("scene", "mirrored", each(points)).withColumn("x", F.when(F.col("mirrored"), TRAP_SIDE - F.col("x")).otherwise(F.col("x"))).drop("mirrored")
        traps = scenes.select("scene", each(traps)).withColumns({c: F.col(c).cast("double") for c in ("source_azimuth", "reference_azimuth")})
    h = P.spatial_entropy(points, "x", "y", TRAP_SIDE, TRAP_SIDE, 4, 4, by=by)
    hull = T.hull_shares(points, "x", "y", float(TRAP_SIDE) ** 2, by)
    held = traps.join(points.groupBy(*by).agg(F.count("*").alias("inliers")), by, "left").join(h, by, "left").join(hull, by, "left")
    held = held.withColumns({"inliers": F.coalesce("inliers", F.lit(0)), "entropy": F.coalesce("entropy", F.lit(0.0)), "hull": F.coalesce("share", F.lit(0.0)), "gap": azimuth_gap(F.col("source_azimuth"), F.col("reference_azimuth"))})
    none = F.lit(None).cast("double")
    judged = F.when(F.col("gap") >= OPPOSITE, "REJECTED (Illumination Conflict)").otherwise(P.verdict(F.col("inliers"), F.col("hull"), F.col("entropy"), none, none))
    return held.select(*by, "inliers", F.round("entropy", 4).alias("entropy"), F.round("hull", 5).alias("hull"), "gap", judged.alias("verdict"))
