"""Pictures of a run: previews side by side, matches as lines, how points spread, differences, and four panels of them. Rasters come
as decimated previews, points as a uniform subsample or as counts by cell, so what the driver draws is bounded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import points as P
from tessera.sources.raw import decimated
from tessera.sources.sinks import png

#: Longest side of a preview, and matches that are drawn.
PREVIEW, MOST_LINES = 1024, 200


def preview(tiles: DataFrame, height: int, width: int, longest: int = PREVIEW) -> tuple[np.ndarray, int]:
    """(grey picture, decimation) of a raster."""
    k = max(1, -(-max(height, width) // longest))
    out = np.zeros((-(-height // k), -(-width // k)))
    rows = decimated(tiles, k).toPandas()  # at most longest x longest
    out[rows["row"], rows["col"]] = rows["v"]
    return K.stretched(out), k


def beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two pictures next to each other, in colour; the lower one is filled up with black."""
    out = np.zeros((max(a.shape[0], b.shape[0]), a.shape[1] + b.shape[1], 3), np.uint8)
    out[: a.shape[0], : a.shape[1]] = a if a.ndim == 3 else a[..., None]
    out[: b.shape[0], a.shape[1] :] = b if b.ndim == 3 else b[..., None]
    return out


def with_lines(picture: np.ndarray, lines: np.ndarray, colour: tuple[int, int, int] = (0, 255, 0)) -> np.ndarray:
    """Lines (x0, y0, x1, y1) drawn into a copy of a picture in colour; what lies outside is left out."""
    out, (h, w) = picture.copy(), picture.shape[:2]
    for x0, y0, x1, y1 in lines:
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        out[y[ok], x[ok]] = colour
    return out


def matches(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int], points: DataFrame, most: int = MOST_LINES) -> np.ndarray:
    """Both previews with lines between a uniform subsample of the tie points."""
    (left, k), (right, m) = a, b
    p = P.uniform_subsample(points.select("sx", "sy", "rx", "ry"), ["sy", "sx", "ry", "rx"], most).toPandas().to_numpy(float)
    lines = np.column_stack([p[:, :2] / k, p[:, 2] / m + left.shape[1], p[:, 3] / m]) if len(p) else np.zeros((0, 4))
    return with_lines(beside(left, right), lines)


def heat(points: DataFrame, height: int, width: int, rows: int, cols: int, size: int = 32) -> np.ndarray:
    """How many points each of rows x cols cells has, from black over red to yellow, size pixels a cell."""
    counts = np.zeros((rows, cols))
    for r in points.groupBy(P.cell("ry", height / rows, rows).alias("y"), P.cell("rx", width / cols, cols).alias("x")).agg(F.count("*").alias("n")).collect():
        counts[r["y"], r["x"]] = r["n"]
    share = counts / max(1.0, counts.max())
    colour = np.stack([np.minimum(1, 2 * share), np.maximum(0, 2 * share - 1), np.zeros_like(share)], -1)
    return np.kron(np.rint(255 * colour), np.ones((size, size, 1))).astype(np.uint8)


def panels(pictures: list[np.ndarray], gap: int = 4) -> np.ndarray:
    """Up to four pictures in two rows, with a white gap."""
    full = [p if p.ndim == 3 else np.repeat(p[..., None], 3, 2) for p in pictures]
    h, w = max(p.shape[0] for p in full), max(p.shape[1] for p in full)
    out = np.full((2 * h + gap, 2 * w + gap, 3), 255, np.uint8)
    for i, p in enumerate(full[:4]):
        y, x = (i // 2) * (h + gap), (i % 2) * (w + gap)
        out[y : y + h, x : x + w] = 0
        out[y : y + p.shape[0], x : x + p.shape[1]] = p
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The absolute difference of two previews where both hold data, else 0."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    x, y = a[:h, :w].astype(int), b[:h, :w].astype(int)
    return np.where((x > 0) & (y > 0), np.abs(x - y), 0).astype(np.uint8)


def pictures(registered: DataFrame, reference: DataFrame, points: DataFrame, shape: tuple[int, int], rows: int = 4, cols: int = 4) -> dict[str, bytes]:
    """The run's pictures as PNG, by file name: the registered source beside the reference, their difference, the points' heat map,
    and all of them with a false-colour composite in four panels."""
    a, b = preview(registered, *shape), preview(reference, *shape)
    colour = np.stack([a[0], b[0], b[0]], -1)
    apart, warm = difference(a[0], b[0]), heat(points, *shape, rows, cols)
    made = {"overview_side_by_side": beside(a[0], b[0]), "overview_false_color": colour, "difference_heatmap": apart, "matches": matches(a, b, points), "registration_verification": panels([a[0], colour, apart, warm])}
    return {f"{name}.png": png(p) for name, p in made.items()}
