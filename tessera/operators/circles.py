"""Circles in whole rasters by voting tables.

Edge pixels vote for centres along their gradient, for each radius. A cell of the raster gets every edge pixel whose votes reach it or
its margin, and counts them radius by radius itself, so a circle is found however many tiles it lies on, and no vote is a row. Of centres
that are too near the strongest stays, which rounds of joins by grid cell decide as one sorted pass over all would."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import scenes as S
from tessera.sources.shared import written

#: How far smoothing of votes reaches, in pixels: four deviations of 1.
_REACH = 4
#: An edge pixel's place and gradient.
_EDGE = np.dtype([("x", "<i4"), ("y", "<i4"), ("gx", "<f8"), ("gy", "<f8")])
#: Edge pixels in a row at most, and bytes of a Parquet row group, which a task that reads them holds whole.
_ROW_EDGES, _ROW_GROUP = 4096, 8 << 20


def edges(tiles: DataFrame, share: float = 0.3, size: int = 512) -> DataFrame:
    """(image_id, height, width, px): pixels, some thousand a row, whose gradient is over share of the raster's strongest, with that
    gradient (_EDGE), and the raster's size.

    What isn't over share of its own tile's strongest can't be over share of the raster's, so a tile's pixels are left behind at once."""

    def steep(image: str, row_off: int, col_off: int, h: int, w: int, a: np.ndarray) -> pd.DataFrame:
        gy, gx = (g[6 : 6 + h, 6 : 6 + w] for g in np.gradient(K.gaussian(a.astype(float), 1.2)))
        m = np.hypot(gx, gy)
        top = float(np.nan_to_num(m.max(), nan=np.inf, posinf=np.inf))  # as the kernel has it, nothing is found beside what is no number
        ys, xs = np.nonzero(m > share * top)
        found = np.empty(len(xs), _EDGE)
        found["x"], found["y"], found["gx"], found["gy"] = xs + col_off, ys + row_off, gx[ys, xs], gy[ys, xs]
        rows = [found[k : k + _ROW_EDGES].tobytes() for k in range(0, max(1, len(found)), _ROW_EDGES)]
        return pd.DataFrame({"image_id": image, "bottom": row_off + h, "right": col_off + w, "top": top, "px": rows})

    own = written(S.with_margins(tiles, 6, steep, "image_id string, bottom int, right int, top double, px binary", size), "edges", _ROW_GROUP)
    whole = own.groupBy("image_id").agg(F.max("bottom").alias("height"), F.max("right").alias("width"), F.max("top").alias("most"))  # every tile has a row

    def strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                e = np.frombuffer(t.px, _EDGE)
                rows.append((t.image_id, t.height, t.width, e[np.hypot(e["gx"], e["gy"]) > share * t.most].tobytes()))
            yield pd.DataFrame([r for r in rows if r[-1]], columns=["image_id", "height", "width", "px"])

    return S.few_at_once(own.join(F.broadcast(whole), "image_id"), strong, "image_id string, height int, width int, px binary")


def _box_maximum(a: np.ndarray, r: int) -> np.ndarray:
    """The maximum within r of each place on both axes: of windows twice as long at each step, and of two that overlap at last."""
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        m, size = np.full((len(a) + 2 * r, a.shape[1]), -np.inf), 1
        m[r : r + len(a)] = a
        while 2 * size <= 2 * r + 1:
            m, size = np.maximum(m[:-size], m[size:]), 2 * size
        rest = 2 * r + 1 - size
        a = np.moveaxis(np.maximum(m[: len(m) - rest], m[rest:]), 0, axis)
    return a


def _peaks(e: np.ndarray, ux: np.ndarray, uy: np.ndarray, r: int, cell: tuple[int, int, int, int], height: int, width: int, least_votes: float) -> list[tuple[int, int, float]]:
    """(x, y, score) of centres in the cell (its first row and column, and its ends) for which edge pixels e, of directions ux and uy,
    vote with radius r."""
    y0, x0, y1, x1 = cell
    margin, most = r + _REACH, max(least_votes, 1)
    top, left, end, right = max(0, y0 - margin), max(0, x0 - margin), min(height, y1 + margin), min(width, x1 + margin)
    h, w = end - top, right - left
    acc = np.zeros(h * w)
    for sign in (-1, 1):
        cx, cy = np.rint(e["x"] + sign * r * ux).astype(np.int64) - left, np.rint(e["y"] + sign * r * uy).astype(np.int64) - top
        ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        acc += np.bincount(cy[ok] * w + cx[ok], minlength=h * w)
    # Smoothed votes are averages: they reach most only near a place that has as many, and rows far from such places hold no peak.
    hot_y, hot_x = np.divmod(np.flatnonzero(acc * (2 * np.pi * (1 + 1e-9)) >= most), w)
    acc, far, out = acc.reshape(h, w), r + 2 * _REACH, []
    for own in np.split(np.arange(len(hot_y)), np.flatnonzero(np.diff(hot_y) > far) + 1) if len(hot_y) else ():
        ya, yb = max(0, hot_y[own[0]] - 2 * _REACH), min(h, hot_y[own[-1]] + 2 * _REACH + 1)
        xa, xb = max(0, hot_x[own].min() - 2 * _REACH), min(w, hot_x[own].max() + 2 * _REACH + 1)
        part = K.gaussian(acc[ya:yb, xa:xb], 1.0) * 2 * np.pi
        ys, xs = np.nonzero((part >= most) & (part > _box_maximum(part, r) * (1 - 1e-12)))
        for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
            cy, cx = int(y + ya + top), int(x + xa + left)
            if not (y0 <= cy < y1 and x0 <= cx < x1):
                continue
            box = part[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            # Sums of the same votes in another cell may differ in their last digits.
            by, bx = np.unravel_index(np.argmax(box > box.max() * (1 - 1e-12)), box.shape)
            if (by, bx) == (y - max(0, y - r), x - max(0, x - r)):
                out.append((cx, cy, float(part[y, x] / r)))
    return out


def centres(found: DataFrame, radii: range, least_votes: float, size: int = 512) -> DataFrame:
    """(image_id, r, cx, cy, score): centres within the raster whose smoothed votes (the kernel's weights times 2 pi) are least_votes and
    more, and the most within r of them on both axes, the first by row and column of equal ones. A task has one cell and its edges."""
    reach = 2 * max(radii) + _REACH + 1  # a vote at the margin's end comes from as far again

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                e = np.frombuffer(t.px, _EDGE)
                low = lambda v: max(0, int(v.min()) - reach) // size
                high = lambda v, end: min(end - 1, int(v.max()) + reach) // size
                for gy in range(low(e["y"]), high(e["y"], t.height) + 1):
                    row = e[(e["y"] >= gy * size - reach) & (e["y"] < (gy + 1) * size + reach)]
                    for gx in range(low(e["x"]), high(e["x"], t.width) + 1):
                        piece = row[(row["x"] >= gx * size - reach) & (row["x"] < (gx + 1) * size + reach)]
                        if len(piece):
                            out.append((t.image_id, gy, gx, t.height, t.width, piece.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "gy", "gx", "height", "width", "px"])

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        image, gy, gx, height, width = (pdf[c].iloc[0] for c in ("image_id", "gy", "gx", "height", "width"))
        e = np.concatenate([np.frombuffer(px, _EDGE) for px in pdf["px"]])
        m = np.hypot(e["gx"], e["gy"])
        ux, uy = e["gx"] / m, e["gy"] / m
        cell = gy * size, gx * size, min(height, (gy + 1) * size), min(width, (gx + 1) * size)
        out = [(image, r, x, y, score) for r in radii for x, y, score in _peaks(e, ux, uy, r, cell, height, width, least_votes)]
        return pd.DataFrame(out, columns=["image_id", "r", "cx", "cy", "score"])

    dealt = S.few_at_once(found, deal, "image_id string, gy int, gx int, height int, width int, px binary")
    return S.each_cell(dealt, peaks, "image_id string, r int, cx int, cy int, score double")


def strongest(found: DataFrame, apart: float, most_rounds: int = 1000) -> DataFrame:
    """The rows (image_id, r, cx, cy, score) that a pass from the strongest down keeps, if each keeps away all whose centres lie within
    apart of it. A round keeps every open row that is the strongest around, and closes those that it keeps away; rows meet by grid cell."""
    cell = lambda c: F.floor(F.col(c) / apart).cast("int")
    order = F.struct(F.round("score", 9), -F.col("cy"), -F.col("cx"), -F.col("r"))
    open_rows = written(found.select("image_id", "r", "cx", "cy", "score", order.alias("o"), cell("cy").alias("gy"), cell("cx").alias("gx")), "open")
    around = F.array(*(F.struct((F.col("gy") + i).alias("gy"), (F.col("gx") + j).alias("gx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    kept = None
    for _ in range(most_rounds):
        if open_rows.isEmpty():
            break
        a = open_rows.select("image_id", F.col("o").alias("ao"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(around).alias("g")).select("image_id", "ao", "ax", "ay", "g.*")
        pairs = open_rows.join(a, ["image_id", "gy", "gx"]).where((F.hypot(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")) < apart) & (F.col("ao") > F.col("o")))
        beaten = written(pairs.select("image_id", "o", "ao").distinct(), "beaten")
        first = written(open_rows.join(beaten, ["image_id", "o"], "left_anti"), "kept")
        kept = first if kept is None else kept.unionByName(first)
        gone = beaten.join(first.select("image_id", F.col("o").alias("ao")), ["image_id", "ao"], "left_semi").select("image_id", "o").distinct()
        rest = open_rows.join(first.select("image_id", "o"), ["image_id", "o"], "left_anti").join(gone, ["image_id", "o"], "left_anti")
        open_rows = written(rest, "open")
    else:
        raise RuntimeError(f"centres did not settle in {most_rounds} rounds")
    return (open_rows if kept is None else kept).select("image_id", "r", "cx", "cy", "score")


def circles(tiles: DataFrame, smallest: int = 15, largest: int = 200, least_votes: float = 25, step: int = 2, size: int = 512) -> DataFrame:
    """(image_id, r, cx, cy, score): the circles of whole rasters, centres apart by twice the smallest radius. Rasters without any
    slope have none."""
    found = centres(edges(tiles, size=size), range(smallest, largest + 1, step), least_votes, size)
    return strongest(found, 2.0 * smallest)
