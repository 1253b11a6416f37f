"""Operators on whole rasters that are tables of tiles (image_id, row_off, col_off, h, w, dtype, px), for any number of rasters at once.

What holds for a raster as a whole (order statistics, histograms, a maximum) is counted by tile and summed by Spark; what a pixel
needs of its neighbours comes as margins that tiles send each other. A task holds one tile with its margins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import kernels as K
from tessera.operators.tiles import TILE, pixels_of
from tessera.sources.shared import written

PLACE = ["image_id", "row_off", "col_off"]
#: Tiles that a task has in pandas at once.
HELD = 32


def few_at_once(tiles: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """tiles through f as mapInPandas does it, but f gets HELD of them at a time. Of an Arrow batch, which Spark fills up to
    spark.sql.execution.arrow.maxBytesPerBatch, there is so no second copy in pandas, nor a third of what f makes of it."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batch.slice(k, HELD).to_pandas() for batch in batches for k in range(0, batch.num_rows, HELD)):
            yield pa.RecordBatch.from_pandas(out, made, preserve_index=False)

    return tiles.mapInArrow(run, schema)


def each_cell(pieces: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of the pieces of each cell (image_id, gy, gx) of a grid, as applyInPandas has it. Cells come sorted, and a task holds one at a
    time; applyInPandas opens a stream for each group, which takes longer than most f of a cell."""
    key = ["image_id", "gy", "gx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for pdf in batches:
            places = list(zip(*(pdf[c] for c in key), strict=True))
            starts = [k for k in range(len(places)) if not k or places[k] != places[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
                if held and places[a] != at:
                    yield f(pd.concat(held, ignore_index=True))
                    held = []
                held, at = [*held, pdf.iloc[a:b]], places[a]
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return few_at_once(pieces.repartition(*key).sortWithinPartitions(*key), run, schema)


def each_tile(tiles: DataFrame, f: Callable[..., np.ndarray], *extra: str) -> DataFrame:
    """tiles with their pixels replaced by f(pixels, *values of the extra columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                a = np.ascontiguousarray(f(pixels_of(t.h, t.w, t.dtype, t.px), *(getattr(t, c) for c in extra)))
                out.append((t.image_id, t.row_off, t.col_off, *a.shape, a.dtype.str, a.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TILE.split(", ")])

    return few_at_once(tiles.select(*(c.split()[0] for c in TILE.split(", ")), *(c for c in extra if c not in PLACE)), run, TILE)


def sizes(tiles: DataFrame) -> DataFrame:
    """(image_id, height, width)."""
    return tiles.groupBy("image_id").agg(F.max(F.col("row_off") + F.col("h")).alias("height"), F.max(F.col("col_off") + F.col("w")).alias("width"))


def pixels(tiles: DataFrame) -> DataFrame:
    """(image_id, row, col, v), places in the whole raster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                y, x = np.divmod(np.arange(t.h * t.w), t.w)
                yield pd.DataFrame({"image_id": t.image_id, "row": (y + t.row_off).astype(np.int32), "col": (x + t.col_off).astype(np.int32), "v": pixels_of(t.h, t.w, t.dtype, t.px).ravel().astype(float)})

    return few_at_once(tiles.select(*(c.split()[0] for c in TILE.split(", "))), run, "image_id string, row int, col int, v double")


# ---------------------------------------------------------------- order statistics


def _ordered(v: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of doubles; -0 is 0."""
    bits = (np.ascontiguousarray(v, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(float)


def percentiles(tiles: DataFrame, shares: Sequence[float], positive: bool = True) -> DataFrame:
    """(image_id, n, q): each raster's number of finite (and, if so asked, positive) pixels and their linearly interpolated
    percentiles of shares, an array; rasters without such pixels have no row.

    A radix selection: the ranks' 64-bit keys are found 16 bits at a time, in four passes whatever the values; in each, a tile
    gives counts of its values that still agree with a rank's upper bits. No value is gathered."""
    k = len(shares)

    def counting(shift: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for t in pdf.itertuples(index=False):
                    v = pixels_of(t.h, t.w, t.dtype, t.px).ravel().astype(float)
                    v = v[np.isfinite(v) & (v > 0)] if positive else v[np.isfinite(v)]
                    u = _ordered(v)
                    for prefix in np.unique(np.asarray(t.prefixes, np.int64)).tolist():
                        own = u if shift == 48 else u[(u >> np.uint64(shift + 16)).astype(np.int64) == prefix]
                        level, n = np.unique(own >> np.uint64(shift) & np.uint64(0xFFFF), return_counts=True)
                        yield pd.DataFrame({"image_id": t.image_id, "prefix": prefix, "level": level.astype(np.int64), "n": n})

        return run

    wanted = None
    for shift in (48, 32, 16, 0):
        prefixes = tiles.select("image_id").distinct().withColumn("prefixes", F.array(F.lit(0).cast("long"))) if wanted is None else wanted.groupBy("image_id").agg(F.collect_set("prefix").alias("prefixes"))
        seen = few_at_once(tiles.select("image_id", "h", "w", "dtype", "px").join(prefixes, "image_id"), counting(shift), "image_id string, prefix long, level long, n long")
        counts = written(seen.groupBy("image_id", "prefix", "level").agg(F.sum("n").alias("n")), "levels")
        if wanted is None:
            total = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
            at = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
            ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at))))
            wanted = total.select("image_id", "total", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
        up_to = F.sum("n").over(Window.partitionBy("image_id", "rank").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
        placed = wanted.join(counts, ["image_id", "prefix"]).withColumn("upto", up_to)
        hit = placed.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        wanted = written(hit.select("image_id", "total", "rank", (F.shiftleft("prefix", 16) + F.col("level")).alias("prefix"), (F.col("upto") - F.col("n")).alias("before")), "ranks")

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = {x["rank"]: x["prefix"] for x in r.found}
                value = {rank: float(_double(np.array([bits], np.int64).view(np.uint64))[0]) for rank, bits in found.items()}
                q = []
                for s in shares:
                    at = s * (r.total - 1)
                    low, high, part = value[int(np.floor(at))], value[int(np.ceil(at))], at - np.floor(at)
                    q.append(high - (high - low) * (1 - part) if part >= 0.5 else low + (high - low) * part)
                out.append((r.image_id, r.total, q))
            yield pd.DataFrame(out, columns=["image_id", "n", "q"])

    # Two ranks for each share at most.
    held = wanted.groupBy("image_id", "total").agg(F.collect_list(F.struct("rank", "prefix")).alias("found"))
    assert k
    return held.mapInPandas(between, "image_id string, n long, q array<double>")


# ---------------------------------------------------------------- local contrast


def stretched(tiles: DataFrame, low: float = 2, high: float = 98, least: int = 100) -> DataFrame:
    """Bytes between each raster's percentiles of valid pixels; under least of those, its values cut to bytes."""
    q = percentiles(tiles, [low / 100, high / 100])

    def run(a: np.ndarray, n, ends) -> np.ndarray:
        if n is None or n != n or n < least:
            return np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)
        return (np.clip((a.astype(float) - ends[0]) / (ends[1] - ends[0] + 1e-6), 0, 1) * 255).astype(np.uint8)

    return each_tile(tiles.join(q, "image_id", "left"), run, "n", "q")


def _mirrored(first: int, end: int, size: int, padded: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, source): places up to padded, beyond size mirrored, whose sources are from first to end."""
    place = np.concatenate([np.arange(first, end), np.arange(size, padded)])  # others are their own sources
    source = K._folded(place, size)
    own = (source >= first) & (source < end)
    return place[own], source[own] - first


def equalised(tiles: DataFrame, clip: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation of byte rasters over grid x grid cells of each whole raster, as kernels.clahe has it.

    Cells' histograms are counts of all tiles; each cell's table is made from its 256 counts; a tile gets the tables of the cells
    around it, and blends them by place."""
    sized = tiles.join(sizes(tiles), "image_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a, th, tw = pixels_of(t.h, t.w, t.dtype, t.px), -(-t.height // grid), -(-t.width // grid)
                py, y = _mirrored(t.row_off, t.row_off + t.h, t.height, th * grid)
                px, x = _mirrored(t.col_off, t.col_off + t.w, t.width, tw * grid)
                key = ((py // th)[:, None] * grid + (px // tw)[None, :]) * 256 + a[np.ix_(y, x)]
                level, n = np.unique(key, return_counts=True)
                yield pd.DataFrame({"image_id": t.image_id, "cell": (level // 256).astype(np.int32), "level": (level % 256).astype(np.int32), "n": n})

    hist = few_at_once(sized, count, "image_id string, cell int, level int, n long").groupBy("image_id", "cell", "level").agg(F.sum("n").alias("n"))
    cells = hist.groupBy("image_id", "cell").agg(F.collect_list(F.struct("level", "n")).alias("counts"))  # 256 at most

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                counts = np.zeros(256)
                for x in r.counts:
                    counts[x["level"]] = x["n"]
                area = counts.sum()
                limit = max(1.0, clip * area / 256)
                over = np.maximum(counts - limit, 0).sum()
                out.append((r.image_id, r.cell, np.clip(np.cumsum(np.minimum(counts, limit) + over / 256) * 255 / area, 0, 255).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "cell", "table"])

    made = written(cells.mapInPandas(tables, "image_id string, cell int, table binary"), "tables")
    high, wide = F.ceil(F.col("height") / grid), F.ceil(F.col("width") / grid)

    def around(first, n, size):
        return F.sequence(F.greatest(F.lit(0), F.floor((first + 0.5) / size - 0.5)).cast("int"), F.least(F.lit(grid - 1), F.floor((first + n - 0.5) / size - 0.5) + 1).cast("int"))

    need = sized.select(*PLACE, around(F.col("row_off"), F.col("h"), high).alias("ys"), around(F.col("col_off"), F.col("w"), wide).alias("xs"))
    need = need.withColumn("y", F.explode("ys")).withColumn("x", F.explode("xs")).select(*PLACE, (F.col("y") * grid + F.col("x")).alias("cell"))
    held = need.join(made, ["image_id", "cell"]).groupBy(*PLACE).agg(F.collect_list(F.struct("cell", "table")).alias("tables"))  # grid x grid at most

    def blend(a: np.ndarray, row_off, col_off, height, width, tables) -> np.ndarray:
        table = np.zeros((grid, grid, 256))
        for x in tables:
            table[divmod(x["cell"], grid)] = np.frombuffer(x["table"])

        def places(first: int, n: int, size: int):
            at = (np.arange(first, first + n) + 0.5) / size - 0.5
            lo = np.floor(at).astype(int)
            return np.clip(lo, 0, grid - 1), np.clip(lo + 1, 0, grid - 1), at - lo

        (y0, y1, fy), (x0, x1, fx) = places(row_off, a.shape[0], -(-height // grid)), places(col_off, a.shape[1], -(-width // grid))
        look = lambda ys, xs: table[ys[:, None], xs[None, :], a]
        top, low = look(y0, x0) * (1 - fx) + look(y0, x1) * fx, look(y1, x0) * (1 - fx) + look(y1, x1) * fx
        return np.rint(top * (1 - fy[:, None]) + low * fy[:, None]).astype(np.uint8)

    return each_tile(sized.join(held, PLACE), blend, "row_off", "col_off", "height", "width", "tables")


# ---------------------------------------------------------------- margins


def with_margins(tiles: DataFrame, margin: int, f: Callable[..., pd.DataFrame], schema: str, size: int = 512) -> DataFrame:
    """f(image_id, row_off, col_off, h, w, pixels) of every tile of a grid of tiles of size, its pixels with margin more on each side.

    Tiles of any cut send each cell of the grid that part of themselves which it needs; beyond a raster's borders its pixels are
    mirrored, without repeating the border."""
    sized = tiles.join(F.broadcast(sizes(tiles)), "image_id")  # a row for each raster; tiles don't move for it

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                a = pixels_of(t.h, t.w, t.dtype, t.px)
                for gy in range(max(0, t.row_off - margin) // size, (min(t.height, t.row_off + t.h + margin) - 1) // size + 1):
                    for gx in range(max(0, t.col_off - margin) // size, (min(t.width, t.col_off + t.w + margin) - 1) // size + 1):
                        y, x = max(t.row_off, gy * size - margin), max(t.col_off, gx * size - margin)
                        piece = np.ascontiguousarray(a[y - t.row_off : (gy + 1) * size + margin - t.row_off, x - t.col_off : (gx + 1) * size + margin - t.col_off])
                        if piece.size:
                            out.append((t.image_id, gy, gx, t.height, t.width, y, x, *piece.shape, piece.dtype.str, piece.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "gy", "gx", "height", "width", "y", "x", "h", "w", "dtype", "px"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, gy, gx, height, width = (pdf[c].iloc[0] for c in ("image_id", "gy", "gx", "height", "width"))
        y0, x0, y1, x1 = gy * size, gx * size, min(height, (gy + 1) * size), min(width, (gx + 1) * size)
        top, left = max(0, y0 - margin), max(0, x0 - margin)
        whole = np.zeros((min(height, y1 + margin) - top, min(width, x1 + margin) - left), pdf["dtype"].iloc[0])
        for p in pdf.itertuples(index=False):
            whole[p.y - top : p.y - top + p.h, p.x - left : p.x - left + p.w] = pixels_of(p.h, p.w, p.dtype, p.px)
        ys, xs = K._folded(np.arange(y0 - margin, y1 + margin), height) - top, K._folded(np.arange(x0 - margin, x1 + margin), width) - left
        return f(image, int(y0), int(x0), int(y1 - y0), int(x1 - x0), whole[np.ix_(ys, xs)])

    pieces = few_at_once(sized, cut, "image_id string, gy int, gx int, height int, width int, y int, x int, h int, w int, dtype string, px binary")
    return each_cell(pieces, run, schema)


def filtered(tiles: DataFrame, margin: int, f: Callable[[np.ndarray], np.ndarray | Sequence[np.ndarray]], size: int = 512, names: Sequence[str] | None = None) -> DataFrame:
    """f of every tile with margin pixels around it (see with_margins), cut back to the tile, on a grid of tiles of size.

    A margin as wide as f reaches makes the result that of the whole raster. With names, f gives an array for each, and their rows
    have image ids with "#name" added."""

    def run(image: str, row_off: int, col_off: int, h: int, w: int, whole: np.ndarray) -> pd.DataFrame:
        made = f(whole)
        out = []
        for name, a in zip(names or [None], made if names else [made], strict=True):
            a = np.ascontiguousarray(a[margin : margin + h, margin : margin + w])
            out.append((image if name is None else f"{image}#{name}", row_off, col_off, *a.shape, a.dtype.str, a.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TILE.split(", ")])

    return with_margins(tiles, margin, run, TILE, size)


def sharpened(tiles: DataFrame, size: int = 512) -> DataFrame:
    """kernels.unsharp of whole rasters."""
    return filtered(tiles, 5, lambda a: K.unsharp(a.astype(float)), size)


def _magnitude(a: np.ndarray) -> np.ndarray:
    a, step, smooth = a.astype(float), np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return np.hypot(K._convolved(K._convolved(a, step, 1), smooth, 0), K._convolved(K._convolved(a, step, 0), smooth, 1))


def gradient(tiles: DataFrame, size: int = 512) -> DataFrame:
    """Sobel magnitude over each raster's maximum."""
    raw = written(filtered(tiles, 1, _magnitude, size), "gradient")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "m": [float(pixels_of(*x).max()) for x in zip(pdf["h"], pdf["w"], pdf["dtype"], pdf["px"], strict=True)]})

    most = few_at_once(raw.select("image_id", "h", "w", "dtype", "px"), top, "image_id string, m double").groupBy("image_id").agg(F.max("m").alias("most"))
    return each_tile(raw.join(most, "image_id"), lambda a, m: a / m if m > 0 else a, "most")


def shadow_free(tiles: DataFrame, share: float = 5.0, radius: int = 3, size: int = 512, least: int = 100) -> DataFrame:
    """1 where kernels.shadow_free of the whole raster holds, else 0."""
    q = percentiles(tiles, [share / 100])

    def kinds(a: np.ndarray, n, ends) -> np.ndarray:
        """Bits: 1 for valid pixels, 2 for dark ones, 4 where the raster has too few to tell."""
        if n is None or n != n or n < least:
            return np.full(a.shape, 4, np.uint8)
        return (a > 0).astype(np.uint8) | ((a <= ends[0]).astype(np.uint8) << 1)

    def free(a: np.ndarray) -> np.ndarray:
        dark, grown = (a & 2).astype(bool), np.zeros(a.shape, bool)
        h, w = a.shape
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if dy * dy + dx * dx <= radius * radius and abs(dy) < h and abs(dx) < w:
                    grown[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= dark[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
        return ((a & 1).astype(bool) & ~grown | (a & 4).astype(bool)).astype(np.uint8)

    # A mirrored dark pixel is nearer to the raster than its mirror image, so mirroring grows nothing that the raster itself doesn't.
    return filtered(each_tile(tiles.join(q, "image_id", "left"), kinds, "n", "q"), radius, free, size)


# ---------------------------------------------------------------- structure


@lru_cache(maxsize=4)
def log_gabor(scales: int, shortest: float, factor: float, spread: float, radius: int) -> np.ndarray:
    """Kernels (scales, 2 radius + 1, 2 radius + 1) of isotropic log-Gabor filters, tapered to nothing at radius and without a mean."""
    n = 1 << (4 * radius).bit_length()
    f = np.fft.fftfreq(n)
    at = np.hypot(f[:, None], f[None, :])
    at[0, 0] = 1.0
    y = np.arange(-radius, radius + 1)
    taper = np.cos(np.pi / 2 * np.minimum(1, np.hypot(y[:, None], y[None, :]) / (radius + 1))) ** 2
    out = []
    for s in range(scales):
        gain = np.exp(-np.log(at * shortest * factor**s) ** 2 / (2 * np.log(spread) ** 2))
        gain[0, 0] = 0.0
        k = np.fft.ifft2(gain).real[np.ix_(y, y)] * taper
        out.append(k - taper * k.sum() / taper.sum())
    return np.stack(out)


@lru_cache(maxsize=8)
def _spectra(shape: tuple[int, int], scales: int, shortest: float, factor: float, spread: float, radius: int) -> np.ndarray:
    out = []
    for k in log_gabor(scales, shortest, factor, spread, radius):
        padded = np.zeros(shape)
        padded[: 2 * radius + 1, : 2 * radius + 1] = k
        out.append(np.fft.rfft2(np.roll(padded, (-radius, -radius), (0, 1))))
    return np.stack(out)


def phase_congruency(tiles: DataFrame, scales: int = 4, shortest: float = 6.0, factor: float = 2.1, spread: float = 0.55, noise: float = 2.0, radius: int = 128, size: int = 512) -> DataFrame:
    """Coherence of log-Gabor responses over scales, above a noise floor, as kernels.phase_congruency, with kernels of a finite radius.

    Each tile with a margin of the radius is filtered by Fourier transforms and cut back (overlap-save), so the result depends on no
    cut into tiles. The floor is of the whole raster: the mean of the scales' medians."""

    def responses(a: np.ndarray) -> list[np.ndarray]:
        spectrum = np.fft.rfft2(a.astype(float))
        return list(np.fft.irfft2(spectrum * _spectra(a.shape, scales, shortest, factor, spread, radius), a.shape))

    held = written(filtered(tiles, radius, responses, size, [str(s) for s in range(scales)]), "responses")
    middle = percentiles(each_tile(held, np.abs), [0.5], positive=False)
    image = F.regexp_replace("image_id", "#[0-9]+$", "").alias("image_id")
    floor = middle.groupBy(image).agg((F.sum(F.col("q")[0]) / scales).alias("floor"))

    def coherent(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [pixels_of(t.h, t.w, t.dtype, t.px) for t in pdf.sort_values("scale").itertuples(index=False)]
        energy, total = reduce(np.add, each), reduce(np.add, map(np.abs, each))
        out = np.clip(np.maximum(np.abs(energy) - noise * pdf["floor"].iloc[0], 0) / (total + 1e-9), 0, 1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in (*PLACE, "h", "w")}, "dtype": [out.dtype.str], "px": [out.tobytes()]})

    rows = held.select(F.regexp_extract("image_id", "#([0-9]+)$", 1).cast("int").alias("scale"), image, "row_off", "col_off", "h", "w", "dtype", "px")
    return rows.join(floor, "image_id").groupBy(*PLACE).applyInPandas(coherent, TILE)  # a row for each scale


def structural(tiles: DataFrame, method: str = "phase_congruency", equalise: bool = True, size: int = 512, radius: int = 128, least: int = 100) -> DataFrame:
    """kernels.structural of whole rasters: stretched, equalised over the whole, filtered with margins, 0 in shadows and in rasters of
    under least valid pixels."""
    K.structural(np.zeros((2, 2)), method)  # an unknown method fails here
    base = stretched(tiles)
    base = written(equalised(base, 3.0) if equalise else base, "base")
    parts = []
    if method != "gradient":
        parts.append((phase_congruency(base, radius=radius, size=size), 1.0 if method == "phase_congruency" else 0.6))
    if method != "phase_congruency":
        parts.append((gradient(base, size), 1.0 if method == "gradient" else 0.4))
    enough = percentiles(tiles, [0.5]).where(F.col("n") >= least).select("image_id")
    rows = shadow_free(tiles, size=size).withColumn("weight", F.lit(None).cast("double")).unionByName(reduce(DataFrame.unionByName, [p.withColumn("weight", F.lit(w)) for p, w in parts]))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.ones((int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])))
        total = np.zeros_like(out)
        for t in pdf.itertuples(index=False):
            a = pixels_of(t.h, t.w, t.dtype, t.px)
            if t.weight is None or t.weight != t.weight:
                out = out * a
            else:
                total += t.weight * a
        out = out * total * float(pdf["enough"].iloc[0])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in (*PLACE, "h", "w")}, "dtype": [out.dtype.str], "px": [out.tobytes()]})

    known = rows.join(enough.withColumn("enough", F.lit(1.0)), "image_id", "left").withColumn("enough", F.coalesce("enough", F.lit(0.0)))
    return known.groupBy(*PLACE).applyInPandas(together, TILE)  # a row for each map
