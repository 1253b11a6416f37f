"""Operators on tie points: rows (sx, sy, rx, ry) with a source and a reference place, and a score where one is needed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp, half_even, horner
from tessera.operators.quantiles import by_passes, exact_percentiles, grouped_percentiles, number

# ---------------------------------------------------------------- spread over the scene


def cell(v: Column | str, size: float, cells: int) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return clamp(F.floor(v / F.lit(float(size))), 0, cells - 1).cast("int")


def spatial_entropy(points: DataFrame, x: str, y: str, width: float, height: float, rows: int, cols: int, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits of the points' shares of rows x cols cells; 0 for no points (global) or a single cell."""
    counts = points.groupBy(*by, cell(y, height / rows, rows).alias("cy"), cell(x, width / cols, cols).alias("cx")).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    # -sum(p log p) with p = n / total, from two sums
    h = F.coalesce(F.log2("total") - F.try_divide("nlogn", "total"), F.lit(0.0))
    return sums.select(*by, F.greatest(h, F.lit(0.0)).alias("entropy"))


def image_coverage(points: DataFrame, hull: DataFrame, height: Column, by: Sequence[str]) -> DataFrame:
    """(by, hull_pct, span_pct): how much of an image each group's hull (share, of the image's area) covers, and how much of its rows
    the points span."""
    span = points.groupBy(*by).agg((F.max("sy") - F.min("sy")).alias("__span"), F.any_value(height).alias("__height"))
    return hull.join(span, list(by)).select(*by, (100 * F.col("share")).alias("hull_pct"), F.least(F.lit(100.0), 100 * F.col("__span") / F.col("__height")).alias("span_pct"))


def populated_cells(points: DataFrame, tile: str, least: int = 5) -> DataFrame:
    """How many tiles have least points or more."""
    return points.groupBy(tile).count().where(F.col("count") >= least).agg(F.count("*").alias("populated"))


def active_cells(valid_pixels: DataFrame, rows: int, cols: int, height: int, width: int, least_share: float = 0.01) -> DataFrame:
    """(active, max_entropy) of pixels (row, col, ok): cells of which over least_share is valid."""
    share = valid_pixels.groupBy(F.floor(F.col("row") * rows / height).alias("gr"), F.floor(F.col("col") * cols / width).alias("gc")).agg(F.avg(F.col("ok").cast("double")).alias("share"))
    return share.agg(F.count(F.when(F.col("share") > least_share, 1)).alias("active")).select("active", F.log2(F.greatest("active", F.lit(2))).alias("max_entropy"))


# ---------------------------------------------------------------- robust filters


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), passes: bool | None = None) -> DataFrame:
    """med_* of each column. passes: by passes of binned counts, for groups too large for one aggregate's state; unless told, large
    tables go that way."""
    if by_passes(df, passes, by):
        if not by:
            return df.sparkSession.range(1).select(*(F.lit(exact_percentiles(df, c, (0.5,))[0]).cast("double").alias(f"med_{c}") for c in columns))
        each = [grouped_percentiles(df, c, (0.5,), by).withColumnRenamed("q0", f"med_{c}") for c in columns]
        return reduce(lambda a, b: a.join(b, list(by)), each)
    return df.groupBy(*by).agg(*(F.median(number(c)).alias(f"med_{c}") for c in columns))


def _beside(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """stats has one row, or one for each group: a broadcast of a row, or an equi-join."""
    return df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))


def mad_inliers(df: DataFrame, columns: Sequence[str], floor: float, factor: float = 3.0, by: Sequence[str] = (), passes: bool | None = None) -> DataFrame:
    """Rows within max(factor * MAD, floor) of the median on all columns; passes as for medians(). A row with a NaN or null stays
    out."""
    passes = by_passes(df, passes, by)
    held = _beside(df, medians(df, columns, by, passes), by)
    away = held.withColumns({f"dev_{c}": F.abs(F.col(c) - F.col(f"med_{c}")) for c in columns})
    devs = medians(away, [f"dev_{c}" for c in columns], by, passes)
    kept = _beside(away, devs.withColumnsRenamed({f"med_dev_{c}": f"mad_{c}" for c in columns}), by)
    for c in columns:
        kept = kept.where(F.col(f"dev_{c}") <= F.greatest(F.lit(factor) * F.col(f"mad_{c}"), F.lit(floor)))
    return kept.select(*df.columns)


def confidence_filter(df: DataFrame, by: str, high: float = 0.25, low: float = 0.18, least: int = 8) -> DataFrame:
    """Per group, scores from high on if that leaves least points, else from low on."""
    n_high = F.count_if(F.col("score") >= high).over(Window.partitionBy(by))
    return df.withColumn("n_high", n_high).where(F.col("score") >= F.when(F.col("n_high") >= least, high).otherwise(low)).drop("n_high")


def drift_filter(df: DataFrame, slope: tuple[float, float], intercept: tuple[float, float], height: float, confidence: float, bounds: tuple[float, float] = (180.0, 400.0), least: int = 15) -> DataFrame:
    """Points whose offset is near the drift model's, on both axes; all points if fewer than least would stay, if the model's
    confidence is 0.05 or less, or if it says nothing."""
    if confidence <= 0.05 or not any((*slope, *intercept)):
        return df
    most = max(bounds[0], min(bounds[1], 0.015 * height))
    near = (F.abs(F.col("rx") - F.col("sx") - (slope[0] * F.col("sy") + intercept[0])) <= most) & (F.abs(F.col("ry") - F.col("sy") - (slope[1] * F.col("sy") + intercept[1])) <= most)
    flagged = df.withColumn("near", near)
    enough = flagged.agg((F.count_if("near") >= least).alias("enough"))
    return _beside(flagged, enough, ()).where("near or not enough").select(*df.columns)


def stratified_consensus(df: DataFrame, y: str, err: str, tiebreak: Sequence[str], bins: int = 6, floor: float = 0.80, ceiling: float = 1.80, least: int = 6, most: int = 25, passes: bool | None = None) -> DataFrame:
    """Along y in equal-width bins, the rows with the smallest err: those within a cutoff of median and MAD, at least least and
    at most most in each bin. bin and rank_in_bin are added."""
    span = df.agg(F.min(y).alias("y0"), F.max(y).alias("y1"))
    held = _beside(df, span, ()).withColumn("bin", F.coalesce(clamp(F.floor(F.try_divide(F.col(y) - F.col("y0"), (F.col("y1") - F.col("y0")) / bins)), 0, bins - 1), F.lit(0)).cast("int"))
    many = by_passes(df, passes)
    med = medians(held, [err], ["bin"], many).withColumnRenamed(f"med_{err}", "med")
    away = held.join(F.broadcast(med), "bin").withColumn("__dev", F.abs(F.col(err) - F.col("med")))  # a row for each bin
    mad = medians(away, ["__dev"], ["bin"], many).withColumnRenamed("med___dev", "mad")
    ranked = away.join(F.broadcast(mad), "bin").withColumn("rank_in_bin", F.row_number().over(Window.partitionBy("bin").orderBy(err, *tiebreak)))
    cut = clamp(F.col("med") + 1.5 * 1.4826 * F.col("mad"), floor, ceiling)
    return ranked.where(((F.col(err) <= cut) | (F.col("rank_in_bin") <= least)) & (F.col("rank_in_bin") <= most)).select(*df.columns, "bin", "rank_in_bin")


def spike_filter(df: DataFrame, err: str, most: float = 1.15, least: int = 15, again: int = 25, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows with err up to most, if at least least stay; else the again best rows."""
    kept = df.where(F.col(err) <= most)
    return kept if kept.count() >= least else df.orderBy(err, *tiebreak).limit(again)


#: Rows of a bucket that uniform_subsample() aims at, and its most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 4096


def uniform_subsample(df: DataFrame, order: Sequence[str], most: int = 800) -> DataFrame:
    """Rows floor(i * N / most) for i < most in the given order; all rows if there are no more. Rows that the order doesn't tell
    apart go by a hash of all they hold.

    A row's bucket is what its keys say between fixed bounds, found by binary search, and its rank is its bucket's first rank, from
    counts, plus its place in the bucket: neither depends on how the rows are partitioned. The bounds come from a small sample and
    only need to be about even."""
    n = df.count()
    if n <= most:
        return df
    hashable = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    ranked = df.withColumn("__tie", F.xxhash64(*hashable))
    keys = [*order, "__tie"]
    levels = min(MOST_BUCKETS, -(-n // BUCKET_ROWS)).bit_length() - 1 if n > BUCKET_ROWS else 0
    buckets = 1 << levels
    bucket = F.lit(0)
    if levels:
        rows = sorted((r["k"] for r in ranked.select(F.struct(*keys).alias("k")).sample(min(1.0, 30.0 * buckets / n), seed=1).collect()), key=lambda r: [(x is not None, x) for x in r])
        if len(rows) >= buckets:
            kind = ranked.select(F.struct(*keys).alias("k")).dtypes[0][1]
            bounds = F.array(*(F.struct(*(F.lit(v) for v in rows[len(rows) * k // buckets])).cast(kind) for k in range(1, buckets)))
            bucket = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(levels)))), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.struct(*keys), at + step).otherwise(at))
    held = ranked.withColumn("__b", bucket)
    first, starts = 0, []
    for b, size in sorted((r[0], r[1]) for r in held.groupBy("__b").count().collect()):  # a row for each bucket
        starts.append((b, first))
        first += size
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)) - 1
    at = F.create_map(*(F.lit(v) for pair in starts for v in pair))[F.col("__b")] + place
    ranks = held.withColumn("__r", at.cast("long"))
    # Rank r is taken if r = floor(i n / most) for an i; the only i that can be is ceil(r most / n).
    i = F.ceil(F.col("__r") * F.lit(most) / F.lit(n))
    return ranks.where((i < most) & (F.floor(i * F.lit(n) / F.lit(most)) == F.col("__r"))).select(*df.columns)


def border_reject(df: DataFrame, half: int, source: tuple[int, int], reference: tuple[int, int]) -> DataFrame:
    """Points whose patch of 2 * half pixels lies inside both images (height, width); places are rounded half to even."""
    ok = F.lit(True)
    for x, y, (h, w) in (("sx", "sy", source), ("rx", "ry", reference)):
        a, b = half_even(F.col(x)), half_even(F.col(y))
        ok = ok & (a - half >= 0) & (a + half <= w) & (b - half >= 0) & (b + half <= h)
    return df.where(ok)


def snapped(df: DataFrame) -> DataFrame:
    """A refined point: the source is its rounded place, the reference its rounded place plus the offset (ox, oy)."""
    return df.select(half_even(F.col("sx")).cast("double").alias("sx"), half_even(F.col("sy")).cast("double").alias("sy"), (half_even(F.col("rx")) + F.col("ox")).alias("rx"), (half_even(F.col("ry")) + F.col("oy")).alias("ry"), "score")


def ecc_threshold(source: Column, reference: Column) -> Column:
    return F.when(source == reference, 0.60).otherwise(0.45)


# ---------------------------------------------------------------- tiles


def axis_tiles(n: int, size: int, step: int, least: int = 200) -> list[tuple[int, int, int, int, int]]:
    """(index, start, end, core's start, core's end) of an axis's overlapping tiles. Tiles smaller than least are left out; if none is
    left the whole axis is one. Where the last two cores would overlap, the later one begins where the earlier ends."""
    margin = max(0, (size - step) // 2)
    starts = [s for s in range(0, n, step) if min(s + size, n) - s >= least] or [0]
    out, last = [], 0
    for s in starts:
        e = min(s + size, n)
        c0, c1 = (0 if s == 0 else s + margin), (n if e >= n or s == starts[-1] else e - margin)
        c0 = max(c0, last)
        last = max(last, c1)
        out.append((len(out), s, e, c0, c1))
    return out


def tile_grid(spark: SparkSession, height: int, width: int, size: int, step: int, least: int = 200) -> DataFrame:
    """Overlapping tiles with exclusive cores: the tiles of both axes."""
    ys, xs = axis_tiles(height, size, step, least), axis_tiles(width, size, step, least)
    cols = ("i", "0", "1", "core0", "core1")
    frame = lambda rows, a: spark.createDataFrame(rows, ", ".join(f"{a}{c} int" for c in cols))
    tiles = frame(ys, "y").crossJoin(F.broadcast(frame(xs, "x")))  # one axis's tiles
    return tiles.withColumn("tile_id", F.col("yi") * len(xs) + F.col("xi")).drop("yi", "xi")


def tile_grids(images: DataFrame, size: int, step: int, least: int = 200) -> DataFrame:
    """tile_grid() for a table of images (height, width and others), in column expressions: their columns with tile_id, x0, x1, y0, y1 and
    the cores (xcore0, xcore1, ycore0, ycore1)."""
    margin = max(0, (size - step) // 2)

    def axis(n: str) -> Column:
        n = F.col(n)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: F.least(s + size, n) - s >= least)
        starts = F.when(F.size(starts) == 0, F.array(F.lit(0))).otherwise(starts)

        def tile(s: Column, k: Column) -> Column:
            end, before = F.least(s + size, n), F.least(s - step + size, n)
            low = F.when(k == 0, 0).otherwise(F.greatest(s + margin, F.when(before >= n, n).otherwise(before - margin)))
            high = F.when((end >= n) | (k == F.size(starts) - 1), n).otherwise(end - margin)
            return F.struct(k.cast("int").alias("k"), s.cast("int").alias("a"), end.cast("int").alias("b"), low.cast("int").alias("c"), high.cast("int").alias("d"))

        return F.transform(starts, tile)

    both = images.withColumn("__xs", axis("width")).withColumn("__y", F.explode(axis("height"))).withColumn("__x", F.explode("__xs"))
    names = (("a", "0"), ("b", "1"), ("c", "core0"), ("d", "core1"))
    places = [F.col(f"__{v}.{k}").alias(f"{v}{n}") for v in "xy" for k, n in names]
    return both.select(*images.columns, (F.col("__y.k") * F.size("__xs") + F.col("__x.k")).alias("tile_id"), *places)


def in_core(points: DataFrame, size: int, step: int, height: int, width: int, least: int = 200) -> DataFrame:
    """points (sx, sy), each with the one tile of tile_grid() (tile_id) whose core holds it; those that none holds are left out.
    An axis's tile is guessed by arithmetic and is that one or one beside it, so nothing is joined."""

    def tile(v: str, n: int) -> tuple[Column, int]:
        tiles, margin = axis_tiles(n, size, step, least), max(0, (size - step) // 2)
        low, high = (F.array(*(F.lit(float(t[k])) for t in tiles)) for k in (3, 4))
        guess = F.floor((F.col(v) - margin) / F.lit(float(step))).cast("int")
        guess = clamp(guess, 0, len(tiles) - 1).cast("int")
        held = F.filter(F.array(guess - 1, guess, guess + 1), lambda k: (k >= 0) & (F.get(low, k) <= F.col(v)) & (F.col(v) < F.get(high, k)))
        return F.get(held, 0), len(tiles)

    (ty, _), (tx, across) = tile("sy", height), tile("sx", width)
    return points.withColumn("tile_id", ty * across + tx).where("tile_id is not null")


def fixed_grid(spark: SparkSession, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """rows x cols tiles; the last of a row or column takes what is left."""
    cells = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    th, tw = height // rows, width // cols
    end = lambda k, n, size, whole: F.when(F.col(k) == n - 1, F.lit(whole)).otherwise((F.col(k) + 1) * size)
    return cells.select((F.col("r") * cols + F.col("c")).alias("tile_id"), (F.col("r") * th).alias("y0"), end("r", rows, th, height).alias("y1"), (F.col("c") * tw).alias("x0"), end("c", cols, tw, width).alias("x1"))


def fixed_grids(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """fixed_grid() for a table of images (height, width and others)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("tile_id")
    cells = images.select("*", k).withColumns({"__r": F.floor(F.col("tile_id") / cols), "__c": F.col("tile_id") % cols, "__h": F.floor(F.col("height") / rows), "__w": F.floor(F.col("width") / cols)})
    end = lambda k, n, size, whole: F.when(F.col(k) == n - 1, F.col(whole)).otherwise((F.col(k) + 1) * F.col(size)).cast("int")
    return cells.select(*images.columns, "tile_id", (F.col("__r") * F.col("__h")).cast("int").alias("y0"), end("__r", rows, "__h", "height").alias("y1"), (F.col("__c") * F.col("__w")).cast("int").alias("x0"), end("__c", cols, "__w", "width").alias("x1"))


def core_assignment(points: DataFrame, x: Column, y: Column, size: int, step: int, height: int, width: int) -> DataFrame:
    """points with the tile (tx, ty) whose core holds them: arithmetic instead of a join, each point once."""
    margin = (size - step) // 2

    def tile(v: Column, n: int) -> Column:
        last = max(0, -(-(n - size) // step)) if n > size else 0
        return clamp(F.floor((v - margin) / F.lit(float(step))), 0, last).cast("int")

    return points.withColumns({"tx": tile(x, width), "ty": tile(y, height)})


def search_windows(tiles: DataFrame, slope: tuple, intercept: tuple, padding: int, height: int | Column, width: int | Column) -> DataFrame:
    """Each tile's window in the reference: moved by the drift at its middle row, padded, clamped; empty ones are left out. Slopes,
    intercepts and sizes are numbers, or columns of the tiles."""
    middle = (F.col("y0") + F.col("y1")) / 2.0
    dx, dy = slope[0] * middle + intercept[0], slope[1] * middle + intercept[1]
    out = tiles.withColumns({
        "wx0": F.greatest(F.lit(0), half_even(F.col("x0") + dx) - padding),
        "wy0": F.greatest(F.lit(0), half_even(F.col("y0") + dy) - padding),
        "wx1": F.least(F.lit(width), half_even(F.col("x1") + dx) + padding),
        "wy1": F.least(F.lit(height), half_even(F.col("y1") + dy) + padding),
    })
    return out.where("wx1 > wx0 and wy1 > wy0")


def tile_and_step(height: Column, size: int, step: int) -> tuple[Column, Column]:
    tall = (height > 3500) & F.lit(step > 800)
    return F.when(tall, min(size, 1200)).otherwise(size), F.when(tall, 800).otherwise(step)


def padding(confidence: Column, drift: Column, height: Column, base: int = 200) -> Column:
    by_height = F.least(F.lit(1200), F.greatest(F.lit(max(base, 600)), F.floor(0.04 * height).cast("int")))
    return F.when(confidence < 0.05, min(max(base, 700), 1200)).when(confidence < 0.15, min(max(base, 500), 1000)).when((drift > 800) | (height > 8000), by_height).otherwise(base)


# ---------------------------------------------------------------- drift


def drift_regression(df: DataFrame, row: str = "sy", by: Sequence[str] = (), passes: bool | None = None) -> DataFrame:
    """Slope and intercept of the offsets (dx, dy) on a row, with the number of points, means and medians (as medians() finds them)."""
    dx, dy = F.col("rx") - F.col("sx"), F.col("ry") - F.col("sy")
    if by_passes(df, passes, by):
        held = df.withColumns({"dx": dx, "dy": dy})
        med = medians(held, ["dx", "dy"], by, True).withColumnsRenamed({"med_dx": "dx_median", "med_dy": "dy_median"})
        lines = held.groupBy(*by).agg(F.count("*").alias("n"), *(f(c, row).alias(f"{c}_{n}") for c in ("dx", "dy") for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))))
        return _beside(lines, med, by)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(dx, F.col(row)).alias("dx_slope"), F.regr_intercept(dx, F.col(row)).alias("dx_intercept"),
        F.regr_slope(dy, F.col(row)).alias("dy_slope"), F.regr_intercept(dy, F.col(row)).alias("dy_intercept"),
        F.median(dx).alias("dx_median"), F.median(dy).alias("dy_median"),
    )


def capped_drift(model: DataFrame, cap: float = 0.15) -> DataFrame:
    """The regression, or the constant medians where a slope is missing or over cap."""
    bad = F.col("dx_slope").isNull() | F.col("dy_slope").isNull() | F.isnan("dx_slope") | F.isnan("dy_slope") | (F.abs("dx_slope") > cap) | (F.abs("dy_slope") > cap)
    pick = lambda a, b: F.when(bad, b).otherwise(F.col(a)).alias(a)
    others = [c for c in model.columns if c not in ("dx_slope", "dy_slope", "dx_intercept", "dy_intercept")]
    return model.select(*others, pick("dx_slope", F.lit(0.0)), pick("dx_intercept", F.col("dx_median")), pick("dy_slope", F.lit(0.0)), pick("dy_intercept", F.col("dy_median")))


def strip_samples(spark: SparkSession, height: int, strips: int = 10, patch: int = 2048) -> DataFrame:
    """Middle rows of equal strips, and each patch's rows clamped into the image."""
    middle = F.floor((F.col("id") + 0.5) * height / strips).cast("int")
    size = min(patch, height)
    top = F.greatest(F.lit(0), F.least(F.lit(height - size), middle - size // 2))
    return spark.range(strips).select(F.col("id").cast("int").alias("strip_idx"), middle.alias("row"), top.alias("y0"), (top + size).alias("y1"))


def strips_of(images: DataFrame, strips: int = 10, patch: int = 2048) -> DataFrame:
    """strip_samples() for a table of images (height and others)."""
    held = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip_idx")).withColumn("row", F.floor((F.col("strip_idx") + 0.5) * F.col("height") / strips).cast("int"))
    size = F.least(F.lit(patch), F.col("height"))
    top = F.greatest(F.lit(0), F.least(F.col("height") - size, F.col("row") - F.floor(size / 2))).cast("int")
    return held.select(*images.columns, "strip_idx", "row", top.alias("y0"), (top + size).cast("int").alias("y1"))


def arbitrate(strips: DataFrame, agreement: float = 30.0, dominance: float = 2.0, least_votes: int = 4, forced: bool = False) -> DataFrame:
    """Per strip which of two offsets counts: votes (vdx, vdy, votes) where they are forced, agree with the other or are many;
    else Fourier (fdx, fdy, response)."""
    apart = F.hypot(F.col("vdx") - F.col("fdx"), F.col("vdy") - F.col("fdy"))
    enough = F.col("votes") >= least_votes
    method = F.when(F.lit(forced) & enough, "votes").when(enough & (apart <= agreement), "agreed").when(F.col("votes") >= dominance * least_votes, "votes_dominant").otherwise("fourier")
    out = strips.withColumn("method_used", method)
    fourier = F.col("method_used") == "fourier"
    return out.withColumns({"dx": F.when(fourier, F.col("fdx")).otherwise(F.col("vdx")), "dy": F.when(fourier, F.col("fdy")).otherwise(F.col("vdy"))})


def strip_summary(strips: DataFrame) -> DataFrame:
    used = F.bool_or(F.col("method_used") != "fourier")
    return strips.agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.avg("response").alias("confidence"), F.when(used, "hybrid").otherwise("fourier").alias("method_used"))


# ---------------------------------------------------------------- polynomial layer


def poly_moments(df: DataFrame, y: Column, targets: Sequence[Column], degree: int) -> DataFrame:
    """One row of sums from which the normal equations of a polynomial fit are solved, however many points there are."""
    sums = [F.sum(F.pow(y, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)]
    return df.agg(*sums, *(F.sum(t * F.pow(y, F.lit(k))).alias(f"t{i}_{k}") for i, t in enumerate(targets) for k in range(degree + 1)))


def solve_moments(row, degree: int, n_targets: int) -> list[list[float]]:
    """Coefficients of each target, highest power first, of a row of poly_moments()."""
    a = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return [np.linalg.lstsq(a, np.array([row[f"t{t}_{k}"] for k in range(degree + 1)], float), rcond=None)[0][::-1].tolist() for t in range(n_targets)]


def cluster_count(df: DataFrame, y: str) -> DataFrame:
    """Different tenths of a deviation that y takes: how many rows a polynomial can rely on."""
    stats = df.agg(F.avg(y).alias("m"), F.greatest(F.lit(1.0), F.stddev_pop(y)).alias("s"))
    return _beside(df, stats, ()).agg(F.countDistinct(F.rint((F.col(y) - F.col("m")) / F.col("s") * 10.0)).alias("clusters"))


def effective_degree(degree: int, clusters: int, span_share: float) -> int:
    """No more than the clusters carry, and none where the points span under a quarter of the scene."""
    return 0 if span_share < 0.25 else min(degree, max(0, clusters - 1))


def predict(df: DataFrame, affine_row: Sequence[float], px: Sequence[float], py: Sequence[float], y_mean: float, y_std: float) -> DataFrame:
    """df with (px, py): the affine layer plus polynomials of the normalised row."""
    a, b, c, d, e, f = map(float, affine_row)
    yn = (F.col("sy") - y_mean) / y_std
    poly = lambda cs: horner(F.array(*(F.lit(float(v)) for v in cs)), yn)
    return df.withColumns({"px": a * F.col("sx") + b * F.col("sy") + c + poly(px), "py": d * F.col("sx") + e * F.col("sy") + f + poly(py)})


def layer_rmse(df: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return df.agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"))


# ---------------------------------------------------------------- verification


def residual_stats(df: DataFrame, clip: float = 3.0, by: Sequence[str] = (), passes: bool | None = None) -> DataFrame:
    """Of residuals (dx, dy): medians, MADs, inliers within clip of the median, and RMSE, mean and maximum of the distance over
    inliers (all points where there are none)."""
    many = by_passes(df, passes, by)
    held = _beside(df, medians(df, ("dx", "dy"), by, many), by).withColumn("dist", F.hypot("dx", "dy"))
    inlier = F.hypot(F.col("dx") - F.col("med_dx"), F.col("dy") - F.col("med_dy")) <= clip
    held = held.withColumn("inlier", inlier)
    pick = lambda f, x: F.coalesce(f(F.when(F.col("inlier"), x)), f(x))
    mads = {"mad_dx": F.abs(F.col("dx") - F.col("med_dx")), "mad_dy": F.abs(F.col("dy") - F.col("med_dy"))}
    if many:
        away = medians(held.withColumns(mads), list(mads), by, True).withColumnsRenamed({f"med_{c}": c for c in mads})
        held, mad = _beside(held, away, by), [F.first(c).alias(c) for c in mads]
    else:
        mad = [F.median(x).alias(c) for c, x in mads.items()]
    return held.groupBy(*by).agg(
        F.count("*").alias("total_count"), F.count_if("inlier").alias("inlier_count"),
        F.first("med_dx").alias("median_dx"), F.first("med_dy").alias("median_dy"), *mad,
        F.sqrt(pick(F.avg, F.col("dist") * F.col("dist"))).alias("rmse"), pick(F.avg, F.col("dist")).alias("mean_err"), pick(F.max, F.col("dist")).alias("max_err"),
    )


def effective_rmse(rmse: Column, cross_validated: Column) -> Column:
    return F.greatest(rmse, F.coalesce(cross_validated, rmse))


def composite_score(rmse: Column, entropy_share: Column, inlier_ratio: Column, inliers: Column, hull: Column) -> Column:
    unit = lambda x: clamp(x, 0.0, 1.0)
    return 0.40 * unit(1 - rmse / 1.5) + 0.25 * unit(entropy_share) + 0.20 * unit(F.greatest(inlier_ratio, inliers / 40.0)) + 0.15 * unit(hull / 0.20)


def verdict(inliers: Column, hull: Column, entropy: Column, rmse: Column, score: Column, measured: Column | None = None, target: float = 0.5) -> Column:
    """Gates in order; the first that fails decides."""
    v = (
        F.when(inliers < 10, "REJECTED (Insufficient Inliers)")
        .when(hull * 100.0 < 5.0, "REJECTED (Poor Spatial Coverage)")
        .when(entropy < 1.0, "REJECTED (Clustered Matches)")
        .when(rmse >= 1.0, "REJECTED (RMSE Out of Bounds)")
        .when(rmse < target, "VERIFIED_SUCCESS")
        .when(score >= 0.50, "VERIFIED (Sub-Pixel Target Met)")
        .otherwise("UNCERTAIN")
    )
    return v if measured is None else F.when(measured, v).otherwise("UNCERTAIN (No valid tie-point model residuals)")


def precision_tier(rmse: Column) -> Column:
    return F.when(rmse < 0.2, "<0.2px").when(rmse < 0.5, "<0.5px").when(rmse < 1.0, "<1.0px").otherwise(">=1.0px")


def rmse_metres(rmse: Column, gsd: Column, metric: Column, measured: Column) -> Column:
    return F.when(metric & measured, rmse * gsd)


def override_counts(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Counts from the model (inlier_count, total_points) where it has them; the clipped count stays beside as clipped_count."""
    m = model.select(F.col("inlier_count").alias("m_in"), F.col("total_points").alias("m_all"))
    has = F.coalesce(F.col("m_all") > 0, F.lit(False))
    out = _beside(stats.withColumnRenamed("inlier_count", "clipped_count"), m, ())
    return out.withColumns({"inlier_count": F.when(has, F.col("m_in")).otherwise(F.col("clipped_count")), "inlier_ratio": F.when(has, F.col("m_in") / F.col("m_all")).otherwise(F.col("clipped_count") / F.col("total_count"))}).drop("m_in", "m_all")


# ---------------------------------------------------------------- votes


def radius_votes(source: DataFrame, reference: DataFrame, most_offset: float, bin_size: float = 4.0, tolerance: float = 0.25, by: Sequence[str] = ()) -> DataFrame:
    """Votes for offsets (bx, by, votes) by pairs of circles (cx, cy, r) whose radii differ by up to tolerance of the larger and
    that lie less than most_offset apart on both axes; by: keys that both circles of a pair share.

    Equal circles are one row with their number first, and a pair of rows votes by the product, so copies aren't expanded. Both
    sides are keyed by the radius's logarithmic bucket and by a grid cell most_offset wide; one side also visits the neighbouring
    buckets and cells, which hold every circle that can pair. So the pairs come from an equi-join, not from a nested loop (and
    not from a broadcast, as neither side is bounded), and votes are summed before they move. Radii up to 1 share the lowest
    buckets, as the tolerance is relative to at least 1."""
    width = -np.log(1 - tolerance)
    bucket = lambda r: F.floor(F.log(F.greatest(r, F.lit(1.0 - tolerance))) / F.lit(float(width))).cast("int")
    s = source.groupBy(*by, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("r").cast("double").alias("ar")).agg(F.count("*").alias("an"))
    t = reference.groupBy(*by, F.col("cx").alias("bx0"), F.col("cy").alias("by0"), F.col("r").cast("double").alias("br")).agg(F.count("*").alias("bn"))
    grid = lambda v: F.floor(v / F.lit(float(most_offset)))
    near = F.array(*(F.struct((bucket(F.col("ar")) + d).alias("k"), (grid(F.col("ax")) + i).alias("gx"), (grid(F.col("ay")) + j).alias("gy")) for d in (-1, 0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    s = s.select(*by, "ax", "ay", "ar", "an", F.inline(near))
    t = t.withColumns({"k": bucket(F.col("br")), "gx": grid(F.col("bx0")), "gy": grid(F.col("by0"))})
    dx, dy = F.col("bx0") - F.col("ax"), F.col("by0") - F.col("ay")
    pairs = s.hint("merge").join(t, [*by, "k", "gx", "gy"]).where((F.abs(F.col("ar") - F.col("br")) <= tolerance * F.greatest("ar", "br", F.lit(1.0))) & (F.abs(dx) < most_offset) & (F.abs(dy) < most_offset))
    n = int(2 * most_offset / bin_size)
    place = lambda d: F.least(F.floor((d + most_offset) / bin_size), F.lit(n - 1)).cast("int")
    return pairs.groupBy(*by, place(dx).alias("bx"), place(dy).alias("by")).agg(F.sum(F.col("an") * F.col("bn")).alias("votes"))


def vote_peak(votes: DataFrame, most_offset: float, bin_size: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """The middle of the fullest bin (of each by); of equal ones the first by row, then column."""
    order = F.struct(F.col("votes"), (-F.col("by")).alias("by"), (-F.col("bx")).alias("bx"))
    best = votes.groupBy(*by).agg(F.max(order).alias("b")).where("b is not null").select(*by, F.col("b.votes").alias("votes"), (-F.col("b.by")).alias("by"), (-F.col("b.bx")).alias("bx"))
    middle = lambda k: -most_offset + F.col(k) * bin_size + bin_size / 2.0
    return best.select(*by, middle("bx").alias("dx"), middle("by").alias("dy"), "votes")


def match_groups(df: DataFrame, size: int = 1200, margin: int = 250) -> DataFrame:
    """Matches by source cell, with the reference box around each cell's points."""
    k = lambda c: F.floor(F.col(c) / size).cast("int")
    return df.groupBy(k("sx").alias("gx"), k("sy").alias("gy")).agg(
        F.count("*").alias("n"), (F.min("rx") - margin).alias("x0"), (F.max("rx") + margin).alias("x1"), (F.min("ry") - margin).alias("y0"), (F.max("ry") + margin).alias("y1")
    )
