"""Operators on rasters in long form: rows (image_id or other keys, row, col, v)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp, valid
from tessera.operators.quantiles import by_passes, exact_percentiles, grouped_percentiles, number

#: Fixed values of the push-frame instrument's colour mode: lines of a frame, and the lines of each band in it, by index and by
#: wavelength in nm.
FRAME_LINES = 78
BAND_LINES = {1: (0, 4), 2: (4, 8), 3: (8, 22), 4: (22, 36), 5: (36, 50), 6: (50, 64), 7: (64, 78), 321: (0, 4), 360: (4, 8), 415: (8, 22), 566: (22, 36), 604: (36, 50), 643: (50, 64), 689: (64, 78)}
#: First wavelength (nm) and step of the imaging spectrometer's bands.
FIRST_NM, STEP_NM = 800.0, 16.5


def wavelength(band: Column) -> Column:
    return F.lit(FIRST_NM) + F.lit(STEP_NM) * band


def histogram_entropy(df: DataFrame, by: Sequence[str], v: str = "v", bins: int = 64, least: int = 100) -> DataFrame:
    """Bits of entropy of each group's valid values in equal bins between their minimum and maximum; 0 under least values or
    if all are the same."""
    ok = df.where(valid(v))
    span = ok.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))
    k = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(v) - F.col("lo"), (F.col("hi") - F.col("lo")) / bins))), F.lit(0))
    counts = ok.join(span, list(by)).groupBy(*by, k.alias("k")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    p = F.col("c") / F.col("n")
    h = counts.groupBy(*by).agg(F.first("n").alias("n"), (-F.sum(p * F.log2(p)) + 0.0).alias("h"))
    return h.select(*by, F.when(F.col("n") < least, 0.0).otherwise(F.col("h") + 0.0).alias("entropy"))


def band_scores(df: DataFrame, band: str, nm: Column, target_nm: float, least: int = 100) -> DataFrame:
    """(band, score, rank) of each band with enough valid values: spread, entropy and nearness to a wavelength; equal scores
    go by band."""
    ok = df.where(valid("v"))
    spread = ok.groupBy(band).agg(F.stddev_pop("v").alias("sd"), F.count("*").alias("n"), F.first(nm).alias("nm"))
    both = spread.where(F.col("n") >= least).join(histogram_entropy(df, [band], least=least), band)
    score = 0.4 * F.col("sd") + 3.0 * F.col("entropy") + 30.0 / (1.0 + F.abs(F.col("nm") - target_nm) / 500.0)
    scored = both.select(band, score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), band)))  # a row for each band


def pseudo_pan(df: DataFrame, bands: int = 10) -> DataFrame:
    """The mean over the first bands of each pixel's valid values, 0 where none is."""
    return df.where(F.col("band") < bands).groupBy("row", "col").agg(F.coalesce(F.avg(F.when(valid("v"), F.col("v"))), F.lit(0.0)).alias("v"))


def deinterleave(lines: DataFrame, band: int = 7, mode: str = "COLOR") -> DataFrame:
    """One band's rows of a push-frame stream (line, sample, v): (frame, k, row, sample, v). An unknown band is the last one."""
    if mode != "COLOR":
        raise ValueError(f"frames of mode {mode} are not laid out in {FRAME_LINES} lines")
    lo, hi = BAND_LINES.get(band, BAND_LINES[7])
    k = F.pmod(F.col("line"), F.lit(FRAME_LINES))
    frame = F.floor(F.col("line") / FRAME_LINES).cast("long")
    return lines.where(k.between(lo, hi - 1)).select(frame.alias("frame"), (k - lo).alias("k"), (frame * (hi - lo) + k - lo).alias("row"), "sample", "v")


def flat_field(df: DataFrame, phase: str = "k", v: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """v divided by its row phase's mean over the mean of all phases' means; a ratio of 0 counts as 1. by: the keys of images,
    each of which has means of its own."""
    means = df.groupBy(*by, phase).agg(F.avg(v).alias("phase_mean"))
    ratios = means.withColumn("grand", F.avg("phase_mean").over(Window.partitionBy(*by, F.lit(0)))).select(*by, phase, F.when(F.col("grand") > 0, F.coalesce(F.nullif(F.col("phase_mean") / F.col("grand"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("ratio"))
    if not by:
        ratios = F.broadcast(ratios)  # at most a row for each line of a frame
    return df.join(ratios, [*by, phase]).withColumn(v, F.col(v) / F.col("ratio")).drop("ratio")


def feather_seams(df: DataFrame, band_rows: int, order: str = "row", by: str | Sequence[str] = "sample", v: str = "v") -> DataFrame:
    """The last row of a frame and the first of the next, each mixed with the other as it was (3 : 1). by: the sample, and the
    image where there are several."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)
    before, after, k = F.lag(v).over(w), F.lead(v).over(w), F.pmod(F.col(order), F.lit(band_rows))
    mixed = F.when((k == band_rows - 1) & after.isNotNull(), 0.75 * F.col(v) + 0.25 * after).when((k == 0) & before.isNotNull(), 0.25 * before + 0.75 * F.col(v)).otherwise(F.col(v))
    return df.withColumn(v, mixed) if band_rows >= 2 else df


def to_byte(v: Column) -> Column:
    """Clipped to a byte, then truncated."""
    return clamp(v, 0.0, 255.0).cast("int")


def percentile_stretch(df: DataFrame, low: float = 0.02, high: float = 0.98, least: int = 100, by: Sequence[str] = (), high_of_all: bool = False, passes: bool | None = None) -> DataFrame:
    """v from its low to its high percentile as a byte (u8): percentiles of valid values, the high one of all values if
    high_of_all. Groups with under least valid values are only clipped. passes: percentiles by passes of binned counts, where one
    aggregate's state can't hold a group's different values; unless told, large tables go that way."""
    q = lambda x, share: F.percentile(number(x), F.lit(share))
    ok = F.when(valid("v"), F.col("v"))
    passes = by_passes(df, passes, by)
    if passes and by:
        only = df.where(valid("v"))
        lo, hi = (grouped_percentiles(x, "v", (share,), by).withColumnRenamed("q0", n) for x, share, n in ((only, low, "lo"), (df if high_of_all else only, high, "hi")))
        stats = df.groupBy(*by).agg(F.count(ok).alias("n")).join(lo, list(by), "left").join(hi, list(by), "left")
    elif passes:
        only = df.where(valid("v"))
        (lo,), (hi,) = exact_percentiles(only, "v", (low,)), exact_percentiles(df if high_of_all else only, "v", (high,))
        stats = df.agg(F.count(ok).alias("n")).select(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), "n")
    else:
        stats = df.groupBy(*by).agg(q(ok, low).alias("lo"), q(F.col("v") if high_of_all else ok, high).alias("hi"), F.count(ok).alias("n"))
    held = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    scaled = clamp((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 0.0, 1.0) * 255.0
    return held.select(*df.columns, F.when(F.col("n") < least, to_byte(F.coalesce(F.col("v"), F.lit(0.0)))).otherwise(F.floor(scaled)).cast("int").alias("u8"))


def centre_crop(df: DataFrame, size: int, height: Column | int, width: Column | int) -> DataFrame:
    """Pixels (row, col) of the size x size box in the middle of images of height x width, places within the box; smaller images stay whole."""
    top, left = (F.greatest(F.lit(0), F.floor((F.lit(n) - size) / 2)) for n in (height, width))
    inside = df.where((F.col("row") >= top) & (F.col("row") < top + size) & (F.col("col") >= left) & (F.col("col") < left + size))
    return inside.withColumns({"row": (F.col("row") - top).cast("int"), "col": (F.col("col") - left).cast("int")})


def minmax_byte(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    stats = df.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    held = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    return held.select(*df.columns, F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 255.0), F.lit(0)).cast("int").alias("u8"))


def block_average(df: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg("v").alias("v"))


def sobel(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gradient magnitude by the 3 x 3 Sobel kernels over its maximum, at pixels with all eight neighbours.

    Two passes of neighbours, along rows and then along columns: each window is one row or one column of one image (by)."""
    along, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    a = df.select(*by, "row", "col", (F.lead("v").over(along) - F.lag("v").over(along)).alias("d"), (F.lag("v").over(along) + 2 * F.col("v") + F.lead("v").over(along)).alias("s"))
    gx = F.lag("d").over(down) + 2 * F.col("d") + F.lead("d").over(down)
    gy = F.lead("s").over(down) - F.lag("s").over(down)
    m = a.select(*by, "row", "col", F.sqrt(gx * gx + gy * gy).alias("m")).where("m is not null")
    top = m.groupBy(*by).agg(F.max("m").alias("top"))
    return (m.join(top, list(by)) if by else m.crossJoin(F.broadcast(top))).select(*by, "row", "col", F.coalesce(F.try_divide("m", "top"), F.lit(0.0)).alias("g"))


def shadow_mask(df: DataFrame, share: float = 0.05, radius: int = 3, least: int = 100, nodata: float = 0.0, by: Sequence[str] = (), passes: bool | None = None) -> DataFrame:
    """(by, row, col, ok): pixels of each image (by) that are neither shadow nor without data. Shadow is what lies at or under the valid values'
    share percentile, grown by a disc of radius; under least valid pixels all are ok."""
    if by_passes(df, passes, by):
        only, n = df.where(valid("v")), df.groupBy(*by).agg(F.count_if(valid("v")).alias("n"))
        stats = n.join(grouped_percentiles(only, "v", (share,), by).withColumnRenamed("q0", "floor"), list(by), "left") if by else n.withColumn("floor", F.lit(exact_percentiles(only, "v", (share,))[0]).cast("double"))
    else:
        stats = df.groupBy(*by).agg(F.percentile(number(F.when(valid("v"), F.col("v"))), F.lit(share)).alias("floor"), F.count_if(valid("v")).alias("n"))
    flagged = (df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))).select(*by, "row", "col", "v", "n", (F.col("v") <= F.col("floor")).alias("dark"))
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    around = F.inline(F.array(*(F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")) for dy, dx in disc)))
    grown = flagged.where("dark").select(*by, around).distinct().withColumn("near", F.lit(True))
    return flagged.join(grown, [*by, "row", "col"], "left").select(*by, "row", "col", ((F.col("n") < least) | (F.col("near").isNull() & (F.col("v") > nodata))).alias("ok"))


def valid_share(df: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """The groups (tiles, strips) of which at least this share holds data."""
    return df.groupBy(*by).agg(F.avg(valid("v").cast("double")).alias("share")).where(F.col("share") >= least)


def absolute_difference(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """|a - b| where both hold data, else 0; by: the keys of images, where there are several."""
    at = [*by, "row", "col"]
    j = a.select(*at, F.col("v").alias("va")).join(b.select(*at, F.col("v").alias("vb")), at)
    return j.select(*by, "row", "col", F.when(valid("va") & valid("vb"), F.abs(F.col("va") - F.col("vb"))).otherwise(0.0).alias("v"))


def false_colour(source: DataFrame, reference: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Red from the source, green and blue from the reference; by: the keys of images, where there are several."""
    at = [*by, "row", "col"]
    j = source.select(*at, F.col("v").alias("r")).join(reference.select(*at, F.col("v").alias("g")), at, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*at, zero("r").alias("r"), zero("g").alias("g"), zero("g").alias("b"))


def native_grid(a: Column, e: Column, width: Column, height: Column, target: Column) -> dict[str, Column]:
    """Output size and scale of a warp at another GSD."""
    factor = F.abs(a) / target
    return {"width": F.rint(width * factor).cast("long"), "height": F.rint(height * factor).cast("long"), "a": a / factor, "e": e / factor}


#: Queries and candidates that ncc_argmax() multiplies at once.
BLOCK = 2048


def ncc_argmax(patches: DataFrame, candidates: DataFrame, others: bool = False) -> DataFrame:
    """(patch_id, cand_id, score): each patch's best candidate (p and c: arrays of one length) by inner product; ties by cand_id.
    others: a candidate with the patch's own id doesn't count.

    Both sides are dealt into blocks of about BLOCK rows; every block of patches meets every block of candidates once, in a task
    that holds the two, multiplies them as matrices and keeps a row for each patch. So neither side is broadcast, and what is
    shuffled is each side once for each block of the other."""
    import pandas as pd

    n, m = (max(1, -(-x.count() // BLOCK)) for x in (patches, candidates))
    own = lambda df, i, k: df.withColumn("at", F.pmod(F.xxhash64(i), F.lit(k)))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = own(patches, "patch_id", n).select(F.col("at").alias("a"), each(m).alias("b"), F.col("patch_id").alias("id"), F.col("p").alias("v"))
    right = own(candidates, "cand_id", m).select(each(n).alias("a"), F.col("at").alias("b"), F.col("cand_id").alias("id"), F.col("c").alias("v"))

    def best(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(c):
            return pd.DataFrame({"patch_id": [], "cand_id": [], "score": []})
        c = c.sort_values("id", kind="stable")
        scores = np.stack(p["v"].to_numpy()) @ np.stack(c["v"].to_numpy()).T
        if others:
            scores[p["id"].to_numpy()[:, None] == c["id"].to_numpy()[None, :]] = -np.inf
        k = scores.argmax(1)
        return pd.DataFrame({"patch_id": p["id"].to_numpy(), "cand_id": c["id"].to_numpy()[k], "score": scores[np.arange(len(k)), k]})

    kinds = [df.select(c).dtypes[0][1] for df, c in ((patches, "patch_id"), (candidates, "cand_id"))]
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, f"patch_id {kinds[0]}, cand_id {kinds[1]}, score double")
    top = found.groupBy("patch_id").agg(F.max(F.struct("score", (-F.col("cand_id")).alias("neg"))).alias("x")).where("x.score > double('-Infinity')")
    return top.select("patch_id", (-F.col("x.neg")).alias("cand_id"), F.col("x.score").alias("score"))
