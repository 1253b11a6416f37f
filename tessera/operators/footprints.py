"""Operators on footprints, ground control points and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import METRES_PER_DEGREE, clamp, equirectangular, half_even, wrap_longitude
from tessera.sources.shared import written

BOX = ("left", "bottom", "right", "top")
#: Pairs of boxes that a task of overlaps() compares.
TASK_PAIRS = 5_000_000


def overlaps(a: DataFrame, b: DataFrame, cell: float, least_pct: float = 0.001) -> DataFrame:
    """Pairs of boxes (id, left, bottom, right, top) that share an area: (a_id, b_id, left, bottom, right, top, a_pct, b_pct).

    Boxes are dealt to the grid cells that they touch and joined by cell; a pair counts in the cell of its shared lower left
    corner alone, so no distinct is needed. A cell's pairs are counted first: a cell with over TASK_PAIRS is shared out by a's boxes,
    and there are as many tasks as pairs ask for, since the boxes' bytes say little about them. Touching edges share nothing. A pair goes only if its area is under least_pct of
    both boxes."""
    def dealt(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col("id").alias(f"{p}_id"), *(F.col(c).cast("double").alias(f"{p}_{c}") for c in BOX))
        cells = lambda lo, hi: F.sequence(F.floor(F.col(f"{p}_{lo}") / cell).cast("long"), F.floor(F.col(f"{p}_{hi}") / cell).cast("long"))
        return named.withColumn("gx", F.explode(cells("left", "right"))).withColumn("gy", F.explode(cells("bottom", "top")))

    left, right = dealt(a, "a"), dealt(b, "b")
    sizes = left.groupBy("gx", "gy").agg(F.count("*").alias("n")).join(right.groupBy("gx", "gy").agg(F.count("*").alias("m")), ["gx", "gy"])
    shares = written(sizes.select("gx", "gy", (F.col("n") * F.col("m")).alias("pairs"), F.ceil(F.col("n") * F.col("m") / F.lit(TASK_PAIRS)).cast("int").alias("shares")), "cell-sizes")
    tasks = max(-(-(shares.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS), a.sparkSession.sparkContext.defaultParallelism)
    keys = ["gx", "gy", "share"]
    left = left.join(shares, ["gx", "gy"]).withColumn("share", F.pmod(F.xxhash64("a_id", *(f"a_{c}" for c in BOX)), F.col("shares")).cast("int"))
    right = right.join(shares, ["gx", "gy"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    pairs = left.drop("pairs", "shares").repartition(tasks, *keys).hint("merge").join(right.drop("pairs", "shares").repartition(tasks, *keys), keys)
    shared = pairs.withColumns({
        "left": F.greatest("a_left", "b_left"), "bottom": F.greatest("a_bottom", "b_bottom"),
        "right": F.least("a_right", "b_right"), "top": F.least("a_top", "b_top"),
    })
    own = (F.floor(F.col("left") / cell) == F.col("gx")) & (F.floor(F.col("bottom") / cell) == F.col("gy"))
    area = lambda p: (F.col(f"{p}right") - F.col(f"{p}left")) * (F.col(f"{p}top") - F.col(f"{p}bottom"))
    pct = lambda p: F.coalesce(F.try_divide(100.0 * area(""), area(f"{p}_")), F.lit(0.0))
    out = shared.where((F.col("left") < F.col("right")) & (F.col("bottom") < F.col("top")) & own).withColumns({"a_pct": pct("a"), "b_pct": pct("b")})
    return out.where((F.col("a_pct") >= least_pct) | (F.col("b_pct") >= least_pct)).select("a_id", "b_id", *BOX, "a_pct", "b_pct")


def pixel_window(df: DataFrame, pad: int = 50) -> DataFrame:
    """The window (row_off, col_off, height, width) of a box in an image (a, c, e, f: its affine's scale and origin; img_w, img_h),
    padded, clamped to the image, at least a pixel."""
    x0, x1 = (F.floor((F.col(c) - F.col("c")) / F.col("a")) for c in ("left", "right"))
    y0, y1 = (F.floor((F.col(c) - F.col("f")) / F.col("e")) for c in ("top", "bottom"))
    c0, r0 = F.least(F.greatest(F.lit(0), x0 - pad), F.col("img_w") - 1), F.least(F.greatest(F.lit(0), y0 - pad), F.col("img_h") - 1)
    return df.withColumns({
        "col_off": c0.cast("int"), "row_off": r0.cast("int"),
        "width": F.greatest(F.lit(1), F.least(F.col("img_w"), x1 + pad) - c0).cast("int"),
        "height": F.greatest(F.lit(1), F.least(F.col("img_h"), y1 + pad) - r0).cast("int"),
    })


def cropped_geotransform(df: DataFrame) -> DataFrame:
    """The affine's origin moved to the window."""
    return df.withColumns({"c": F.col("c") + F.col("a") * F.col("col_off"), "f": F.col("f") + F.col("e") * F.col("row_off")})


def is_projected(crs: Column, a: Column, b: Column, d: Column, e: Column) -> Column:
    return F.coalesce(crs.isNotNull() & ~((a == 1) & (e == -1) & (b == 0) & (d == 0)), F.lit(False))


def ground_sampling(a: Column, crs: Column, geographic: Column) -> Column:
    """Metres of a pixel: 0.8 without a CRS, degrees turned into metres."""
    return F.when(crs.isNull(), 0.8).when(geographic, F.abs(a) * METRES_PER_DEGREE).otherwise(F.abs(a))


def gsd_ratio(source: Column, reference: Column) -> Column:
    return F.greatest(source, reference) / F.least(source, reference)


def harmonized_gsd(source: Column, reference: Column, wide_angle: Column) -> Column:
    """The common grid's GSD: the geometric mean within [10, 30] m where scales are far apart, neither image is of the
    wide-angle kind and the coarser is over 10 m; else the reference's."""
    apart = (gsd_ratio(source, reference) >= 3.0) & ~wide_angle & (F.greatest(source, reference) > 10.0)
    return F.when(apart, clamp(F.sqrt(source * reference), 10.0, 30.0)).otherwise(reference)


def resampler(ratio: Column, override: Column | None = None) -> Column:
    own = F.when(ratio >= 4.0, "average").when(ratio >= 2.0, "lanczos").otherwise("bilinear")
    return own if override is None else F.coalesce(override, own)


def native_crop(wide_angle: Column, ratio: Column) -> Column:
    return wide_angle & (ratio >= 3.0)


def grid_size(left: Column, right: Column, bottom: Column, top: Column, gsd: Column) -> tuple[Column, Column]:
    return half_even((right - left) / gsd), half_even((top - bottom) / gsd)


def corner_points(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Four ground control points of each image (width, height and ul, ur, ll, lr with _lat, _lon)."""
    at = {"ul": (F.lit(0), F.lit(0)), "ur": (F.col("width"), F.lit(0)), "ll": (F.lit(0), F.col("height")), "lr": (F.col("width"), F.col("height"))}
    corners = F.array(*(F.struct(F.lit(k).alias("corner"), x.cast("double").alias("col"), y.cast("double").alias("row"), wrap_longitude(F.col(f"{k}_lon")).alias("lon"), F.col(f"{k}_lat").alias("lat")) for k, (x, y) in at.items()))
    return df.select(*keep, F.inline(corners))


def affine_from_points(gcps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares affines from (col, row) to equirectangular metres for each image, by normal equations of SQL sums: with
    columns ax, bx, cx and ay, by_, cy of x = ax col + bx row + cx."""
    x, y = equirectangular(F.col("lon"), F.col("lat"))
    base = gcps.withColumns({"x": x, "y": y})
    means = base.groupBy(*by).agg(*(F.avg(c).alias(f"m_{c}") for c in ("col", "row", "x", "y")))
    d = base.join(means, list(by)).withColumns({f"d_{c}": F.col(c) - F.col(f"m_{c}") for c in ("col", "row", "x", "y")})
    s = lambda a, b: F.sum(F.col(f"d_{a}") * F.col(f"d_{b}"))
    sums = d.groupBy(*by).agg(*(F.first(f"m_{c}").alias(f"m_{c}") for c in ("col", "row", "x", "y")), s("col", "col").alias("cc"), s("row", "row").alias("rr"), s("col", "row").alias("cr"), *(s(a, b).alias(f"{a}_{b}") for a in ("col", "row") for b in ("x", "y")))
    det = F.col("cc") * F.col("rr") - F.col("cr") * F.col("cr")
    out = sums
    for t, names in (("x", ("ax", "bx", "cx")), ("y", ("ay", "by_", "cy"))):
        p = F.try_divide(F.col(f"col_{t}") * F.col("rr") - F.col(f"row_{t}") * F.col("cr"), det)
        q = F.try_divide(F.col(f"row_{t}") * F.col("cc") - F.col(f"col_{t}") * F.col("cr"), det)
        out = out.withColumns({names[0]: p, names[1]: q}).withColumn(names[2], F.col(f"m_{t}") - F.col(names[0]) * F.col("m_col") - F.col(names[1]) * F.col("m_row"))
    return out.select(*by, "ax", "bx", "cx", "ay", "by_", "cy")


def look_grid(images: DataFrame, step: int) -> DataFrame:
    """(image_id, line, sample, t): a mesh over each image, ends included, with each line's time."""
    ends = lambda n: F.array_distinct(F.concat(F.sequence(F.lit(0), F.col(n) - 1, F.lit(step)), F.array(F.col(n) - 1)))
    mesh = images.withColumn("line", F.explode(ends("height"))).withColumn("sample", F.explode(ends("width")))
    return mesh.withColumn("t", F.col("start_s") + F.col("line") * F.col("exposure_s"))


def ray_on_sphere(px: Column, py: Column, pz: Column, dx: Column, dy: Column, dz: Column, radius: float) -> tuple[Column, Column]:
    """(lon, lat) in degrees where a look vector from a position first meets the sphere; null where it misses."""
    a, b, c = dx * dx + dy * dy + dz * dz, 2 * (px * dx + py * dy + pz * dz), px * px + py * py + pz * pz - radius * radius
    disc = b * b - 4 * a * c
    t = F.when((disc >= 0) & (-b - F.sqrt(F.greatest(disc, F.lit(0.0))) > 0), (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a))
    x, y, z = px + t * dx, py + t * dy, pz + t * dz
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(z / radius))


def needs_georeferencing(projected: Column, cached_bytes: Column, wide_angle: Column, cached_height: Column) -> Column:
    """Whether an image has to be georeferenced: not if it is projected or a usable cached result is there."""
    usable = (cached_bytes > 1024) & ~(wide_angle & (cached_height > 10000))
    return ~projected & ~F.coalesce(usable, F.lit(False))
