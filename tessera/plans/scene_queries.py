"""Queries of whole rasters as tiles: GeoTIFF files written and read back, statistics, equalisation and filters over tile borders,
circles by votes. The raster is that of the kernels' patches, one below the other; SQL sees it whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import circles as C
from tessera.operators import scenes as S
from tessera.operators import tiles as T
from tessera.plans.kernel_queries import PATCHES, _DISC, _image, _places, _rings, r
from tessera.plans.views import table
from tessera.sources.geotiff import read_geotiff, write_geotiff
from tessera.sources.shared import new_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


IMAGE = PATCHES + """, img AS MATERIALIZED (SELECT patch * 64 + "row" AS "row", col, v FROM patches), size AS (SELECT max("row") + 1 AS h FROM img)"""
_BY_PATCH = 'SELECT CAST("row" // 64 AS BIGINT) AS patch, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) + 0.0 AS sd FROM {} GROUP BY "row" // 64'


def _by_patch(tiles):
    return S.pixels(tiles).groupBy((F.col("row") / 64).cast("long").alias("patch")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).select("patch", r("mean").alias("mean"), r("sd").alias("sd"))


@query("geotiff_tiled", f"WITH {IMAGE} SELECT CAST(\"row\" AS INT) AS \"row\", col, floor(v * 100) AS v FROM img")
def geotiff_tiled(spark, d):
    """The raster as a file of tiles of 32, whole numbers as differences in LZW codes, written by the tasks that have them; read back."""
    tiles, height = _image(spark, d)
    path = new_folder(spark, "tiff") + "/whole.tif"
    write_geotiff(T.each_patch(tiles, lambda a: np.floor(a * 100).astype("<u2")), path, height, 64, "<u2", tile=32, compression="lzw", predictor=2, nodata=0)
    return S.pixels(read_geotiff(spark, path)).select("row", "col", "v")


@query("geotiff_window", f"WITH {IMAGE} SELECT CAST(\"row\" // 32 * 32 AS INT) AS row_off, CAST(col // 32 * 32 AS INT) AS col_off, count(*) AS n, round(sum(v), 3) + 0.0 AS total FROM img WHERE \"row\" BETWEEN 96 AND 159 GROUP BY \"row\" // 32, col // 32")
def geotiff_window(spark, d):
    """The tiles of a deflated file that a window touches, and no others."""
    tiles, height = _image(spark, d)
    path = new_folder(spark, "tiff") + "/window.tif"
    write_geotiff(tiles, path, height, 64, "<f8", tile=32, geotransform=(1000.0, 5.0, 0.0, 2000.0, 0.0, -5.0), radius=1737400.0)
    read = read_geotiff(spark, path, (100, 10, 60, 40))
    sums = S.pixels(read).groupBy((F.floor(F.col("row") / 32) * 32).cast("int").alias("row_off"), (F.floor(F.col("col") / 32) * 32).cast("int").alias("col_off"))
    return sums.agg(F.count("*").alias("n"), F.sum("v").alias("total")).select("row_off", "col_off", "n", r("total", 3).alias("total"))


_QUANTILES = ", ".join(f"round(quantile_cont(v, {s}), 6) + 0.0 AS q{n}" for s, n in ((0.02, "02"), (0.5, "50"), (0.98, "98")))


@query("scene_percentiles", f"WITH {IMAGE} SELECT count(*) AS n, {_QUANTILES} FROM img WHERE v > 0")
def scene_percentiles(spark, d):
    q = F.col("q")
    return S.percentiles(_image(spark, d)[0], [0.02, 0.5, 0.98]).select("n", *((F.round(q[k], 6) + 0.0).alias(n) for k, n in enumerate(("q02", "q50", "q98"))))


def _whole_equalised(clip: float) -> str:
    """kernels' equalisation of the whole image: cells of an eighth of its height and 8 columns."""
    limit = f"greatest(1.0::DOUBLE, {clip}::DOUBLE * (h // 8) * 8 / 256)"
    return f"""q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM img WHERE v > 0),
    u8 AS MATERIALIZED (SELECT "row", col, h, CAST(floor(least(1, greatest(0, (v - lo) / (hi - lo + 1e-6::DOUBLE))) * 255) AS INT) AS v FROM img, q, size),
    hist AS (SELECT "row" // (h // 8) AS ty, col // 8 AS tx, v, count(*) AS n, any_value(h) AS h FROM u8 GROUP BY "row" // (h // 8), col // 8, v),
    excess AS (SELECT ty, tx, any_value(h) AS h, sum(greatest(n - {limit}, 0)) AS x FROM hist GROUP BY ty, tx),
    tab AS MATERIALIZED (SELECT e.ty, e.tx, l.i AS v, least(255, greatest(0, (sum(least(coalesce(t.n, 0), {limit.replace("h //", "e.h //")})) OVER (PARTITION BY e.ty, e.tx ORDER BY l.i) + x / 256.0 * (l.i + 1)) * 255 / ((e.h // 8) * 8.0))) AS y
        FROM excess e CROSS JOIN range(256) l(i) LEFT JOIN hist t ON t.ty = e.ty AND t.tx = e.tx AND t.v = l.i),
    mid AS (SELECT *, ("row" + 0.5::DOUBLE) / (h // 8) - 0.5::DOUBLE AS my, (col + 0.5::DOUBLE) / 8 - 0.5::DOUBLE AS mx FROM u8),
    box AS (SELECT *, greatest(0, least(7, floor(my))) AS y0, greatest(0, least(7, floor(my) + 1)) AS y1, greatest(0, least(7, floor(mx))) AS x0, greatest(0, least(7, floor(mx) + 1)) AS x1, my - floor(my) AS fy, mx - floor(mx) AS fx FROM mid),
    eq AS MATERIALIZED (SELECT b."row", b.col, round_even((a.y * (1 - fx) + c.y * fx) * (1 - fy) + (d.y * (1 - fx) + e.y * fx) * fy, 0) AS v FROM box b
        JOIN tab a ON a.v = b.v AND a.ty = y0 AND a.tx = x0 JOIN tab c ON c.v = b.v AND c.ty = y0 AND c.tx = x1
        JOIN tab d ON d.v = b.v AND d.ty = y1 AND d.tx = x0 JOIN tab e ON e.v = b.v AND e.ty = y1 AND e.tx = x1)"""


@query("clahe_scene", f"WITH {IMAGE}, {_whole_equalised(2.0)} {_BY_PATCH.format('eq')}")
def clahe_scene(spark, d):
    """The whole raster equalised over its own cells, which tiles of 64 cut."""
    return _by_patch(S.equalised(S.stretched(_image(spark, d)[0]), 2.0))


def _filtered(source: str, taps: str, axis: str, to: str) -> str:
    """A CTE that filters an image along an axis with taps (d, w), its borders mirrored."""
    other, last = ("col", "h - 1") if axis == "row" else ("row", "63")
    at = f'(s."{axis}" + k.d)'
    # Each source pixel goes to the places whose taps read it: at itself, and mirrored at either border.
    return f"""{to} AS MATERIALIZED (SELECT t."{axis}", t."{other}", sum(t.w * s.v) AS v
        FROM (SELECT p."row", p.col, k.w, CASE WHEN p."{axis}" + k.d < 0 THEN -(p."{axis}" + k.d) WHEN p."{axis}" + k.d > {last} THEN 2 * ({last}) - (p."{axis}" + k.d) ELSE p."{axis}" + k.d END AS at FROM {source} p, {taps} k, size) t
        JOIN {source} s ON s."{axis}" = t.at AND s."{other}" = t."{other}" GROUP BY t."row", t.col)"""


_GAUSS = "g AS (SELECT d, exp(-(d * d) / 2.88::DOUBLE) / sum(exp(-(d * d) / 2.88::DOUBLE)) OVER () AS w FROM range(-5, 6) t(d))"


@query("unsharp_scene", f"""WITH {IMAGE}, {_GAUSS}, {_filtered("img", "g", "row", "g1")}, {_filtered("g1", "g", "col", "g2")},
    o AS (SELECT "row", floor(least(255, greatest(0, 1.4::DOUBLE * p.v - 0.4::DOUBLE * g2.v))) AS v FROM img p JOIN g2 USING ("row", col)) {_BY_PATCH.format("o")}""")
def unsharp_scene(spark, d):
    """Sharpening over tile borders, on a grid of 48."""
    return _by_patch(S.sharpened(_image(spark, d)[0], 48))


@query("structural_scene", f"""WITH {IMAGE}, {_whole_equalised(3.0)}, dif(d, w) AS (VALUES (-1, -1), (1, 1)), tri(d, w) AS (VALUES (-1, 1), (0, 2), (1, 1)),
    {_filtered("eq", "dif", "col", "a1")}, {_filtered("a1", "tri", "row", "gx")}, {_filtered("eq", "dif", "row", "b1")}, {_filtered("b1", "tri", "col", "gy")},
    m AS (SELECT "row", col, sqrt(gx.v * gx.v + gy.v * gy.v) AS m FROM gx JOIN gy USING ("row", col)), top AS (SELECT max(m) AS t FROM m),
    f AS (SELECT quantile_cont(v, 0.05) AS fl FROM img WHERE v > 0), dark AS (SELECT DISTINCT p."row" + dy AS "row", col + dx AS col FROM img p, f, {_DISC} o WHERE v <= fl),
    o AS (SELECT m."row", CASE WHEN p.v > 0 AND k."row" IS NULL THEN m / t ELSE 0 END AS v FROM m CROSS JOIN top JOIN img p ON p."row" = m."row" AND p.col = m.col LEFT JOIN dark k ON k."row" = m."row" AND k.col = m.col) {_BY_PATCH.format("o")}""")
def structural_scene(spark, d):
    """The gradient's structural map of the whole raster: percentiles, cells, maximum and shadows are the raster's own."""
    return _by_patch(S.structural(_image(spark, d)[0], "gradient", size=96))


@query("phase_congruency_scene")
def phase_congruency_scene(spark, d):
    return _by_patch(S.structural(_image(spark, d)[0], "phase_congruency", size=128, radius=32))


@query("circles_scene", "SELECT s_suppkey, 1::BIGINT AS n, true AS found FROM supplier")
def circles_scene(spark, d):
    """Every supplier's ring in one raster, rings below each other and across the borders of its tiles: how many circles there are where
    each ring is, and whether one is that ring."""
    rings = _rings(spark, d)
    place = (F.col("s_suppkey") * 160).cast("int")
    tiles = rings.select(F.lit("rings").alias("image_id"), place.alias("row_off"), F.lit(0).alias("col_off"), "h", "w", "dtype", "px")
    found = C.circles(tiles, 15, 40, size=256).select(F.floor(F.col("cy") / 160).alias("s_suppkey"), F.col("cx").alias("fx"), (F.col("cy") % 160).alias("fy"), F.col("r").alias("fr"))
    near = (F.hypot(F.col("fx") - F.col("cx"), F.col("fy") - F.col("cy")) <= 3) & (F.abs(F.col("fr") - F.col("r")) <= 3)
    held = table(spark, d, "supplier").select("s_suppkey").join(_places(spark, d), "s_suppkey").join(found, "s_suppkey", "left")
    return held.groupBy("s_suppkey").agg(F.count("fx").alias("n"), F.bool_or(F.coalesce(near, F.lit(False))).alias("found"))


_TAPS = "taps AS (SELECT o, w / sum(w) OVER () AS w FROM (SELECT o, sin(pi() * d / 2) / (pi() * d / 2) * sin(pi() * d / 6) / (pi() * d / 6) AS w FROM (SELECT i AS o, i - 0.5::DOUBLE AS d FROM range(-5, 7) t(i))))"


def _halved(source: str, axis: str, to: str) -> str:
    """A CTE of half as many places along an axis, by the taps, borders mirrored."""
    other, last = ("col", "h - 1") if axis == "row" else ("row", "63")
    at = "(2 * n.i + o)"
    return f"""{to} AS MATERIALIZED (SELECT CAST(k.i AS INT) AS "{axis}", s."{other}", sum(k.w * s.v) AS v
        FROM (SELECT n.i, w, CASE WHEN {at} < 0 THEN -{at} WHEN {at} > {last} THEN 2 * ({last}) - {at} ELSE {at} END AS at FROM size, range({"(SELECT h // 2 FROM size)" if axis == "row" else "32"}) n(i), taps) k
        JOIN {source} s ON s."{axis}" = k.at GROUP BY k.i, s."{other}")"""


@query("lanczos_scene", f"""WITH {IMAGE}, {_TAPS}, {_halved("img", "row", "l1")}, {_halved("l1", "col", "l2")}, o AS (SELECT "row" * 2 AS "row", greatest(0, least(255, round_even(v, 0))) AS v FROM l2)
    {_BY_PATCH.format("o")}""")
def lanczos_scene(spark, d):
    """The raster at half its scale by sincs of three lobes, block by block."""
    from tessera.operators import georeference as G

    tiles, height = _image(spark, d)
    out = G.harmonised(tiles, (1.0, 0.0, -1.0, float(height)), G.Grid(0.0, float(height), 2.0, 32, height // 2), "lanczos", 48)
    v = S.pixels(out.select(F.lit("half").alias("image_id"), "row_off", "col_off", "h", "w", "dtype", "px"))
    return v.groupBy((F.col("row") * 2 / 64).cast("long").alias("patch")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).select("patch", r("mean").alias("mean"), r("sd").alias("sd"))


@query("geotiff_crop", f"WITH {IMAGE} SELECT CAST(\"row\" - 70 AS INT) AS \"row\", CAST(col - 9 AS INT) AS col, floor(v) AS v FROM img WHERE \"row\" BETWEEN 70 AND 169 AND col BETWEEN 9 AND 58")
def geotiff_crop(spark, d):
    """A window as a file of its own, whose corner is the window's; read back."""
    from tessera.sources.geotiff import layout_of, write_window

    tiles, height = _image(spark, d)
    path = new_folder(spark, "tiff") + "/crop.tif"
    write_window(T.each_patch(tiles, lambda a: np.floor(a).astype("|u1")), path, (70, 9, 100, 50), geotransform=(500.0, 2.0, 0.0, 900.0, 0.0, -2.0), tile=48)
    assert layout_of(path).geotransform == (518.0, 2.0, 0.0, 760.0, 0.0, -2.0)
    return S.pixels(read_geotiff(spark, path)).select("row", "col", "v")
