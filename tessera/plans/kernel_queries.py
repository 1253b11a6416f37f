"""Queries of the numeric kernels. SQL says what they should give: in full where it can (filters, gradients, warps, hulls), else of
planted data (shifts, models, circles), whose answer is known. The others are held against closed forms in tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels as K
from tessera.operators import georeference as G
from tessera.operators import points as P
from tessera.operators import tiles as T
from tessera.plans.views import GOOD, PX, RES, TP, pixels, planted, residuals, table, tie_points
from tessera.sources.shared import new_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(c, n=5):
    return F.round(F.col(c), n) + 0.0


def _patches(spark, d, shift=0):
    """The raster's rows by 64 as patches of bytes' range; every row belongs to one."""
    p = pixels(spark, d).select((F.col("row") / 64).cast("long").alias("patch"), (F.col("row") % 64).alias("row"), ((F.col("col") + shift) % 64).alias("col"), ((F.col("v") + 1) * 100 + 1).alias("v"))
    return T.pack_rows(p, "patch", 64, 64)


def _summary(df):
    """A row per patch: mean and deviation of its values."""
    return T.long_form(df, "patch").groupBy("patch").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).select("patch", r("mean").alias("mean"), r("sd").alias("sd"))


#: The same patches: rows that a last patch lacks are zeros.
PATCHES = PX + """, patches AS MATERIALIZED (SELECT p.patch, CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS col, coalesce((px.v + 1) * 100 + 1, 0) AS v
    FROM (SELECT DISTINCT "row" // 64 AS patch FROM px) p, range(64) r(i), range(64) c(i) LEFT JOIN px ON px."row" = p.patch * 64 + r.i AND px.col = c.i)"""
_SUM = 'SELECT patch, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) + 0.0 AS sd FROM {} GROUP BY patch'
_FOLD = "CASE WHEN abs({0}) > 63 THEN 126 - abs({0}) ELSE abs({0}) END"


def _convolved(source: str, taps: str, axis: str, to: str) -> str:
    """A CTE that filters source along an axis with taps (d, w), borders mirrored."""
    other = "col" if axis == "row" else "row"
    return f"""{to} AS MATERIALIZED (SELECT s.patch, CAST(t.i AS INT) AS "{axis}", s."{other}", sum(k.w * s.v) AS v
        FROM range(64) t(i) CROSS JOIN {taps} k JOIN {source} s ON s."{axis}" = {_FOLD.format("(t.i + k.d)")} GROUP BY ALL)"""


#: Percentiles to bytes, then 8 x 8 tiles' clipped and equalising tables, blended.
def _equalised(source: str, clip: float) -> str:
    return f"""q AS (SELECT patch, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM {source} WHERE v > 0 GROUP BY patch),
    u8 AS MATERIALIZED (SELECT patch, "row", col, CAST(floor(least(1, greatest(0, (v - lo) / (hi - lo + 1e-6::DOUBLE))) * 255) AS INT) AS v FROM {source} JOIN q USING (patch)),
    hist AS (SELECT patch, "row" // 8 AS ty, col // 8 AS tx, v, count(*) AS n FROM u8 GROUP BY ALL),
    excess AS (SELECT patch, ty, tx, sum(greatest(n - {max(1.0, clip * 64 / 256)}, 0)) AS x FROM hist GROUP BY ALL),
    tab AS MATERIALIZED (SELECT e.patch, e.ty, e.tx, l.i AS v, least(255, greatest(0, (sum(least(coalesce(h.n, 0), {max(1.0, clip * 64 / 256)})) OVER (PARTITION BY e.patch, e.ty, e.tx ORDER BY l.i) + x / 256.0 * (l.i + 1)) * 255 / 64.0)) AS y
        FROM excess e CROSS JOIN range(256) l(i) LEFT JOIN hist h ON h.patch = e.patch AND h.ty = e.ty AND h.tx = e.tx AND h.v = l.i),
    mid AS (SELECT *, ("row" + 0.5) / 8 - 0.5 AS gy, (col + 0.5) / 8 - 0.5 AS gx FROM u8),
    box AS (SELECT *, greatest(0, least(7, floor(gy))) AS y0, greatest(0, least(7, floor(gy) + 1)) AS y1, greatest(0, least(7, floor(gx))) AS x0, greatest(0, least(7, floor(gx) + 1)) AS x1, gy - floor(gy) AS fy, gx - floor(gx) AS fx FROM mid),
    eq AS MATERIALIZED (SELECT b.patch, b."row", b.col, round_even((a.y * (1 - fx) + c.y * fx) * (1 - fy) + (d.y * (1 - fx) + e.y * fx) * fy, 0) AS v FROM box b
        JOIN tab a ON a.patch = b.patch AND a.v = b.v AND a.ty = y0 AND a.tx = x0 JOIN tab c ON c.patch = b.patch AND c.v = b.v AND c.ty = y0 AND c.tx = x1
        JOIN tab d ON d.patch = b.patch AND d.v = b.v AND d.ty = y1 AND d.tx = x0 JOIN tab e ON e.patch = b.patch AND e.v = b.v AND e.ty = y1 AND e.tx = x1)"""


@query("clahe", f"WITH {PATCHES}, {_equalised('patches', 2.0)} {_SUM.format('eq')}")
def clahe(spark, d):
    return _summary(T.equalised(_patches(spark, d)))


_GAUSS = "g AS (SELECT d, exp(-(d * d) / 2.88::DOUBLE) / sum(exp(-(d * d) / 2.88::DOUBLE)) OVER () AS w FROM range(-5, 6) t(d))"


@query("unsharp", f"""WITH {PATCHES}, {_GAUSS}, {_convolved("patches", "g", "row", "g1")}, {_convolved("g1", "g", "col", "g2")},
    o AS (SELECT patch, floor(least(255, greatest(0, 1.4::DOUBLE * p.v - 0.4::DOUBLE * g2.v))) AS v FROM patches p JOIN g2 USING (patch, "row", col)) {_SUM.format("o")}""")
def unsharp(spark, d):
    return _summary(T.sharpened(_patches(spark, d)))


@query("phase_congruency")
def phase_congruency(spark, d):
    return _summary(T.structural_maps(_patches(spark, d)))


_DISC = "(SELECT a.i AS dy, b.i AS dx FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i <= 9)"


@query("structural_gradient", f"""WITH {PATCHES}, {_equalised("patches", 3.0)}, dif(d, w) AS (VALUES (-1, -1), (1, 1)), tri(d, w) AS (VALUES (-1, 1), (0, 2), (1, 1)),
    {_convolved("eq", "dif", "col", "a1")}, {_convolved("a1", "tri", "row", "gx")}, {_convolved("eq", "dif", "row", "b1")}, {_convolved("b1", "tri", "col", "gy")},
    m AS (SELECT patch, "row", col, sqrt(gx.v * gx.v + gy.v * gy.v) AS m FROM gx JOIN gy USING (patch, "row", col)), top AS (SELECT patch, max(m) AS t FROM m GROUP BY patch),
    f AS (SELECT patch, quantile_cont(v, 0.05) AS fl FROM patches WHERE v > 0 GROUP BY patch), dark AS (SELECT DISTINCT p.patch, p."row" + dy AS "row", col + dx AS col FROM patches p JOIN f USING (patch), {_DISC} o WHERE v <= fl),
    o AS (SELECT m.patch, CASE WHEN p.v > 0 AND k.patch IS NULL THEN m / t ELSE 0 END AS v FROM m JOIN top USING (patch) JOIN patches p ON p.patch = m.patch AND p."row" = m."row" AND p.col = m.col
        LEFT JOIN dark k ON k.patch = m.patch AND k."row" = m."row" AND k.col = m.col) {_SUM.format("o")}""")
def structural_gradient(spark, d):
    return _summary(T.structural_maps(_patches(spark, d), "gradient"))


@query("phase_corr", f"WITH {PX} SELECT DISTINCT \"row\" // 64 AS patch, 3.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, true AS sure FROM px")
def phase_corr(spark, d):
    """Patches against themselves moved by three columns."""
    found = T.phase_shift(T.paired(_patches(spark, d), _patches(spark, d, 3), "patch"), "patch")
    return found.select("patch", r("dx", 0).alias("dx"), r("dy", 0).alias("dy"), (F.col("response") > 0.1).alias("sure"))


@query("ecc_refine", f"WITH {PX} SELECT DISTINCT \"row\" // 64 AS patch, 1.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, true AS sure FROM px")
def ecc_refine(spark, d):
    """Smooth patches against themselves moved by a column."""
    smooth = lambda df: T.each_patch(df, lambda a: K.gaussian(a, 2.0))
    found = T.subpixel(T.paired(smooth(_patches(spark, d)), smooth(_patches(spark, d, 1)), "patch"), "patch")
    return found.select("patch", r("ox", 0).alias("ox"), r("oy", 0).alias("oy"), (F.col("score") > 0.6).alias("sure"))


@query("dense_match", f"WITH {PX} SELECT DISTINCT \"row\" // 64 AS patch, 3.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM px")
def dense_match(spark, d):
    """The median offset of matches between patches and themselves moved by three columns."""
    found = T.matched(T.paired(_patches(spark, d), _patches(spark, d, 3), "patch"), "patch", lambda a, b: K.grid_matcher(a, b, 32, 8))
    return found.groupBy("patch").agg(F.median(F.col("rx") - F.col("sx")).alias("dx"), F.median(F.col("ry") - F.col("sy")).alias("dy")).select("patch", r("dx", 0).alias("dx"), r("dy", 0).alias("dy"))


def _places(spark, d):
    """Where each supplier's ring is; place and radius by its key."""
    return table(spark, d, "supplier").select("s_suppkey", (70 + F.col("s_suppkey") % 20).alias("cx"), (85 - F.col("s_suppkey") % 15).alias("cy"), (20 + 2 * (F.col("s_suppkey") % 5)).alias("r"))


def _rings(spark, d):
    """A bright ring for each supplier; a task has few, as an image is far larger than the row that it is drawn from."""
    where = T.dealt(_places(spark, d), "s_suppkey")

    def draw(batches):
        yy, xx = np.mgrid[0:160, 0:160]
        for pdf in batches:
            px = [(200.0 * (np.abs(np.hypot(xx - x, yy - y) - r) < 2)).tobytes() for x, y, r in zip(pdf["cx"], pdf["cy"], pdf["r"], strict=True)]
            yield pdf.assign(h=160, w=160, dtype="<f8", px=px)[["s_suppkey", "cx", "cy", "r", "h", "w", "dtype", "px"]]

    return where.mapInPandas(draw, "s_suppkey long, cx long, cy long, r long, h int, w int, dtype string, px binary")


@query("hough_circles", "SELECT s_suppkey, true AS found FROM supplier")
def hough_circles(spark, d):
    """Whether the strongest circle of each supplier's ring is that ring, within 3 pixels."""
    found = T.found_circles(_rings(spark, d).select("s_suppkey", "h", "w", "dtype", "px"), "s_suppkey", 15, 40).withColumnsRenamed({"cx": "fx", "cy": "fy", "r": "fr"})
    near = (F.hypot(F.col("fx") - F.col("cx"), F.col("fy") - F.col("cy")) <= 3) & (F.abs(F.col("fr") - F.col("r")) <= 3)
    return _places(spark, d).join(found, "s_suppkey", "left").groupBy("s_suppkey").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("found"))


@query("hull_area", f"""WITH {TP}, p AS MATERIALIZED (SELECT DISTINCT supp, okey % 16 AS part, sx, sy FROM tp),
    e AS (SELECT supp, part, a.sx AS ax, a.sy AS ay, b.sx AS bx, b.sy AS bw FROM p a JOIN p b USING (supp, part) WHERE a.sx <> b.sx OR a.sy <> b.sy),
    c AS (SELECT e.*, (bx - ax) * (q.sy - ay) - (bw - ay) * (q.sx - ax) AS turn, (bx - ax) * (q.sx - ax) + (bw - ay) * (q.sy - ay) AS along FROM e JOIN p q USING (supp, part)),
    ring AS (SELECT supp, part, ax, ay, bx, bw FROM c GROUP BY ALL HAVING bool_and(turn > 0 OR (turn = 0 AND along BETWEEN 0 AND (bx - ax) * (bx - ax) + (bw - ay) * (bw - ay))))
    SELECT g.supp, g.part, round(coalesce(area, 0), 5) + 0.0 AS share FROM (SELECT DISTINCT supp, part FROM p) g LEFT JOIN (SELECT supp, part, least(1, abs(sum(ax * bw - bx * ay)) / 2 / 4000000.0::DOUBLE) AS area FROM ring GROUP BY ALL) USING (supp, part)""")
def hull_area(spark, d):
    points = tie_points(spark, d).withColumn("part", F.col("okey") % 16)
    return T.hull_shares(points, "sx", "sy", 4_000_000.0, ["supp", "part"]).select("supp", "part", r("share").alias("share"))


def _members():
    return F.count("*").alias("n"), F.sum(F.col("okey") * 8 + F.col("line")).alias("members")


@query("ransac_tiles", f"WITH {TP} SELECT supp, count(*) AS n, CAST(sum(okey * 8 + line) AS BIGINT) AS members FROM tp WHERE {GOOD} GROUP BY supp")
def ransac_tiles(spark, d):
    return T.robust_inliers(planted(spark, d, False, 0.01), "supp", 0.8).groupBy("supp").agg(*_members())


@query("ransac_affine", f"WITH {TP} SELECT count(*) AS n, CAST(sum(okey * 8 + line) AS BIGINT) AS members FROM tp WHERE {GOOD}")
def ransac_affine(spark, d):
    return T.ransac_by_rows(planted(spark, d), 0.8)[1].agg(*_members())


@query("tps_cv")
def tps_cv(spark, d):
    e = residuals(spark, d).withColumn("err", F.hypot("dx", "dy"))
    kept = P.stratified_consensus(e, "sy", "err", ["okey", "line"])
    return T.cross_validated(kept).agg(F.sum("n").alias("n"), F.sqrt(F.sum("sum_sq") / F.sum("n")).alias("rmse")).select("n", r("rmse").alias("rmse"))


def _image(spark, d):
    tiles = _patches(spark, d).select(F.lit("image").alias("image_id"), (F.col("patch") * 64).cast("int").alias("row_off"), F.lit(0).alias("col_off"), "h", "w", "dtype", "px")
    return tiles, 64 * tiles.count()


@query("warp_block")
def warp_block(spark, d):
    tiles, height = _image(spark, d)
    out = T.warp(tiles, lambda p: p + np.array([1.5, -0.25]), height, 64, block=128, order=3)
    return _summary(out.withColumn("patch", F.col("row_off").cast("long")))


@query("warp_bilinear", f"""WITH {PATCHES}, img AS MATERIALIZED (SELECT patch * 64 + "row" AS "row", col, v FROM patches), h AS (SELECT max("row") + 1 AS h FROM img),
    place AS (SELECT "row", col, greatest(0, least(h - 1, "row" - 0.25::DOUBLE)) AS y, least(63, col + 1.5::DOUBLE) AS x, col + 1.5 <= 63.5 AS ok, h FROM img, h),
    c AS (SELECT *, least(floor(y), h - 2) AS y0, least(floor(x), 62) AS x0 FROM place),
    o AS (SELECT c."row" // 128 * 128 AS patch, CASE WHEN ok THEN least(255, round_even((p.v * (1 - (x - x0)) + q.v * (x - x0)) * (1 - (y - y0)) + (s.v * (1 - (x - x0)) + t.v * (x - x0)) * (y - y0), 0)) ELSE 0 END AS v FROM c
        JOIN img p ON p."row" = y0 AND p.col = x0 JOIN img q ON q."row" = y0 AND q.col = x0 + 1 JOIN img s ON s."row" = y0 + 1 AND s.col = x0 JOIN img t ON t."row" = y0 + 1 AND t.col = x0 + 1) {_SUM.format("o")}""")
def warp_bilinear(spark, d):
    tiles, height = _image(spark, d)
    out = T.warp(tiles, lambda p: p + np.array([1.5, -0.25]), height, 64, block=128, order=1)
    return _summary(out.withColumn("patch", F.col("row_off").cast("long")))


@query("poly_fit", f"""WITH {RES}, m AS (SELECT (sy - 1000) / 500 AS y, dx, dy FROM res), s AS (SELECT count(*) AS a, sum(y) AS b, sum(y * y) AS c, sum(y * y * y) AS d, sum(y * y * y * y) AS e, sum(dx) AS t0, sum(dx * y) AS t1, sum(dx * y * y) AS t2, sum(dy) AS u0, sum(dy * y) AS u1, sum(dy * y * y) AS u2 FROM m),
    g AS (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS det FROM s)
    SELECT round((a * (c * t2 - t1 * d) - b * (b * t2 - t1 * c) + t0 * (b * d - c * c)) / det, 4) + 0.0 AS px0, round((a * (t1 * e - t2 * d) - t0 * (b * e - c * d) + c * (b * t2 - t1 * c)) / det, 4) + 0.0 AS px1, round((t0 * (c * e - d * d) - b * (t1 * e - d * t2) + c * (t1 * d - c * t2)) / det, 4) + 0.0 AS px2,
        round((a * (c * u2 - u1 * d) - b * (b * u2 - u1 * c) + u0 * (b * d - c * c)) / det, 4) + 0.0 AS py0, round((a * (u1 * e - u2 * d) - u0 * (b * e - c * d) + c * (b * u2 - u1 * c)) / det, 4) + 0.0 AS py1, round((u0 * (c * e - d * d) - b * (u1 * e - d * u2) + c * (u1 * d - c * u2)) / det, 4) + 0.0 AS py2 FROM g""")
def poly_fit(spark, d):
    m = P.poly_moments(residuals(spark, d), (F.col("sy") - 1000) / 500, [F.col("dx"), F.col("dy")], 2).first()
    px, py = P.solve_moments(m, 2, 2)
    return spark.range(1).select(*(F.round(F.lit(float(v)), 4).alias(f"{n}{k}") for n, c in (("px", px), ("py", py)) for k, v in enumerate(c)))


@query("event_stream_retention", "WITH o AS (SELECT user_id AS job_id, ts, event_id, event_type AS title, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT job_id, event_id, title FROM o WHERE rn <= 40")
def event_stream_retention(spark, d):
    """The events read as a stream, batch by batch, into a table of each job's newest ones; that table when the stream is empty."""
    from tessera.sources.buckets import BucketedTable
    from tessera.streaming.telemetry import retained_table

    at = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/event[s].parquet")  # a file or a folder
    folder = new_folder(spark, "retained")
    events = stream.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("title"))
    query = retained_table(events, f"{folder}/table", f"{folder}/checkpoint", 40)
    query.awaitTermination()
    return BucketedTable(spark, f"{folder}/table", "job_id").read().select("job_id", "event_id", "title")


@query("trap_verdicts", f"""WITH one AS (SELECT 'twin_craters' AS trap, {G.RING[0]} + {G.RING[1]} * cos(2 * pi() * i / {G.RING[2]}) AS x, {G.RING[0]} + {G.RING[1]} * sin(2 * pi() * i / {G.RING[2]}) AS y FROM range({G.RING[2]}) t(i)
      UNION ALL SELECT 'clustered_boulders', {G.HEAP[0]} + {G.HEAP[1]} * a.i, {G.HEAP[0]} + {G.HEAP[1]} * b.i FROM range({G.HEAP[2]}) a(i), range({G.HEAP[2]}) b(i)
      UNION ALL SELECT 'featureless_plain', x, y FROM (VALUES {", ".join(map(str, G.PLAIN))}) v(x, y)),
    p AS (SELECT s_suppkey AS scene, trap, CASE WHEN s_suppkey % 2 = 1 THEN {G.TRAP_SIDE} - x ELSE x END AS x, y FROM supplier, one),
    c AS (SELECT scene, trap, floor(y / 400) AS cy, floor(x / 400) AS cx, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT scene, trap, sum(n) AS inliers, greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS entropy FROM c GROUP BY scene, trap),
    a(trap, area) AS (VALUES ('twin_craters', {G.RING[2]} / 2.0 * {G.RING[1]} * {G.RING[1]} * sin(2 * pi() / {G.RING[2]})), ('clustered_boulders', 144.0), ('featureless_plain', abs((450 - 200) * (1200 - 300) - (800 - 200) * (600 - 300)) / 2.0), ('shadow_inversion', 0)),
    g AS (SELECT s_suppkey AS scene, a.trap, CAST(coalesce(inliers, 0) AS BIGINT) AS inliers, round(coalesce(entropy, 0), 4) + 0.0 AS entropy, round(area / 2560000.0::DOUBLE, 5) + 0.0 AS hull, CASE WHEN a.trap = 'shadow_inversion' THEN 180.0::DOUBLE END AS gap FROM supplier CROSS JOIN a LEFT JOIN h ON h.trap = a.trap AND h.scene = s_suppkey)
    SELECT *, CASE WHEN gap >= 120 THEN 'REJECTED (Illumination Conflict)' WHEN inliers < 10 THEN 'REJECTED (Insufficient Inliers)' WHEN hull < 0.05 THEN 'REJECTED (Poor Spatial Coverage)' ELSE 'UNCERTAIN' END AS verdict FROM g""")
def trap_verdicts(spark, d):
    """The trap sets in a scene for each supplier, mirrored in every other."""
    return G.judged_traps(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene"), (F.col("s_suppkey") % 2 == 1).alias("mirrored")))


@query("global_inliers", ORACLE_SQL["ransac_affine"])
def global_inliers(spark, d):
    return G.global_inliers(planted(spark, d), 2000, 0.8).agg(*_members())


@query("harmonised_average", f"""WITH {PATCHES}, c AS (SELECT (patch * 64 + "row") // 4 AS "row", col // 4 AS col, coalesce(avg(v) FILTER (v > 0), 0) AS v FROM patches GROUP BY ALL),
    o AS (SELECT "row" // 128 * 128 AS patch, least(255, round_even(v, 0)) AS v FROM c) {_SUM.format("o")}""")
def harmonised_average(spark, d):
    tiles, height = _image(spark, d)
    out = G.harmonised(tiles, (1.0, 0.0, -1.0, float(height)), G.Grid(0.0, float(height), 4.0, 16, height // 4), "average", 128)
    return _summary(out.withColumn("patch", F.col("row_off").cast("long")))


@query("gcp_warp", f"""WITH {PATCHES}, o AS (SELECT (patch * 64 + "row") // 128 * 128 AS patch, least(255, round_even(v, 0)) AS v FROM patches) {_SUM.format("o")}""")
def gcp_warp(spark, d):
    tiles, height = _image(spark, d)
    per = 180 / np.pi / 1_737_400.0
    gcps = spark.createDataFrame([(float(x), float(y), x * per, -y * per) for x in (0, 32, 64) for y in (0, height // 2, height)], "col double, row double, lon double, lat double")
    out = G.by_control_points(tiles, gcps, G.Grid(0.0, 0.0, 1.0, 64, height), block=128)
    return _summary(out.withColumn("patch", F.col("row_off").cast("long")))


@query("thumbnail_drift", f"WITH {TP} SELECT 48.0::DOUBLE AS dx, -28.0::DOUBLE AS dy, count(*) AS inliers FROM tp WHERE {GOOD}")
def thumbnail_drift(spark, d):
    """Three in four points moved by (12, -7) pixels of a thumbnail at a quarter of the scale, the others elsewhere."""
    away = F.when(F.expr(GOOD), 0.0).otherwise(40 + 100 * F.col("score"))
    points = tie_points(spark, d).withColumns({"rx": F.col("sx") + 12 + away, "ry": F.col("sy") - 7 - away})
    t = G.thumbnail_drift(points, 0.25, 8000)
    return spark.createDataFrame([(None, None, None)] if t is None else [(round(t.dx, 3), round(t.dy, 3), t.inliers)], "dx double, dy double, inliers long")


@query("fixed_point_inverse", f"WITH {TP} SELECT okey, line, round(sx, 4) + 0.0 AS sx, round(sy, 4) + 0.0 AS sy FROM tp")
def fixed_point_inverse(spark, d):
    """Places sent forward by a map near a shift, and back by its fixed-point inverse."""
    forward = lambda p: p + np.column_stack([12 + 0.01 * p[:, 1], -7 + 0.01 * p[:, 0]])
    inverse = T.fixed_point_inverse(forward, 6)

    def run(batches):
        for pdf in batches:
            back = inverse(forward(pdf[["sx", "sy"]].to_numpy()))
            yield pdf.assign(sx=back[:, 0].round(4) + 0.0, sy=back[:, 1].round(4) + 0.0)

    return tie_points(spark, d).select("okey", "line", "sx", "sy").mapInPandas(run, "okey long, line int, sx double, sy double")


_WIDE = 'SELECT patch, "row", col, round(v, 4) + 0.0 AS v FROM'


@query("raw_raster", f"WITH {PATCHES} {_WIDE} patches")
def raw_raster(spark, d):
    """Patches written as raw files after a header of 128 bytes, and read back by label: lines, samples, offset and pixel type."""
    from tessera.sources.raw import read_raw, write_raw

    files = write_raw(_patches(spark, d), new_folder(spark, "raw"), "patch", 128).orderBy("patch").collect()  # a row for each file
    tiles = read_raw(spark, [x["path"] for x in files], lines=64, samples=64, offset=128, pixel_type="<f8", block_rows=24)
    at = tiles.withColumn("tile", F.struct(F.regexp_extract("image_id", r"(\d+)[.]img$", 1).cast("long").alias("patch"), "row_off", "col_off"))
    out = T.long_form(at.select("tile", "h", "w", "dtype", "px").withColumn("tile", F.to_json("tile")), "tile").withColumn("at", F.from_json("tile", "patch long, row_off int, col_off int"))
    return out.select(F.col("at.patch").alias("patch"), (F.col("at.row_off") + F.col("row")).alias("row"), (F.col("at.col_off") + F.col("col")).alias("col"), r("v", 4).alias("v"))


@query("window_crop", f"WITH {PATCHES} SELECT patch * 64 + \"row\" - 30 AS \"row\", col - 5 AS col, round(v, 4) + 0.0 AS v FROM patches WHERE patch * 64 + \"row\" BETWEEN 30 AND 149 AND col BETWEEN 5 AND 54")
def window_crop(spark, d):
    """A window of the tiled image, written as a tile table, read by window and cut out; rows beyond the image are left out."""
    from tessera.registration import windows_of
    from tessera.sources.sinks import read_window, write_tiles

    tiles, height = _image(spark, d)
    folder = new_folder(spark, "tiles")
    write_tiles(tiles, folder)
    box = spark.createDataFrame([(0, 30, min(150, height), 5, 55)], "id int, y0 int, y1 int, x0 int, x1 int")
    cut = windows_of(read_window(spark, folder, "image", 30, 5, 120, 50), box, "id")
    return T.long_form(cut, "id").select(F.col("row").cast("long").alias("row"), "col", r("v", 4).alias("v"))


@query("dense_rotation", "SELECT s_suppkey, true AS found FROM supplier")
def dense_rotation(spark, d):
    """Each supplier's texture against itself turned by 2 to 4 degrees and larger by a twentieth: whether the matches give that back."""
    from tessera.functions.descriptors import dense_matcher

    def draw(batches):
        yy, xx = np.mgrid[0:96, 0:96].astype(float)
        for pdf in batches:
            rows = []
            for k in pdf["s_suppkey"]:
                rng, turn = np.random.default_rng(int(k)), np.deg2rad(2 + k % 3)
                a = sum(K.gaussian(rng.normal(size=(96, 96)), s) * s for s in (1.5, 3.0)) * 100 + 500
                x, y = (xx - 47.5) / 1.05, (yy - 47.5) / 1.05
                b = K.sample(a, -np.sin(turn) * x + np.cos(turn) * y + 47.5, np.cos(turn) * x + np.sin(turn) * y + 47.5, 1)
                rows.append((k, 96, 96, "<f8", a.tobytes(), 96, 96, "<f8", b.tobytes()))
            yield type(pdf)(rows, columns=["s_suppkey", "a_h", "a_w", "a_dtype", "a_px", "b_h", "b_w", "b_dtype", "b_px"])

    pairs = T.dealt(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").mapInPandas(draw, "s_suppkey long, a_h int, a_w int, a_dtype string, a_px binary, b_h int, b_w int, b_dtype string, b_px binary")
    turn = F.radians(2 + F.col("s_suppkey") % 3)
    x, y = (F.col("sx") - 47.5) * 1.05, (F.col("sy") - 47.5) * 1.05
    away = F.hypot(F.cos(turn) * x - F.sin(turn) * y + 47.5 - F.col("rx"), F.sin(turn) * x + F.cos(turn) * y + 47.5 - F.col("ry"))
    found = T.matched(pairs, "s_suppkey", dense_matcher).groupBy("s_suppkey").agg(F.count_if(away < 1.5).alias("good"), F.count("*").alias("n"))
    held = table(spark, d, "supplier").select("s_suppkey").join(found, "s_suppkey", "left")
    return held.select("s_suppkey", F.coalesce((F.col("good") >= 20) & (F.col("good") > 0.6 * F.col("n")), F.lit(False)).alias("found"))
