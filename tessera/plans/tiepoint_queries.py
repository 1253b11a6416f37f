"""Queries of the tie-point operators over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import points as P
from tessera.plans.views import RES, TP, residuals, table, tie_points

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


_ENTROPY = """cells AS (SELECT least(3, greatest(0, floor(sy / 500))) AS cy, least(3, greatest(0, floor(sx / {w}))) AS cx, count(*) AS n FROM {t} GROUP BY ALL)"""


@query("spatial_entropy", f"WITH {TP}, {_ENTROPY.format(t='tp', w='500')} SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS entropy, CAST(sum(n) AS BIGINT) AS n FROM cells")
def spatial_entropy(spark, d):
    tp = tie_points(spark, d)
    return P.spatial_entropy(tp, "sx", "sy", 2000, 2000, 4, 4).crossJoin(tp.agg(F.count("*").alias("n"))).select(r("entropy").alias("entropy"), "n")


@query("drift_regression", f"""WITH {TP} SELECT count(*) AS n, round(regr_slope(rx - sx, sy) * 1e6, 4) + 0.0 AS dx_slope_e6, round(regr_intercept(rx - sx, sy), 6) + 0.0 AS dx_intercept,
    round(regr_slope(ry - sy, sy) * 1e6, 4) + 0.0 AS dy_slope_e6, round(regr_intercept(ry - sy, sy), 6) + 0.0 AS dy_intercept, round(median(rx - sx), 6) + 0.0 AS dx_median, round(median(ry - sy), 6) + 0.0 AS dy_median FROM tp""")
def drift_regression(spark, d):
    m = P.drift_regression(tie_points(spark, d))
    return m.select("n", r(F.col("dx_slope") * 1e6, 4).alias("dx_slope_e6"), r("dx_intercept").alias("dx_intercept"), r(F.col("dy_slope") * 1e6, 4).alias("dy_slope_e6"), r("dy_intercept").alias("dy_intercept"), r("dx_median").alias("dx_median"), r("dy_median").alias("dy_median"))


@query("capped_drift", f"""WITH {TP}, m AS (SELECT supp, count(*) AS n, regr_slope(rx - sx, sy) AS a, regr_intercept(rx - sx, sy) AS b, regr_slope(ry - sy, sy) AS c, regr_intercept(ry - sy, sy) AS e, median(rx - sx) AS mx, median(ry - sy) AS my FROM tp GROUP BY supp),
    j AS (SELECT *, a IS NULL OR c IS NULL OR abs(a) > 0.00002 OR abs(c) > 0.00002 AS bad FROM m)
    SELECT supp, n, round(CASE WHEN bad THEN 0 ELSE a END * 1e6, 3) + 0.0 AS dx_slope_e6, round(CASE WHEN bad THEN mx ELSE b END, 6) + 0.0 AS dx_intercept, round(CASE WHEN bad THEN 0 ELSE c END * 1e6, 3) + 0.0 AS dy_slope_e6, round(CASE WHEN bad THEN my ELSE e END, 6) + 0.0 AS dy_intercept FROM j""")
def capped_drift(spark, d):
    m = P.capped_drift(P.drift_regression(tie_points(spark, d), by=["supp"]), cap=0.00002)
    return m.select("supp", "n", r(F.col("dx_slope") * 1e6, 3).alias("dx_slope_e6"), r("dx_intercept").alias("dx_intercept"), r(F.col("dy_slope") * 1e6, 3).alias("dy_slope_e6"), r("dy_intercept").alias("dy_intercept"))


@query("mad_inliers", f"""WITH {RES}, m AS (SELECT supp, median(dx) AS mx, median(dy) AS my FROM res GROUP BY supp),
    a AS (SELECT res.*, abs(dx - mx) AS ax, abs(dy - my) AS ay FROM res JOIN m USING (supp)), s AS (SELECT supp, median(ax) AS sx2, median(ay) AS sy2 FROM a GROUP BY supp)
    SELECT supp, count(*) AS n, round(sum(dx), 4) + 0.0 AS sum_dx, round(sum(dy), 4) + 0.0 AS sum_dy FROM a JOIN s USING (supp) WHERE ax <= greatest(1.2 * sx2, 0.3) AND ay <= greatest(1.2 * sy2, 0.3) GROUP BY supp""")
def mad_inliers(spark, d):
    kept = P.mad_inliers(residuals(spark, d), ["dx", "dy"], floor=0.3, factor=1.2, by=["supp"])
    return kept.groupBy("supp").agg(F.count("*").alias("n"), r(F.sum("dx"), 4).alias("sum_dx"), r(F.sum("dy"), 4).alias("sum_dy"))


@query("stratified_consensus", f"""WITH {RES}, e AS (SELECT *, sqrt(dx * dx + dy * dy) AS err FROM res), s AS (SELECT min(sy) AS y0, max(sy) AS y1 FROM e),
    b AS (SELECT e.*, CAST(least(5, greatest(0, floor((sy - y0) / ((y1 - y0) / 6)))) AS INT) AS bin FROM e, s),
    m AS (SELECT bin, median(err) AS med FROM b GROUP BY bin), a AS (SELECT bin, med, median(abs(err - med)) AS mad FROM b JOIN m USING (bin) GROUP BY bin, med),
    k AS (SELECT b.*, med, mad, CAST(row_number() OVER (PARTITION BY bin ORDER BY err, okey, line) AS INT) AS rank_in_bin FROM b JOIN a USING (bin))
    SELECT bin, rank_in_bin, okey, line, round(err, 6) + 0.0 AS err FROM k WHERE (err <= least(1.8, greatest(0.8, med + 1.5 * 1.4826 * mad)) OR rank_in_bin <= 6) AND rank_in_bin <= 25""")
def stratified_consensus(spark, d):
    e = residuals(spark, d).withColumn("err", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return P.stratified_consensus(e, "sy", "err", ["okey", "line"]).select("bin", "rank_in_bin", "okey", "line", r("err").alias("err"))


@query("spike_filter", f"WITH {RES}, e AS (SELECT *, sqrt(dx * dx + dy * dy) AS err FROM res) SELECT supp, count(*) AS n, round(max(err), 6) + 0.0 AS worst FROM e WHERE err <= 0.25 GROUP BY supp")
def spike_filter(spark, d):
    e = residuals(spark, d).withColumn("err", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return P.spike_filter(e, "err", most=0.25, tiebreak=["okey", "line"]).groupBy("supp").agg(F.count("*").alias("n"), r(F.max("err")).alias("worst"))


_VOTE_SQL = """WITH c AS (SELECT CAST(p_partkey % 1000 AS DOUBLE) AS cx, CAST((p_partkey * 7) % 1000 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) AS r, p_partkey AS id FROM part),
    t AS (SELECT cx + 12 AS cx, cy - 8 AS cy, r FROM c),
    v AS (SELECT CAST(least(49, floor((t.cx - s.cx + 100) / 4)) AS INT) AS bx, CAST(least(49, floor((t.cy - s.cy + 100) / 4)) AS INT) AS "by", count(*) AS votes
        FROM c s, t WHERE abs(s.r - t.r) <= 0.25 * greatest(s.r, t.r, 1) AND abs(t.cx - s.cx) < 100 AND abs(t.cy - s.cy) < 100 GROUP BY ALL)"""



@query("crater_votes", _VOTE_SQL + ' SELECT bx, "by", votes FROM v')
def crater_votes(spark, d):
    p = table(spark, d, "part")
    c = p.select((F.col("p_partkey") % 1000).cast("double").alias("cx"), (F.col("p_partkey") * 7 % 1000).cast("double").alias("cy"), F.col("p_size").cast("double").alias("r"))
    return P.radius_votes(c, c.select((F.col("cx") + 12).alias("cx"), (F.col("cy") - 8).alias("cy"), "r"), most_offset=100.0)


@query("crater_peak", _VOTE_SQL + ' SELECT -100 + bx * 4.0::DOUBLE + 2 AS dx, -100 + "by" * 4.0::DOUBLE + 2 AS dy, votes FROM v ORDER BY votes DESC, "by", bx LIMIT 1')
def crater_peak(spark, d):
    return P.vote_peak(crater_votes(spark, d), 100.0)


@query("residual_stats", f"""WITH {RES}, m AS (SELECT supp, median(dx) AS mx, median(dy) AS my FROM res GROUP BY supp),
    a AS (SELECT res.*, mx, my, sqrt(dx * dx + dy * dy) AS dist, sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) <= 0.8 AS inl FROM res JOIN m USING (supp))
    SELECT supp, count(*) AS total_count, count(*) FILTER (inl) AS inlier_count, round(first(mx), 4) + 0.0 AS median_dx, round(first(my), 4) + 0.0 AS median_dy, round(median(abs(dx - mx)), 4) + 0.0 AS mad_dx, round(median(abs(dy - my)), 4) + 0.0 AS mad_dy,
    round(sqrt(coalesce(avg(dist * dist) FILTER (inl), avg(dist * dist))), 4) + 0.0 AS rmse, round(coalesce(avg(dist) FILTER (inl), avg(dist)), 4) + 0.0 AS mean_err, round(coalesce(max(dist) FILTER (inl), max(dist)), 4) + 0.0 AS max_err FROM a GROUP BY supp""")
def residual_stats(spark, d):
    s = P.residual_stats(residuals(spark, d), clip=0.8, by=["supp"])
    return s.select("supp", "total_count", "inlier_count", *(r(c, 4).alias(c) for c in ("median_dx", "median_dy", "mad_dx", "mad_dy", "rmse", "mean_err", "max_err")))


_REPORT_SQL = f"""{RES}, cells AS (SELECT supp, least(3, greatest(0, floor(sy / 500))) AS cy, least(3, greatest(0, floor(sx / 500))) AS cx, count(*) AS n FROM res GROUP BY ALL),
    h AS (SELECT supp, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS entropy FROM cells GROUP BY supp),
    s AS (SELECT supp, count(*) AS n, count(*) FILTER (sqrt(dx * dx + dy * dy) <= 1.0) AS inliers, sqrt(avg(dx * dx + dy * dy)) AS rmse, least(1.0, (max(sx) - min(sx)) * (max(sy) - min(sy)) / 4000000.0) AS hull FROM res GROUP BY supp),
    j AS (SELECT *, 0.40 * least(1, greatest(0, 1 - rmse / 1.5)) + 0.25 * least(1, greatest(0, entropy / 4.0)) + 0.20 * least(1, greatest(0, greatest(inliers / n, inliers / 40.0))) + 0.15 * least(1, greatest(0, hull / 0.20)) AS score FROM s JOIN h USING (supp))"""
_VERDICT = """CASE WHEN inliers < 10 THEN 'REJECTED (Insufficient Inliers)' WHEN hull * 100 < 5 THEN 'REJECTED (Poor Spatial Coverage)' WHEN entropy < 1 THEN 'REJECTED (Clustered Matches)'
    WHEN rmse >= 1 THEN 'REJECTED (RMSE Out of Bounds)' WHEN rmse < 0.5 THEN 'VERIFIED_SUCCESS' WHEN score >= 0.5 THEN 'VERIFIED (Sub-Pixel Target Met)' ELSE 'UNCERTAIN' END"""


def _report(spark, d):
    res = residuals(spark, d)
    h = P.spatial_entropy(res, "sx", "sy", 2000, 2000, 4, 4, by=["supp"])
    sq = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    hull = F.least(F.lit(1.0), (F.max("sx") - F.min("sx")) * (F.max("sy") - F.min("sy")) / 4000000.0)
    s = res.groupBy("supp").agg(F.count("*").alias("n"), F.count_if(F.sqrt(sq) <= 1.0).alias("inliers"), F.sqrt(F.avg(sq)).alias("rmse"), hull.alias("hull")).join(h, "supp")
    return s.withColumn("score", P.composite_score(F.col("rmse"), F.col("entropy") / 4.0, F.col("inliers") / F.col("n"), F.col("inliers"), F.col("hull")))


@query("registration_report", f"WITH {_REPORT_SQL} SELECT supp, n, inliers, round(rmse, 5) + 0.0 AS rmse, round(hull, 5) + 0.0 AS hull, round(entropy, 5) + 0.0 AS entropy, round(score, 5) + 0.0 AS score, {_VERDICT} AS verdict FROM j")
def registration_report(spark, d):
    v = P.verdict(F.col("inliers"), F.col("hull"), F.col("entropy"), F.col("rmse"), F.col("score"))
    return _report(spark, d).select("supp", "n", "inliers", *(r(c, 5).alias(c) for c in ("rmse", "hull", "entropy", "score")), v.alias("verdict"))


@query("precision_tier", f"WITH {RES}, s AS (SELECT okey % 997 AS k, sqrt(avg(dx * dx + dy * dy)) * (okey % 997) / 500.0 AS rmse FROM res GROUP BY okey % 997) SELECT CASE WHEN rmse < 0.2 THEN '<0.2px' WHEN rmse < 0.5 THEN '<0.5px' WHEN rmse < 1 THEN '<1.0px' ELSE '>=1.0px' END AS tier, count(*) AS n FROM s GROUP BY 1")
def precision_tier(spark, d):
    s = residuals(spark, d).groupBy((F.col("okey") % 997).alias("k")).agg((F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) * F.col("k") / 500.0).alias("rmse"))
    return s.groupBy(P.precision_tier(F.col("rmse")).alias("tier")).agg(F.count("*").alias("n"))


@query("effective_rmse", f"WITH {RES}, s AS (SELECT supp, sqrt(avg(dx * dx)) AS a, CASE WHEN supp % 3 > 0 THEN sqrt(avg(dy * dy)) END AS b FROM res GROUP BY supp) SELECT supp, round(greatest(a, coalesce(b, a)), 6) + 0.0 AS rmse, CASE WHEN supp % 2 = 0 THEN round(greatest(a, coalesce(b, a)) * 5.0, 6) + 0.0 END AS rmse_m FROM s")
def effective_rmse(spark, d):
    s = residuals(spark, d).groupBy("supp").agg(F.sqrt(F.avg(F.col("dx") * F.col("dx"))).alias("a"), F.sqrt(F.avg(F.col("dy") * F.col("dy"))).alias("b"))
    e = s.withColumn("rmse", P.effective_rmse(F.col("a"), F.when(F.col("supp") % 3 > 0, F.col("b"))))
    return e.select("supp", r("rmse").alias("rmse"), r(P.rmse_metres(F.col("rmse"), F.lit(5.0), F.col("supp") % 2 == 0, F.lit(True))).alias("rmse_m"))


@query("override_counts", f"WITH {RES}, s AS (SELECT count(*) AS n, count(*) FILTER (sqrt(dx * dx + dy * dy) <= 0.8) AS k FROM res) SELECT n AS total_count, k AS clipped_count, 800 AS inlier_count, 0.8::DOUBLE AS inlier_ratio FROM s")
def override_counts(spark, d):
    sq = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    s = residuals(spark, d).agg(F.count("*").alias("total_count"), F.count_if(sq <= 0.8).alias("inlier_count"))
    model = spark.range(1).select(F.lit(800).alias("inlier_count"), F.lit(1000).alias("total_points"))
    return P.override_counts(s, model).select("total_count", "clipped_count", F.col("inlier_count").cast("int"), "inlier_ratio")


@query("uniform_subsample", """WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity FROM o WHERE k IN (SELECT CAST(floor(i * n / 800.0) AS BIGINT) FROM range(800) t(i), (SELECT count(*) AS n FROM lineitem))""")
def uniform_subsample(spark, d):
    """800 rows evenly along the order, whose last key tells apart all rows that differ in the result."""
    chosen = P.uniform_subsample(table(spark, d, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"], 800)
    return chosen.select("l_orderkey", "l_linenumber", "l_quantity")


@query("border_reject", f"WITH {TP} SELECT supp, count(*) AS n FROM tp WHERE round_even(sx, 0) >= 32 AND round_even(sx, 0) + 32 <= 1500 AND round_even(sy, 0) >= 32 AND round_even(sy, 0) + 32 <= 1500 AND round_even(rx, 0) >= 32 AND round_even(rx, 0) + 32 <= 1500 AND round_even(ry, 0) >= 32 AND round_even(ry, 0) + 32 <= 1500 GROUP BY supp")
def border_reject(spark, d):
    return P.border_reject(tie_points(spark, d), 32, (1500, 1500), (1500, 1500)).groupBy("supp").agg(F.count("*").alias("n"))


@query("snapped_points", f"WITH {TP} SELECT okey, line, round_even(sx + 0.5, 0) AS sx, round_even(sy, 0) AS sy, round(round_even(rx, 0) + score, 6) AS rx, round(round_even(ry, 0) - score, 6) + 0.0 AS ry FROM tp")
def snapped_points(spark, d):
    t = tie_points(spark, d).withColumns({"sx": F.col("sx") + 0.5, "ox": F.col("score"), "oy": -F.col("score")})
    s = t.withColumn("score", F.struct("okey", "line"))
    return P.snapped(s).select(F.col("score.okey").alias("okey"), F.col("score.line").alias("line"), "sx", "sy", r("rx").alias("rx"), r("ry").alias("ry"))




@query("tile_assignment", f"WITH {TP} SELECT CAST(least(4, greatest(0, floor((sy - 60) / 400))) AS INT) AS ty, CAST(least(4, greatest(0, floor((sx - 60) / 400))) AS INT) AS tx, count(*) AS n FROM tp GROUP BY ALL")
def tile_assignment(spark, d):
    return P.core_assignment(tie_points(spark, d), F.col("sx"), F.col("sy"), 520, 400, 2000, 2000).groupBy("ty", "tx").agg(F.count("*").alias("n"))


@query("core_filter", f"""WITH {TP}, ax AS (SELECT i, i * 400 AS s, CASE WHEN i = 0 THEN 0 ELSE i * 400 + 60 END AS c0, CASE WHEN i = 4 THEN 2000 ELSE i * 400 + 460 END AS c1 FROM range(0, 5) t(i))
    SELECT CAST(y.i * 5 + x.i AS INT) AS tile_id, count(*) AS n FROM tp JOIN ax x ON sx >= x.c0 AND sx < x.c1 JOIN ax y ON sy >= y.c0 AND sy < y.c1 GROUP BY ALL""")
def core_filter(spark, d):
    return P.in_core(tie_points(spark, d), 520, 400, 2000, 2000).groupBy("tile_id").agg(F.count("*").alias("n"))


#: Sizes of images, by supplier.
_SIZES = "images AS (SELECT s_suppkey AS image, CAST(900 + s_suppkey * 37 % 1900 AS INT) AS height, CAST(150 + s_suppkey * 53 % 2600 AS INT) AS width FROM supplier)"


def _images(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("image"), (900 + k * 37 % 1900).cast("int").alias("height"), (150 + k * 53 % 2600).cast("int").alias("width"))


def _axis_sql(n: str, v: str) -> str:
    """Tiles of 520 every 400 of an axis, of 200 at least, and their cores: (image, k, v0, v1, c0, c1)."""
    return f"""{v}s AS (SELECT image, {n} AS n, s, least(s + 520, {n}) AS e FROM (SELECT *, unnest(range(0, {n}, 400)) AS s FROM images) WHERE least(s + 520, {n}) - s >= 200 OR ({n} < 200 AND s = 0)),
    {v} AS (SELECT image, CAST(row_number() OVER w - 1 AS INT) AS k, count(*) OVER (PARTITION BY image) AS many, CAST(s AS INT) AS {v}0, CAST(e AS INT) AS {v}1,
        CAST(CASE WHEN s = 0 THEN 0 ELSE greatest(s + 60, coalesce(lag(CASE WHEN e >= n THEN n ELSE e - 60 END) OVER w, 0)) END AS INT) AS {v}core0,
        CAST(CASE WHEN e >= n OR lead(s) OVER w IS NULL THEN n ELSE e - 60 END AS INT) AS {v}core1 FROM {v}s WINDOW w AS (PARTITION BY image ORDER BY s))"""


_GRIDS = f"{_SIZES}, {_axis_sql('height', 'y')}, {_axis_sql('width', 'x')}, g AS (SELECT image, CAST(y.k * x.many + x.k AS INT) AS tile_id, x0, x1, y0, y1, xcore0, xcore1, ycore0, ycore1 FROM y JOIN x USING (image))"


@query("tile_grid", f"WITH {_GRIDS} SELECT * FROM g")
def tile_grid(spark, d):
    """Every image's overlapping tiles and their cores."""
    return P.tile_grids(_images(spark, d), 520, 400).drop("height", "width")


@query("fixed_grid", f"WITH {_SIZES} SELECT image, CAST(r * 4 + c AS INT) AS tile_id, CAST(r * (height // 4) AS INT) AS y0, CAST(CASE WHEN r = 3 THEN height ELSE (r + 1) * (height // 4) END AS INT) AS y1, CAST(c * (width // 4) AS INT) AS x0, CAST(CASE WHEN c = 3 THEN width ELSE (c + 1) * (width // 4) END AS INT) AS x1 FROM images, range(0, 4) a(r), range(0, 4) b(c)")
def fixed_grid(spark, d):
    return P.fixed_grids(_images(spark, d), 4, 4).drop("height", "width")


@query("search_window", f"""WITH {_GRIDS}, p AS (SELECT g.*, i.height, i.width, (image % 5 - 2) / 100.0::DOUBLE * ((y0 + y1) / 2.0::DOUBLE) + (12.5::DOUBLE + image % 7) AS dx, -0.02::DOUBLE * ((y0 + y1) / 2.0::DOUBLE) - 3.25::DOUBLE AS dy FROM g JOIN images i USING (image)),
    w AS (SELECT image, tile_id, CAST(greatest(0, round_even(x0 + dx, 0) - 200) AS BIGINT) AS wx0, CAST(least(width, round_even(x1 + dx, 0) + 200) AS BIGINT) AS wx1, CAST(greatest(0, round_even(y0 + dy, 0) - 200) AS BIGINT) AS wy0, CAST(least(height, round_even(y1 + dy, 0) + 200) AS BIGINT) AS wy1 FROM p)
    SELECT * FROM w WHERE wx1 > wx0 AND wy1 > wy0""")
def search_window(spark, d):
    """Every image's tiles, each moved by its own image's drift."""
    tiles, k = P.tile_grids(_images(spark, d), 520, 400), F.col("image")
    w = P.search_windows(tiles, ((k % 5 - 2) / 100.0, -0.02), (12.5 + k % 7, -3.25), 200, F.col("height"), F.col("width"))
    return w.select("image", "tile_id", *(F.col(c).cast("long").alias(c) for c in ("wx0", "wx1", "wy0", "wy1")))


@query("padding_rule", """SELECT p_partkey, CASE WHEN p_size / 100.0 < 0.05 THEN 700 WHEN p_size / 100.0 < 0.15 THEN 500 WHEN p_retailprice > 800 OR p_size * 400 > 8000 THEN CAST(least(1200, greatest(600, floor(0.04 * p_size * 400))) AS INT) ELSE 200 END AS padding,
    CASE WHEN p_size * 100 > 3500 THEN 1200 ELSE 1600 END AS size, CASE WHEN p_size * 100 > 3500 THEN 800 ELSE 1200 END AS step FROM part""")
def padding_rule(spark, d):
    size, step = P.tile_and_step(F.col("p_size") * 100, 1600, 1200)
    return table(spark, d, "part").select("p_partkey", P.padding(F.col("p_size") / 100.0, F.col("p_retailprice"), F.col("p_size") * 400).cast("int").alias("padding"), size.alias("size"), step.alias("step"))


@query("conf_filter", f"WITH {TP}, w AS (SELECT *, okey % 500 AS cell, count(*) FILTER (score >= 0.9) OVER (PARTITION BY okey % 500) AS nh FROM tp) SELECT cell, count(*) AS n FROM w WHERE score >= CASE WHEN nh >= 12 THEN 0.9 ELSE 0.5 END GROUP BY cell")
def conf_filter(spark, d):
    return P.confidence_filter(tie_points(spark, d).withColumn("cell", F.col("okey") % 500), "cell", 0.9, 0.5, 12).groupBy("cell").agg(F.count("*").alias("n"))


@query("populated_cells", f"WITH {TP}, c AS (SELECT okey % 450 AS tile, count(*) AS n FROM tp GROUP BY 1) SELECT count(*) AS populated FROM c WHERE n >= 140")
def populated_cells(spark, d):
    return P.populated_cells(tie_points(spark, d).withColumn("tile", F.col("okey") % 450), "tile", 140)


@query("drift_filter", f"WITH {RES} SELECT supp, count(*) AS n FROM res WHERE abs(dx * 300 - (0.05 * sy + 10)) <= 180 AND abs(dy * 300 - (0.02 * sy + 5)) <= 180 GROUP BY supp")
def drift_filter(spark, d):
    t = residuals(spark, d).withColumns({"rx": F.col("sx") + F.col("dx") * 300, "ry": F.col("sy") + F.col("dy") * 300})
    kept = P.drift_filter(t, (0.05, 0.02), (10.0, 5.0), 2000, 0.5)
    return kept.groupBy("supp").agg(F.count("*").alias("n"))


@query("poly_moments", f"""WITH {RES}, y AS (SELECT (sy - 1000) / 500 AS yn, dx, dy FROM res) SELECT CAST(count(*) AS DOUBLE) AS s0, round(sum(yn), 3) + 0.0 AS s1, round(sum(yn ** 2), 3) + 0.0 AS s2, round(sum(yn ** 3), 3) + 0.0 AS s3, round(sum(yn ** 4), 3) + 0.0 AS s4,
    round(sum(dx), 4) + 0.0 AS t0_0, round(sum(dx * yn), 4) + 0.0 AS t0_1, round(sum(dx * yn ** 2), 4) + 0.0 AS t0_2, round(sum(dy), 4) + 0.0 AS t1_0, round(sum(dy * yn), 4) + 0.0 AS t1_1, round(sum(dy * yn ** 2), 4) + 0.0 AS t1_2 FROM y""")
def poly_moments(spark, d):
    m = P.poly_moments(residuals(spark, d), (F.col("sy") - 1000) / 500, [F.col("dx"), F.col("dy")], 2)
    return m.select(*(r(c, 3 if c[0] == "s" else 4).alias(c) for c in m.columns))


@query("cluster_count", f"WITH {TP}, s AS (SELECT avg(sy) AS m, greatest(1, stddev_pop(sy)) AS sd FROM tp) SELECT count(DISTINCT round_even((sy - m) / sd * 10, 0)) AS clusters FROM tp, s")
def cluster_count(spark, d):
    return P.cluster_count(tie_points(spark, d), "sy")


@query("model_predict", f"WITH {TP}, y AS (SELECT *, (sy - 1000) / 500 AS yn FROM tp) SELECT okey, line, round(1.01 * sx - 0.02 * sy + 5 + (0.5 * yn - 0.25) * yn + 2, 5) + 0.0 AS px, round(0.02 * sx + 0.99 * sy - 3 + (0.1 * yn + 0.3) * yn - 1, 5) + 0.0 AS py FROM y")
def model_predict(spark, d):
    p = P.predict(tie_points(spark, d), (1.01, -0.02, 5, 0.02, 0.99, -3), (0.5, -0.25, 2.0), (0.1, 0.3, -1.0), 1000.0, 500.0)
    return p.select("okey", "line", r("px", 5).alias("px"), r("py", 5).alias("py"))


@query("layer_rmse", f"WITH {RES} SELECT round(sqrt(avg(dx * dx + dy * dy)), 8) AS rmse FROM res")
def layer_rmse(spark, d):
    return P.layer_rmse(residuals(spark, d), F.col("dx"), F.col("dy")).select(r("rmse", 8).alias("rmse"))


@query("strip_samples", f"WITH {_SIZES}, r AS (SELECT image, height, i AS strip_idx, CAST(floor((i + 0.5::DOUBLE) * (height * 3) / 10) AS INT) AS \"row\", height * 3 AS h FROM images, range(0, 10) t(i)) SELECT image, CAST(strip_idx AS INT) AS strip_idx, \"row\", CAST(greatest(0, least(h - least(2048, h), \"row\" - least(2048, h) // 2)) AS INT) AS y0, CAST(greatest(0, least(h - least(2048, h), \"row\" - least(2048, h) // 2)) + least(2048, h) AS INT) AS y1 FROM r")
def strip_samples(spark, d):
    return P.strips_of(_images(spark, d).select("image", (F.col("height") * 3).alias("height"))).drop("height")


_STRIPS = """s AS (SELECT event_id % 200 AS strip, avg(value) AS vdx, avg(value) * 0.5 AS vdy, avg(value) + (event_id % 200) / 4.0 AS fdx, avg(value) * 0.5 AS fdy, count(*) % 11 AS votes, (event_id % 200) / 200.0 AS response FROM events GROUP BY event_id % 200),
    m AS (SELECT *, CASE WHEN votes >= 4 AND sqrt((vdx - fdx) ** 2 + (vdy - fdy) ** 2) <= 30 THEN 'agreed' WHEN votes >= 8 THEN 'votes_dominant' ELSE 'fourier' END AS method_used FROM s)"""


def _strips(spark, d):
    k = F.col("event_id") % 200
    s = table(spark, d, "events").groupBy(k.alias("strip")).agg(F.avg("value").alias("vdx"), F.count("*").alias("n"))
    return s.select("strip", "vdx", (F.col("vdx") * 0.5).alias("vdy"), (F.col("vdx") + F.col("strip") / 4.0).alias("fdx"), (F.col("vdx") * 0.5).alias("fdy"), (F.col("n") % 11).alias("votes"), (F.col("strip") / 200.0).alias("response"))


@query("strip_arbitration", f"WITH {_STRIPS} SELECT strip, method_used, round(CASE WHEN method_used <> 'fourier' THEN vdx ELSE fdx END, 6) + 0.0 AS dx, round(CASE WHEN method_used <> 'fourier' THEN vdy ELSE fdy END, 6) + 0.0 AS dy FROM m")
def strip_arbitration(spark, d):
    return P.arbitrate(_strips(spark, d)).select("strip", "method_used", r("dx").alias("dx"), r("dy").alias("dy"))


@query("strip_summary", f"WITH {_STRIPS} SELECT round(median(CASE WHEN method_used <> 'fourier' THEN vdx ELSE fdx END), 6) + 0.0 AS dx, round(median(CASE WHEN method_used <> 'fourier' THEN vdy ELSE fdy END), 6) + 0.0 AS dy, round(avg(response), 6) + 0.0 AS confidence, CASE WHEN bool_or(method_used <> 'fourier') THEN 'hybrid' ELSE 'fourier' END AS method_used FROM m")
def strip_summary(spark, d):
    return P.strip_summary(P.arbitrate(_strips(spark, d))).select(r("dx").alias("dx"), r("dy").alias("dy"), r("confidence").alias("confidence"), "method_used")


@query("match_groups", f"WITH {TP} SELECT CAST(floor(sx / 1200) AS INT) AS gx, CAST(floor(sy / 1200) AS INT) AS gy, count(*) AS n, round(min(rx) - 250, 6) AS x0, round(max(rx) + 250, 6) AS x1, round(min(ry) - 250, 6) AS y0, round(max(ry) + 250, 6) AS y1 FROM tp GROUP BY ALL")
def match_groups(spark, d):
    g = P.match_groups(tie_points(spark, d))
    return g.select("gx", "gy", "n", *(r(c).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query("ecc_threshold", "SELECT l_returnflag || l_linestatus AS pair, CASE WHEN l_returnflag = l_linestatus THEN 0.6 ELSE 0.45 END::DOUBLE AS threshold, count(*) AS n FROM lineitem GROUP BY ALL")
def ecc_threshold(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy(F.concat("l_returnflag", "l_linestatus").alias("pair"), P.ecc_threshold(F.col("l_returnflag"), F.col("l_linestatus")).cast("double").alias("threshold")).agg(F.count("*").alias("n"))


@query("active_cells", "WITH c AS (SELECT floor(CAST(okey AS BIGINT) * 4 / 2000) AS gr, floor(part * 4 / 2000) AS gc, avg(CASE WHEN q > 49 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT l_orderkey % 2000 AS okey, l_partkey % 2000 AS part, l_quantity AS q FROM lineitem) GROUP BY ALL) SELECT count(*) FILTER (share > 0.02) AS active, round(log2(greatest(count(*) FILTER (share > 0.02), 2)), 6) AS max_entropy FROM c")
def active_cells(spark, d):
    px = table(spark, d, "lineitem").select((F.col("l_orderkey") % 2000).alias("row"), (F.col("l_partkey") % 2000).alias("col"), (F.col("l_quantity") > 49).alias("ok"))
    return P.active_cells(px, 4, 4, 2000, 2000, 0.02).select("active", r("max_entropy").alias("max_entropy"))


@query("exact_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.02), 6) AS q02, round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.98), 6) AS q98 FROM lineitem")
def exact_quantiles(spark, d):
    from tessera.operators.quantiles import exact_percentiles

    q = exact_percentiles(table(spark, d, "lineitem"), "l_extendedprice", (0.02, 0.5, 0.98))
    return spark.range(1).select(*(F.round(F.lit(v), 6).alias(n) for n, v in zip(("q02", "q50", "q98"), q, strict=True)))
