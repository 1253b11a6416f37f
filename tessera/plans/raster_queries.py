"""Queries of the raster operators over embeddings (a raster 64 wide) and events (bands, streams of lines)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import points as P
from tessera.operators import rasters as R
from tessera.plans.views import PX, pixels, table

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


_ENT = """ok AS (SELECT event_type AS band, value AS v FROM events WHERE value > 0 AND NOT isnan(value)), sp AS (SELECT band, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_pop(v) AS sd FROM ok GROUP BY band),
    c AS (SELECT band, n, least(63, floor((v - lo) / ((hi - lo) / 64))) AS k, count(*) AS c FROM ok JOIN sp USING (band) GROUP BY ALL), h AS (SELECT band, -sum(c / n * log2(c / n)) AS entropy FROM c GROUP BY band)"""


@query("histogram_entropy", f"WITH {_ENT} SELECT band, round(entropy, 6) + 0.0 AS entropy FROM h")
def histogram_entropy(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("band"), F.col("value").alias("v"))
    return R.histogram_entropy(e, ["band"]).select("band", r("entropy").alias("entropy"))


@query("band_scoring", f"""WITH {_ENT}, s AS (SELECT band, 0.4 * sd + 3 * entropy + 30.0 / (1 + abs(800 + 16.5 * length(band) - 689) / 500) AS score FROM sp JOIN h USING (band))
    SELECT band, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (ORDER BY score DESC, band) AS INT) AS rank FROM s""")
def band_scoring(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("band"), F.col("value").alias("v"))
    return R.band_scores(e, "band", R.wavelength(F.length("band")), 689.0).select("band", r("score").alias("score"), "rank")


@query("pseudo_pan", "SELECT event_id % 500 AS \"row\", user_id % 5 AS col, round(coalesce(avg(CASE WHEN value > 20 THEN value - 20 END), 0), 6) + 0.0 AS v FROM events WHERE length(event_type) < 7 GROUP BY ALL")
def pseudo_pan(spark, d):
    e = table(spark, d, "events").select(F.length("event_type").alias("band"), (F.col("event_id") % 500).alias("row"), (F.col("user_id") % 5).alias("col"), (F.col("value") - 20).alias("v"))
    return R.pseudo_pan(e, 7).select("row", "col", r("v").alias("v"))


@query("deinterleave", "SELECT event_id // 78 AS frame, event_id % 78 - 64 AS k, (event_id // 78) * 14 + event_id % 78 - 64 AS \"row\", user_id AS sample, value AS v FROM events WHERE event_id % 78 BETWEEN 64 AND 77")
def deinterleave(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("sample"), F.col("value").alias("v"))
    return R.deinterleave(e, 7)


@query("flat_field", "WITH m AS (SELECT event_id % 14 AS k, avg(value) AS pm FROM events GROUP BY 1), g AS (SELECT avg(pm) AS grand FROM m) SELECT event_id, round(value / (pm / grand), 6) + 0.0 AS v FROM events JOIN m ON event_id % 14 = k, g")
def flat_field(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 14).alias("k"), F.col("value").alias("v"))
    return R.flat_field(e).select("event_id", r("v").alias("v"))


@query("seam_feather", """WITH o AS (SELECT event_id, user_id, value AS v, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM o WINDOW w AS (PARTITION BY user_id ORDER BY k))
    SELECT event_id, round(CASE WHEN k % 14 = 13 AND a IS NOT NULL THEN 0.75 * v + 0.25 * a WHEN k % 14 = 0 AND b IS NOT NULL THEN 0.25 * b + 0.75 * v ELSE v END, 6) + 0.0 AS v FROM n""")
def seam_feather(spark, d):
    e = table(spark, d, "events").withColumn("row", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return R.feather_seams(e.select("event_id", F.col("user_id").alias("sample"), "row", F.col("value").alias("v")), 14).select("event_id", r("v").alias("v"))


_STRETCH = "s AS (SELECT quantile_cont(value, 0.02) FILTER (value > 0) AS lo, quantile_cont(value, 0.98){f} AS hi FROM events)"
_STRETCHED = "SELECT event_id, CAST(floor(least(1, greatest(0, (value - lo) / (hi - lo + 1e-6::DOUBLE))) * 255) AS INT) AS u8 FROM events, s"


@query("percentile_stretch", "WITH " + _STRETCH.format(f=" FILTER (value > 0)") + " " + _STRETCHED)
def percentile_stretch(spark, d):
    return R.percentile_stretch(table(spark, d, "events").select("event_id", F.col("value").alias("v"))).select("event_id", "u8")


@query("percentile_stretch_all", "WITH " + _STRETCH.format(f="") + " " + _STRETCHED)
def percentile_stretch_all(spark, d):
    return R.percentile_stretch(table(spark, d, "events").select("event_id", F.col("value").alias("v")), high_of_all=True).select("event_id", "u8")


@query("stretch_by_group", "WITH s AS (SELECT user_id, quantile_cont(value, 0.01) FILTER (value > 0) AS lo, quantile_cont(value, 0.99) FILTER (value > 0) AS hi, count(*) FILTER (value > 0) AS n FROM events GROUP BY user_id) SELECT event_id, CAST(CASE WHEN n < 60 THEN trunc(least(255, greatest(0, value))) ELSE floor(least(1, greatest(0, (value - lo) / (hi - lo + 1e-6::DOUBLE))) * 255) END AS INT) AS u8 FROM events JOIN s USING (user_id)")
def stretch_by_group(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("v"))
    return R.percentile_stretch(e, 0.01, 0.99, 60, by=["user_id"]).select("event_id", "u8")


@query("minmax_norm", f"WITH {PX}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM px) SELECT \"row\", col, CAST(floor((v - lo) / (hi - lo) * 255) AS INT) AS u8 FROM px, s")
def minmax_norm(spark, d):
    return R.minmax_byte(pixels(spark, d)).select("row", "col", "u8")


@query("block_average", f"WITH {PX} SELECT CAST(floor(\"row\" / 8) AS INT) AS \"row\", CAST(floor(col / 8) AS INT) AS col, round(avg(v), 6) + 0.0 AS v FROM px GROUP BY ALL")
def block_average(spark, d):
    return R.block_average(pixels(spark, d), 8).select("row", "col", r("v").alias("v"))


@query("sobel_gradient", f"""WITH {PX}, n AS (SELECT p."row", p.col,
      sum(q.v * (CASE q.col - p.col WHEN -1 THEN -1 WHEN 1 THEN 1 ELSE 0 END) * (CASE WHEN q."row" = p."row" THEN 2 ELSE 1 END)) AS gx,
      sum(q.v * (CASE q."row" - p."row" WHEN -1 THEN -1 WHEN 1 THEN 1 ELSE 0 END) * (CASE WHEN q.col = p.col THEN 2 ELSE 1 END)) AS gy, count(*) AS n
    FROM px p JOIN (SELECT px."row", px.col, px.v, px."row" + o.dy AS r0, px.col + o.dx AS c0 FROM px, (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i)) o) q ON q.r0 = p."row" AND q.c0 = p.col GROUP BY ALL)
    SELECT "row", col, round(sqrt(gx * gx + gy * gy) / max(sqrt(gx * gx + gy * gy)) OVER (), 5) AS g FROM n WHERE n = 9""")
def sobel_gradient(spark, d):
    return R.sobel(pixels(spark, d)).select("row", "col", r("g", 5).alias("g"))


@query("shadow_mask", f"""WITH {PX}, q AS (SELECT "row", col, v + 0.3 AS v FROM px), f AS (SELECT quantile_cont(v, 0.05) FILTER (v > 0) AS fl FROM q),
    near AS (SELECT DISTINCT q."row" + o.dy AS "row", q.col + o.dx AS col FROM q, f, (SELECT a.i AS dy, b.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i) WHERE a.i * a.i + b.i * b.i <= 1) o WHERE q.v <= fl)
    SELECT q."row", q.col, near."row" IS NULL AND q.v > 0 AS ok FROM q LEFT JOIN near ON q."row" = near."row" AND q.col = near.col""")
def shadow_mask(spark, d):
    return R.shadow_mask(pixels(spark, d).withColumn("v", F.col("v") + 0.3), radius=1)


@query("shadow_floor", "SELECT round(quantile_cont(value, 0.05), 6) AS \"floor\" FROM events WHERE value > 0")
def shadow_floor(spark, d):
    return table(spark, d, "events").where("value > 0").agg(r(F.percentile("value", F.lit(0.05))).alias("floor"))


@query("valid_tiles", f"WITH {PX} SELECT CAST(\"row\" // 16 AS BIGINT) AS tile, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM px GROUP BY 1 HAVING avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) >= 0.5")
def valid_tiles(spark, d):
    return R.valid_share(pixels(spark, d).withColumn("tile", F.floor(F.col("row") / 16)), ["tile"], 0.5).select("tile", r("share").alias("share"))


@query("abs_difference", f"""WITH {PX}, n AS (SELECT "row", col, v, lead(v) OVER w AS b, lead("row") OVER w AS next FROM px WINDOW w AS (PARTITION BY col ORDER BY "row"))
    SELECT "row", col, round(CASE WHEN v > 0 AND b > 0 THEN abs(v - b) ELSE 0 END, 6) AS v FROM n WHERE next = "row" + 1""")
def abs_difference(spark, d):
    p = pixels(spark, d)
    return R.absolute_difference(p, p.withColumn("row", F.col("row") - 1)).select("row", "col", r("v").alias("v"))


@query("false_colour", f"""WITH {PX}, u AS (SELECT "row", col, v AS r, NULL AS g FROM px UNION ALL SELECT "row" - 1, col, NULL, v FROM px)
    SELECT "row", col, round(coalesce(max(r), 0), 6) AS r, round(coalesce(max(g), 0), 6) AS g, round(coalesce(max(g), 0), 6) AS b FROM u GROUP BY ALL""")
def false_colour(spark, d):
    p = pixels(spark, d)
    c = R.false_colour(p, p.withColumn("row", F.col("row") - 1))
    return c.select("row", "col", *(r(x).alias(x) for x in ("r", "g", "b")))


@query("vector_ncc_argmax", """WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), j AS (SELECT p.vec_id AS patch_id, c.vec_id AS cand_id, list_inner_product(p.e, c.e) AS score FROM e p, e c WHERE p.vec_id % 20 = 0 AND p.vec_id <> c.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, cand_id) AS rn FROM j) SELECT patch_id, cand_id, round(score, 5) AS score FROM k WHERE rn = 1""")
def vector_ncc_argmax(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    patches = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("patch_id"), F.col("e").alias("p"))
    return R.ncc_argmax(patches, e.select(F.col("vec_id").alias("cand_id"), F.col("e").alias("c")), others=True).select("patch_id", "cand_id", r("score", 5).alias("score"))


@query("raster_entropy", f"WITH {PX}, c AS (SELECT least(3, floor(\"row\" / 125)) AS cy, least(3, floor(col / 16)) AS cx, count(*) AS n FROM px WHERE v > 0 GROUP BY ALL) SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c")
def raster_entropy(spark, d):
    return P.spatial_entropy(pixels(spark, d).where("v > 0"), "col", "row", 64, 500, 4, 4).select(r("entropy").alias("entropy"))


@query("native_grid", "SELECT p_partkey, CAST(round_even(1000 * (p_size / 10.0::DOUBLE), 0) AS BIGINT) AS width, CAST(round_even(750 * (p_size / 10.0::DOUBLE), 0) AS BIGINT) AS height, round(p_size / (p_size / 10.0::DOUBLE), 6) AS a FROM part")
def native_grid(spark, d):
    g = R.native_grid(F.col("p_size").cast("double"), -F.col("p_size").cast("double"), F.lit(1000), F.lit(750), F.lit(10.0))
    return table(spark, d, "part").select("p_partkey", g["width"].alias("width"), g["height"].alias("height"), r(g["a"]).alias("a"))
