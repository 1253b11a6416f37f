from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import points as P
from tessera.operators import quantiles as Q
from tessera.operators.quantiles import exact_percentiles


def frame(spark, rows, columns="sx double, sy double, rx double, ry double"):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], columns)


def test_entropy_of_even_and_clustered_points(spark):
    even = frame(spark, [(25 + 50 * i, 25 + 50 * j, 0, 0) for i in range(4) for j in range(4)])
    assert P.spatial_entropy(even, "sx", "sy", 200, 200, 4, 4).first()[0] == pytest.approx(4.0)
    one = frame(spark, [(10 + i, 10, 0, 0) for i in range(4)])
    assert P.spatial_entropy(one, "sx", "sy", 200, 200, 4, 4).first()[0] == 0.0
    assert P.spatial_entropy(one.limit(0), "sx", "sy", 200, 200, 4, 4).first()[0] == 0.0


def test_entropy_of_adversarial_sets(spark):
    ring = [(512 + 150 * np.cos(a), 512 + 150 * np.sin(a), 0, 0) for a in np.linspace(0, 2 * np.pi, 24, endpoint=False)]
    h = P.spatial_entropy(frame(spark, ring), "sx", "sy", 1024, 1024, 4, 4).first()[0]
    assert 1.0 < h < 3.0


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 2500])
def test_uniform_subsample(spark, n):
    df = spark.range(n).select(F.col("id").alias("k")).repartition(5)
    got = sorted(r[0] for r in P.uniform_subsample(df, ["k"], 800).collect())
    assert got == (list(range(n)) if n <= 800 else sorted({i * n // 800 for i in range(800)}))


def test_tiles_hold_each_point_once(spark):
    for height, size, step in ((2000, 520, 400), (2700, 1600, 1200), (150, 1600, 1200), (3000, 1600, 1200)):
        grid = P.tile_grid(spark, height, height, size, step).toPandas()
        for v in range(0, height, 7):
            assert len(grid[(grid.ycore0 <= v) & (grid.ycore1 > v) & (grid.xcore0 <= v) & (grid.xcore1 > v)]) == 1, (height, v)


def test_consensus_bounds_per_bin(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.uniform(0, 100), rng.uniform(0, 6000), e, k) for k, e in enumerate(rng.exponential(1.0, 600))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "sx double, sy double, err double, k double")
    kept = P.stratified_consensus(df, "sy", "err", ["k"]).toPandas()
    assert kept.groupby("bin").size().between(6, 25).all() and kept.bin.nunique() == 6


def test_drift_filter_is_all_or_nothing(spark):
    far = frame(spark, [(k, k, k + 5000, k) for k in range(10)])
    assert P.drift_filter(far, (0.0, 0.0), (1.0, 0.0), 1000, 0.5).count() == 10
    near = frame(spark, [(k, k, k + 1, k) for k in range(20)] + [(1, 1, 5000, 1)])
    assert P.drift_filter(near, (0.0, 0.0), (1.0, 0.0), 1000, 0.5).count() == 20


def test_votes_equal_a_nested_loop(spark):
    rng = np.random.default_rng(3)
    a, b = ([(float(x), float(y), float(r)) for x, y, r in np.column_stack([rng.integers(0, 300, (80, 2)), rng.choice([0.2, 0.5, 1, 2, 5, 9, 12, 15, 20, 60], 80)])] for _ in (0, 1))
    cols = "cx double, cy double, r double"
    got = {(r["bx"], r["by"]): r["votes"] for r in P.radius_votes(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 100.0).collect()}
    want: dict = {}
    for x, y, r in a:
        for u, v, q in b:
            if abs(r - q) / max(r, q, 1) <= 0.25 and abs(u - x) < 100 and abs(v - y) < 100:
                k = (min(int((u - x + 100) / 4), 49), min(int((v - y + 100) / 4), 49))
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_verdict_gates_in_order(spark):
    rows = [(9, 1.0, 4.0, 0.1, 1.0), (10, 0.0499, 4.0, 0.1, 1.0), (10, 0.05, 0.99, 0.1, 1.0), (10, 0.05, 1.0, 1.0, 1.0), (10, 0.05, 1.0, 0.4999, 0.0), (10, 0.05, 1.0, 0.5, 0.5), (10, 0.05, 1.0, 0.9999, 0.49)]
    df = spark.createDataFrame(rows, "i int, h double, e double, r double, s double")
    got = [x[0] for x in df.select(P.verdict(*(F.col(c) for c in "iher"[:1] + "h" + "e" + "r"), F.col("s"))).collect()]
    assert got == ["REJECTED (Insufficient Inliers)", "REJECTED (Poor Spatial Coverage)", "REJECTED (Clustered Matches)", "REJECTED (RMSE Out of Bounds)", "VERIFIED_SUCCESS", "VERIFIED (Sub-Pixel Target Met)", "UNCERTAIN"]


def test_residuals_without_inliers_use_all_points(spark):
    df = spark.createDataFrame([(10.0, 0.0), (-10.0, 0.0)], "dx double, dy double")
    row = P.residual_stats(df).first()
    assert row["inlier_count"] == 0 and row["rmse"] == pytest.approx(10.0)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 5000])
def test_exact_percentiles(spark, n):
    v = np.random.default_rng(n).choice([1.5, 2.0, 1e6, -3.0, 7.25], n) if n < 5000 else np.random.default_rng(0).normal(size=n) ** 3
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = exact_percentiles(df, "v", (0.02, 0.5, 0.98))
    assert got == ([None] * 3 if n == 0 else pytest.approx(np.percentile(v, [2, 50, 98]).tolist()))


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(500, 4)).tolist()
    cols = "sx double, sy double, rx double, ry double"
    one, many = (spark.createDataFrame(rows, cols).repartition(k) for k in (1, 7))
    a, b = (P.drift_regression(d).first().asDict() for d in (one, many))
    assert a == pytest.approx(b)


def test_passes_give_the_same(spark):
    from tessera.operators import rasters as R

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rng.standard_t(2, (3000, 2)))], "k int, dx double, dy double")
    ids = lambda d: sorted(r["k"] for r in d.collect())
    assert ids(P.mad_inliers(df, ["dx", "dy"], 0.1, 2.0, passes=True)) == ids(P.mad_inliers(df, ["dx", "dy"], 0.1, 2.0))
    px = df.select("k", F.col("dx").alias("v"))
    for flag in (False, True):
        a, b = (sorted(map(tuple, R.percentile_stretch(px, high_of_all=flag, passes=p).collect())) for p in (False, True))
        assert a == b


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_uniform_subsample_of_a_million_wide_rows(spark, adaptive):
    """Nine columns and a unique key; the rows are the ones at the ranks, however Spark cuts its partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n, prime = 1_000_000, 1_000_003
        df = spark.range(n).select((F.col("id") * 7919 % prime).alias("k"), *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(c)), 256).alias(f"c{c}") for c in range(8)))
        want = sorted(k * 7919 % prime for k in range(n))
        got = sorted(r[0] for r in P.uniform_subsample(df, ["k"], 800).select("k").collect())
        assert got == [want[i * n // 800] for i in range(800)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_uniform_subsample_of_a_hot_key(spark):
    """A third of the rows has one key: the others tell them apart, and the number is right."""
    df = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    got = P.uniform_subsample(df, ["k"], 800).collect()
    assert len(got) == 800 == len({r["id"] for r in got}) and abs(sum(r["k"] == 5 for r in got) - 267) <= 1


@pytest.mark.parametrize("size,step,h,w", [(520, 400, 2000, 2000), (100, 101, 950, 700), (101, 80, 1003, 260), (300, 300, 250, 900)])
def test_in_core_is_the_join_with_the_grid(spark, size, step, h, w):
    rng = np.random.default_rng(size)
    p = spark.createDataFrame([(float(x), float(y)) for x, y in np.concatenate([rng.uniform(-5, 1.02 * max(h, w), (800, 2)), rng.integers(0, max(h, w), (800, 2))])], "sx double, sy double")
    grid = P.tile_grid(spark, h, w, size, step).collect()
    want = sorted((r["sx"], r["sy"], t["tile_id"]) for r in p.collect() for t in grid if t["xcore0"] <= r["sx"] < t["xcore1"] and t["ycore0"] <= r["sy"] < t["ycore1"])
    assert sorted((r["sx"], r["sy"], r["tile_id"]) for r in P.in_core(p, size, step, h, w).collect()) == want


def test_passes_give_what_aggregates_give(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 3 else g, float(x), float(y), float(e)) for g in range(4) for x, y, e in zip(rng.normal(size=400), rng.integers(0, 5, 400), rng.exponential(size=400), strict=True)]
    df = spark.createDataFrame(rows, "g int, dx double, dy double, err double").withColumns({"sx": F.lit(0.0), "sy": F.monotonically_increasing_id() % 97 * 1.0, "rx": F.col("dx"), "ry": F.col("dy") + F.monotonically_increasing_id() % 97})
    got = Q.grouped_percentiles(df, "dx", (0.02, 0.5, 0.98), ["g"]).orderBy("g").collect()
    want = df.groupBy("g").agg(F.percentile("dx", F.lit(0.02)), F.percentile("dx", F.lit(0.5)), F.percentile("dx", F.lit(0.98))).orderBy("g").collect()
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want])
    known = df.where("g is not null")
    for f in (lambda p: P.residual_stats(known, 1.0, ["g"], passes=p), lambda p: P.residual_stats(known, 1.0, passes=p), lambda p: P.drift_regression(known, by=["g"], passes=p), lambda p: P.drift_regression(known, passes=p), lambda p: P.mad_inliers(known, ["dx", "dy"], 0.1, 1.0, ["g"], passes=p).select("dx", "dy"), lambda p: P.stratified_consensus(known, "sy", "err", ["dx"], passes=p).select("dx", "rank_in_bin")):
        a, b = (f(p).toPandas() for p in (True, False))
        names = sorted(b.columns)
        a, b = (x[names].sort_values(names).to_numpy(float) for x in (a, b))
        assert a.shape == b.shape and np.allclose(a, b)


@pytest.mark.parametrize("values", [[1.0, 2.0, np.nan, np.nan, np.nan], [np.inf, 1.0, 2.0, 3.0], [-np.inf, -np.inf, 0.0, np.inf], [-0.0, 0.0, 5.0, 5.0], [1e308, -1e308, 1e-300, 2.0, None]])
def test_percentiles_both_ways(spark, values):
    """NaN and nulls are no values, infinities are, by Spark's aggregate and by passes; passes end whatever the values are."""
    df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values * 3)], "g int, v double")
    assert str(P.medians(df, ["v"], passes=True).collect()) == str(P.medians(df, ["v"], passes=False).collect())
    both = [sorted((r["g"], str(r["med_v"])) for r in P.medians(df, ["v"], ["g"], passes=p).collect() if r["med_v"] is not None) for p in (True, False)]
    assert both[0] == both[1]


def test_wide_percentiles_end(spark):
    """Numbers over all magnitudes, with one infinity among many."""
    v = [float(2.0 ** (k % 2000 - 1000)) for k in range(20_000)] + [float("inf")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = exact_percentiles(df, "v", (0.0, 0.25, 0.5, 1.0))
    assert got == [np.percentile(v, 0), np.percentile(v, 25), np.percentile(v, 50), np.inf]


def test_grids_of_tables(spark):
    """Grids and strips by column expressions are those of the single images."""
    sizes = [(1, 5), (199, 200), (200, 520), (2000, 2000), (521, 919), (999, 1321), (4001, 37)]
    images = spark.createDataFrame([(k, h, w) for k, (h, w) in enumerate(sizes)], "image int, height int, width int")
    columns = ["x0", "x1", "xcore0", "xcore1", "y0", "y1", "ycore0", "ycore1"]
    for size, step in ((520, 400), (300, 300), (100, 160)):
        got = {(r["image"], r["tile_id"]): tuple(r[c] for c in columns) for r in P.tile_grids(images, size, step).collect()}
        want = {}
        for k, (h, w) in enumerate(sizes):
            xs = P.axis_tiles(w, size, step)
            for y in P.axis_tiles(h, size, step):
                for x in xs:
                    want[k, y[0] * len(xs) + x[0]] = (*x[1:], *y[1:])
        assert got == want
    for k, (h, w) in enumerate(sizes):
        fixed = P.fixed_grids(images.where(f"image = {k}"), 4, 3).select("tile_id", "y0", "y1", "x0", "x1")
        assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, P.fixed_grid(spark, h, w, 4, 3).select("tile_id", "y0", "y1", "x0", "x1").collect()))
        strips = P.strips_of(images.where(f"image = {k}")).select("strip_idx", "row", "y0", "y1")
        assert sorted(map(tuple, strips.collect())) == sorted(map(tuple, P.strip_samples(spark, h).collect()))
