"""Steps whose cost mustn't grow with the square of copies, or pass through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import points as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_of_equal_circles(spark):
    """100,000 copies on both sides are 10^10 pairs; no side is broadcast, however small it seems."""
    one = spark.createDataFrame([(10.0, 20.0, 5.0), (40.0, 20.0, 5.0)], "cx double, cy double, r double")
    votes = P.radius_votes(one, one, 16.0)
    assert "BroadcastHashJoin" not in plan(votes)
    many = one.where("cx = 10").crossJoin(spark.range(100_000)).drop("id")
    got = P.radius_votes(many, many.withColumn("cx", F.col("cx") + 2), 16.0).collect()
    assert [(r["bx"], r["by"], r["votes"]) for r in got] == [(4, 4, 10**10)]


def test_hulls_of_many_small_groups(spark):
    """Groups are looked at many at a time, not one after another by a call each, and cut anywhere."""
    import numpy as np

    from tessera.functions import kernels as K
    from tessera.operators import tiles as T

    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 40, 30_000, 70_000, *rng.integers(1, 90, 300).tolist()]
    rows = [(None if g == 3 else g, str(g % 2), float(x), float(y)) for g, n in enumerate(sizes) for x, y in rng.integers(0, 500, (n, 2))]
    df = spark.createDataFrame(rows, "g int, part string, x double, y double").repartition(5, "x")
    out = T.hull_shares(df, "x", "y", 1e6, ["g", "part"])
    assert "FlatMapGroupsInPandas" not in plan(out)
    want = {(g, p): K.hull_share(np.array([(x, y) for a, _, x, y in rows if a == g]), 1e6) for g, p in {(r[0], r[1]) for r in rows}}
    assert {(r["g"], r["part"]): r["share"] for r in out.collect()} == want
    assert T.hull_shares(df, "x", "y", 1e6, []).collect()[0]["share"] == K.hull_share(np.array([r[2:] for r in rows]), 1e6)
    own = spark.range(30_000).select("id", (F.col("id") * 7 % 501).cast("double").alias("x"), (F.col("id") * 11 % 503).cast("double").alias("y"), F.when(F.col("id") < 20_000, F.col("id")).otherwise(-1).alias("g"))
    assert T.hull_shares(own, "x", "y", 1e6, ["g"]).where("share > 0").collect()[0]["g"] == -1  # keys that can't be null
    assert T.hull_shares(df.limit(0), "x", "y", 1e6, ["g"]).count() == 0


def test_box_maximum():
    import numpy as np

    from tessera.operators.circles import _box_maximum

    a = np.random.default_rng(2).normal(size=(37, 50))
    for r in (0, 1, 3, 4, 20, 60):
        want = [[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(50)] for y in range(37)]
        assert (_box_maximum(a, r) == np.array(want)).all()


def test_images_are_drawn_by_many_tasks(spark):
    """A small table of keys stays in one partition by its bytes, whatever each row costs."""
    from tessera.plans.kernel_queries import QUERIES, _rings

    sf = "/root/testdata/sf0.1"
    assert _rings(spark, sf).rdd.getNumPartitions() >= 8
    for name in ("hough_circles", "dense_rotation"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf))


def test_boxes_of_one_cell_are_shared_out(spark, monkeypatch):
    """All boxes in one cell: their pairs are cut into shares, and none is lost or found twice."""
    from tessera.operators import footprints as G

    monkeypatch.setattr(G, "TASK_PAIRS", 1000)
    box = lambda k: (k, k % 7 * 1.0, k % 5 * 1.0, k % 7 + 3.0, k % 5 + 3.0)
    rows = [box(k) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, left double, bottom double, right double, top double").repartition(1)
    out = G.overlaps(df, df, 100.0)
    want = sorted((a[0], b[0]) for a in rows for b in rows if max(a[1], b[1]) < min(a[3], b[3]) and max(a[2], b[2]) < min(a[4], b[4]))
    assert sorted((r["a_id"], r["b_id"]) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() == 15
    assert G.overlaps(df.limit(0), df, 100.0).count() == 0


def test_links_and_components_pass_nothing_through_the_driver(spark, monkeypatch):
    from tessera.llm import components, simhash

    plans, written = [], components.written

    def noted(df, name):
        plans.append(plan(df))
        return written(df, name)

    for module in (components, simhash):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.createDataFrame([(k, f"one two three {k % 9}") for k in range(40)], "doc_id long, text string")
    plans.append(plan(simhash.clusters(docs)))
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
