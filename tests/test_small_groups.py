"""Which way medians of groups are found."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import points as P
from tessera.operators import quantiles


def test_small_groups_of_large_tables_need_no_passes(spark, monkeypatch):
    """A table of over MOST_HELD rows in small groups takes the aggregate; one large group makes it passes. Both give the same."""
    def offset(k):
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).cast("double") / 100

    df = spark.range(2000).select((F.col("id") % 100).alias("g"), offset(1).alias("dx"), offset(2).alias("dy"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), offset(1).alias("rx"), offset(2).alias("ry"))
    calls, passes = [], P.grouped_percentiles
    monkeypatch.setattr(P, "grouped_percentiles", lambda *a: calls.append(a) or passes(*a))
    monkeypatch.setattr(quantiles, "MOST_HELD", 1000)
    monkeypatch.setattr(quantiles, "HELD_GROUPS", 20)
    makers = (lambda d, p: P.mad_inliers(d, ["dx", "dy"], 0.1, 1.0, ["g"], p), lambda d, p: P.residual_stats(d, 4.0, ["g"], p), lambda d, p: P.drift_regression(d.withColumn("sy", F.col("dx")), by=["g"], passes=p))
    for make in makers:
        got = make(df, None).collect()
        assert not calls
        assert [str(x) for x in sorted(got)] == [str(x) for x in sorted(make(df, False).collect())]
    large = df.withColumn("g", F.when(F.col("g") < 50, 0).otherwise(F.col("g")))
    for make in makers[:1]:
        got = make(large, None).collect()
        assert calls
        assert sorted(map(str, got)) == sorted(map(str, make(large, False).collect()))
