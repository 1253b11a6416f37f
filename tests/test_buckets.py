"""Tables by bucket: what a batch writes again, repeats, schemas, odd keys."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.buckets import BucketedTable


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(table, *columns):
    return sorted((tuple(r) for r in table.read().select(*columns).collect()), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", "id", 8)
    t.upsert(spark.range(200).select("id", F.lit("a").alias("v")), 0)
    first, before = files(tmp_path), t.manifest()["folders"]
    update = spark.createDataFrame([(5, "b"), (900, "b")], "id long, v string")
    hit = {str(r[0]) for r in update.select(t.bucket()).collect()}
    assert t.upsert(update, 1)
    after = t.manifest()["folders"]
    assert {b for b in after if after[b] != before.get(b)} == hit and 0 < len(hit) < 8
    assert first < files(tmp_path)  # files of other buckets keep their names, and nothing is written over
    assert rows(t, "id", "v") == sorted([(k, "b" if k == 5 else "a") for k in range(200)] + [(900, "b")], key=str)
    assert rows(t, "id") != [] and t.read(0).count() == 200


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", "id", 4)
    assert t.upsert(spark.range(10).select("id", F.lit(1).alias("v")), 3)
    held = files(tmp_path)
    assert not t.upsert(spark.range(99).select("id", F.lit(2).alias("v")), 3)
    assert files(tmp_path) == held and t.versions() == [3]
    with pytest.raises(ValueError):
        t.upsert(spark.range(1).select("id", F.lit(2).alias("v")), 2)
    with pytest.raises(ValueError):
        BucketedTable(spark, f"{tmp_path}/t", "id", 5).upsert(spark.range(1).select("id", F.lit(2).alias("v")), 4)


def test_failed_batches_leave_the_table(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", "id", 4)
    t.upsert(spark.range(10).select("id", F.lit(1).alias("v")), 0)
    bad = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(2).alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad, 1)
    assert t.versions() == [0] and rows(t, "v") == [(1,)] * 10
    t.upsert(spark.range(3).select("id", F.lit(2).alias("v")), 1)
    assert rows(t, "id", "v") == sorted([(k, 2 if k < 3 else 1) for k in range(10)], key=str)
    gone = t.vacuum(keep=1)
    assert rows(t, "id", "v") == sorted([(k, 2 if k < 3 else 1) for k in range(10)], key=str) and t.versions() == [1]
    assert t.vacuum(keep=1) == [] and gone


def test_odd_rows(spark, tmp_path):
    """Null keys, several updates of one key, columns that come and go, empty updates, a key's name with a dot."""
    t = BucketedTable(spark, f"{tmp_path}/t", "a.b", 4)
    assert t.upsert(spark.createDataFrame([], "`a.b` long, v string"), 0) and t.read().count() == 0
    with pytest.raises(ValueError):
        BucketedTable(spark, f"{tmp_path}/none", "x").read()
    t.upsert(spark.createDataFrame([(None, "x"), (1, "y")], "`a.b` long, v string"), 1)
    t.upsert(spark.createDataFrame([(None, 1, 1.5), (1, 2, 2.5), (1, 3, 3.5)], "`a.b` long, n int, w double"), 2, order=F.col("n"))
    assert rows(t, "`a.b`", "v", "n", "w") == sorted([(None, None, 1, 1.5), (1, None, 3, 3.5)], key=str)
    t.upsert(spark.createDataFrame([], "`a.b` long, v string"), 3)
    assert t.read().count() == 2 and t.versions() == [0, 1, 2, 3]
