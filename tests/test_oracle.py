"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows and a stable schema."""

from __future__ import annotations

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Queries whose rules only larger tables reach, held against SQL on those too.
LARGER, SF_LARGER = ("candidate_csv", "exposure_unit", "label_corners", "label_metadata", "refined_csv", "bucketed_upsert", "tile_grid", "fixed_grid", "search_window", "strip_samples", "ray_grid", "ransac_affine"), "/root/testdata/sf0.01"


def _views(folder: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def sql():
    return {folder: _views(folder) for folder in (SF, SF_LARGER)}


@pytest.mark.parametrize("name,folder", [*((n, SF) for n in sorted(catalog.ORACLE_SQL)), *((n, SF_LARGER) for n in LARGER)])
def test_oracle(spark, sql, name, folder):
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), sql[folder].sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    for c in columns:
        assert a[c].dtype == b[c].dtype, c
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].iloc[0], b[c][~same].iloc[0])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.schema == catalog.QUERIES[name](spark, SF).schema
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_votes_join_by_key(spark):
    plan = catalog.QUERIES["crater_votes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_are_pruned(spark):
    plan = catalog.QUERIES["drift_regression"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan
