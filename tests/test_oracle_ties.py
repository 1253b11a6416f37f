"""Queries whose SQL only fitted small tables or left ties to chance."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["gcp_corners", "gcp_affine"])
def test_longitudes_some_turns_off(spark, name):
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{SF}/supplier.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).collect()))
    assert got == sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def test_subsample_of_rows_with_equal_keys(spark, tmp_path):
    """Rows of one date, order and line differ in their quantity only."""
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").limit(3000).withColumns({"l_orderkey": F.lit(1).cast("long"), "l_linenumber": F.lit(1), "l_shipdate": F.lit("1995-01-01").cast("timestamp_ntz")})
    rows = rows.withColumn("l_quantity", F.monotonically_increasing_id().cast("double"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()["uniform_subsample"](spark, str(tmp_path)).collect()))
    assert len(got) == 800 and got == sorted(con.sql(__spark_entry__.oracle_sql()["uniform_subsample"]).fetchall())
