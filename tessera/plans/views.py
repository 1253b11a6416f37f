"""The driver's tables in the roles of tie points and rasters, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tie_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tie points; only the six columns it takes are read."""
    x, y = F.col("l_partkey").cast("double"), (F.col("l_orderkey") % 2000).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        x.alias("sx"), y.alias("sy"), (x + F.lit(20.0) * F.col("l_discount") - F.lit(1.0)).alias("rx"), (y + F.lit(20.0) * F.col("l_tax") - F.lit(1.0)).alias("ry"),
        (F.col("l_quantity") / F.lit(50.0)).alias("score"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
    )


TP = """tp AS (SELECT CAST(l_partkey AS DOUBLE) AS sx, CAST(l_orderkey % 2000 AS DOUBLE) AS sy,
    CAST(l_partkey AS DOUBLE) + CAST(20 AS DOUBLE) * l_discount - CAST(1 AS DOUBLE) AS rx,
    CAST(l_orderkey % 2000 AS DOUBLE) + CAST(20 AS DOUBLE) * l_tax - CAST(1 AS DOUBLE) AS ry,
    l_quantity / CAST(50 AS DOUBLE) AS score, l_suppkey AS supp, l_orderkey AS okey, l_linenumber AS line FROM lineitem)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tie_points(spark, sf_dir).withColumns({"dx": F.col("rx") - F.col("sx"), "dy": F.col("ry") - F.col("sy")})


RES = TP + ", res AS (SELECT *, rx - sx AS dx, ry - sy AS dy FROM tp)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a raster 64 wide: a row for each vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("v"))


PX = """px AS (SELECT vec_id AS "row", CAST(i - 1 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def line_values(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """events as a stream of lines: (line, sample, v)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), (F.col("event_id") % modulus).alias("k"), F.col("value").alias("v"), "event_type", "user_id")


def planted(spark: SparkSession, sf_dir: str, affine: bool = True, noise: float = 0.25) -> DataFrame:
    """Tie points of which three in four follow one affine (or similarity) within noise, and the others are far from it."""
    t = tie_points(spark, sf_dir)
    good = (F.col("okey") + F.col("line")) % 4 != 0
    a, b, c, d = (1.01, 0.02, -0.015, 0.99) if affine else (1.0, -0.02, 0.02, 1.0)
    x = a * F.col("sx") + b * F.col("sy") + 30 + F.when(good, noise * (F.col("rx") - F.col("sx"))).otherwise(60 + 100 * F.col("score"))
    y = c * F.col("sx") + d * F.col("sy") - 12 + F.when(good, noise * (F.col("ry") - F.col("sy"))).otherwise(-80 - 100 * F.col("score"))
    return t.withColumns({"rx": x, "ry": y})


GOOD = "(okey + line) % 4 <> 0"
