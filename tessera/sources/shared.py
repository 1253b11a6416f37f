"""The folder that the driver and all executors share, for tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and all runs on this machine (a local master), a folder of our own; elsewhere that
    would lose rows, and is refused."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.shared.dir", None)
    if at is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.shared.dir", at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation. A task that reads large
    values holds a row group of them, of row_group bytes if given."""
    at = new_folder(df.sparkSession, name)
    (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
