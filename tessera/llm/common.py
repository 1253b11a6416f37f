"""What the operators share: reading tables, the shared folder, cutting lineage, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Code points that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on this machine (a local
    master), one of our own; elsewhere that would lose rows, and is refused."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.conf.get("spark.tessera.shared.dir", None)
    if at is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.shared.dir", at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def map_columns(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df through f, one Arrow batch at a time; memory is bounded by a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is the empty text. bytes.split() cuts at exactly SPACES."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words) - 1, _P))])
    inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _P_INVERSE))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    return mixed((sums[n:] - sums[:-n]) * inverse)


def long_array(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64), pa.int64())
