"""Exact order statistics that don't gather the values.

A radix selection: doubles become 64-bit numbers of the same order, and the numbers at the wanted ranks are found 16 bits at a time.
A pass counts the values that agree with a rank's upper bits by their next 16, so there are four whatever the values are, infinities
among them. NaN and nulls are no values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written

#: Rows up to which Spark's exact aggregate, whose state is a group's different values, is used; of larger tables it is used where no
#: group has over MOST_HELD / HELD_GROUPS rows, as a task has the states of HELD_GROUPS groups (Spark's
#: spark.sql.objectHashAggregate.sortBased.fallbackThreshold) at once and goes on with one at a time.
MOST_HELD, HELD_GROUPS = 20_000_000, 128
_LOW = np.int64((1 << 63) - 1)


def by_passes(df: DataFrame, passes: bool | None, by: Sequence[str] = ()) -> bool:
    """Whether percentiles of df by groups are to be found by passes of counts: as told, or of over MOST_HELD rows, unless all groups
    are small. Both ways give the same."""
    if passes is not None:
        return passes
    if not by:
        return df.count() > MOST_HELD
    total, largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return (total or 0) > MOST_HELD and largest > MOST_HELD // HELD_GROUPS


def number(c: str | Column) -> Column:
    """A value as a double, null if it is NaN: what Spark's own aggregates have to be given, as they count NaN as the largest."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Between doubles' bits and whole numbers of the same order; its own inverse."""
    return np.where(bits < 0, bits ^ _LOW, bits)


def _mapped(df: DataFrame, column: str, to: str, f) -> DataFrame:
    """df with a column replaced by f of it, in Arrow batches."""
    at, schema = df.columns.index(column), ", ".join(f"`{c}` {to if c == column else t}" for c, t in df.dtypes)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([f(x) if k == at else x for k, x in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def _as_bits(x: pa.Array) -> pa.Array:
    return pa.array(_flipped((x.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)), pa.int64())


def _as_doubles(x: pa.Array) -> pa.Array:
    return pa.array(_flipped(x.to_numpy(zero_copy_only=False)).view(float), pa.float64())


def grouped_percentiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, q0, q1, ...): each group's linearly interpolated percentiles; nulls are a key as others. Groups without values have no row.

    The column is written once, as numbers; a pass is an aggregation with map-side combining over those numbers that agree with a rank's
    upper bits (an equi-join with a few rows a group). Values of a group never meet in one state, however large it is."""
    keys = [f"__by{i}" for i in range(len(by))]
    v = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), number(column).alias("v")).where("v is not null")
    v = written(_mapped(v, "v", "long", _as_bits), "numbers")
    total = v.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    at = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(s)), F.ceil(at(s))) for s in shares))))
    zero = F.lit(0).cast("long")
    wanted = written(total.select(*keys, "n", F.explode(ranks).alias("rank"), zero.alias("prefix"), zero.alias("before")), "ranks")

    def met(left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[k]) for k in [*keys, "prefix"]))

    for shift in (48, 32, 16, 0):
        upper = v.withColumn("prefix", F.shiftright("v", shift + 16) if shift < 48 else zero)
        if shift < 48:
            asked = wanted.select(*keys, "prefix").distinct()
            upper = upper.join(asked, met(upper, asked), "left_semi")
        level = F.shiftright("v", shift) if shift == 48 else F.shiftright("v", shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        counts = upper.groupBy(*keys, "prefix", level.alias("level")).agg(F.count("*").alias("size"))
        placed = wanted.join(counts, met(wanted, counts)).select(*(wanted[k] for k in keys), "n", "rank", wanted["prefix"], "before", "level", "size")
        up_to = F.sum("size").over(Window.partitionBy(*keys, "rank").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
        placed = placed.withColumn("upto", up_to).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("size") <= F.col("rank")))
        wanted = written(placed.select(*keys, "n", "rank", (F.shiftleft("prefix", 16) + F.col("level")).alias("prefix"), (F.col("upto") - F.col("size")).alias("before")), "ranks")
    held = _mapped(wanted.select(*keys, "n", "rank", "prefix"), "prefix", "double", _as_doubles)
    held = held.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "prefix"))).alias("m"))  # two ranks for each share
    part = lambda s: at(s) - F.floor(at(s))
    low, high = (lambda s: F.col("m")[F.floor(at(s))]), (lambda s: F.col("m")[F.ceil(at(s))])
    # Weighted as Spark's aggregate does it.
    between = lambda s: F.when((part(s) == 0) | (low(s) == high(s)), low(s)).otherwise((F.ceil(at(s)) - at(s)) * low(s) + part(s) * high(s))
    return held.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(between(s).alias(f"q{i}") for i, s in enumerate(shares)))


def exact_percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The linearly interpolated percentiles of a column's values, all in the same passes; nulls without any. Use it where the values
    don't fit a task; percentile() is simpler elsewhere."""
    row = grouped_percentiles(df, column, shares, []).first()
    return [None] * len(shares) if row is None else list(row)
