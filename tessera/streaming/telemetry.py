"""Job telemetry as a stream: events are appended; each job keeps its newest ones and its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.buckets import BucketedTable

EVENTS = "job_id long, ts timestamp_ntz, event_id long, title string"
#: Progress (percent) that each stage of a run reports, in order (fixed values of the interface).
PROGRESS = (5, 18, 20, 35, 38, 63, 65, 80, 82, 97)


def emit(spark: SparkSession, path: str, job_id: int, stage: int, title: str, message: str = "", details: dict | None = None) -> None:
    """Appends a stage's event to the events of a folder, which readStream can follow. A run goes on if that fails."""
    row = spark.range(1).select(
        F.lit(job_id).cast("long").alias("job_id"), F.localtimestamp().alias("ts"), F.unix_micros(F.current_timestamp()).alias("event_id"), F.lit(title).alias("title"),
        F.lit(PROGRESS[min(stage, len(PROGRESS) - 1)]).alias("progress_pct"), F.lit(message).alias("message"), F.to_json(F.create_map(*(F.lit(str(x)) for kv in (details or {"stage": stage}).items() for x in kv))).alias("details"),
    )
    try:
        row.coalesce(1).write.mode("append").parquet(path)
    except (AnalysisException, Py4JJavaError):
        return


def batch_retention(events: DataFrame, most: int = 40) -> DataFrame:
    newest = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most).drop("rn")


def streaming_state(events: DataFrame, most: int = 40) -> DataFrame:
    """(job_id, title, n_kept, n_seen) after each trigger, for the jobs it brought events of. A job's state is its newest most
    events' order keys and the latest title: bounded, whatever the stream's length."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, seen = (list(map(tuple, zip(*state.get[:2], strict=True))), state.get[2]) if state.exists else ([], 0)
        for pdf in batches:
            seen += len(pdf)
            kept += [(int(o), t) for o, t in zip(pdf["at"], pdf["title"], strict=True)]
            kept = sorted(kept, key=lambda x: (x[0], x[1] or ""))[-most:]
        state.update(([o for o, _ in kept], [t for _, t in kept], seen))
        yield pd.DataFrame({"job_id": [key[0]], "title": [kept[-1][1]], "n_kept": [len(kept)], "n_seen": [seen]})

    ordered = events.select("job_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("at"), "title")
    return ordered.groupBy("job_id").applyInPandasWithState(update, "job_id long, title string, n_kept long, n_seen long", "ats array<long>, titles array<string>, seen long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of each title by event-time window; state of windows past the watermark is dropped."""
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", window), "title").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "title", "n")


def retained_table(events: DataFrame, path: str, checkpoint: str, most: int = 40) -> StreamingQuery:
    """Keeps a table (a BucketedTable by job_id) of each job's newest events up to date. A micro-batch writes the buckets of its own jobs
    again; its number is the version's, so a repeated batch changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        BucketedTable(batch.sparkSession, path, "job_id").apply(batch, epoch, lambda before, new: batch_retention(before.unionByName(new), most))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
