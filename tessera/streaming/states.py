"""Jobs as a stream: each job's state from its events, in the order of their times whatever the order they come in, with jobs failed
that have been silent for too long, and state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.buckets import BucketedTable

#: States and what may follow them (fixed names of the interface); a job's first state may be any.
FOLLOWS = {"PENDING": ("PROCESSING", "FAILED"), "PROCESSING": ("SUCCESS", "FAILED")}
STATES, FINAL = ("PENDING", "PROCESSING", "SUCCESS", "FAILED"), ("SUCCESS", "FAILED")
CHANGE = "job_id long, status string, at_us long, reason string, n_events long"
#: Where timers' states are kept: the only store that has them.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobStates(StatefulProcessor):
    """Events wait until the watermark has passed them and are applied by (time, id). One timer a job: when its first waiting event is
    due, when it is silent for stale_us, or when its final state is keep_us old and goes."""

    def __init__(self, stale_us: int, keep_us: int):
        self.stale, self.keep = stale_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, status string")
        self.job = handle.getValueState("job", "status string, last long, n long, timer long")

    def _settle(self, key, status, last, n, timer, waiting: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """Applies what is due before now (microseconds), and sets the next timer."""
        changes = []

        def to(state: str, at: int, reason: str) -> None:
            nonlocal status
            status = state
            changes.append((key[0], state, at, reason, n))

        due = sorted(e for e in waiting if e[0] < now)
        rest = [e for e in waiting if e[0] >= now]
        for at, _, state in due:
            if status not in FINAL and last is not None and at - last > self.stale:
                to("FAILED", last + self.stale, "stale")
            if status in FINAL:
                continue
            n, last = n + 1, at
            if state in STATES and (status is None or state in FOLLOWS[status]):
                to(state, at, "event")
        if status not in FINAL and last is not None and now - last > self.stale:
            to("FAILED", last + self.stale, "stale")
        ends = [e[0] for e in rest]
        if status in FINAL:
            ends.append(last + self.keep)
        elif last is not None:
            ends.append(last + self.stale)
        gone = status in FINAL and not rest and now > last + self.keep
        if timer:
            self.handle.deleteTimer(timer)
        if gone:
            self.job.clear()
            self.waiting.clear()
        else:
            timer = -(-min(ends) // 1000) + 1  # the first millisecond after
            self.handle.registerTimer(timer)
            self.job.update((status, last, n, timer))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if changes:
            yield pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def _state(self):
        status, last, n, timer = self.job.get() if self.job.exists() else (None, None, 0, None)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        return status, last, n, timer, waiting

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, last, n, timer, waiting = self._state()
        for pdf in rows:
            waiting += list(zip(map(int, pdf["at"]), map(int, pdf["event_id"]), pdf["status"], strict=True))
        yield from self._settle(key, status, last, n, timer, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, n, timer, waiting = self._state()
        yield from self._settle(key, status, last, n, None, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, stale: float, late: float, keep: float = 86_400.0) -> DataFrame:
    """(job_id, status, at_us, reason, n_events): a row for each change of a job's state, from a stream of (job_id, ts, event_id, status).

    PENDING goes to PROCESSING or FAILED, PROCESSING to SUCCESS or FAILED; other events count as signs of life only. A job that is silent
    for over stale seconds of event time has FAILED then ("stale"). Events may come late seconds out of order; later ones are dropped.
    A final state is forgotten after keep seconds of event time; a job that comes again after that begins anew. Rows with a null job,
    time or id are left out."""
    held = events.where("job_id is not null and ts is not null and event_id is not null").select("job_id", F.col("ts").cast("timestamp").alias("t"), "event_id", "status")
    timed = held.withWatermark("t", f"{late} seconds").select("job_id", "t", F.unix_micros("t").alias("at"), "event_id", "status")
    return timed.groupBy("job_id").transformWithStateInPandas(JobStates(int(stale * 1e6), int(keep * 1e6)), CHANGE, "append", "EventTime")


def job_table(events: DataFrame, path: str, checkpoint: str, stale: float, late: float, keep: float = 86_400.0, buckets: int = 16) -> StreamingQuery:
    """Keeps a table of jobs (as a BucketedTable by job_id) at their latest state; a batch rewrites the buckets of the jobs that changed."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def merge(batch: DataFrame, epoch: int) -> None:
        table = BucketedTable(batch.sparkSession, path, "job_id", buckets)
        # Final states come after others at one time.
        table.upsert(batch, epoch, F.struct("n_events", "at_us", F.col("status").isin(*FINAL)))

    return job_changes(events, stale, late, keep).writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
