"""Job states from streams: whatever the order, the batches and the restarts, as one sorted pass gives them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.buckets import BucketedTable
from tessera.streaming import states

STALE, LATE = 50.0, 30.0
SCHEMA = "job_id long, ts timestamp, event_id long, status string"


def one_pass(events, now):
    """Final (status, at, reason) by job of events (job, seconds, id, status)."""
    out, jobs = {}, {}
    for job, t, n, state in sorted(events, key=lambda e: (e[1], e[2])):
        jobs.setdefault(job, []).append((t, state))
    for job, seen in jobs.items():
        status = last = change = None
        for t, state in [*seen, (now, "end")]:
            if status in states.FINAL:
                break
            if last is not None and t - last > STALE:
                status, change = "FAILED", ("FAILED", last + STALE, "stale")
                break
            if state == "end":
                break
            last = t
            if state in states.STATES and (status is None or state in states.FOLLOWS[status]):
                status, change = state, (state, t, "event")
        if change:
            out[job] = change
    return out


def frame(spark, events):
    return spark.createDataFrame([(j, t, n, s) for j, t, n, s in events], "job_id long, s double, event_id long, status string").select("job_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "event_id", "status")


@pytest.mark.parametrize("batches", [1, 5])
def test_any_order_any_batches(spark, tmp_path, batches):
    """Events up to LATE seconds out of order; each batch is a run of its own from the checkpoint."""
    rng = random.Random(batches)
    names = ["PENDING", "PROCESSING", "PROCESSING", "SUCCESS", "FAILED", "NOTE", None]
    events = [(rng.randrange(25), round(rng.uniform(0, 400), 3), n, rng.choice(names)) for n in range(250)]
    events = sorted({(j, t): (j, t, n, s) for j, t, n, s in events}.values(), key=lambda e: e[1] + rng.uniform(0, LATE - 1))
    end = max(e[1] for e in events) + 1.0
    parts = [events[k * len(events) // batches : (k + 1) * len(events) // batches] for k in range(batches)] + [[(-1, round(end + LATE, 3), 0, "NOTE")]]
    for part in parts:
        frame(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        states.job_table(stream, f"{tmp_path}/table", f"{tmp_path}/cp", STALE, LATE, buckets=4).awaitTermination()
    got = {r["job_id"]: (r["status"], r["at_us"] / 1e6, r["reason"]) for r in BucketedTable(spark, f"{tmp_path}/table", "job_id", 4).read().collect()}
    want = one_pass(events, int(end * 1000) / 1000)
    assert set(got) == set(want)
    for job, (status, at, reason) in want.items():
        assert got[job][0] == status and got[job][2] == reason and got[job][1] == pytest.approx(at, abs=1e-3), job


def test_state_expires_and_odd_rows_stay_out(spark, tmp_path):
    """A finished job that comes again after its state went begins anew; nulls are left out."""
    runs = [[(1, 0.0, 1, "PENDING"), (1, 1.0, 2, "FAILED"), (None, 1.0, 3, "PENDING"), (2, None, 4, "PENDING")], [(3, 200.0, 5, "PENDING")], [(1, 205.0, 6, "PENDING"), (3, 240.0, 7, "NOTE")], [(3, 245.0, 8, "NOTE")]]
    for run in runs:
        frame(spark, run).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        states.job_table(stream, f"{tmp_path}/table", f"{tmp_path}/cp", STALE, LATE, keep=60.0).awaitTermination()
    got = {r["job_id"]: r["status"] for r in BucketedTable(spark, f"{tmp_path}/table", "job_id").read().collect()}
    assert got == {1: "PENDING", 3: "PENDING"}
