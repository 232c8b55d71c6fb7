"""Structured Streaming forms: windowed energy, sessions, jobs, latest rows, idempotent replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def energy_windows(samples: DataFrame, key: str, at: str, level: str, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Root mean square, peak and crossings of the levels in fixed windows.

    In batch the same call works, with the watermark ignored.
    """
    squares = F.sqrt(F.avg(F.col(level) * F.col(level)))
    rows = samples.withWatermark(at, late).groupBy(key, F.window(at, f"{seconds} seconds").alias("w"))
    out = rows.agg(squares.alias("rms"), F.max(F.abs(level)).alias("peak"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("at"), "rms", "n", F.round(20 * F.log10(F.greatest("rms", F.lit(1e-10))), 2).alias("db"), F.least(F.lit(20.0), F.col("peak") / F.greatest("rms", F.lit(1e-6))).alias("crest"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of events no more than a gap apart, with their first and last time."""
    rows = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("s")


JOB = "job_id string, state string, stage string, seconds_in_stage double, cancel_requested boolean"
JOB_STATE = "state string, stage string, since double, cancelled boolean"
FINAL = ("completed", "failed", "cancelled")


def job_states(events: DataFrame, stale_seconds: int = 3600) -> DataFrame:
    """Job states from ``job_id, at (seconds), state, stage``: a request to cancel sticks, final states stay, silence fails a job.

    Emits a row for every stage that ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, stage, since, cancelled = held.get if held.exists else ("queued", "", 0.0, False)
        out: list[tuple] = []
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(key[0], "failed", stage, float(stale_seconds), cancelled)], columns=[x.split()[0] for x in JOB.split(", ")])
            return
        for row in pd.concat(batches).sort_values("at", kind="stable").itertuples():
            if state in FINAL:
                continue
            cancelled |= row.state == "cancel_requested"
            new = state if row.state == "cancel_requested" else "cancelled" if cancelled and row.state == "completed" else row.state
            if new in FINAL or (row.stage and row.stage != stage):
                if stage:
                    out.append((key[0], new, stage, float(row.at - since), bool(cancelled)))
                stage, since = row.stage or stage, float(row.at)
            state = new
        held.update((state, stage, since, bool(cancelled)))
        if state not in FINAL:
            held.setTimeoutDuration(stale_seconds * 1000)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in JOB.split(", ")])

    return events.groupBy("job_id").applyInPandasWithState(step, JOB, JOB_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table with the last row of each key, each version in a folder of its own.

    A batch that runs again writes the same version, so a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        rest = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge
