"""Streams: incremental ingestion, quota admission, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.governance import folded

DAY_MS = 86_400_000


def file_stream(spark: SparkSession, root: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(root)


def ingest_stream(records: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs work on each micro-batch of what is there now; its offsets are the cursor, so a rerun finds nothing to do."""
    return records.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_by_change(records: DataFrame, key: str, change: str, ts: str, late: str = "1 day") -> DataFrame:
    """A stream's records without repeats of the same change within the lateness bound."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, change])


def admitted_stream(events: DataFrame, limit: float, key: str = "key", ts: str = "ts", amount: str = "amount", late: str = "1 hour") -> DataFrame:
    """(key, ts, amount, admitted): a 24-hour sliding quota for each key; state is the admitted events of the last day."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(amount).cast("double").alias("amount")).withWatermark("ts", late)
    out = "key string, ts timestamp, amount double, admitted boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, sizes = state.get if state.exists else ([], [])
        window = list(zip(times, sizes, strict=True))
        got = pd.concat(list(frames)).sort_values(["ts", "amount"], kind="stable")
        flags = []
        for at, x in zip(got["ts"].astype("datetime64[ms]").astype("int64"), got["amount"], strict=True):
            window = [w for w in window if w[0] >= at - DAY_MS]
            ok = sum(w[1] for w in window) + x <= limit
            if ok:
                window.append((int(at), float(x)))
            flags.append(ok)
        state.update(([w[0] for w in window], [w[1] for w in window]))
        if window:
            state.setTimeoutTimestamp(max(window[-1][0] + DAY_MS, state.getCurrentWatermarkMs() + 1))
        yield got[["key", "ts", "amount"]].assign(admitted=flags)

    return rows.groupBy("key").applyInPandasWithState(step, out, "times array<long>, sizes array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding event-time windows; rows later than the bound are dropped from state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def token_bucket(events: DataFrame, capacity: float, per_second: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """Batch rate limiting: each key's bucket refills with time, an event needs one token; one without a time comes last and refills nothing."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))

    def start() -> Callable:
        level, last = capacity, None

        def step(at: pd.Timestamp) -> bool:
            nonlocal level, last
            if last is not None and not pd.isna(at):
                level = min(capacity, level + (at - last).total_seconds() * per_second)
            last = last if pd.isna(at) else at
            ok = level >= 1
            level -= ok
            return ok

        return step

    return folded(rows, [F.asc_nulls_last("ts")], start, "allowed")
