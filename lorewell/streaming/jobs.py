"""Streaming jobs: incremental ingest and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import LIMITS


def first_contents(pages: DataFrame) -> DataFrame:
    """A stream of pages with each content once, the state of which is its hashes."""
    return pages.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])


def recent_first_contents(pages: DataFrame, time: str, delay: str) -> DataFrame:
    """The same with a state of bounded size: contents are new again after `delay`."""
    return pages.withColumn("content_hash", F.sha2("text", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(pages: DataFrame, table_path: str, checkpoint: str):
    """Adds pages with contents that the table doesn't have yet; runs over what is there and ends."""

    def add(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(["content_hash"])
        try:
            known = spark.read.parquet(table_path).select("content_hash")
            new = new.join(known, "content_hash", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table_path)

    hashed = pages.withColumn("content_hash", F.sha2("text", 256))
    return hashed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited(events: DataFrame, most: int = LIMITS.requests, window_seconds: int = LIMITS.window_seconds, expires: bool = True) -> DataFrame:
    """(session_id, event_id, allowed) of a stream of (session_id, event_id, ts): the state of a session is
    its last `most` allowed times, and with `expires` it goes when the session was silent for a whole
    window by the clock.  A query that expires state by the clock has no end, so one that is to end
    (availableNow) is made without.  Within a micro-batch, requests are taken in order of time; what a
    trigger reads bounds a micro-batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if expires and state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in (rows["ts"].astype("datetime64[us, UTC]") if rows["ts"].dt.tz is not None else rows["ts"].astype("datetime64[us]")).astype("int64"):
            while times and times[0] < t - window_seconds * 1_000_000:
                times.pop(0)
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(int(t))
        state.update((times,))
        if expires:
            state.setTimeoutDuration(1000 * window_seconds)
        yield pd.DataFrame({"session_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.select("session_id", "event_id", "ts").groupBy("session_id").applyInPandasWithState(step, "session_id long, event_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout)
