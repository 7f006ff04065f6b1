"""A registry of live runs: what streaming queries and stages report goes to a run table that anyone polls.

A listener writes a small file for each start, progress and end of a streaming query; a stage's counters
are observed on its own plan while it writes, so they cost no second pass.  `registry` folds both into
one row a run."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.records import job_registry
from ..shared import Files

EVENT = "job_id string, seq long, ts timestamp, kind string, name string, message string, stats string"


class RunLog:
    """Events of runs, one file each, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files, self._last = spark, path.rstrip("/"), Files(spark, path), 0

    def add(self, job: str, kind: str, name: str | None = None, message: str | None = None, stats: dict | None = None) -> None:
        """kind: started, progress, completed or failed."""
        now = self._last = max(time.time_ns() // 1000, self._last + 1)
        at = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now // 1_000_000)) + f".{now % 1_000_000:06d}Z"
        row = {"job_id": job, "seq": now, "ts": at, "kind": kind, "name": name, "message": message, "stats": None if stats is None else json.dumps(stats)}
        self._files.create(f"{self.path}/{now}-{uuid.uuid4().hex}.json", json.dumps(row))

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).json(self.path)

    def registry(self) -> DataFrame:
        """(job_id, name, status, started_at, finished_at, error, stats): of each run its state, and its last counters."""
        rows = self.events()
        last = rows.groupBy("job_id").agg(F.max("name").alias("name"), F.max_by("stats", F.when(F.col("stats").isNotNull(), F.col("seq"))).alias("stats"))
        return job_registry(rows).join(last, "job_id").select("job_id", "name", "status", "started_at", "finished_at", "error", "stats")


class QueryListener(StreamingQueryListener):
    """Writes the start, progress and end of every streaming query of a session to a run log."""

    def __init__(self, log: RunLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.add(str(event.runId), "started", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.log.add(str(p.runId), "progress", p.name, stats={"batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self.log.add(str(event.runId), "failed" if failed else "completed", message=event.exception.strip().split("\n")[0][:500] if failed else None)


def observed_write(rows: DataFrame, path: str, log: RunLog, stage: str, then: Callable[[DataFrame], DataFrame] = lambda rows: rows, **counters: Column) -> dict:
    """Writes then(rows) to path, with counters of rows observed on the way and logged as a run; gives the counters.
    A stage that fails is logged as such."""
    job, seen = f"{stage}-{uuid.uuid4().hex}", Observation(f"{stage}-{uuid.uuid4().hex}")
    log.add(job, "started", stage)
    try:
        then(rows.observe(seen, *[c.alias(n) for n, c in counters.items()])).write.parquet(path)
        stats = {n: int(v or 0) for n, v in seen.get.items()}
    except Exception as e:
        log.add(job, "failed", stage, str(e).strip().split("\n")[0][:500])
        raise
    log.add(job, "completed", stage, stats=stats)
    return stats
