"""Streams that decide in order of time, against batches; restarts; the registry of live runs."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorewell.operators import chat
from lorewell.plans.chat_queries import rate_limit
from lorewell.streaming import runs, sessions

SCHEMA = "session_id long, event_id long, ts timestamp, minted boolean"


def requests(n=240):
    r, at = random.Random(1), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 5, 40]), microseconds=r.randrange(1000))
        rows.append((r.randrange(4), i, at, r.random() < 0.05))
    return rows


@pytest.fixture
def arrivals(spark, tmp_path):
    """Files in which rows of neighbouring times are mixed up, and at last a row of long after."""
    rows, r = requests(), random.Random(2)
    late = sorted(rows, key=lambda x: x[1] + r.randrange(40))
    end = [(99, 10_000, datetime(2025, 1, 1), False)]
    parts = [late[60 * k : 60 * k + 60] for k in range(4)]
    folder = tmp_path / "in"

    def put(k):
        spark.createDataFrame(parts[k] if k < 4 else end, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return rows, put, stream


def decided(df, name):
    return {r.event_id: r[name] for r in df.collect() if r.event_id < 10_000}


def test_limiter_is_the_batch_limiter_after_a_restart(spark, arrivals, tmp_path):
    rows, put, stream = arrivals
    run = lambda: sessions.drained(sessions.limited(stream(), "1 hour", 5, 60), str(tmp_path / "out"), str(tmp_path / "c"))
    put(0), put(1)
    first = decided(run(), "allowed")
    put(2), put(3), put(4)
    got = decided(run(), "allowed")  # another query that starts from the checkpoint
    batch = chat.rate_limited(spark.createDataFrame(rows, SCHEMA), 5, 60)
    assert got == decided(batch, "allowed") and not all(got.values()) and first.items() <= got.items()
    assert sum(1 for _ in sessions.drained(sessions.limited(stream(), "1 hour", 5, 60), str(tmp_path / "out"), str(tmp_path / "c")).filter("event_id < 10000").collect()) == len(rows)  # each once


def test_registry_is_the_batch_registry(spark, arrivals, tmp_path):
    rows, put, stream = arrivals
    for k in range(5):
        put(k)
    got = decided(sessions.drained(sessions.known(stream(), "1 hour", 300), str(tmp_path / "out"), str(tmp_path / "c")), "known")
    minted, plain = {}, {}
    for s, i, t, m in sorted(rows, key=lambda x: (x[2], x[1])):
        if m:
            minted[s] = t
        plain[i] = s in minted and t <= minted[s] + timedelta(seconds=300)
    assert got == plain == decided(sessions.known_batch(spark.createDataFrame(rows, SCHEMA), 300), "known")
    assert set(got.values()) == {True, False}


def test_late_rows_are_dropped(spark, arrivals, tmp_path):
    _, put, stream = arrivals
    run = lambda: sessions.drained(sessions.limited(stream(), "1 hour", 5, 60), str(tmp_path / "out"), str(tmp_path / "c"))
    put(4)
    run()
    put(0)  # a year after the watermark
    assert decided(run(), "allowed") == {}


def test_what_waits_is_kept_by_buckets_of_sessions(spark, tmp_path):
    """3,000 sessions wait in a few entries a bucket, and are decided as a batch decides them; one has no number."""
    start = datetime(2024, 1, 1)
    rows = [(None if i % 3000 == 7 else i % 3000, i, start + timedelta(seconds=i // 7), i % 11 == 0) for i in range(12_000)]
    folder, end = str(tmp_path / "in"), [(-1, -1, datetime(2025, 1, 1), False)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    query = sessions.limited(stream(), "1 hour", 2, 900).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 1500
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    got = sessions.drained(sessions.limited(stream(), "1 hour", 2, 900), str(tmp_path / "out"), str(tmp_path / "c")).filter("event_id >= 0")
    want = chat.rate_limited(spark.createDataFrame(rows, SCHEMA).filter("session_id IS NOT NULL"), 2, 900)
    named = got.filter("session_id IS NOT NULL")
    assert sorted(tuple(r) for r in named.collect()) == sorted(tuple(r) for r in want.select("session_id", "event_id", "allowed").collect()) and got.count() == 12_000
    assert {r.allowed for r in named.collect()} == {True, False}


def test_no_arrival_is_too_late_when_ids_do_not_follow_time(spark, tmp_path, monkeypatch):
    from lorewell.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_FILE_ROWS", 100, raising=False)  # many files, many micro-batches
    r, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=r.randrange(30 * 86_400)), r.randrange(50), r.choice(["view", "click"])) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    for stream, batch in ((stream_queries.stream_rate_limit, rate_limit), (stream_queries.stream_known_sessions, stream_queries.known_sessions)):
        assert sorted(tuple(r) for r in stream(spark, d).collect()) == sorted(tuple(r) for r in batch(spark, d).collect())


def test_running_completed_and_failed_queries_are_registered(spark, arrivals, tmp_path):
    _, put, stream = arrivals
    put(0), put(1)
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    listener = runs.QueryListener(log)
    spark.streams.addListener(listener)
    try:
        good = stream().writeStream.format("noop").queryName("good").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        good.awaitTermination()
        broken = stream().withColumn("x", F.raise_error(F.lit("broken on purpose"))).writeStream.format("noop").queryName("bad").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            broken.awaitTermination()
        live = stream().writeStream.format("noop").queryName("live").option("checkpointLocation", str(tmp_path / "c3")).trigger(processingTime="100 milliseconds").start()
        live.processAllAvailable()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = {}
        for _ in range(60):
            got = {r.name: r for r in log.registry().collect()}
            if {n: r.status for n, r in got.items()} == {"good": "completed", "bad": "failed", "live": "running"} and got["live"].stats:
                break
        assert {n: r.status for n, r in got.items()} == {"good": "completed", "bad": "failed", "live": "running"}
        assert got["bad"].error and got["good"].error is None and got["good"].finished_at >= got["good"].started_at and got["live"].finished_at is None
        assert json.loads(got["good"].stats)["batch"] == 1
        live.stop()
    finally:
        spark.streams.removeListener(listener)


def test_counters_are_observed_while_a_stage_writes(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    rows = spark.range(100).withColumn("ok", F.col("id") % 3 == 0)
    stats = runs.observed_write(rows, str(tmp_path / "o"), log, "chunk", processed=F.count_if("ok"), skipped=F.count_if(~F.col("ok")), total=F.sum("id"))
    assert stats == {"processed": 34, "skipped": 66, "total": 4950}
    with pytest.raises(Exception):
        runs.observed_write(rows.withColumn("x", F.raise_error(F.lit("no"))), str(tmp_path / "p"), log, "embed", n=F.count(F.lit(1)))
    got = {r.name: r for r in log.registry().collect()}
    assert got["chunk"].status == "completed" and json.loads(got["chunk"].stats) == stats and got["embed"].status == "failed"
