"""Queries that run as streams over arrivals of `events`, and the SQL of the batch that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import own_folder
from ..streaming import sessions
from .chat_queries import ORACLE_SQL as _CHAT_SQL
from .derivations import table

_FILE_ROWS = 2_000_000  # of one file of arrivals; each micro-batch costs something for each partition of the state
_SCHEMA = "session_id long, event_id long, ts timestamp, minted boolean"


def _arrivals(spark, d) -> tuple[DataFrame, str]:
    """A stream of all events in several files that overlap in time, with a last row of long after; and a delay of the
    watermark that no row exceeds.

    A quarter of the time arrives after the other, and of three rows one is as late as a 20th of the time, and
    one half as late.  Files have at most about _FILE_ROWS rows, and those of a quarter come in any order."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("minted"))
    at = F.unix_micros("ts")
    n, first, last, low, high = rows.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts"), F.min(at), F.max(at)).first()
    span = high - low + 1 if n else 1
    files = max(1, -(-n // (4 * _FILE_ROWS)))
    folder, part = own_folder(spark, "arrivals"), F.least(F.lit(3), F.floor((at - F.lit(low) + (F.col("event_id") % 3) * F.lit(span // 40)) * 4 / F.lit(span)))
    for k in range(4):
        rows.filter(part == k).repartition(files).write.mode("append").parquet(folder)
    seconds = int((last - first).total_seconds()) if n else 0
    end = spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("event_id"), (F.lit(last).cast("timestamp") + F.make_dt_interval(secs=F.lit(2 * seconds + 86_400 * 30))).alias("ts"), F.lit(False).alias("minted"))
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 4).parquet(folder), f"{3 * seconds // 10 + 60} seconds"


def _drained(spark, stream: DataFrame) -> DataFrame:
    return sessions.drained(stream, own_folder(spark, "decided"), own_folder(spark, "stream")).filter("event_id >= 0")


def stream_rate_limit(spark, d):
    """rate_limit as a stream."""
    stream, delay = _arrivals(spark, d)
    return _drained(spark, sessions.limited(stream, delay, 2, 86_400)).select("session_id", "event_id", "allowed")


def stream_known_sessions(spark, d):
    """Which rows come from a session that a view minted within the last hour, as a stream."""
    stream, delay = _arrivals(spark, d)
    return _drained(spark, sessions.known(stream, delay, 3600)).select("session_id", "event_id", "known")


def known_sessions(spark, d):
    """The same over the table."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("event_type") == "view").alias("minted"))
    return sessions.known_batch(rows, 3600)


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_known_sessions, known_sessions)}

_KNOWN = """SELECT user_id AS session_id, event_id, coalesce(epoch_us(ts) <= max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 3600000000, false) AS known FROM events"""
ORACLE_SQL = {"stream_rate_limit": _CHAT_SQL["rate_limit"], "stream_known_sessions": _KNOWN, "known_sessions": _KNOWN}
