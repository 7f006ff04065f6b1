"""Sessions as streams: what is decided in order of event time while rows arrive in any order.

A session's rows wait in state until the watermark has passed them; then they are decided in order of time,
so the decisions are those of a batch over all rows, however the rows were dealt over micro-batches.  Rows
that come after the watermark has passed them are too late and dropped, as Spark drops them.  What waits
is bounded by the watermark's delay; what a decision remembers is bounded by the decision, and goes with a
timer once it can't matter any more.  State is in RocksDB and survives a restart from the checkpoint.

Sessions are dealt into buckets by a hash, and a bucket is a key of the state: a micro-batch asks it a few
times a bucket, not a few times a session, and rows wait as Arrow batches, not one by one."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import LIMITS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of sessions.  A checkpoint is tied to their number.
_BUCKETS = 512
_WAITING = pa.schema([("k", pa.string()), ("t", pa.int64()), ("o", pa.int64()), ("x", pa.bool_())])
_KEPT = pa.schema([("k", pa.string()), ("t", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(state, schema: pa.Schema) -> pa.Table:
    parts = [pa.ipc.open_stream(pa.py_buffer(bytes(r[0]))).read_all() for r in state.get()] if state.exists() else []
    return pa.concat_tables(parts) if parts else schema.empty_table()


class Ordered(StatefulProcessor):
    """Rows (k: a session, t: microseconds, o: an order among equal times, x: a flag) of a bucket of sessions, each
    session's decided in order.

    A subclass has `decide(memory, t, x)`, which gives a decision and changes the memory, a deque of times of one
    session, and `lives(memory)`, until when (microseconds) the memory matters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getListState("kept", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            if len(b):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(b[_WAITING.names], _WAITING, preserve_index=False)),))
                first = min(int(b["t"].min()), first) if first is not None else int(b["t"].min())
        if first is not None:  # one timer a bucket: each that expires reads what waits
            there = [int(t) for t in self.handle.listTimers()]
            if not there or first // 1000 < min(there):
                for t in there:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        there, memories = _unpacked(self.waiting, _WAITING), {}
        for k, t in zip(*_unpacked(self.kept, _KEPT).to_pydict().values(), strict=True):
            memories.setdefault(k, deque()).append(t)
        is_ready = there["t"].to_numpy() <= passed
        ready, left = there.filter(pa.array(is_ready)), there.filter(pa.array(~is_ready))
        names = ready["k"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, t, x = names.indices.to_numpy(), ready["t"].to_numpy(), ready["x"].to_numpy()
        order = np.lexsort((x, ready["o"].to_numpy(), t, code))
        sessions, out, now, memory = names.dictionary.to_pylist(), [], -1, None
        for c, at, flag in zip(code[order].tolist(), t[order].tolist(), x[order].tolist(), strict=True):
            if c != now:
                now, memory = c, memories.setdefault(sessions[c], deque())
            out.append(self.decide(memory, at, flag))
        memories = {k: m for k, m in memories.items() if m and self.lives(m) > passed}
        if left.num_rows:
            self.waiting.put([(_packed(left),)])
        elif there.num_rows:
            self.waiting.clear()
        if memories:
            pairs = [(k, t) for k, m in memories.items() for t in m]
            self.kept.put([(_packed(pa.table([[k for k, _ in pairs], [t for _, t in pairs]], _KEPT)),)])
        elif self.kept.exists():
            self.kept.clear()
        if left.num_rows:
            self.handle.registerTimer(max(int(left["t"].to_numpy().min()) // 1000, passed // 1000 + 1))
        elif memories:
            self.handle.registerTimer(min(map(self.lives, memories.values())) // 1000 + 1)
        rows = ready.select(["k", "o"]).take(pa.array(order))
        yield pd.DataFrame({"k": rows["k"].to_pandas(), "o": rows["o"].to_pandas(), "decision": np.array(out, bool)})

    def close(self) -> None:
        pass


class Limiter(Ordered):
    """Whether a request is allowed: at most `most` allowed ones in a sliding window."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def decide(self, memory: deque, t: int, x: bool) -> bool:
        while memory and memory[0] < t - self.window:
            memory.popleft()
        if len(memory) < self.most:
            memory.append(t)
            return True
        return False

    def lives(self, memory: deque) -> int:
        return memory[-1] + self.window


class Registry(Ordered):
    """Whether a row's session is known: x mints it, and it is known for `ttl` from then on."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def decide(self, memory: deque, t: int, x: bool) -> bool:
        if x:
            memory.clear()
            memory.append(t)
        return bool(memory) and t <= memory[0] + self.ttl

    def lives(self, memory: deque) -> int:
        return memory[0] + self.ttl


def _decided(rows: DataFrame, processor: Ordered, key: str, ts: str, order: str, flag: str | None, delay: str, name: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("b")
    plain = rows.select(bucket, F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").alias("at"), F.col(order).cast("long").alias("o"), (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)).alias("x"))
    timed = plain.withWatermark("at", delay).withColumn("t", F.unix_micros("at"))
    found = timed.groupBy("b").transformWithStateInPandas(processor, "k string, o long, decision boolean", "Append", "eventTime")
    return found.select(F.col("k").cast(rows.schema[key].dataType).alias(key), F.col("o").alias(order), F.col("decision").alias(name))


def limited(requests: DataFrame, delay: str = "1 hour", most: int = LIMITS.requests, window_seconds: int = LIMITS.window_seconds, key: str = "session_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, order, allowed) of a stream of requests: chat.rate_limited as a stream."""
    return _decided(requests, Limiter(most, window_seconds * 1_000_000), key, ts, order, None, delay, "allowed")


def known(rows: DataFrame, delay: str = "1 hour", ttl_seconds: int = 86_400, key: str = "session_id", ts: str = "ts", order: str = "event_id", minted: str = "minted") -> DataFrame:
    """(key, order, known) of a stream of rows, of which some mint their session: only sessions that were minted here,
    and not too long ago, are known."""
    return _decided(rows, Registry(ttl_seconds * 1_000_000), key, ts, order, minted, delay, "known")


def known_batch(rows: DataFrame, ttl_seconds: int = 86_400, key: str = "session_id", ts: str = "ts", order: str = "event_id", minted: str = "minted") -> DataFrame:
    """The same over a table."""
    before = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col(minted), F.unix_micros(F.col(ts).cast("timestamp")))).over(before)
    return rows.select(key, order, F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) <= last + ttl_seconds * 1_000_000, F.lit(False)).alias("known"))


def minted_sessions(rows: DataFrame) -> DataFrame:
    """rows with `session_id`, a new random one each, and `minted`."""
    return rows.withColumns({"session_id": F.expr("uuid()"), "minted": F.lit(True)})


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, to its end, into files at path; gives what they hold."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
