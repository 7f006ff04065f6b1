"""Runs, settings, schedules, storage listings and URL reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import url_part
from ..shared import materialised

_BROADCAST_CRONS = 100_000  # expressions whose next times are sent to all executors at most


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """(key, value): base with the values of over in their place."""
    b, o = base.select("key", F.col("value").alias("_b")), over.select("key", F.col("value").alias("_o"), F.lit(True).alias("_has"))
    return b.join(o, "key", "full").select("key", F.when(F.col("_has"), F.col("_o")).otherwise(F.col("_b")).alias("value"))


def run_history(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "id").limit(limit)


#: From which states a run may go to which.
TRANSITIONS = {"IDLE": "CRAWLING", "CRAWLING": "CHUNKING", "CHUNKING": "EMBEDDING", "EMBEDDING": "DONE"}
TERMINAL = ("IDLE", "DONE", "FAILED", "CANCELLED")


#: The state after an event in a state, where it changes.
AFTER = {(a, "ok"): b for a, b in TRANSITIONS.items() if a not in TERMINAL} | {(s, "start"): "CRAWLING" for s in TERMINAL} | {(a, e): to for a in TRANSITIONS if a not in TERMINAL for e, to in (("fail", "FAILED"), ("cancel", "CANCELLED"))}


def next_state(state: Column, event: Column) -> Column:
    """The state after an event: start (from a state of rest only), ok, fail, cancel."""
    onward = F.lit(None).cast("string")
    for a, b in TRANSITIONS.items():
        onward = F.when(state == a, b).otherwise(onward)
    resting = state.isin(*TERMINAL)
    return F.when(event == "start", F.when(resting, "CRAWLING").otherwise(state)).when(resting, state).when(event == "ok", onward).when(event == "fail", "FAILED").when(event == "cancel", "CANCELLED").otherwise(state)


def bucket_stats(objects: DataFrame) -> DataFrame:
    """(bucket, objects, bytes, mb) of objects (bucket, name, size)."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return objects.groupBy("bucket").agg(F.count(F.lit(1)).alias("objects"), total.alias("bytes"), F.round(total / 1048576, 2).alias("mb"))


def browse(objects: DataFrame, prefix: str = "", sort_by: str = "name", descending: bool = False) -> DataFrame:
    """What lies directly under prefix: folders, then files, each sorted."""
    rest = F.substring(F.col("name"), F.lit(len(prefix) + 1), F.length("name"))
    under = objects.filter(F.col("name").startswith(prefix)).select(rest.alias("rest"), "name", "size", "last_modified")
    parts = F.split("rest", "/")
    folders = under.filter(F.contains("rest", F.lit("/"))).select(parts[0].alias("name")).distinct().select("name", F.concat(F.lit(prefix), "name", F.lit("/")).alias("path"), F.lit("folder").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("last_modified"))
    files = under.filter(~F.contains("rest", F.lit("/")) & (F.col("rest") != "")).select(F.col("rest").alias("name"), F.col("name").alias("path"), F.lit("file").alias("type"), F.col("size").cast("long").alias("size"), F.col("last_modified").cast("string").alias("last_modified"))
    key = F.coalesce("last_modified", F.lit("")) if sort_by == "date" else F.lower("name")
    return folders.unionByName(files).orderBy(F.desc("type"), key.desc() if descending else key.asc())


def url_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(url, where) of two URL sets: a, b or both."""
    x, y = a.select("url").distinct().withColumn("_a", F.lit(True)), b.select("url").distinct().withColumn("_b", F.lit(True))
    return x.join(y, "url", "full").select("url", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "a").otherwise("b").alias("where"))


def url_report(urls: DataFrame, examples: int = 5) -> DataFrame:
    """(prefix, n, urls): URLs by the first segment of their path, with a few of them; the
    largest groups come first."""
    path = F.regexp_replace(url_part(F.col("url"), "path"), r"^/+", "")
    rows = urls.select("url", F.split(path, "/")[0].alias("prefix"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("prefix").orderBy("url"))).filter(F.col("_r") <= examples)
    few = first.groupBy("prefix").agg(F.sort_array(F.collect_list("url")).alias("urls"))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).join(few, "prefix").orderBy(F.desc("n"), "prefix")


def log_tail(lines: DataFrame, n: int, most: int = 5000, order: str = "seq") -> DataFrame:
    """The last n of the last `most` lines, in order; all of those for n <= 0."""
    return lines.orderBy(F.desc(order)).limit(most if n <= 0 else min(n, most)).orderBy(order)


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, dash, b = span.partition("-")
        if span == "*":
            first, last = low, high
        else:
            first = int(a)
            last = int(b) if dash else high if step else first
        if not (low <= first <= last <= high) or (step and int(step) < 1):
            raise ValueError(f"bad cron field {spec!r}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def cron_fields(cron: str) -> list[set[int]]:
    """Minutes, hours, days, months, weekdays (0: Sunday) of a five-field expression."""
    parts = cron.split()
    if len(parts) != 5:
        raise ValueError(f"{cron!r} doesn't have five fields")
    fields = [_field(p, *r) for p, r in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True)]
    fields[4] = {d % 7 for d in fields[4]}
    return fields


def cron_next_runs(schedules: DataFrame, start: str, n: int = 5, days: int = 366 * 5) -> DataFrame:
    """(id, run, run_at): the next n times after start of the enabled schedules (id, cron, enabled) whose
    expression is valid.  The times hang on the expression alone, so they are made once for each distinct one, within
    its row, which is bounded: of the days that fit the first n + 1, which are enough, and of each the first n
    minutes after start.  Then the schedules look them up; nothing is sorted."""

    @F.pandas_udf("array<array<int>>")
    def fields(cron: pd.Series) -> pd.Series:
        def of(c: str | None) -> list[list[int]] | None:
            try:
                return [sorted(f) for f in cron_fields(c or "")]
            except ValueError:
                return None

        return pd.Series([of(c) for c in cron], dtype=object)

    free = lambda k: F.split(F.trim("cron"), r"\s+")[k] == "*"
    begin = F.lit(start).cast("timestamp_ntz")
    enabled = schedules.filter("enabled").select("id", "cron")
    rows = enabled.select("cron").distinct().withColumn("f", fields("cron")).filter("f IS NOT NULL")
    rows = rows.select("cron", "f", free(2).alias("any_day"), free(4).alias("any_weekday"))

    def fits(d: Column) -> Column:
        on_day, on_weekday = F.array_contains(F.col("f")[2], F.dayofmonth(d)), F.array_contains(F.col("f")[4], F.dayofweek(d) - 1)
        return F.array_contains(F.col("f")[3], F.month(d)) & F.when(~F.col("any_day") & ~F.col("any_weekday"), on_day | on_weekday).otherwise(on_day & on_weekday)

    first = F.to_date(F.lit(start))
    found = rows.select(
        "cron", F.slice(F.filter(F.sequence(first, F.date_add(first, days)), fits), 1, n + 1).alias("d"),
        F.flatten(F.transform(F.col("f")[1], lambda h: F.transform(F.col("f")[0], lambda m: h * 60 + m))).alias("minutes"),
    )
    at = lambda d, m: d.cast("timestamp_ntz") + F.make_dt_interval(mins=m)
    later = lambda d: F.slice(F.when(d == first, F.filter("minutes", lambda m: at(d, m) > begin)).otherwise(F.col("minutes")), 1, n)
    times = found.select("cron", F.slice(F.flatten(F.transform("d", lambda d: F.transform(later(d), lambda m: at(d, m)))), 1, n).alias("times"))
    times = materialised(times, "times")
    some = enabled.join(F.broadcast(times) if times.count() <= _BROADCAST_CRONS else times, "cron")
    return some.select("id", F.posexplode("times").alias("run", "run_at")).withColumn("run", F.col("run") + 1)


def phrase_scores(docs: DataFrame, boilerplate: list[str], content: list[str]) -> DataFrame:
    """docs with n_boilerplate, n_content (phrases found, in any case), chars, newlines and clean."""
    low = F.lower("text")
    count = lambda ps: sum((F.contains(low, F.lit(p.lower())).cast("int") for p in ps), F.lit(0))
    rows = docs.withColumns({"n_boilerplate": count(boilerplate), "n_content": count(content), "chars": F.length("text"), "newlines": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))})
    return rows.withColumn("clean", (F.col("n_boilerplate") == 0) & (F.col("n_content") == len(content)))
