"""Records around ingest and runs: stored URLs, sidecars, counters, point scans, run tables, limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS_DEFAULTS
from ..functions.text import strip


def unstored(rows: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL isn't stored yet; rows without a URL aren't stored either."""
    return rows.join(stored.select(url).distinct(), url, "left_anti")


def union_urls(known: DataFrame, found: DataFrame, url: str = "url") -> DataFrame:
    """The URLs known, and those found that are new: each once."""
    return known.select(url).union(found.select(url)).filter(F.col(url).isNotNull()).distinct()


def with_sidecars(docs: DataFrame, sidecars: DataFrame, key: str = "object_key") -> DataFrame:
    """docs with the columns of their sidecars and `has_sidecar`; a document without one stays."""
    return docs.join(sidecars.withColumn("has_sidecar", F.lit(True)), key, "left").withColumn("has_sidecar", F.coalesce("has_sidecar", F.lit(False)))


def resized(sidecars: DataFrame, bodies: DataFrame, key: str = "object_key", body: str = "body") -> DataFrame:
    """Sidecars with the byte size of the body that their document has now."""
    size = bodies.select(key, F.octet_length(body).alias("_size"))
    return sidecars.join(size, key, "left").withColumn("markdown_size_bytes", F.coalesce("_size", "markdown_size_bytes")).drop("_size")


def with_static(docs: DataFrame, static: DataFrame, key: str = "object_key") -> DataFrame:
    """docs with the static documents; where both have a key, the static one counts."""
    return docs.join(static.select(key), key, "left_anti").unionByName(static, allowMissingColumns=True)


def document_counters(log: DataFrame) -> DataFrame:
    """Pages and documents of a crawl log (kind, status), counted apart."""
    doc, ok = F.col("kind") == "document", F.col("status") == "SAVED"
    failed = F.col("status").isin("FAILED", "SKIPPED", "BLOCKED", "EMPTY")
    return log.agg(
        F.count_if(~doc & ok).alias("pages_crawled"), F.count_if(~doc & failed).alias("pages_failed"), F.count_if(F.col("status") == "DUPLICATE").alias("pages_skipped_duplicate"),
        F.count_if(doc & ok).alias("documents_saved"), F.count_if(doc & failed).alias("documents_failed"),
    )


def clean_counters(pages: DataFrame, error: Column, stale: Column, before: Column, after: Column) -> DataFrame:
    """Pages of a cleaning run: error pages and long past events are left out, the rest is cleaned."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(error).alias("error_pages"), F.count_if(~error & stale).alias("stale_pages"), F.count_if(~error & ~stale).alias("cleaned"), F.count_if(~error & ~stale & (before != after)).alias("changed"))


def chunk_counters(docs: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents of a chunking run (document_id, error): processed, without chunks, failed; and the chunks."""
    n = chunks.groupBy(document).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.join(n, document, "left")
    fine = F.col("error").isNull()
    return rows.agg(F.count_if(fine & F.col("n").isNotNull()).alias("processed"), F.count_if(fine & F.col("n").isNull()).alias("skipped"), F.count_if(~fine).alias("failed"), F.coalesce(F.sum(F.when(fine, F.col("n"))), F.lit(0)).alias("total_chunks"))


def embed_counters(checked: DataFrame, stale: DataFrame) -> DataFrame:
    """An indexing run's chunks (document_id, reason): embedded and skipped ones, documents that have any
    embedded and documents that have none, and the stale points that go."""
    good = F.col("reason").isNull()
    by_doc = checked.groupBy("document_id").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("all"))
    counts = by_doc.agg(F.count_if(F.col("good") > 0).alias("documents"), F.count_if(F.col("good") == 0).alias("failed"), F.coalesce(F.sum("good"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("all") - F.col("good")), F.lit(0)).alias("skipped"))
    return counts.crossJoin(stale.agg(F.count(F.lit(1)).alias("stale")))  # one row each


def scroll(points: DataFrame, must: dict | None = None, should: dict | None = None, must_not: dict | None = None, limit: int | None = None, after: str | None = None, order: str = "point_id") -> DataFrame:
    """Points that have all values of `must`, one at least of `should` and none of `must_not`, in order; a
    value may be a list of values.  `after` is the last key of the page before."""
    has = lambda c, v: F.coalesce(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v, F.lit(False))
    keep = F.lit(True)
    for c, v in (must or {}).items():
        keep &= has(c, v)
    for c, v in (must_not or {}).items():
        keep &= ~has(c, v)
    if should:
        some = F.lit(False)
        for c, v in should.items():
            some |= has(c, v)
        keep &= some
    rows = points.filter(keep if after is None else keep & (F.col(order) > after)).orderBy(order)
    return rows if limit is None else rows.limit(limit)


def collection_stats(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """Points, those with a vector, documents, and a status: empty, green, or yellow while some have none."""
    n, done = F.count(F.lit(1)), F.count(vector)
    return points.agg(n.alias("points"), done.alias("indexed"), F.countDistinct("document_id").alias("documents"), F.when(n == 0, "empty").when(done == n, "green").otherwise("yellow").alias("status"))


#: Content types by extension; others are bytes.
CONTENT_TYPES = {"md": "text/markdown", "json": "application/json", "txt": "text/plain", "html": "text/html", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def content_type(name: Column) -> Column:
    extension, out = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit("application/octet-stream")
    for e, kind in CONTENT_TYPES.items():
        out = F.when(extension == e, kind).otherwise(out)
    return out


def etag(x: Column) -> Column:
    return F.regexp_replace(x, '^"+|"+$', "")


def shown(x: Column, n: int) -> Column:
    """The first n characters in one line."""
    return F.replace(F.left(x, F.lit(n)), F.lit("\n"), F.lit(" "))


def split_lines(x: Column) -> Column:
    """Lines by every break that Unicode knows; a break at the end opens no further line."""
    lines = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    last = F.element_at(lines, -1) == ""
    return F.when(last, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def environment(settings: DataFrame, prefix: str, defaults: dict[str, str] = SETTINGS_DEFAULTS) -> DataFrame:
    """(name, value) of the environment of a stage: its settings, or their defaults, under upper-case names.
    Blank values count as unset."""
    known = F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv])
    base = settings.sparkSession.range(1).select(F.explode(known).alias("key", "default")).filter(F.col("key").startswith(f"{prefix}."))
    rows = base.join(settings.select("key", "value"), "key", "left")
    return rows.select(F.upper(F.replace("key", F.lit("."), F.lit("_"))).alias("name"), F.coalesce(F.nullif(strip(F.col("value")), F.lit("")), "default").alias("value"))


def applied(rows: DataFrame, changes: DataFrame, allowed: tuple[str, ...], key: str = "id") -> DataFrame:
    """rows after changes (seq, action, key, and columns): insert adds a row or replaces it, update sets the
    allowed columns that aren't null and of which others stay, delete takes it away.  The changes of a key
    count in order of seq; what comes before its last insert or delete is forgotten."""
    columns = [c for c in rows.columns if c != key]
    anew = F.col("action").isin("insert", "delete")
    base = changes.filter(anew).groupBy(key).agg(F.max_by(F.struct("action", *columns), "seq").alias("b"), F.max("seq").alias("s"))
    later = changes.filter(F.col("action") == "update").join(base.select(key, "s"), key, "left").filter(F.col("s").isNull() | (F.col("seq") > F.col("s")))
    last = later.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns if c in allowed])
    kept = rows.join(base.select(key), key, "left_anti").unionByName(base.filter("b.action = 'insert'").select(key, *[F.col(f"b.{c}").alias(c) for c in columns]))
    return kept.join(last, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in allowed else F.col(c) for c in columns]).select(rows.columns)


def stat(doc: Column, path: str, kind: str) -> Column:
    """A value of a JSON document (VARIANT) by its path, as a type; null where it isn't there or isn't of that type."""
    return F.try_variant_get(doc, path, kind)


def variant(text: Column) -> Column:
    """Text as a JSON document; null where it isn't one."""
    return F.try_parse_json(text)


def patched(doc: Column, changes: dict[str, Column | None]) -> Column:
    """A JSON object with the top-level fields that `changes` names set to their values, or taken out where that is None.
    The rest stays as it is, nested values too.  What isn't an object counts as an empty one."""
    fields = F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*changes))
    within = lambda text: F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))  # noqa: E731  an object's text without its braces
    set_to = [within(F.to_json(F.create_map(F.lit(k), v))) for k, v in changes.items() if v is not None]
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", within(F.to_json(rest)), *set_to), F.lit("}")))


def stat_fields(rows: DataFrame, doc: str) -> DataFrame:
    """(field, kind, n): which top-level fields the documents have, of which types, and how often."""
    each = rows.select(F.explode(F.try_variant_get(F.col(doc), "$", "map<string,variant>")).alias("field", "v"))
    return each.groupBy("field", F.schema_of_variant("v").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def by_created(schedules: DataFrame) -> DataFrame:
    return schedules.orderBy("created_at", "id")


def job_registry(events: DataFrame) -> DataFrame:
    """(job_id, status, started_at, finished_at, error) of job events (job_id, seq, ts, kind, message):
    running until a completed or failed comes; what comes after that is not looked at."""
    end = F.when(F.col("kind").isin("completed", "failed"), F.col("seq"))
    ended = F.min_by(F.struct("kind", "ts", "message"), end)
    return events.groupBy("job_id").agg(F.min("ts").alias("started_at"), F.when(F.min(end).isNotNull(), ended).alias("e")).select(
        "job_id", F.coalesce("e.kind", F.lit("running")).alias("status"), "started_at", F.col("e.ts").alias("finished_at"), F.when(F.col("e.kind") == "failed", F.col("e.message")).alias("error")
    )


def _folded(rows: DataFrame, key: str, order: list[str], out: str, start, step, done=None) -> DataFrame:
    """Rows of `out`, made by reading each key's rows in order: step(state, row) gives the next state and the rows to
    give, start(key) the first state, done(key, state) the rows at a key's end.  A partition is read once and holds
    one state, so a key with any number of rows is never gathered."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, some = None, None, False
        for b in batches:
            given = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if not some or k != now:
                    given += done(now, state) if some and done else []
                    now, state, some = k, start(k), True
                state, more = step(state, row)
                given += more
            yield pd.DataFrame(given, columns=names)
        if some and done:
            yield pd.DataFrame(done(now, state), columns=names)

    names = [c.split()[0] for c in out.split(", ")]
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, out)


def without_overlaps(triggers: DataFrame) -> DataFrame:
    """Triggers (schedule, id, start, seconds) with `skipped`: a trigger while an earlier run of its schedule,
    which wasn't skipped itself, is still at work doesn't start."""
    rows = triggers.select("schedule", "id", F.unix_micros("start").alias("t"), (F.col("seconds") * 1_000_000).cast("long").alias("u"))

    def step(until, r):
        busy = r.t < until
        return (until if busy else r.t + r.u), [(r.schedule, r.id, r.t, busy)]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = _folded(rows, "schedule", ["t", "id", "u"], f"schedule {kinds['schedule']}, id {kinds['id']}, t long, skipped boolean", lambda k: -(1 << 62), step)
    return found.select("schedule", "id", F.timestamp_micros("t").alias("start"), "skipped")


def state_changes(events: DataFrame, after: dict[tuple[str, str], str], first: str = "IDLE") -> DataFrame:
    """(run_id, step, seq, state): each change of a run's state, in order, by its events (run_id, seq, event); `after` gives
    the state after an event in a state, which stays as it is where nothing is given."""
    kind = events.schema["run_id"].dataType.simpleString()

    def step(state, r):
        at, n = state
        new = after.get((at, r.event), at)
        return ((at, n), []) if new == at else ((new, n + 1), [(r.run_id, n + 1, r.seq, new)])

    return _folded(events.select("run_id", "seq", "event"), "run_id", ["seq", "event"], f"run_id {kind}, step long, seq long, state string", lambda k: (first, 0), step)


def run_states(events: DataFrame, after: dict[tuple[str, str], str], first: str = "IDLE") -> DataFrame:
    """(run_id, state, path) after all events (run_id, seq, event) of a run in order; a path is as long as its changes."""
    kind = events.schema["run_id"].dataType.simpleString()

    def step(path, r):
        new = after.get((path[-1], r.event), path[-1])
        if new != path[-1]:
            path.append(new)
        return path, []

    return _folded(events.select("run_id", "seq", "event"), "run_id", ["seq", "event"], f"run_id {kind}, state string, path string", lambda k: [first], step, lambda k, path: [(k, path[-1], ">".join(path))])


def job_pods(pods: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job, pod, phase, n_events, last_reason): the pods of each job, by label, with their events; jobs
    without pods and pods without events stay."""
    seen = events.groupBy("pod").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("reason", "seq").alias("last_reason"))
    rows = jobs.select("job").join(pods.select(F.col("label").alias("job"), "pod", "phase"), "job", "left").join(seen, "pod", "left")
    return rows.select("job", "pod", "phase", F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_reason")


def leaky_bucket(requests: DataFrame, rate: float = 20.0, burst: int = 10, key: str = "ip", ts: str = "ts", order: str = "request_id") -> DataFrame:
    """(key, order, allowed): a bucket of `burst` requests for each key that leaks `rate` a second; a request
    that would flow over is turned away and adds nothing.

    A partition is read in order of key and time and holds one number: the requests of a key are never
    gathered.  Levels are counted in thousandths, as whole numbers."""
    rows = requests.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    per_ms = round(rate)  # thousandths that leak in a millisecond

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, level, last = None, 0, 0
        for b in batches:
            ok = []
            for k, t in zip(b["k"], b["t"] // 1000, strict=True):
                if k != now:
                    now, level, last = k, -1000, t
                after = max(0, level - per_ms * (t - last)) + 1000 if level >= 0 else 0
                ok.append(after <= 1000 * burst)
                if ok[-1]:
                    level, last = after, t
            yield pd.DataFrame({"k": b["k"], "o": b["o"], "allowed": ok})

    k, o = rows.schema["k"].dataType.simpleString(), rows.schema["o"].dataType.simpleString()
    done = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(fold, f"k {k}, o {o}, allowed boolean")
    return done.select(F.col("k").alias(key), F.col("o").alias(order), "allowed")


def first_pages(found: DataFrame, most: int, order: tuple[str, ...] = ("depth", "node")) -> DataFrame:
    """The first `most` pages of a traversal, by depth: a crawl's bound on pages."""
    return found.orderBy(*order).limit(most)


def with_position(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with `position`, from 1, within each key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
