"""Queries of operations: listings, reports, settings, runs, schedules, JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import admin
from .derivations import table


def _objects(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(ids.url_part(u, "host").alias("bucket"), ids.object_key(u).alias("name"), F.octet_length("html").cast("long").alias("size"), F.lit(None).cast("string").alias("last_modified"))


def bucket_stats(spark, d):
    return admin.bucket_stats(_objects(spark, d))


def storage_browse(spark, d):
    return admin.browse(_objects(spark, d).select("bucket", F.regexp_replace("name", r"^[^/]*/", "site/").alias("name"), "size", "last_modified").dropDuplicates(["name"]), "site/").select("name", "path", "type")


def _sides(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url"))
    canonical = p.select("page_id", ids.canonical_url(F.col("url")).alias("url"))
    return canonical.filter("page_id % 3 <> 0"), canonical.filter("page_id % 2 = 0 OR page_id % 3 = 0")


def url_set_ops(spark, d):
    return admin.url_differences(*_sides(spark, d))


def url_prefix_report(spark, d):
    urls = table(spark, d, "pages").select(ids.canonical_url(F.col("url")).alias("url")).distinct()
    return admin.url_report(urls).select("prefix", "n", F.array_join("urls", " ").alias("urls"))


def _runs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("event_type").alias("stage"))


def run_history(spark, d):
    return admin.run_history(_runs(spark, d), 50).select("id", "stage")


def settings_overlay(spark, d):
    """The status of every order, with that of its lines in its place where it has an odd number of them; and keys that only
    the overlay has."""
    base = table(spark, d, "orders").select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("value"), F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return admin.overlay(base, lines.select(F.concat(F.when(F.col("n") == 7, "lines.").otherwise("order."), F.col("l_orderkey").cast("string")).alias("key"), F.when(F.col("n") != 5, F.col("value")).alias("value")))


_EVENTS = ("start", "ok", "fail", "cancel")


def pipeline_state(spark, d):
    """How often each event meets each state in the events, and what state follows."""
    states = (*admin.TRANSITIONS, "DONE", "FAILED", "CANCELLED")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    rows = table(spark, d, "events").select(pick(states, F.col("event_id")).alias("state"), pick(_EVENTS, F.floor(F.col("event_id") / 7) + F.col("user_id")).alias("event"))
    return rows.groupBy("state", "event").agg(F.count(F.lit(1)).alias("n")).select("state", "event", "n", admin.next_state(F.col("state"), F.col("event")).alias("next"))


def cron_next_runs(spark, d):
    """The next five runs of a schedule of each customer: weekly, twice a month, every few hours, off, or of no valid form."""
    c = F.col("c_custkey")
    text = lambda x: x.cast("string")
    cron = F.when(c % 4 == 0, F.concat(text(c % 60), F.lit(" "), text(c % 24), F.lit(" * * "), text(c % 7))).when(c % 4 == 1, F.concat(text(c % 30), F.lit(",59 3 "), text(c % 27 + 1), F.lit(",28 * *"))).when(c % 4 == 2, F.concat(F.lit("*/20 "), text(c % 12), F.lit("-"), text(c % 12 + 2), F.lit(" * * *"))).otherwise("99 * * * *")
    rows = table(spark, d, "customer").select(c.alias("id"), cron.alias("cron"), (c % 9 != 0).alias("enabled"))
    return admin.cron_next_runs(rows, "2024-01-01 00:00:00", days=110).withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd HH:mm"))


def log_tail(spark, d):
    return admin.log_tail(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 100)


_CHROME, _CONTENT = ("the ", "Search", "###"), ("and", " of ")


def phrase_score(spark, d):
    return admin.phrase_scores(table(spark, d, "documents").select("doc_id", "text"), list(_CHROME), list(_CONTENT)).drop("text")


def props_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


QUERIES = {f.__name__: f for f in (bucket_stats, storage_browse, url_set_ops, url_prefix_report, run_history, settings_overlay, pipeline_state, cron_next_runs, log_tail, phrase_score, props_json)}

_OBJECTS = r"""o AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS bucket, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS p, octet_length(encode(html)) AS size FROM pages), obj AS (SELECT bucket, CASE WHEN p = '' THEN 'index' ELSE p END || CASE WHEN p LIKE '%.md' THEN '' ELSE '.md' END AS name, size FROM o)"""
_CANON = r"""cn AS (SELECT page_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS url FROM pages)"""

ORACLE_SQL = {
    "bucket_stats": f"WITH {_OBJECTS} SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1048576.0::DOUBLE, 2) AS mb FROM obj GROUP BY bucket",
    "storage_browse": f"""WITH {_OBJECTS} SELECT DISTINCT CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) ELSE name END AS name, 'site/' || CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) || '/' ELSE name END AS path, CASE WHEN contains(name, '/') THEN 'folder' ELSE 'file' END AS type FROM obj""",
    "url_set_ops": f"""WITH {_CANON}, a AS (SELECT DISTINCT url FROM cn WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT url FROM cn WHERE page_id % 2 = 0 OR page_id % 3 = 0) SELECT url, 'both' AS "where" FROM a WHERE url IN (SELECT url FROM b) UNION ALL SELECT url, 'a' FROM a WHERE url NOT IN (SELECT url FROM b) UNION ALL SELECT url, 'b' FROM b WHERE url NOT IN (SELECT url FROM a)""",
    "url_prefix_report": rf"""WITH {_CANON}, u AS (SELECT DISTINCT url, split_part(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+', ''), '/', 1) AS prefix FROM cn) SELECT prefix, count(*) AS n, array_to_string(list_sort(list(url))[1:5], ' ') AS urls FROM u GROUP BY prefix""",
    "run_history": "SELECT event_id AS id, event_type AS stage FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "settings_overlay": """WITH b AS (SELECT 'order.' || o_orderkey AS key, o_orderstatus AS value FROM orders), l AS (SELECT l_orderkey, max(l_linestatus) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) % 2 = 1),
o AS (SELECT CASE WHEN n = 7 THEN 'lines.' ELSE 'order.' END || l_orderkey AS key, CASE WHEN n <> 5 THEN value END AS value, true AS has FROM l) SELECT key, CASE WHEN o.has THEN o.value ELSE b.value END AS value FROM b FULL JOIN o USING (key)""",
    "pipeline_state": """WITH e AS (SELECT (['IDLE', 'CRAWLING', 'CHUNKING', 'EMBEDDING', 'DONE', 'FAILED', 'CANCELLED'])[CAST(event_id % 7 AS INTEGER) + 1] AS state, (['start', 'ok', 'fail', 'cancel'])[CAST((event_id // 7 + user_id) % 4 AS INTEGER) + 1] AS event FROM events), g AS (SELECT state, event, count(*) AS n FROM e GROUP BY ALL)
SELECT state, event, n, CASE WHEN state IN ('IDLE', 'DONE', 'FAILED', 'CANCELLED') THEN CASE WHEN event = 'start' THEN 'CRAWLING' ELSE state END WHEN event = 'start' THEN state WHEN event = 'fail' THEN 'FAILED' WHEN event = 'cancel' THEN 'CANCELLED' ELSE map {'CRAWLING': 'CHUNKING', 'CHUNKING': 'EMBEDDING', 'EMBEDDING': 'DONE'}[state] END AS next FROM g""",
    "cron_next_runs": """WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 9 <> 0), y AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-20', INTERVAL 1 DAY)) AS TIMESTAMP) AS day),
w AS (SELECT id, day + to_hours(id % 24) + to_minutes(id % 60) AS t FROM c, y WHERE id % 4 = 0 AND dayofweek(day) = id % 7),
m AS (SELECT DISTINCT id, day + to_hours(3) + to_minutes(x) AS t FROM (SELECT id, day, unnest([id % 30, 59]) AS x FROM c, y WHERE id % 4 = 1 AND day(day) IN (id % 27 + 1, 28))),
h AS (SELECT id, day + to_hours(hh) + to_minutes(mm) AS t FROM (SELECT id, day, unnest([id % 12, id % 12 + 1, id % 12 + 2]) AS hh FROM c, y WHERE id % 4 = 2 AND day < TIMESTAMP '2024-01-05'), (SELECT unnest([0, 20, 40]) AS mm)),
a AS (SELECT * FROM w UNION ALL SELECT * FROM m UNION ALL SELECT * FROM h), r AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY t) AS INTEGER) AS run, strftime(t, '%Y-%m-%d %H:%M') AS run_at FROM a WHERE t > TIMESTAMP '2024-01-01') SELECT * FROM r WHERE run <= 5""",
    "log_tail": "SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "phrase_score": """WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'the ') AS INTEGER) + CAST(contains(lower(text), 'search') AS INTEGER) + CAST(contains(text, '###') AS INTEGER) AS n_boilerplate, CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), ' of ') AS INTEGER) AS n_content, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS newlines FROM documents)
SELECT *, n_boilerplate = 0 AND n_content = 2 AS clean FROM s""",
    "props_json": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS k_max FROM events GROUP BY event_type",
}
