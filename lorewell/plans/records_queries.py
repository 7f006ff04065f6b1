"""Queries of records around ingest and runs, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SETTINGS_DEFAULTS
from ..functions import ids
from ..functions import text as tx
from ..functions.ids import point_id
from ..operators import admin, chat, cleaning, crawl, index, records, retrieval
from ..operators.point_store import PointStore
from ..shared import own_folder
from ..streaming.runs import RunLog
from . import service
from .chat_queries import _CHATS
from .derivations import CHROME, CRAWL, MARKDOWN, POINTS, QUESTIONS, chrome_pages, crawl_results, markdown_docs, points, questions, table
from .ingest_queries import _BLOCK_STEP, _CHROME_RE, _CHUNKS, dated
from .ops_queries import _CANON
from .retrieval_queries import _KEYWORD, _TOKENS, _VECTOR


def _canonical(spark, d):
    return table(spark, d, "pages").select("page_id", ids.canonical_url(F.col("url")).alias("url"))


def unstored_urls(spark, d):
    rows = _canonical(spark, d)
    return records.unstored(rows.filter("page_id % 4 <> 1"), rows.filter("page_id % 2 = 1")).select("page_id", "url")


def known_urls(spark, d):
    """The URLs of all pages, and the absolute targets of their links."""
    found = crawl.links(table(spark, d, "pages")).filter("href LIKE 'http%'").select(F.col("href").alias("url"))
    return records.union_urls(_canonical(spark, d), found)


def _documents(spark, d):
    m = markdown_docs(spark, d)
    i = F.col("doc_id")
    docs = m.select(F.col("document_id").alias("object_key"), "body")
    meta = m.filter(i % 9 != 0).select(F.col("document_id").alias("object_key"), "title", (i % 5).cast("int").alias("crawl_depth"), F.lit(7).alias("markdown_size_bytes"))
    return docs, meta


def markdown_sidecars(spark, d):
    docs, meta = _documents(spark, d)
    return records.with_sidecars(docs, meta).select("object_key", "title", F.coalesce("crawl_depth", F.lit(-1)).alias("crawl_depth"), "has_sidecar", F.octet_length("body").alias("size"))


def resized_sidecars(spark, d):
    docs, meta = _documents(spark, d)
    return records.resized(meta, docs.filter("object_key NOT LIKE '%3'")).select("object_key", "title", "markdown_size_bytes")


def static_documents(spark, d):
    docs, _ = _documents(spark, d)
    static = spark.createDataFrame([("0000000000000007", "# Contact\n\nwrite to us"), ("about.md", "# About\n\nall of it")], "object_key string, body string")
    return records.with_static(docs, static).select("object_key", F.md5("body").alias("body_md5"))


def document_counters(spark, d):
    log = crawl.classified(crawl_results(spark, d)).withColumn("kind", F.when(F.col("crawl_seq") % 6 == 0, "document").otherwise("page"))
    return records.document_counters(log)


def clean_counters(spark, d):
    """A cleaning run over pages with chrome, of which the cleaner tells error pages and past events."""
    pages = dated(spark, d, chrome_pages(spark, d).select("doc_id", F.array_join("lines", "\n").alias("body"))).withColumn("after", cleaning.without_chrome(F.col("body")))
    return records.clean_counters(pages, tx.is_error_page(F.col("body")), tx.is_stale(F.col("url"), F.col("body"), F.to_date(F.lit("2024-06-01"))), F.col("body"), F.col("after"))


def chunk_counters(spark, d):
    """A chunking run: documents over 20,000 bytes are errors; what is chunked is written, and counted while it is."""
    size = F.octet_length("body")
    docs = markdown_docs(spark, d).withColumn("error", F.when(size > 20_000, "too large"))
    stats = service.chunk_run(docs, own_folder(spark, "chunks"), RunLog(spark, own_folder(spark, "runs")))
    return spark.createDataFrame([tuple(stats[c] for c in ("processed", "skipped", "failed", "total_chunks"))], "processed long, skipped long, failed long, total_chunks long")


def _checked(spark, d):
    p = points(spark, d)
    bad = F.when(F.col("vec_id") % 5 < F.floor(F.col("vec_id") / 5) % 7, "")
    return index.validated(p.withColumns({"url": F.coalesce(bad, "url"), "point_id": point_id(F.col("chunk_id"))}))


def embed_counters(spark, d):
    """An indexing run: the store has two thirds of the points, some of bad chunks, and the pages' even and third chunks come anew."""
    p = _checked(spark, d).drop("reason")
    store = PointStore(spark, own_folder(spark, "points"))
    embed = index.hash_embedder(16)
    keep = ("point_id", "chunk_id", "document_id", "chunk_index", "text", "url", "title", "vec_id", "embedding")
    store.upsert(p.filter("vec_id % 3 <> 0").select(*keep[:-1], F.array().cast("array<float>").alias("embedding")))
    stats = service.index_run(p.filter("vec_id % 2 = 0 OR vec_id % 3 = 0").select(*keep[1:-1]), store, embed, own_folder(spark, "embedded"), RunLog(spark, own_folder(spark, "runs")))
    return spark.createDataFrame([tuple(stats[c] for c in ("documents", "failed", "chunks", "skipped", "stale"))], "documents long, failed long, chunks long, skipped long, stale long")


def point_scroll(spark, d):
    p = points(spark, d).withColumn("kind", F.concat(F.lit("k"), (F.col("vec_id") % 7).cast("string")))
    found = records.scroll(p, must={"kind": ["k1", "k2", "k3"]}, should={"chunk_index": [0, 4], "title": "Page 3"}, must_not={"document_id": "0000000000000001"}, limit=40, after="0000000000000002", order="chunk_id")
    return found.select("chunk_id", "kind", "title")


def collection_stats(spark, d):
    return records.collection_stats(points(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 50 != 49, F.col("embedding"))))


#: Endings of object keys, by the page's number.
_ENDINGS = (".md", ".meta.json", ".PDF", ".docx", ".html", "", ".txt", ".tar.gz", ".md/", ".")


def content_types(spark, d):
    """Types and tags of objects that are named after the pages."""
    name = F.concat(ids.object_key(F.col("url")), F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % len(_ENDINGS) + 1).cast("int")))
    rows = table(spark, d, "pages").select("page_id", name.alias("name"), F.concat(F.when(F.col("page_id") % 2 == 0, '"').otherwise('""'), F.md5("html"), F.lit('"')).alias("tag"))
    return rows.select("page_id", "name", records.content_type(F.col("name")).alias("content_type"), records.etag(F.col("tag")).alias("etag"))


def display_fields(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", records.shown(t, 60).alias("short"), F.md5(records.shown(t, 200)).alias("long_md5"))


def text_lines(spark, d):
    mixed = F.concat(F.replace("text", F.lit(". "), F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, "\r\nlast\r").otherwise("\x0c"))
    lines = records.split_lines(mixed)
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), F.md5(F.array_join(lines, "|")).alias("lines_md5"))


def _settings(spark, d):
    """Settings as the last of many changes of each: every event is one, some of them blank."""
    keys = F.array(*[F.lit(k) for k in (*SETTINGS_DEFAULTS, "other.key")])
    e = table(spark, d, "events").select("event_id", F.element_at(keys, (F.floor(F.col("event_id") / 3) % (len(SETTINGS_DEFAULTS) + 1) + 1).cast("int")).alias("key"), F.when(F.col("event_id") % 4 == 1, "  ").otherwise(F.floor("value").cast("string")).alias("value"))
    return index.last_wins(e, "key", "value", "event_id")


def settings_env(spark, d):
    over = _settings(spark, d)
    return records.environment(over, "crawl").unionByName(records.environment(over, "chunker"))


def run_changes(spark, d):
    """Runs from orders; changes from their lines: insert, update (of which `owner` may not) and delete."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("owner"))
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"))
    action = F.when(F.col("n") % 4 == 0, "delete").when(F.col("n") % 5 == 1, "insert").otherwise("update")
    changes = line.select((F.col("id") * 10 + F.col("n")).alias("seq"), action.alias("action"), "id", F.when(F.col("flag") != "R", F.col("flag")).alias("status"), F.lit("someone").alias("owner"))
    return records.applied(runs, changes, ("status",))


def run_stats(spark, d):
    """Statistics of events as JSON documents: typed values, documents with fields set and taken out, and those read again."""
    e = table(spark, d, "events")
    nested = F.concat(F.lit('{"stage": "'), "event_type", F.lit('", "stats": {"value": '), F.col("value").cast("string"), F.lit(', "props": '), "props", F.lit("}, "), F.when(F.col("event_id") % 5 == 0, '"error": "slow"').otherwise('"error": null'), F.lit("}"))
    doc = e.select("event_id", records.variant(nested).alias("doc"))
    doc = doc.withColumn("doc", records.patched(F.col("doc"), {"error": None, "checked": F.col("event_id") % 2 == 0, "stage": F.concat(F.lit("x-"), records.stat(F.col("doc"), "$.stage", "string"))}))
    get = lambda path, kind: records.stat(F.col("doc"), path, kind)
    return doc.select("event_id", get("$.stats.props.k", "int").alias("k"), F.round(get("$.stats.value", "double"), 2).alias("value"), get("$.stage", "string").alias("stage"), get("$.checked", "boolean").alias("checked"), get("$.error", "string").alias("error"), get("$.stage", "int").alias("wrong_type"))


def prop_fields(spark, d):
    return records.stat_fields(table(spark, d, "events").select(records.variant(F.col("props")).alias("p")), "p")


def schedules_by_age(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return records.by_created(rows).limit(30).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def job_registry(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    rows = table(spark, d, "events").select((F.col("user_id") * 40 + F.floor(F.col("event_id") / 500)).alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("props").alias("message"))
    return records.job_registry(rows)


def overlap_skips(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("schedule"), F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("start"), (F.floor("value") * 370 + 6000).alias("seconds"))
    return records.without_overlaps(rows)


def _run_events(spark, d):
    event = F.element_at(F.array(*[F.lit(e) for e in ("start", "ok", "ok", "ok", "fail", "cancel")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), event.alias("event"))


def run_state_paths(spark, d):
    return records.run_states(_run_events(spark, d), admin.AFTER)


def run_state_changes(spark, d):
    return records.state_changes(_run_events(spark, d), admin.AFTER)


def job_pods(spark, d):
    jobs = table(spark, d, "orders").filter("o_orderkey % 3 <> 2").select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job"))
    name = F.concat_ws("-", F.lit("pod"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("phase"), F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    pods = lines.select(F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("label"), name.alias("pod"), "phase")
    events = lines.filter("part % 2 = 0").select(name.alias("pod"), F.explode(F.sequence(F.lit(1), (F.col("l_linenumber") % 3).cast("int") + 1)).alias("seq"), "flag").withColumn("reason", F.concat("flag", F.col("seq").cast("string")))
    return records.job_pods(pods, jobs, events)


def leaky_bucket(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))  # to ten minutes, so that there are bursts
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("ip"), F.col("event_id").alias("request_id"), F.timestamp_micros(micros - F.pmod(micros, F.lit(600_000_000))).alias("ts"))
    return records.leaky_bucket(rows, rate=1, burst=4)


def bfs_pages(spark, d):
    from .ingest_queries import bfs_depth

    return records.first_pages(bfs_depth(spark, d), 60)


def bounded_pages(spark, d):
    """The pages of bfs_pages, by a traversal that stops at its bound."""
    from .ingest_queries import graph

    return crawl.crawled(graph(spark, d), spark.range(1).select(F.lit("r1").alias("node")), 4, 60)


def site_crawl(spark, d):
    """A crawl of the pages' links from their hosts, at most 1,500 nodes: a host leads to its pages, a page to its link
    targets; documents are visited but not followed.  Hosts take turns."""
    pages = table(spark, d, "pages")
    own = pages.select("page_id", ids.url_part(F.col("url"), "host").alias("host"), ids.canonical_url(F.col("url")).alias("page"))
    target = F.concat(F.lit("https://"), "host", "href")
    links = crawl.links(pages).filter("href LIKE '/%'").join(own, "page_id").select(F.col("page").alias("src"), ids.canonical_url(target).alias("dst"))
    edges = own.select(F.col("host").alias("src"), F.col("page").alias("dst")).unionByName(links).filter("src <> '' AND dst <> ''")
    host = F.coalesce(F.nullif(ids.url_part(F.col("node"), "host"), F.lit("")), F.col("node"))
    return crawl.crawled(edges, own.select(F.col("host").alias("node")).filter("node <> ''"), 3, 1500, host, ~crawl.is_document_url(F.col("node")))


def rrf_min_score(spark, d):
    q, p = questions(spark, d), points(spark, d)
    return retrieval.rrf_fuse(retrieval.vector_topk(q, p), retrieval.keyword_search(q, p), min_score=0.0155).withColumn("score", F.round("score", 9))


def chat_context(spark, d):
    c = chat.chats(table(spark, d, "conversations"))
    m = chat.chat_messages(F.col("question"), F.col("history"), F.concat(F.lit("[Source 1] Page"), F.col("conv_id").cast("string")), n=2)
    return c.select("conv_id", F.size(m).alias("n_messages"), F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")).alias("messages_md5"))


def storage_browse_by_date(spark, d):
    """The newest ten objects of a folder."""
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 7919), "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, d, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.octet_length("html").cast("long").alias("size"), at.alias("last_modified"))
    return admin.browse(rows, "site/", "date", descending=True).limit(10).select("name", "path", "size", "last_modified")


def _contacts(spark, d):
    i = F.col("doc_id")
    extra = F.when(i % 4 == 0, F.concat(F.lit("# Title\nFirst line of "), i.cast("string"), F.lit("\n\nRoom: 12 B\nOffice: East 3, call (512) 555-0100\nat 7 Long Hall\n"))).when(i % 4 == 1, "Write to a.b@cs.example.com or x@example.com, rm. 5\n").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(extra, "text").alias("body"))


def office_extract(spark, d):
    return _contacts(spark, d).select("doc_id", F.array_join(tx.offices(F.col("body")), "|").alias("offices"))


def contact_blocks(spark, d):
    return _contacts(spark, d).select("doc_id", tx.contact_block(F.col("body")).alias("block"), F.md5(tx.with_contact(F.col("body"))).alias("body_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        unstored_urls, known_urls, markdown_sidecars, resized_sidecars, static_documents, document_counters, clean_counters, chunk_counters, embed_counters, point_scroll, collection_stats, content_types, display_fields, text_lines,
        settings_env, run_changes, run_stats, prop_fields, schedules_by_age, job_registry, overlap_skips, run_state_paths, run_state_changes, job_pods, leaky_bucket, bfs_pages, bounded_pages, site_crawl, rrf_min_score, chat_context, storage_browse_by_date, office_extract, contact_blocks,
    )
}

_DOCS = f"""{MARKDOWN}, docs AS (SELECT doc_id, document_id AS object_key, title, body FROM mdd)"""
_FUSE_MIN = """f0 AS (SELECT qid, chunk_id, coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + k_rank), 0) AS score, v_rank, k_rank FROM v FULL JOIN k USING (qid, chunk_id)),
f AS (SELECT qid, chunk_id, score, rank, v_rank IS NOT NULL AS from_vector FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, v_rank IS NULL, coalesce(v_rank, k_rank)) AS INTEGER) AS rank FROM f0) WHERE rank <= 5 AND score >= 0.0155)"""
_STEP = """CASE WHEN s.state IN ('IDLE', 'DONE', 'FAILED', 'CANCELLED') THEN CASE WHEN e.event = 'start' THEN 'CRAWLING' ELSE s.state END WHEN e.event = 'start' THEN s.state WHEN e.event = 'fail' THEN 'FAILED' WHEN e.event = 'cancel' THEN 'CANCELLED' ELSE map {'CRAWLING': 'CHUNKING', 'CHUNKING': 'EMBEDDING', 'EMBEDDING': 'DONE'}[s.state] END"""
_CONTACTS = r"""ct AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# Title' || chr(10) || 'First line of ' || doc_id || chr(10) || chr(10) || 'Room: 12 B' || chr(10) || 'Office: East 3, call (512) 555-0100' || chr(10) || 'at 7 Long Hall' || chr(10)
  WHEN 1 THEN 'Write to a.b@cs.example.com or x@example.com, rm. 5' || chr(10) ELSE '' END || text AS body FROM documents)"""
_CONTACT_PARTS = r"""o1 AS (SELECT doc_id, body, list_filter(list_transform(list_concat(regexp_extract_all(body, '(?i)(?:Office|Room|Rm\.?)\s*:?\s*([^\n,]+)', 1), regexp_extract_all(body, '(\d+\s+[\w\s]+(?:Hall|House|Building|Tower|Street|Square)(?:\s+\w+)?)', 1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS o,
  regexp_extract_all(body, '\[([^\]]*@[^\]]+)\]\(mailto:[^)]+\)', 1) AS linked, regexp_extract_all(body, '[A-Za-z0-9_.+-]+@(?:[a-z]+\.)?example\.com') AS bare, regexp_extract_all(body, '\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}') AS ph FROM ct),
o2 AS (SELECT doc_id, body, CASE WHEN len(linked) > 0 THEN linked ELSE bare END AS em0, ph, o[1:2] AS o FROM o1),
o3 AS (SELECT doc_id, body, list_filter(em0, lambda x, i: list_position(em0, x) = i) AS em, list_filter(ph, lambda x, i: list_position(ph, x) = i) AS ph, list_filter(o, lambda x, i: list_position(o, x) = i) AS offices FROM o2),
o4 AS (SELECT *, CASE WHEN len(em) + len(ph) > 0 THEN chr(10) || chr(10) || '**Contact Information:**' || chr(10) || array_to_string(list_concat(list_transform(em, lambda x: '- Email: ' || x), list_concat(list_transform(ph, lambda x: '- Phone: ' || x), list_transform(offices, lambda x: '- Office: ' || x))), chr(10)) || chr(10) END AS block,
  regexp_extract(body, '(?m)^(#[^\S\n]+[^\n]+\n(?:[^\n]*\S[^\n]*\n)*)', 1) AS heading FROM o3)"""

_PLACED = "CASE WHEN block IS NULL THEN body WHEN heading = '' THEN block || body ELSE left(body, instr(body, heading) + length(heading) - 1) || block || substr(body, instr(body, heading) + length(heading)) END"
_BFS = """WITH RECURSIVE e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4) SELECT node, min(depth) AS depth FROM b GROUP BY node ORDER BY depth, node LIMIT 60"""
_SITE = r"""WITH o AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS page FROM pages),
h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT DISTINCT page AS src, 'https://' || host || CASE WHEN regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(href, '^([^?#]*)', 1), '/+$', '') END AS dst FROM h JOIN o USING (page_id) WHERE href LIKE '/%'),
l0 AS (SELECT DISTINCT host AS node, host FROM o WHERE host <> ''), c0 AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY node) AS turn FROM l0), v0 AS (SELECT node, host, 0 AS depth FROM c0 ORDER BY turn, node LIMIT 1500),
f1 AS (SELECT DISTINCT o.page AS node, lower(regexp_extract(o.page, '^https://([^/?#:]*)', 1)) AS host FROM v0 JOIN o ON o.host = v0.node WHERE o.page NOT IN (SELECT node FROM v0)), c1 AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY node) AS turn FROM f1),
v1 AS (SELECT node, host, 1 AS depth FROM c1 ORDER BY turn, node LIMIT (SELECT 1500 - count(*) FROM v0)),
f2 AS (SELECT DISTINCT l.dst AS node, lower(regexp_extract(l.dst, '^https://([^/?#:]*)', 1)) AS host FROM v1 JOIN l ON l.src = v1.node WHERE NOT regexp_matches(lower(v1.node), '\.(pdf|docx?)$') AND l.dst NOT IN (SELECT node FROM v0 UNION ALL SELECT node FROM v1)), c2 AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY node) AS turn FROM f2),
v2 AS (SELECT node, host, 2 AS depth FROM c2 ORDER BY turn, node LIMIT (SELECT 1500 - (SELECT count(*) FROM v0) - count(*) FROM v1)),
f3 AS (SELECT DISTINCT l.dst AS node, lower(regexp_extract(l.dst, '^https://([^/?#:]*)', 1)) AS host FROM v2 JOIN l ON l.src = v2.node WHERE NOT regexp_matches(lower(v2.node), '\.(pdf|docx?)$') AND l.dst NOT IN (SELECT node FROM v0 UNION ALL SELECT node FROM v1 UNION ALL SELECT node FROM v2)), c3 AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY node) AS turn FROM f3),
v3 AS (SELECT node, host, 3 AS depth FROM c3 ORDER BY turn, node LIMIT (SELECT 1500 - (SELECT count(*) FROM v0) - (SELECT count(*) FROM v1) - count(*) FROM v2))
SELECT node, depth FROM v0 UNION ALL SELECT node, depth FROM v1 UNION ALL SELECT node, depth FROM v2 UNION ALL SELECT node, depth FROM v3"""
_OBJECT_KEYS = r"""op AS (SELECT page_id, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || '/' || CASE WHEN trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN 'index' ELSE trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') END AS k FROM pages), ok AS (SELECT page_id, html, k || CASE WHEN k LIKE '%.md' THEN '' ELSE '.md' END AS object_key FROM op)"""
_STATES = f"""WITH RECURSIVE e0 AS (SELECT user_id AS run_id, event_id AS seq, (['start', 'ok', 'ok', 'ok', 'fail', 'cancel'])[CAST(event_id % 6 AS INTEGER) + 1] AS event FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM e0),
s(run_id, n, state, path) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), 'IDLE', 'IDLE' FROM e UNION ALL SELECT run_id, n, state, CASE WHEN state = was THEN path ELSE path || '>' || state END FROM (SELECT e.run_id, e.n, s.state AS was, s.path, {_STEP} AS state FROM s JOIN e ON e.run_id = s.run_id AND e.n = s.n + 1))
"""

ORACLE_SQL = {
    "unstored_urls": f"WITH {_CANON} SELECT page_id, url FROM cn n WHERE page_id % 4 <> 1 AND NOT EXISTS (SELECT 1 FROM cn s WHERE s.page_id % 2 = 1 AND s.url = n.url)",
    "known_urls": f"""WITH {_CANON}, l AS (SELECT unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS url FROM pages) SELECT url FROM cn UNION SELECT url FROM l WHERE url LIKE 'http%'""",
    "markdown_sidecars": f"WITH {_DOCS} SELECT object_key, CASE WHEN doc_id % 9 <> 0 THEN title END AS title, CAST(CASE WHEN doc_id % 9 <> 0 THEN doc_id % 5 ELSE -1 END AS INTEGER) AS crawl_depth, doc_id % 9 <> 0 AS has_sidecar, CAST(octet_length(encode(body)) AS INTEGER) AS size FROM docs",
    "resized_sidecars": f"WITH {_DOCS} SELECT object_key, title, CAST(CASE WHEN object_key LIKE '%3' THEN 7 ELSE octet_length(encode(body)) END AS INTEGER) AS markdown_size_bytes FROM docs WHERE doc_id % 9 <> 0",
    "static_documents": f"WITH {_DOCS}, st AS (SELECT * FROM (VALUES ('0000000000000007', '# Contact' || chr(10) || chr(10) || 'write to us'), ('about.md', '# About' || chr(10) || chr(10) || 'all of it')) t(object_key, body)) SELECT object_key, md5(body) AS body_md5 FROM docs WHERE object_key NOT IN (SELECT object_key FROM st) UNION ALL SELECT object_key, md5(body) FROM st",
    "document_counters": f"""WITH {CRAWL}, g AS (SELECT status, crawl_seq % 6 = 0 AS doc, status IN ('FAILED', 'SKIPPED', 'BLOCKED', 'EMPTY') AS bad FROM logged) SELECT count(*) FILTER (NOT doc AND status = 'SAVED') AS pages_crawled, count(*) FILTER (NOT doc AND bad) AS pages_failed, count(*) FILTER (status = 'DUPLICATE') AS pages_skipped_duplicate,
count(*) FILTER (doc AND status = 'SAVED') AS documents_saved, count(*) FILTER (doc AND bad) AS documents_failed FROM g""",
    "clean_counters": """WITH p AS (SELECT doc_id % 4 = 1 AS bad, doc_id % 4 = 0 AND doc_id % 3 < 2 AND date '2024-06-01' - (date '2023-01-01' + CAST(doc_id % 700 AS INTEGER)) > 180 AS old FROM documents)
SELECT count(*) AS pages, count(*) FILTER (bad) AS error_pages, count(*) FILTER (NOT bad AND old) AS stale_pages, count(*) FILTER (NOT bad AND NOT old) AS cleaned, count(*) FILTER (NOT bad AND NOT old) AS changed FROM p""",
    "chunk_counters": f"""WITH RECURSIVE {_CHUNKS}, g AS (SELECT m.doc_id, octet_length(encode(m.body)) > 20000 AS bad, count(c.doc_id) AS n FROM mdd m LEFT JOIN chunks c USING (doc_id) GROUP BY ALL)
SELECT count(*) FILTER (NOT bad AND n > 0) AS processed, count(*) FILTER (NOT bad AND n = 0) AS skipped, count(*) FILTER (bad) AS failed, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS total_chunks FROM g""",
    "clean_pages": rf"""WITH RECURSIVE {CHROME}, {_BLOCK_STEP}, kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM st JOIN li USING (doc_id, i) WHERE kept AND NOT ({_CHROME_RE}) GROUP BY doc_id),
ct AS (SELECT doc_id, regexp_replace(coalesce(t, ''), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS body FROM documents LEFT JOIN kept USING (doc_id)), {_CONTACT_PARTS} SELECT doc_id, md5({_PLACED}) AS text_md5 FROM o4""",
    "embed_counters": rf"""WITH {POINTS}, c AS (SELECT *, NOT (regexp_replace(text, '\s', '', 'g') = '' OR vec_id % 5 < (vec_id // 5) % 7) AS good FROM pts), g AS (SELECT document_id, count(*) FILTER (good) AS good, count(*) AS n FROM c WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 GROUP BY document_id),
now AS (SELECT * FROM c WHERE good AND (vec_id % 2 = 0 OR vec_id % 3 = 0)), s AS (SELECT count(*) AS stale FROM c WHERE vec_id % 3 <> 0 AND document_id IN (SELECT document_id FROM now) AND vec_id NOT IN (SELECT vec_id FROM now))
SELECT count(*) FILTER (good > 0) AS documents, count(*) FILTER (good = 0) AS failed, CAST(sum(good) AS BIGINT) AS chunks, CAST(sum(n - good) AS BIGINT) AS skipped, max(stale) AS stale FROM g, s""",
    "point_scroll": f"""WITH {POINTS} SELECT chunk_id, 'k' || (vec_id % 7) AS kind, title FROM pts WHERE vec_id % 7 IN (1, 2, 3) AND (chunk_index IN (0, 4) OR title = 'Page 3') AND document_id <> '0000000000000001' AND chunk_id > '0000000000000002' ORDER BY chunk_id LIMIT 40""",
    "collection_stats": f"WITH {POINTS} SELECT count(*) AS points, count(*) FILTER (vec_id % 50 <> 49) AS indexed, count(DISTINCT document_id) AS documents, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (vec_id % 50 = 49) = 0 THEN 'green' ELSE 'yellow' END AS status FROM pts",
    "content_types": rf"""WITH {_OBJECT_KEYS}, n AS (SELECT page_id, object_key || ({list(_ENDINGS)})[CAST(page_id % {len(_ENDINGS)} AS INTEGER) + 1] AS name, html FROM ok), x AS (SELECT *, lower(regexp_extract(name, '\.([A-Za-z0-9]+)$', 1)) AS e FROM n)
SELECT page_id, name, CASE e WHEN 'md' THEN 'text/markdown' WHEN 'json' THEN 'application/json' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS content_type, md5(html) AS etag FROM x""",
    "display_fields": "SELECT doc_id, replace(left(text, 60), chr(10), ' ') AS short, md5(replace(left(text, 200), chr(10), ' ')) AS long_md5 FROM documents",
    "text_lines": r"""WITH m AS (SELECT doc_id, replace(text, '. ', chr(8232)) || CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) || 'last' || chr(13) ELSE chr(12) END AS t FROM documents), l AS (SELECT doc_id, regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS x FROM m), k AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM l)
SELECT doc_id, CAST(len(x) AS INTEGER) AS n, md5(array_to_string(x, '|')) AS lines_md5 FROM k""",
    "settings_env": f"""WITH d AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SETTINGS_DEFAULTS.items())}) t(key, value)), e AS (SELECT event_id, ({[*SETTINGS_DEFAULTS, 'other.key']})[CAST((event_id // 3) % {len(SETTINGS_DEFAULTS) + 1} AS INTEGER) + 1] AS key, CASE WHEN event_id % 4 = 1 THEN '  ' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value FROM events),
l AS (SELECT key, arg_max(value, event_id) AS value FROM e GROUP BY key) SELECT upper(replace(d.key, '.', '_')) AS name, coalesce(nullif(trim(l.value), ''), d.value) AS value FROM d LEFT JOIN l USING (key)""",
    "run_changes": """WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), c AS (SELECT id, n, nullif(flag, 'R') AS status, CASE WHEN n % 4 = 0 THEN 'delete' WHEN n % 5 = 1 THEN 'insert' ELSE 'update' END AS action FROM l),
b AS (SELECT id, max(n) AS n FROM c WHERE action <> 'update' GROUP BY id), base AS (SELECT c.* FROM c JOIN b USING (id, n)),
kept AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS owner FROM orders WHERE o_orderkey NOT IN (SELECT id FROM base) UNION ALL SELECT id, status, 'someone' FROM base WHERE action = 'insert'),
u AS (SELECT c.id, arg_max(c.status, c.n) FILTER (c.status IS NOT NULL) AS status FROM c LEFT JOIN b USING (id) WHERE action = 'update' AND (b.n IS NULL OR c.n > b.n) GROUP BY c.id)
SELECT kept.id, coalesce(u.status, kept.status) AS status, owner FROM kept LEFT JOIN u USING (id)""",
    "run_stats": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, round(value, 2) AS value, 'x-' || event_type AS stage, event_id % 2 = 0 AS checked, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS INTEGER) AS wrong_type FROM events",
    "prop_fields": "SELECT 'k' AS field, 'BIGINT' AS kind, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "schedules_by_age": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 30",
    "job_registry": """WITH e AS (SELECT user_id * 40 + event_id // 500 AS job_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind, props AS message FROM events),
x AS (SELECT job_id, min(seq) AS seq FROM e WHERE kind <> 'progress' GROUP BY job_id), s AS (SELECT job_id, min(ts) AS started_at FROM e GROUP BY job_id)
SELECT s.job_id, coalesce(e.kind, 'running') AS status, s.started_at, e.ts AS finished_at, CASE WHEN e.kind = 'failed' THEN e.message END AS error FROM s LEFT JOIN x USING (job_id) LEFT JOIN e ON e.job_id = x.job_id AND e.seq = x.seq""",
    "overlap_skips": """WITH RECURSIVE e AS (SELECT user_id AS schedule, event_id AS id, date_trunc('second', ts) AS start, floor(value) * 370 + 6000 AS seconds FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY schedule ORDER BY start, id) AS n FROM e),
f AS (SELECT schedule, id, start, n, start + to_seconds(CAST(seconds AS BIGINT)) AS until, false AS skipped FROM r WHERE n = 1 UNION ALL
  SELECT r.schedule, r.id, r.start, r.n, CASE WHEN r.start < f.until THEN f.until ELSE r.start + to_seconds(CAST(r.seconds AS BIGINT)) END, r.start < f.until FROM f JOIN r ON r.schedule = f.schedule AND r.n = f.n + 1)
SELECT schedule, id, start, skipped FROM f""",
    "run_state_paths": f"{_STATES} SELECT run_id, arg_max(state, n) AS state, arg_max(path, n) AS path FROM s GROUP BY run_id",
    "run_state_changes": f"""{_STATES}, c AS (SELECT s.run_id, s.n, s.state, e.seq, lag(s.state) OVER (PARTITION BY s.run_id ORDER BY s.n) AS was FROM s LEFT JOIN e ON e.run_id = s.run_id AND e.n = s.n) SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY n) AS step, seq, state FROM c WHERE n > 0 AND state <> was""",
    "job_pods": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS phase, min(l_returnflag) AS flag, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), j AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 2)
SELECT 'job-' || o_orderkey AS job, CASE WHEN l_orderkey IS NOT NULL THEN 'pod-' || l_orderkey || '-' || l_linenumber END AS pod, phase, CAST(CASE WHEN part % 2 = 0 THEN l_linenumber % 3 + 1 ELSE 0 END AS BIGINT) AS n_events, CASE WHEN part % 2 = 0 THEN flag || (l_linenumber % 3 + 1) END AS last_reason FROM j LEFT JOIN l ON l_orderkey = o_orderkey""",
    "leaky_bucket": """WITH RECURSIVE e AS (SELECT user_id % 10 AS ip, event_id AS request_id, (epoch_us(ts) // 600000000) * 600000 AS ms FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ms, request_id) AS n FROM e),
f AS (SELECT ip, request_id, n, ms AS last, CAST(0 AS BIGINT) AS level, true AS allowed FROM r WHERE n = 1 UNION ALL
  SELECT ip, request_id, n, CASE WHEN ok THEN ms ELSE last END, CASE WHEN ok THEN after ELSE level END, ok FROM (SELECT *, after <= 4000 AS ok FROM (SELECT r.ip, r.request_id, r.n, r.ms, f.last, f.level, greatest(0, f.level - (r.ms - f.last)) + 1000 AS after FROM f JOIN r ON r.ip = f.ip AND r.n = f.n + 1)))
SELECT ip, request_id, allowed FROM f""",
    "bfs_pages": _BFS,
    "bounded_pages": _BFS,
    "site_crawl": _SITE,
    "rrf_min_score": f"WITH {POINTS}, {QUESTIONS}, {_TOKENS}, {_VECTOR}, {_KEYWORD}, {_FUSE_MIN} SELECT qid, chunk_id, round(score, 9) AS score, rank, from_vector FROM f",
    "chat_context": f"""WITH {_CHATS} SELECT conv_id, CAST(least(count(*) - 1, 2) + 2 AS INTEGER) AS n_messages, md5('system:' || '{(chat.SYSTEM_PROMPT + chat.CONTEXT_INTRO).replace("'", "''")}' || '[Source 1] Page' || conv_id || chr(10) || coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (back BETWEEN 1 AND 2) || chr(10), '') || 'user:' || max(text) FILTER (back = 0)) AS messages_md5 FROM b GROUP BY conv_id""",
    "storage_browse_by_date": """SELECT page_id || '.md' AS name, 'site/' || page_id || '.md' AS path, octet_length(encode(html)) AS size, strftime(make_timestamp((1700000000 + page_id * 7919) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_modified FROM pages ORDER BY last_modified DESC, path DESC LIMIT 10""",
    "office_extract": f"WITH {_CONTACTS}, {_CONTACT_PARTS} SELECT doc_id, array_to_string(offices, '|') AS offices FROM o4",
    "contact_blocks": f"WITH {_CONTACTS}, {_CONTACT_PARTS} SELECT doc_id, block, md5({_PLACED}) AS body_md5 FROM o4",
}
