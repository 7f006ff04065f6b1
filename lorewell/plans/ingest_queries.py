"""Queries of ingest: identities, crawl outcomes, links, sections, chunks, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx
from ..operators import chunking, cleaning, crawl, index
from .derivations import CHROME, CRAWL, MARKDOWN, chrome_pages, crawl_results, markdown_docs, table


def url_identity(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", ids.canonical_url(u).alias("canonical"), ids.doc_id(u).alias("doc_id"), ids.raw_doc_id(u).alias("raw_id"), ids.object_key(u).alias("object_key"), ids.sidecar_key(ids.object_key(u)).alias("sidecar_key"))


def host_filter(spark, d):
    host = ids.url_part(F.col("url"), "host")
    return table(spark, d, "pages").select("page_id", host.alias("host"), crawl.host_allowed(host).alias("allowed"))


def blocked_path(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.path_blocked(F.col("url")).alias("blocked"))


#: What is put behind a page's URL, by the page's number, to make links of all kinds.
_ENDS = ("/Paper.PDF", "/report_of-2024.docx?x=1", "/old.doc#p", ".pdf/", "/x.pdfx", "/data-set_one.DOCX")


def document_url(spark, d):
    """Links made of the pages' URLs: documents and others, of several schemes, without a host or a scheme."""
    n = F.col("page_id")
    plain = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (n % len(_ENDS) + 1).cast("int"))
    head = F.when(n % 7 == 0, "ftp://").when(n % 7 == 1, "").when(n % 7 == 2, "https:///").when(n % 7 == 3, "mailto:").when(n % 7 == 4, "HTTP://").otherwise("https://")
    u = F.col("link_in")
    urls = table(spark, d, "pages").select("page_id", F.concat(head, F.regexp_replace(plain, "/+$", ""), end).alias("link_in"))
    return urls.select("page_id", crawl.is_document_url(u).alias("is_document"), crawl.is_safe_document_url(u).alias("safe"), tx.safe_url(u).alias("link"), tx.title_from_url(u).alias("title"))


def page_types(spark, d):
    return markdown_docs(spark, d).select("doc_id", tx.page_type(F.col("url")).alias("page_type"))


def crawl_classify(spark, d):
    return crawl.classified(crawl_results(spark, d)).select("crawl_seq", "host", "status")


def visit_status_counts(spark, d):
    return crawl.status_counts(crawl.classified(crawl_results(spark, d)))


def visit_domain_counts(spark, d):
    return crawl.host_counts(crawl.classified(crawl_results(spark, d)))


def crawl_counters(spark, d):
    return crawl.crawl_counters(crawl.classified(crawl_results(spark, d)))


def _halves(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")


def incremental_new_pages(spark, d):
    new, seen = _halves(spark, d)
    return crawl.new_pages(new, seen).select("doc_id")


def hash_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return index.last_wins(docs, "content_hash", "url", "doc_id")


def link_extract(spark, d):
    return crawl.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("internal").alias("internal"), F.countDistinct("href").alias("targets"))


def graph(spark, d):
    """The graph of customers and the nation and region above them."""
    up = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    top = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    back = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return up.unionByName(top).unionByName(back)


def bfs_depth(spark, d):
    return crawl.bfs_depth(graph(spark, d), spark.range(1).select(F.lit("r1").alias("node")), 4)


def frontmatter_roundtrip(spark, d):
    m = markdown_docs(spark, d)
    doc = tx.markdown_document(F.col("url"), F.col("title"), F.col("body"), F.lit(2), F.col("crawl_timestamp"), F.col("document_id"), ids.short_hash(F.col("body")))
    rows = m.select("doc_id", doc.alias("md"))
    v = tx.front_matter_values(F.col("md"))
    return rows.select("doc_id", v["url"].alias("url"), v["title"].alias("title"), v["crawl_depth"].alias("crawl_depth"), v["content_hash"].alias("content_hash"), F.md5(tx.strip(tx.body_of(F.col("md")))).alias("body_md5"))


def sections(spark, d):
    rows = markdown_docs(spark, d).select("doc_id", F.posexplode(chunking.sections(F.col("body"))).alias("n", "s"))
    return rows.select("doc_id", "n", F.array_join("s.headings_path", " > ").alias("path"), F.md5("s.text").alias("text_md5"), tx.token_estimate(F.col("s.text")).alias("tokens"))


def heading_paths(spark, d):
    return sections(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def large_section_windows(spark, d):
    rows = markdown_docs(spark, d).select("doc_id", F.posexplode(chunking.windows(F.col("body"))).alias("n", "w"))
    return rows.select("doc_id", "n", F.length("w").alias("chars"), F.md5("w").alias("text_md5"))


def build_chunks(spark, d):
    c = chunking.chunk_records(markdown_docs(spark, d))
    return c.select("chunk_id", "document_id", "chunk_index", "page_type", F.array_join("headings_path", " > ").alias("path"), "content_hash", "token_count")


def chunk_stats(spark, d):
    m = markdown_docs(spark, d)
    c = chunking.chunk_records(m).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    j = m.join(c, "document_id", "left")
    return j.agg(F.count("chunks").alias("processed"), F.count_if(F.col("chunks").isNull()).alias("skipped"), F.sum("chunks").alias("total_chunks"), F.max("chunks").alias("most_chunks"))


def clean_lines(spark, d):
    kept = F.filter("lines", lambda x: ~cleaning.is_chrome(x))
    return chrome_pages(spark, d).select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def clean_blocks(spark, d):
    kept = cleaning.outside_blocks(F.col("lines"))
    return chrome_pages(spark, d).select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def collapse_blank(spark, d):
    return chrome_pages(spark, d).select("doc_id", F.md5(cleaning.collapse_blank(F.array_join("lines", "\n"))).alias("text_md5"))


def clean_pages(spark, d):
    pages = chrome_pages(spark, d).select("doc_id", F.array_join("lines", "\n").alias("body"))
    return cleaning.cleaned(pages).select("doc_id", F.md5("body").alias("text_md5"))


def contact_extract(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.emails(t), ",").alias("emails"), F.array_join(tx.phones(t), ",").alias("phones"))


def dated(spark, d, m=None):
    """Pages of which some are error pages and some of past events; m has their doc_id and body."""
    m = markdown_docs(spark, d) if m is None else m
    i = F.col("doc_id")
    day = F.date_add(F.to_date(F.lit("2023-01-01")), (i % 700).cast("int"))
    head = F.when(i % 4 == 0, F.concat(F.date_format(day, "EEEE, MMMM d, yyyy"), F.lit("\n"))).when(i % 4 == 1, F.lit("# Resource at '/x' not found\n")).when(i % 4 == 2, F.lit("Monday, Smarch 41, 2023\n")).otherwise("")
    url = F.concat(F.lit("https://www.example.org"), F.when(i % 3 == 0, "/research/Seminars/").when(i % 3 == 1, "/News/Seminars/").otherwise("/other/"), i.cast("string"))
    return m.select("doc_id", url.alias("url"), F.concat(head, "body").alias("body"))


def error_pages(spark, d):
    return dated(spark, d).select("doc_id", tx.is_error_page(F.col("body")).alias("error"))


def stale_pages(spark, d):
    return dated(spark, d).select("doc_id", tx.is_stale(F.col("url"), F.col("body"), F.to_date(F.lit("2024-06-01"))).alias("stale"))


def html_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.markdown_from_html(F.col("html"))).alias("md_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        url_identity, host_filter, blocked_path, document_url, crawl_classify, visit_status_counts, visit_domain_counts, crawl_counters, incremental_new_pages, hash_index, link_extract, bfs_depth, frontmatter_roundtrip,
        sections, heading_paths, large_section_windows, build_chunks, chunk_stats, clean_lines, clean_blocks, collapse_blank, clean_pages, contact_extract, error_pages, stale_pages, html_markdown,
    )
} | {"page_type": page_types}

_PARTS = r"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"""
_SECTIONS = rf"""{MARKDOWN},
ln AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM mdd),
hd AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}}[^\S\n]+\S') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level FROM ln),
sec AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hd),
body AS (SELECT doc_id, s, max(level) AS level, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text, max(CASE WHEN level > 0 THEN regexp_replace(regexp_replace(line, '^#+', ''), '^\s+|\s+$', '', 'g') END) AS title FROM sec GROUP BY doc_id, s),
lev AS (SELECT *, max(CASE WHEN level = 1 THEN s END) OVER w AS s1, max(CASE WHEN level = 2 THEN s END) OVER w AS s2, max(CASE WHEN level = 3 THEN s END) OVER w AS s3 FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
pth AS (SELECT l.doc_id, l.s, l.text, concat_ws(' > ', a.title, b.title, c.title) AS path FROM lev l LEFT JOIN body a ON a.doc_id = l.doc_id AND a.s = l.s1
  LEFT JOIN body b ON b.doc_id = l.doc_id AND b.s = l.s2 AND l.s2 > coalesce(l.s1, -1) LEFT JOIN body c ON c.doc_id = l.doc_id AND c.s = l.s3 AND l.s3 > greatest(coalesce(l.s1, -1), coalesce(l.s2, -1)) WHERE l.text <> ''),
sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS n, path, text, CAST(length(text) // 4 AS INTEGER) AS tokens FROM pth)"""
_BLOCK_STEP = r"""ex AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM pages_in),
li AS (SELECT *, trim(line) AS x, regexp_matches(trim(line), '^##\s*(Search filters|How to search)') AS helps FROM ex),
st(doc_id, i, menu, search, footer, kept) AS (
  SELECT doc_id, CAST(0 AS BIGINT), false, false, false, false FROM pages_in UNION ALL
  SELECT q.doc_id, q.i, q.stays OR (NOT q.hidden AND q.x = 'Site menu'), CASE WHEN q.stays THEN q.search ELSE q.searching OR (NOT q.hidden AND q.x <> 'Site menu' AND (q.x = 'Search this site' OR q.helps)) END,
    q.footer OR (NOT q.hidden AND q.x LIKE '### Site footer%'), NOT q.hidden AND q.x <> 'Site menu' AND q.x <> 'Search this site' AND NOT q.helps AND q.x NOT LIKE '### Site footer%'
  FROM (SELECT *, stays OR searching OR footer AS hidden FROM (SELECT *, NOT stays AND search AND (x NOT LIKE '#%' OR helps) AS searching FROM (
    SELECT li.doc_id, CAST(li.i AS BIGINT) AS i, li.x, li.helps, st.search, st.footer, st.menu AND NOT regexp_matches(li.x, '^#{1,2}\s+\S') AND (li.x = '' OR li.x LIKE '* [%' OR li.x LIKE '- [%' OR li.x LIKE '*  %') AS stays
    FROM st JOIN li ON li.doc_id = st.doc_id AND li.i = st.i + 1))) q)"""
_CHROME_RE = r"""regexp_matches(line, '^\s*\[?Skip to content') OR regexp_matches(line, '^\s*(Print|Share) this page\s*$') OR regexp_matches(line, '^\s*Back to top\s*$') OR regexp_matches(line, '^\s*Copyright \d{4}\b')
 OR regexp_matches(line, '!\[[^\]]*\]\(data:image/') OR trim(line) IN ('Menu', 'Close', 'Accept cookies') OR contains(line, '[Toggle navigation]') OR contains(line, '(#top)') OR (contains(line, '[Log in]') AND contains(line, 'staff only'))
 OR (regexp_matches(line, '^\s*(\* )?\[([^\]]+)\]\([^)]*\)\s*$') AND regexp_extract(line, '\[([^\]]+)\]\(([^)]*)\)', 1) = regexp_extract(line, '\[([^\]]+)\]\(([^)]*)\)', 2))"""

_NL = "chr(10) || chr(10)"
_CHUNKS = rf"""{_SECTIONS},
para AS (SELECT doc_id, n, list_filter(list_transform(string_split(text, {_NL}), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM sections WHERE tokens > 400),
f(doc_id, n, i, win, size, done) AS (SELECT doc_id, n, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM para UNION ALL
  SELECT doc_id, n, i, CASE WHEN win IS NULL THEN p WHEN NOT fits THEN CASE WHEN regexp_replace(right(win, 256), '\s', '', 'g') <> '' THEN right(win, 256) || {_NL} || p ELSE p END ELSE win || {_NL} || p END,
    CASE WHEN win IS NULL OR fits THEN size ELSE least(length(win), 256) END + length(p) + 2, CASE WHEN NOT fits THEN win END
  FROM (SELECT f.doc_id, f.n, f.i + 1 AS i, f.win, f.size, para.ps[f.i + 1] AS p, f.win IS NULL OR f.size + length(para.ps[f.i + 1]) + 2 <= 1600 AS fits FROM f JOIN para USING (doc_id, n) WHERE f.i < len(para.ps))),
win AS (SELECT doc_id, n, i, done AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT f.doc_id, f.n, f.i + 1, f.win FROM f JOIN para USING (doc_id, n) WHERE f.i = len(ps)),
c(doc_id, n, pend, ppath, ptok, flushed, fpath, own) AS (SELECT DISTINCT doc_id, CAST(-1 AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0 FROM sections UNION ALL
  SELECT doc_id, n, CASE WHEN waits THEN j END, CASE WHEN waits THEN first_path END, CASE WHEN waits THEN ptok + t ELSE 0 END, CASE WHEN t > 400 THEN pend WHEN t < 120 THEN CASE WHEN NOT waits THEN j END WHEN merges THEN j ELSE pend END, first_path, CASE WHEN t > 400 THEN 2 WHEN t < 120 OR merges THEN 0 ELSE 1 END
  FROM (SELECT c.doc_id, s.n, c.pend, c.ptok, s.tokens AS t, coalesce(c.pend || {_NL}, '') || s.text AS j, CASE WHEN c.pend IS NULL THEN s.path ELSE c.ppath END AS first_path, s.tokens < 120 AND c.ptok + s.tokens < 120 AS waits, c.pend IS NOT NULL AND c.ptok + s.tokens <= 400 AS merges
    FROM c JOIN sections s ON s.doc_id = c.doc_id AND s.n = c.n + 1)),
parts AS (SELECT doc_id, n, 0 AS k, CAST(0 AS BIGINT) AS i, flushed AS text, fpath AS path FROM c WHERE flushed IS NOT NULL UNION ALL SELECT c.doc_id, c.n, 1, 0, s.text, s.path FROM c JOIN sections s USING (doc_id, n) WHERE own = 1
  UNION ALL SELECT c.doc_id, c.n, 1, w.i, w.text, s.path FROM c JOIN sections s USING (doc_id, n) JOIN win w USING (doc_id, n) WHERE own = 2
  UNION ALL SELECT doc_id, n, 2, 0, pend, ppath FROM c WHERE pend IS NOT NULL AND (doc_id, n) IN (SELECT doc_id, max(n) FROM sections GROUP BY doc_id)),
chunks AS (SELECT doc_id, text, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k, i) - 1 AS INTEGER) AS chunk_index FROM parts)"""

_RENDER = "html"
for _pattern, _to in (
    *[(rf"(?is)<{t}\b.*?</{t}>", "") for t in ("nav", "script", "style", "noscript", "iframe")],
    *[(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "NL" + "#" * n + r" \1NL") for n in (1, 2, 3)],
    (r"(?is)<a\b[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>", r"[\2](\1)"), (r"(?is)<li[^>]*>", "BR* "), (r"(?is)<br\s*/?>", "BR"),
    (r"(?is)</?(p|div|article|footer|ul|ol|body|html|head)\b[^>]*>", "NL"), (r"(?s)<[^>]+>", ""),
):
    _new = "'" + _to.replace("NL", "' || chr(10) || chr(10) || '").replace("BR", "' || chr(10) || '") + "'"
    _RENDER = f"regexp_replace({_RENDER}, '{_pattern}', {_new}, 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _RENDER = f"replace({_RENDER}, '{_a}', '{_b}')"

ORACLE_SQL = {
    "html_markdown": rf"SELECT page_id, md5(regexp_replace(regexp_replace({_RENDER}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS md_md5 FROM pages",
    "build_chunks": f"""WITH RECURSIVE {_CHUNKS} SELECT printf('%016d_%04d', doc_id, chunk_index) AS chunk_id, printf('%016d', doc_id) AS document_id, chunk_index, (['faculty','course','research','news','about','general'])[CAST(doc_id % 6 AS INTEGER) + 1] AS page_type, path, substr(sha256(text), 1, 16) AS content_hash, CAST(length(text) // 4 AS INTEGER) AS token_count FROM chunks""",
    "chunk_stats": f"""WITH RECURSIVE {_CHUNKS}, g AS (SELECT d.doc_id, nullif(count(c.doc_id), 0) AS n FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id) SELECT count(n) AS processed, count(*) FILTER (n IS NULL) AS skipped, CAST(sum(n) AS BIGINT) AS total_chunks, max(n) AS most_chunks FROM g""",
    "url_identity": rf"""WITH p AS ({_PARTS}), c AS (SELECT *, 'https://' || netloc || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS canonical, lower(netloc) || '/' || CASE WHEN trim(path, '/') = '' THEN 'index' ELSE trim(path, '/') END AS k FROM p)
SELECT page_id, canonical, substr(sha256(canonical), 1, 16) AS doc_id, substr(sha256(url), 1, 16) AS raw_id, k || CASE WHEN k LIKE '%.md' THEN '' ELSE '.md' END AS object_key, regexp_replace(k || CASE WHEN k LIKE '%.md' THEN '' ELSE '.md' END, '\.md$', '.meta.json') AS sidecar_key FROM c""",
    "host_filter": f"""WITH p AS ({_PARTS}) SELECT page_id, netloc AS host, (netloc IN ('example.com', 'example.org') OR netloc LIKE '%.example.com' OR netloc LIKE '%.example.org') AND NOT (netloc IN ('spam-farm.example.org', 'login.example.com') OR netloc LIKE '%.spam-farm.example.org' OR netloc LIKE '%.login.example.com') AS allowed FROM p""",
    "blocked_path": f"""WITH p AS ({_PARTS}) SELECT page_id, path LIKE '/es/%' OR path LIKE '/drafts/%' OR path LIKE '/preview.html%' AS blocked FROM p""",
    "document_url": rf"""WITH l AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ftp://' WHEN 1 THEN '' WHEN 2 THEN 'https:///' WHEN 3 THEN 'mailto:' WHEN 4 THEN 'HTTP://' ELSE 'https://' END || regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') || ({list(_ENDS)})[CAST(page_id % {len(_ENDS)} AS INTEGER) + 1] AS u FROM pages),
p AS (SELECT page_id, u, page_id % 7 AS k, regexp_extract(u, '^([^?#]*)', 1) AS t FROM l)
SELECT page_id, k NOT IN (0, 3) AND regexp_matches(lower(t), '\.(pdf|docx?)$') AS is_document, k IN (4, 5, 6) AS safe, CASE WHEN k IN (2, 3, 4, 5, 6) THEN u ELSE '#' END AS link,
  array_to_string(list_transform(string_split(regexp_replace(regexp_replace(string_split(regexp_replace(t, '/+$', ''), '/')[-1], '\.[A-Za-z0-9]+$', ''), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM p""",
    "page_type": f"""WITH {MARKDOWN} SELECT doc_id, CASE WHEN lower(url) LIKE '%/people/%' OR lower(url) LIKE '%faculty%' THEN 'faculty' WHEN lower(url) LIKE '%/course%' OR lower(url) LIKE '%/classes/%' THEN 'course' WHEN lower(url) LIKE '%/research/%' OR lower(url) LIKE '%/labs/%' THEN 'research'
WHEN lower(url) LIKE '%/news/%' OR lower(url) LIKE '%/events/%' THEN 'news' WHEN lower(url) LIKE '%/about%' OR lower(url) LIKE '%/info%' THEN 'about' ELSE 'general' END AS page_type FROM mdd""",
    "crawl_classify": f"WITH {CRAWL} SELECT crawl_seq, host, status FROM logged",
    "visit_status_counts": f"WITH {CRAWL} SELECT status, count(*) AS n FROM logged GROUP BY status",
    "visit_domain_counts": f"WITH {CRAWL}, g AS (SELECT host, count(*) AS n, min(crawl_seq) AS first_seq FROM logged GROUP BY host) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, first_seq) AS INTEGER) AS position FROM g",
    "crawl_counters": f"WITH {CRAWL} SELECT count(*) AS entries, count(DISTINCT host) AS hosts, count(*) FILTER (status = 'SAVED') AS pages_crawled, count(*) FILTER (status IN ('FAILED', 'SKIPPED', 'BLOCKED', 'EMPTY')) AS pages_failed, count(*) FILTER (status = 'DUPLICATE') AS pages_skipped_duplicate FROM logged",
    "incremental_new_pages": "SELECT doc_id FROM documents n WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 2 = 1 AND s.text = n.text)",
    "hash_index": "SELECT sha256(text) AS content_hash, 'u' || max(doc_id) AS url FROM documents GROUP BY text",
    "link_extract": r"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]') OR lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)', 1)) = host) AS internal, count(DISTINCT href) AS targets FROM l WHERE href <> '' GROUP BY page_id""",
    "bfs_depth": """WITH RECURSIVE e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4) SELECT node, min(depth) AS depth FROM b GROUP BY node""",
    "frontmatter_roundtrip": rf"""WITH {MARKDOWN} SELECT doc_id, url, title, '2' AS crawl_depth, substr(sha256(body), 1, 16) AS content_hash, md5(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS body_md5 FROM mdd""",
    "sections": f"WITH {_SECTIONS} SELECT doc_id, n, path, md5(text) AS text_md5, tokens FROM sections",
    "heading_paths": f"WITH {_SECTIONS} SELECT path, count(*) AS n FROM sections GROUP BY path",
    "large_section_windows": rf"""WITH RECURSIVE {MARKDOWN},
para AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps, length(body) // 4 AS t, body FROM mdd),
f(doc_id, i, win, size, done) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM para WHERE t > 400 UNION ALL
  SELECT doc_id, i, CASE WHEN win IS NULL THEN p WHEN NOT fits THEN CASE WHEN regexp_replace(right(win, 256), '\s', '', 'g') <> '' THEN right(win, 256) || chr(10) || chr(10) || p ELSE p END ELSE win || chr(10) || chr(10) || p END,
    CASE WHEN win IS NULL OR fits THEN size ELSE least(length(win), 256) END + length(p) + 2, CASE WHEN NOT fits THEN win END
  FROM (SELECT f.doc_id, f.i + 1 AS i, f.win, f.size, para.ps[f.i + 1] AS p, f.win IS NULL OR f.size + length(para.ps[f.i + 1]) + 2 <= 1600 AS fits FROM f JOIN para USING (doc_id) WHERE f.i < len(para.ps))),
o AS (SELECT doc_id, i, done AS w FROM f WHERE done IS NOT NULL UNION ALL SELECT f.doc_id, f.i + 1, f.win FROM f JOIN para USING (doc_id) WHERE f.i = len(ps) AND f.win IS NOT NULL
  UNION ALL SELECT doc_id, 0, regexp_replace(body, '^\s+|\s+$', '', 'g') FROM para WHERE t <= 400)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, CAST(length(w) AS INTEGER) AS chars, md5(w) AS text_md5 FROM o""",
    "clean_lines": f"""WITH {CHROME}, x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM pages_in), k AS (SELECT * FROM x WHERE NOT ({_CHROME_RE})) SELECT doc_id, CAST(count(*) AS INTEGER) AS n_kept, md5(string_agg(line, chr(10) ORDER BY i)) AS kept_md5 FROM k GROUP BY doc_id""",
    "clean_blocks": f"""WITH RECURSIVE {CHROME}, {_BLOCK_STEP} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_kept, md5(string_agg(line, chr(10) ORDER BY i)) AS kept_md5 FROM st JOIN li USING (doc_id, i) WHERE kept GROUP BY doc_id""",
    "collapse_blank": rf"""WITH {CHROME} SELECT doc_id, md5(regexp_replace(array_to_string(lines, chr(10)), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) AS text_md5 FROM pages_in""",
    "contact_extract": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '\[([^\]]*@[^\]]+)\]\(mailto:[^)]+\)', 1) AS a, regexp_extract_all(text, '[A-Za-z0-9_.+-]+@(?:[a-z]+\.)?example\.com') AS b, regexp_extract_all(text, '\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}') AS p FROM documents)
SELECT doc_id, array_to_string(list_filter(CASE WHEN len(a) > 0 THEN a ELSE b END, lambda x, i: list_position(CASE WHEN len(a) > 0 THEN a ELSE b END, x) = i), ',') AS emails, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS phones FROM e""",
    "error_pages": "SELECT doc_id, doc_id % 4 = 1 AS error FROM documents",
    "stale_pages": "SELECT doc_id, doc_id % 4 = 0 AND doc_id % 3 < 2 AND date '2024-06-01' - (date '2023-01-01' + CAST(doc_id % 700 AS INTEGER)) > 180 AS stale FROM documents",
}
