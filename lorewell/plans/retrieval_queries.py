"""Queries of retrieval: vectors, keywords, fusion, neighbours, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import STOP_WORDS
from ..functions.ids import point_id
from ..functions.text import query_tokens
from ..operators import index, retrieval
from ..operators.keyword_index import KeywordIndex
from ..operators.point_store import PointStore
from ..operators.vector_index import VectorIndex, recall
from ..shared import own_folder
from .derivations import POINTS, QUESTIONS, points, questions, table


def _search(spark, d):
    q, p = questions(spark, d), points(spark, d)
    return q, p, retrieval.hybrid_search(q, p)


def vector_topk(spark, d):
    q, p = questions(spark, d), points(spark, d)
    return retrieval.vector_topk(q, p).select("qid", "chunk_id", F.round("score", 6).alias("score"), "v_rank")


def vector_min_score(spark, d):
    return vector_topk(spark, d).filter("score >= 0.2")


def query_token_rows(spark, d):
    return questions(spark, d).select("qid", F.array_join(query_tokens(F.col("qtext")), " ").alias("tokens"))


def posting_counts(spark, d):
    return retrieval.postings(table(spark, d, "documents").withColumn("chunk_id", F.col("doc_id"))).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.min("chunk_id").alias("first_doc"))


def keyword_rows(spark, d):
    q, p = questions(spark, d), points(spark, d)
    return retrieval.keyword_search(q, p)


def rrf_rows(spark, d):
    q, p = questions(spark, d), points(spark, d)
    return retrieval.rrf_fuse(retrieval.vector_topk(q, p), retrieval.keyword_search(q, p)).withColumn("score", F.round("score", 9))


def adjacent_rows(spark, d):
    q, p = questions(spark, d), points(spark, d)
    hits = retrieval.vector_topk(q, p).withColumn("from_vector", F.lit(True))
    return retrieval.adjacent_chunks(hits, p)


def hybrid_search(spark, d):
    _, _, found = _search(spark, d)
    return found.withColumn("score", F.round("score", 9)).select("qid", "position", "chunk_id", "score", "from_vector", "adjacent")


def source_rows(spark, d):
    _, p, found = _search(spark, d)
    return retrieval.dedup_sources(found, p).withColumn("score", F.round("score", 9))


def context_rows(spark, d):
    _, p, found = _search(spark, d)
    return retrieval.context_block(found, p).select("qid", "n_chunks", F.md5("context").alias("context_md5"))


def point_uuid(spark, d):
    return points(spark, d).select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


def embed_context(spark, d):
    heads = F.when(F.col("chunk_index") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Top"), F.concat(F.lit("Part "), F.col("chunk_index").cast("string"))))
    return points(spark, d).select("chunk_id", F.md5(retrieval.embed_context(F.col("title"), heads, F.col("text"))).alias("context_md5"))


def _blanked(spark, d):
    blank = lambda c, k: F.when(F.col("vec_id") % k == 0, "").otherwise(F.col(c)).alias(c)
    return points(spark, d).select("vec_id", blank("chunk_id", 7), blank("document_id", 11), F.when(F.col("vec_id") % 13 == 0, " \t\n").otherwise(F.col("text")).alias("text"), blank("url", 17), blank("title", 3))


def chunk_validation(spark, d):
    return index.validated(_blanked(spark, d)).select("vec_id", "reason", "title")


def _old_new(spark, d):
    p = points(spark, d).select("document_id", point_id(F.col("chunk_id")).alias("point_id"), "vec_id", F.octet_length("text").alias("size"))
    old, new = p.filter("vec_id % 3 <> 0").withColumn("version", F.lit(1)), p.filter("vec_id % 2 = 0 OR vec_id % 3 = 0").withColumn("version", F.lit(2))
    return old, new


def upsert_points(spark, d):
    old, new = _old_new(spark, d)
    return index.upsert(old, new).select("point_id", "vec_id", "version")


def stale_points(spark, d):
    old, new = _old_new(spark, d)
    return index.stale_points(old, new).select("point_id", "vec_id")


def _vector_index(spark, d):
    """An index of all embeddings, and as questions every row whose number is divisible by 20."""
    rows = table(spark, d, "embeddings").select(F.format_string("%016d", "vec_id").alias("chunk_id"), "embedding")
    asked = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return VectorIndex.build(rows, own_folder(spark, "vectors")), asked, rows


def ann_topk(spark, d):
    index, asked, _ = _vector_index(spark, d)
    return index.search(asked).select("qid", F.col("chunk_id").cast("long").alias("vec_id"), "score", "v_rank")


def ann_recall(spark, d):
    """The index's rows held against the exact search over all rows."""
    index, asked, rows = _vector_index(spark, d)
    return recall(index.search(asked), retrieval.vector_topk(asked, rows)).select("questions", "wanted", (F.col("recall") >= 0.9).alias("reached"))


def indexed_search(spark, d):
    """hybrid_search by a stored keyword index that was written in two parts, the second of which replaces some of the
    first, and after deletes."""
    q, p = questions(spark, d), points(spark, d)
    stored = KeywordIndex(spark, own_folder(spark, "keywords"))
    stored.upsert(p.withColumn("text", F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("old words "), "text")).otherwise(F.col("text"))))
    stored.upsert(p.filter("vec_id % 3 = 0"))
    stored.delete(p.filter("vec_id % 7 = 3"))
    live = p.filter("vec_id % 7 <> 3")
    found = retrieval.hybrid_search(q, live, keyword_index=stored)
    return found.withColumn("score", F.round("score", 9)).select("qid", "position", "chunk_id", "score", "from_vector", "adjacent")


def point_store(spark, d):
    """All points, then pages with an even number anew in fewer chunks, the stale ones gone, and the store compacted."""
    p = points(spark, d).select(point_id(F.col("chunk_id")).alias("point_id"), "document_id", "chunk_index", "vec_id", F.lit(1).alias("version"))
    store = PointStore(spark, own_folder(spark, "points"))
    store.upsert(p)
    now = p.filter((F.floor(F.col("vec_id") / 5) % 2 == 0) & (F.col("chunk_index") < 3)).withColumn("version", F.lit(2))
    store.upsert(now)
    store.remove_stale(now)
    store.compact()
    return store.read().select("point_id", "vec_id", "version")


def hash_embed(spark, d):
    embed = index.hash_embedder()
    v = table(spark, d, "documents").select("doc_id", embed("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm"))


QUERIES = {
    "vector_topk": vector_topk, "vector_min_score": vector_min_score, "query_tokens": query_token_rows, "postings": posting_counts, "keyword_search": keyword_rows, "rrf_fuse": rrf_rows, "adjacent_chunks": adjacent_rows,
    "hybrid_search": hybrid_search, "dedup_sources": source_rows, "context_block": context_rows, "point_uuid": point_uuid, "embed_context": embed_context, "chunk_validation": chunk_validation,
    "upsert_points": upsert_points, "stale_points": stale_points, "hash_embed": hash_embed, "ann_topk": ann_topk, "ann_recall": ann_recall, "indexed_search": indexed_search, "point_store": point_store,
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOKENS = rf"""tok AS (SELECT qid, list_filter(list_transform(list_filter(regexp_extract_all(qtext, '[^\s]+'), lambda t: length(t) >= 2), lambda t: regexp_replace(t, '[?.,;:!]+$', '')), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, lower(t))) AS ts FROM qry)"""
_VECTOR = """vs AS (SELECT qid, chunk_id, round(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM qry, pts),
v AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS v_rank FROM vs) WHERE v_rank <= 5)"""
_KEYWORD = r"""post AS (SELECT chunk_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) BETWEEN 2 AND 20)) AS words, lower(text) AS low FROM pts),
one AS (SELECT qid, n, list_distinct(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda x: length(x) BETWEEN 2 AND 20)) AS parts FROM (SELECT qid, unnest(ts) AS t, generate_subscripts(ts, 1) AS n FROM tok)),
cand AS (SELECT DISTINCT qid, chunk_id FROM one JOIN post ON len(parts) > 0 AND list_has_all(words, parts)),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS r FROM cand) WHERE r <= 10),
kw AS (SELECT qid, chunk_id, CAST(len(list_filter(ts, lambda t: contains(low, lower(t)))) AS INTEGER) AS matches FROM lim JOIN tok USING (qid) JOIN post USING (chunk_id)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY matches DESC, chunk_id) AS INTEGER) AS k_rank FROM kw)"""
_FUSED = """f0 AS (SELECT qid, chunk_id, coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + k_rank), 0) AS score, v_rank, k_rank FROM v FULL JOIN k USING (qid, chunk_id)),
f AS (SELECT qid, chunk_id, score, rank, v_rank IS NOT NULL AS from_vector FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, v_rank IS NULL, coalesce(v_rank, k_rank)) AS INTEGER) AS rank FROM f0) WHERE rank <= 5 AND score >= 0)"""
_FOUND = """hits AS (SELECT qid, chunk_id, score, rank, from_vector FROM f WHERE qid IN (SELECT qid FROM k) UNION ALL SELECT qid, chunk_id, score, v_rank, true FROM v WHERE qid NOT IN (SELECT qid FROM k) AND score >= 0.53),
near AS (SELECT DISTINCT h.qid, n.chunk_id FROM hits h JOIN pts p ON p.chunk_id = h.chunk_id JOIN pts n ON n.document_id = p.document_id AND abs(n.chunk_index - p.chunk_index) <= 2
  WHERE h.from_vector AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.qid = h.qid AND x.chunk_id = n.chunk_id)),
found AS (SELECT qid, rank AS position, chunk_id, score, from_vector, false AS adjacent FROM hits UNION ALL SELECT qid, CAST(5 + row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS INTEGER), chunk_id, 0.0, true, true FROM near)"""
_BASE = f"WITH {POINTS}, {QUESTIONS}"
_ALL = f"{_BASE}, {_TOKENS}, {_VECTOR}, {_KEYWORD}, {_FUSED}, {_FOUND}"
_POINT_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_IDS = f"ids AS (SELECT *, {_POINT_ID} AS point_id FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM pts))"

ORACLE_SQL = {
    "vector_topk": f"{_BASE}, {_VECTOR} SELECT * FROM v",
    "vector_min_score": f"{_BASE}, {_VECTOR} SELECT * FROM v WHERE score >= 0.2",
    "query_tokens": f"{_BASE}, {_TOKENS} SELECT qid, array_to_string(ts, ' ') AS tokens FROM tok",
    "postings": r"SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) BETWEEN 2 AND 20))) AS token FROM documents) GROUP BY token",
    "keyword_search": f"{_BASE}, {_TOKENS}, {_KEYWORD} SELECT * FROM k",
    "rrf_fuse": f"{_BASE}, {_TOKENS}, {_VECTOR}, {_KEYWORD}, {_FUSED} SELECT qid, chunk_id, round(score, 9) AS score, rank, from_vector FROM f",
    "adjacent_chunks": f"""{_BASE}, {_VECTOR} SELECT DISTINCT v.qid, n.chunk_id FROM v JOIN pts p USING (chunk_id) JOIN pts n ON n.document_id = p.document_id AND abs(n.chunk_index - p.chunk_index) <= 2 WHERE (v.qid, n.chunk_id) NOT IN (SELECT qid, chunk_id FROM v)""",
    "hybrid_search": f"{_ALL} SELECT qid, position, chunk_id, round(score, 9) AS score, from_vector, adjacent FROM found",
    "dedup_sources": f"""{_ALL}, s AS (SELECT qid, url, title, score, position FROM (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY score DESC, position) AS r FROM found JOIN pts USING (chunk_id) WHERE from_vector) WHERE r = 1)
SELECT qid, url, title, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS INTEGER) AS source_rank FROM s""",
    "context_block": rf"""{_ALL}, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) AS i FROM found JOIN pts USING (chunk_id) WHERE from_vector)
SELECT qid, CAST(count(*) AS INTEGER) AS n_chunks, md5(string_agg('[Source ' || i || '] ' || title || ' — ' || url || chr(10) || regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), 'data:[a-zA-Z0-9+/;=,\s]{{20,}}', '', 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM c GROUP BY qid""",
    "point_uuid": f"WITH {POINTS}, {_IDS} SELECT chunk_id, point_id FROM ids",
    "embed_context": f"""WITH {POINTS} SELECT chunk_id, md5('Title: ' || title || chr(10) || CASE WHEN chunk_index = 0 THEN '' ELSE 'Section: Part ' || chunk_index || chr(10) || 'Path: Top > Part ' || chunk_index || chr(10) END || chr(10) || text) AS context_md5 FROM pts""",
    "chunk_validation": f"""WITH {POINTS} SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing chunk_id' WHEN vec_id % 11 = 0 THEN 'missing document_id' WHEN vec_id % 13 = 0 OR regexp_replace(text, '\\s', '', 'g') = '' THEN 'empty text' WHEN vec_id % 17 = 0 THEN 'missing url' END AS reason, CASE WHEN vec_id % 3 = 0 THEN 'Untitled' ELSE title END AS title FROM pts""",
    "ann_recall": "SELECT count(*) AS questions, 5 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
    "indexed_search": f"WITH {POINTS.replace('pts AS', 'allpts AS', 1)}, {QUESTIONS.replace('FROM pts', 'FROM allpts')}, pts AS (SELECT * FROM allpts WHERE vec_id % 7 <> 3), {_TOKENS}, {_VECTOR}, {_KEYWORD}, {_FUSED}, {_FOUND} SELECT qid, position, chunk_id, round(score, 9) AS score, from_vector, adjacent FROM found",
    "point_store": f"WITH {POINTS}, {_IDS} SELECT point_id, vec_id, CASE WHEN (vec_id // 5) % 2 = 0 THEN 2 ELSE 1 END AS version FROM ids WHERE (vec_id // 5) % 2 = 1 OR chunk_index < 3",
    "upsert_points": f"WITH {POINTS}, {_IDS} SELECT point_id, vec_id, CASE WHEN vec_id % 2 = 0 OR vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM ids",
    "stale_points": f"WITH {POINTS}, {_IDS} SELECT point_id, vec_id FROM ids o WHERE vec_id % 3 <> 0 AND vec_id % 2 <> 0 AND EXISTS (SELECT 1 FROM ids n WHERE n.document_id = o.document_id AND (n.vec_id % 2 = 0 OR n.vec_id % 3 = 0))",
}
