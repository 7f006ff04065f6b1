"""Inputs that the named queries derive from the tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Index points: each vector with the text of the document of its number; five chunks a page."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    page = F.floor(F.col("vec_id") / 5).cast("long")
    rows = e.join(docs, e.vec_id == docs.doc_id)
    return rows.select(
        "vec_id", F.format_string("%016d", page).alias("document_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.format_string("%016d_%04d", page, F.col("vec_id") % 5).alias("chunk_id"),
        F.concat(F.lit("https://www.example.org/"), page.cast("string")).alias("url"), F.concat(F.lit("Page "), page.cast("string")).alias("title"), "text", "embedding",
    )


POINTS = """pts AS (SELECT vec_id, printf('%016d', vec_id // 5) AS document_id, CAST(vec_id % 5 AS INTEGER) AS chunk_index, printf('%016d_%04d', vec_id // 5, vec_id % 5) AS chunk_id,
  'https://www.example.org/' || (vec_id // 5) AS url, 'Page ' || (vec_id // 5) AS title, text, embedding FROM embeddings JOIN documents ON doc_id = vec_id)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions: every point whose number is divisible by 20, asked by its first six words."""
    p = points(spark, d).filter("vec_id % 20 = 0")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return p.select(F.col("vec_id").alias("qid"), F.array_join(F.slice(words, 1, 6), " ").alias("qtext"), F.col("embedding").alias("qvec"))


QUESTIONS = r"""qry AS (SELECT vec_id AS qid, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:6], ' ') AS qtext, embedding AS qvec FROM pts WHERE vec_id % 20 = 0)"""


def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """Markdown documents: some lines of a text become headings, and lines become paragraphs."""
    kind = lambda i: (F.col("doc_id") * 7 + i) % 11
    line = lambda x, i: F.concat(F.when(kind(i) == 0, F.lit("# ")).when(kind(i) == 3, F.lit("## ")).when(kind(i) == 5, F.lit("### ")).otherwise(F.lit("")), F.when(kind(i).isin(0, 3, 5), F.left(x, F.lit(40))).otherwise(x))
    part = F.element_at(F.array(*[F.lit(x) for x in ("people", "courses", "research", "news", "about", "x")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", F.format_string("%016d", "doc_id").alias("document_id"), F.concat(F.lit("https://www.example.org/"), part, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("body"), F.lit("2024-01-01T00:00:00+00:00").alias("crawl_timestamp"),
    )


MARKDOWN = r"""mdd AS (SELECT doc_id, printf('%016d', doc_id) AS document_id, 'https://www.example.org/' || (['people','courses','research','news','about','x'])[CAST(doc_id % 6 AS INTEGER) + 1] || '/' || doc_id AS url, 'Doc ' || doc_id AS title,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (doc_id * 7 + i - 1) % 11 WHEN 0 THEN '# ' || left(x, 40) WHEN 3 THEN '## ' || left(x, 40) WHEN 5 THEN '### ' || left(x, 40) ELSE x END), chr(10) || chr(10)) AS body FROM documents)"""


def crawl_results(spark: SparkSession, d: str) -> DataFrame:
    """Crawl results: documents at URLs of which some are of another scheme, host or path."""
    i = F.col("doc_id")
    s = i.cast("string")
    url = (
        F.when(i % 13 == 0, F.concat(F.lit("ftp://files.example.com/"), s)).when(i % 11 == 0, F.concat(F.lit("https://login.example.com/"), s)).when(i % 7 == 0, F.concat(F.lit("https://www.example.net/p/"), s))
        .when(i % 5 == 0, F.concat(F.lit("https://www.example.com/es/"), s)).otherwise(F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), s))
    )
    return table(spark, d, "documents").select(i.alias("crawl_seq"), url.alias("url"), (i % 5).cast("int").alias("depth"), (i % 17 != 0).alias("success"), F.when(i % 19 == 0, "").otherwise(F.col("text")).alias("markdown"))


CRAWL = r"""crw AS (SELECT doc_id AS crawl_seq, CASE WHEN doc_id % 13 = 0 THEN 'ftp://files.example.com/' || doc_id WHEN doc_id % 11 = 0 THEN 'https://login.example.com/' || doc_id WHEN doc_id % 7 = 0 THEN 'https://www.example.net/p/' || doc_id
  WHEN doc_id % 5 = 0 THEN 'https://www.example.com/es/' || doc_id ELSE 'https://' || source || '.example.com/' || lang || '/' || doc_id END AS url, CAST(doc_id % 5 AS INTEGER) AS depth, doc_id % 17 <> 0 AS success, CASE WHEN doc_id % 19 = 0 THEN '' ELSE text END AS markdown FROM documents),
cls AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, sha256(markdown) AS content_hash,
  CASE WHEN NOT success THEN 'FAILED' WHEN url NOT LIKE 'http%' THEN 'SKIPPED' WHEN regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) LIKE '/es/%' THEN 'BLOCKED'
  WHEN NOT (regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) IN ('example.com', 'example.org') OR regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) LIKE '%.example.com' OR regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) LIKE '%.example.org') THEN 'BLOCKED'
  WHEN url LIKE 'https://login.example.com/%' THEN 'BLOCKED' WHEN markdown = '' THEN 'EMPTY' END AS early FROM crw),
logged AS (SELECT crawl_seq, url, depth, host, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, content_hash ORDER BY crawl_seq) > 1 THEN 'DUPLICATE' ELSE 'SAVED' END) AS status FROM cls)"""


_BEFORE = ("Site menu", "* [Home](https://www.example.org/)", "- [Here](#here)", "[Skip to content](#main)")
_TIPS = ("## How to search", "use short words", "# Found")
_AFTER = ("Back to top", "Print this page", "  Share this page", "![](data:image/svg+xml;base64,AA)", "Copyright 2024 Example", " Close ", "Close to here", "go [Toggle navigation] now", "[Log in] for staff only", "[Log in] please", "* [www.example.org](www.example.org)", "[a](b)", "", "", "", "", "the end")
_FOOTER = ("### Site footer and more", "beyond the footer")


def chrome_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages: a document's lines among lines of page chrome."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    i = F.col("doc_id")
    lines = F.concat(lits(_BEFORE), F.when(i % 2 == 0, lits(("# Title",))).otherwise(none), F.when(i % 3 == 0, lits(_TIPS)).otherwise(none), F.split("text", "\n"), lits(_AFTER), F.when(i % 4 == 0, lits(_FOOTER)).otherwise(none))
    return table(spark, d, "documents").select("doc_id", lines.alias("lines"))


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


CHROME = f"""pages_in AS (SELECT doc_id, list_concat({_list(_BEFORE)}, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['# Title'] ELSE [] END, list_concat(CASE WHEN doc_id % 3 = 0 THEN {_list(_TIPS)} ELSE [] END,
  list_concat(string_split(text, chr(10)), list_concat({_list(_AFTER)}, CASE WHEN doc_id % 4 = 0 THEN {_list(_FOOTER)} ELSE [] END))))) AS lines FROM documents)"""
