"""Crawl outcomes: predicates on URLs, ordered classification, visit log, links, breadth-first depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALLOWED_DOMAINS, BLOCKED_DOMAINS, BLOCKED_PATHS
from ..functions.ids import url_part
from ..shared import materialised, own_folder, with_rank


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def host_in(host: Column, domains=ALLOWED_DOMAINS) -> Column:
    """Whether a host is one of the domains or below one; null and empty hosts aren't."""
    return F.coalesce((host != "") & _any([(host == d) | host.endswith(f".{d}") for d in domains]), F.lit(False))


def host_allowed(host: Column, allowed=ALLOWED_DOMAINS, blocked=BLOCKED_DOMAINS) -> Column:
    return host_in(host, allowed) & ~host_in(host, blocked)


def path_blocked(url: Column, prefixes=BLOCKED_PATHS) -> Column:
    path = url_part(url, "path")
    return _any([path.startswith(p) for p in prefixes])


def is_document_url(url: Column) -> Column:
    """PDF and word-processor files, by the extension of the path; http, https or no scheme."""
    return url_part(url, "scheme").isin("", "http", "https") & F.lower(url_part(url, "path")).rlike(r"\.(pdf|docx?)$")


def is_safe_document_url(url: Column) -> Column:
    return url_part(url, "scheme").isin("http", "https") & (url_part(url, "host") != "")


def classified(results: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Crawl results (crawl_seq, url, success, markdown) with host and status, in order of precedence:
    FAILED, SKIPPED (scheme), BLOCKED (path, host), EMPTY, DUPLICATE (content of an earlier page that
    got so far, or of `seen`, a table of content_hash), SAVED."""
    rows = results.withColumns({"host": url_part(F.col("url"), "host"), "content_hash": F.sha2("markdown", 256)})
    early = (
        F.when(~F.col("success"), "FAILED")
        .when(~url_part(F.col("url"), "scheme").isin("http", "https"), "SKIPPED")
        .when(path_blocked(F.col("url")) | ~host_allowed(F.col("host")), "BLOCKED")
        .when(F.col("markdown").isNull() | (F.col("markdown") == ""), "EMPTY")
    )
    rows = rows.withColumn("early", early)
    # only rows that got so far share a hash; the others each stand alone, so no null key is hot
    key = F.when(F.col("early").isNull(), F.col("content_hash")).otherwise(F.concat(F.lit("#"), F.col("crawl_seq").cast("string")))
    order = F.row_number().over(Window.partitionBy("_k").orderBy("crawl_seq"))
    rows = rows.withColumn("_k", key).withColumn("_n", order)
    known = F.lit(False)
    if seen is not None:
        rows = rows.join(seen.select(F.col("content_hash").alias("_k")).distinct().withColumn("_s", F.lit(True)), "_k", "left")
        known = F.col("_s").isNotNull()
    status = F.coalesce(F.col("early"), F.when(known | (F.col("_n") > 1), "DUPLICATE").otherwise("SAVED"))
    return rows.withColumn("status", status).drop("_k", "_n", "_s", "early")


def new_pages(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages whose content isn't stored yet."""
    return pages.join(seen.select("content_hash"), "content_hash", "left_anti")


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def host_counts(log: DataFrame) -> DataFrame:
    """Visits by host, most first, ties in order of first visit."""
    host = F.coalesce(F.nullif("host", F.lit("")), F.lit("unknown")).alias("host")
    counts = log.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.min("crawl_seq").alias("first_seq"))
    return with_rank(counts, F.desc("n"), F.col("first_seq"))


def crawl_counters(log: DataFrame) -> DataFrame:
    is_in = lambda *s: F.count_if(F.col("status").isin(*s))
    return log.agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("host").alias("hosts"), is_in("SAVED").alias("pages_crawled"), is_in("FAILED", "SKIPPED", "BLOCKED", "EMPTY").alias("pages_failed"), is_in("DUPLICATE").alias("pages_skipped_duplicate")
    )


def links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """(page_id, href, internal): non-empty link targets of a page, absolute or on its own host."""
    found = pages.select("page_id", base, F.explode(F.regexp_extract_all(html, F.lit(r"<a[^>]*href=\"([^\"]*)\""), F.lit(1))).alias("href")).filter("href <> ''")
    own = url_part(F.col(base), "host")
    return found.select("page_id", "href", ((url_part(F.col("href"), "netloc") == "") | (url_part(F.col("href"), "host") == own)).alias("internal"))


def _levels(spark, seeds: DataFrame):
    """A folder of visited levels: write(depth, rows) and read(depths)."""
    path = own_folder(spark, "crawl")
    schema = f"{seeds.schema['node'].simpleString().replace(':', ' ')}, depth int"
    write = lambda depth, rows: rows.select("node", F.lit(depth).alias("depth")).write.parquet(f"{path}/level={depth}")
    read = lambda depths: spark.read.schema(schema).parquet(*[f"{path}/level={k}" for k in depths])
    return write, read


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """(node, depth): the least number of edges (src, dst) from a seed, up to max_depth.  A frontier
    is joined with the edges and rid of what was visited; each round is cut from its lineage by files."""
    return crawled(edges, seeds, max_depth)


def crawled(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, max_pages: int | None = None, host: Column | None = None, expands: Column | None = None) -> DataFrame:
    """(node, depth) of a breadth-first crawl that ends with the page that fills max_pages: a level is cut to
    what is left of the bound before anything of it is followed, and no level comes after that.

    Within a level hosts take turns, each with its nodes in order, so that none is asked many times in a row; without
    `host`, an expression on node, nodes come in order.  Nodes for which `expands` isn't true, such as documents that
    aren't pages, are visited but not followed."""
    spark = edges.sparkSession
    write, read = _levels(spark, seeds)
    left, depth = max_pages, 0
    frontier = seeds.select("node").filter(F.col("node").isNotNull()).distinct()
    while True:
        cut = frontier if left is None else _first_turns(frontier, left, host)
        write(depth, cut)
        found = 0 if read([depth]).isEmpty() else read([depth]).count()
        left = None if left is None else left - found
        if not found or depth == max_depth or left == 0:
            return read(range(depth + 1))
        now = read([depth])
        followed = now if expands is None else now.filter(expands)
        step = followed.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).filter(F.col("node").isNotNull()).distinct()
        frontier = step.join(read(range(depth + 1)).select("node"), "node", "left_anti")
        depth += 1


def _first_turns(frontier: DataFrame, most: int, host: Column | None) -> DataFrame:
    """The first `most` nodes of a level, hosts taking turns.  How many turns fit is told by counts by turn, so that only
    the last turn, with a node of each host at most, is ordered as a whole."""
    if most <= 0:
        return frontier.limit(0)
    if host is None:
        return frontier.orderBy("node").limit(most)
    turns = materialised(frontier.withColumn("turn", F.row_number().over(Window.partitionBy(host).orderBy("node"))), "turns")
    counts = turns.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).orderBy("turn")
    whole, last = 0, None
    for r in counts.limit(most).toLocalIterator():  # a turn has a node at least
        if whole + r["n"] > most:
            last = r["turn"]
            break
        whole += r["n"]
    if last is None:
        return turns.select("node")
    rest = turns.filter(F.col("turn") == last).orderBy("node").limit(most - whole)
    return turns.filter(F.col("turn") < last).select("node").unionByName(rest.select("node"))
