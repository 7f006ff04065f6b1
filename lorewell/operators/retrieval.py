"""Hybrid retrieval for batches of questions: vector and keyword search, fusion, neighbours, sources.

Points have chunk_id, document_id, chunk_index, url, title, text and embedding; questions have qid,
qtext and qvec.  Similarities are ranked after rounding to six decimals, then by chunk_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions.text import index_tokens, query_tokens, without_images
from ..shared import materialised
from .keyword_index import KeywordIndex, first_hits, question_terms
from .vector_index import BLOCK as _BLOCK
from .vector_index import VectorIndex, best_rows
from .vector_index import unit as _vectors

_HITS_OF_A_TEXT = 1000  # hits that are scored beside one copy of their text, about
_SLICE_BYTES = 16 << 20  # of the vectors in one slice of the points


def vector_topk(questions: DataFrame, points: DataFrame, k: int = RETRIEVAL.top_k) -> DataFrame:
    """(qid, chunk_id, score, v_rank): the k most similar points of each question.

    One block of questions, counted before, goes to all tasks, and the points stay where they are read.
    More are dealt into blocks and points into slices of bounded size, and each pair of them is one group,
    which answers with the k best of its slice: one plan for any number of questions, none of which goes
    to the driver.  A window keeps the best of all.  Questions and points without a vector have no part
    in it."""
    asked = questions.where(F.col("qvec").isNotNull()).select("qid", "qvec")
    stored = points.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    few = asked.limit(_BLOCK + 1).toArrow()
    if few.num_rows <= _BLOCK:
        return _best_ranked(_beside(few, asked, stored, k), k)
    size = stored.agg(F.sum(8 * F.size("embedding")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-asked.count() // _BLOCK))
    slices = max(-(-int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks), -(-size // _SLICE_BYTES))
    slice_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = stored.select("chunk_id", "embedding", slice_of("chunk_id", slices).alias("s"), every(blocks).alias("b"))
    y = asked.select("qid", "qvec", slice_of("qid", blocks).alias("b"), every(slices).alias("s"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        names = np.array(x.column("chunk_id").to_pylist(), object)
        if not len(names) or not y.num_rows:
            return pa.table({"qid": y.column("qid").slice(0, 0), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        order = np.argsort(names, kind="stable")
        names, vectors = names[order], _vectors(x.column("embedding"))[order]
        questions, found = _vectors(y.column("qvec")), []
        for i in range(0, len(questions), 128):
            found.append(best_rounded(questions[i : i + 128] @ vectors.T, k))
        top, score = (np.concatenate(c) for c in zip(*found, strict=True))
        asked = y.column("qid").take(pa.array(np.repeat(np.arange(y.num_rows), top.shape[1])))
        return pa.table({"qid": asked, "chunk_id": pa.array(names[top.ravel()], pa.string()), "score": score.ravel()})

    return _best_ranked(x.groupBy("s", "b").cogroup(y.groupBy("s", "b")).applyInArrow(best, f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id string, score double"), k)


def best_rounded(score: np.ndarray, k: int, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rounded scores of the k best of each row by rounded score; of equal ones the first column.  Only what
    may round to one of the k best is rounded and sorted."""
    if score.shape[1] <= 4 * k:
        return best_rows(np.round(score, digits), None, k)
    least = np.partition(score, -k, axis=1)[:, -k] - 2 * 10.0**-digits
    row, column = np.nonzero(score >= least[:, None])
    rounded = np.round(score[row, column], digits)
    order = np.lexsort((column, -rounded, row))
    first = np.searchsorted(row, np.arange(len(score)))[:, None] + np.arange(k)  # row ascends, so order keeps each row's places
    return column[order][first], rounded[order][first]


def _best_ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("v_rank", F.row_number().over(order)).filter(F.col("v_rank") <= k)


def _beside(block: pa.Table, asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score): the k best points of each batch for each question of a block."""
    ids, vectors = block.column("qid").combine_chunks(), _vectors(block.column("qvec"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.compute.sort_indices(b.column("chunk_id")))
            if not b.num_rows or not len(vectors):
                continue
            rows = _vectors(b.column("embedding"))
            for i in range(0, len(vectors), 128):
                top, score = best_rounded(vectors[i : i + 128] @ rows.T, k)
                who = np.repeat(np.arange(i, i + len(top)), top.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), b.column("chunk_id").take(pa.array(top.ravel())), pa.array(score.ravel())], names=["qid", "chunk_id", "score"])

    return stored.mapInArrow(ranked, f"qid {asked.schema['qid'].dataType.simpleString()}, chunk_id string, score double")


def postings(points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(token, key): the inverted index of the points' texts, one row a distinct token."""
    return points.select(F.col(key), F.explode(index_tokens(F.col("text"))).alias("token")).select("token", key)


def keyword_search(questions: DataFrame, points: DataFrame, limit: int | None = RETRIEVAL.keyword_limit, index: DataFrame | KeywordIndex | None = None) -> DataFrame:
    """(qid, chunk_id, matches, k_rank).  A point is a candidate if it has all index tokens of one of
    the question's tokens; the first `limit` candidates by chunk_id are scored by the number of
    question tokens that their text contains, and ranked by that.  index: a stored index, or postings;
    without one all points are tokenised."""
    if isinstance(index, KeywordIndex):
        return _by_matches(index.candidates(questions, limit), questions, points)
    index = postings(points) if index is None else index
    return _by_matches(first_hits(question_terms(questions), index.withColumnRenamed("chunk_id", "k"), limit).withColumnRenamed("k", "chunk_id"), questions, points)


def _by_matches(hits: DataFrame, questions: DataFrame, points: DataFrame) -> DataFrame:
    """The hits with what they match.  The first points by chunk_id are hits of very many questions: the text of one
    goes out in as many copies as its hits are dealt into, and no further than to the join that reads it."""
    hits = materialised(hits, "candidates")
    asked = questions.select("qid", F.transform(query_tokens(F.col("qtext")), F.lower).alias("low"))
    copies = hits.groupBy("chunk_id").agg(F.ceil(F.count(F.lit(1)) / _HITS_OF_A_TEXT).cast("int").alias("copies"))
    texts = points.select("chunk_id", "text").join(copies, "chunk_id").select("chunk_id", F.lower("text").alias("text"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    rows = hits.join(asked, "qid").join(copies, "chunk_id").withColumn("copy", F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be put together
    scored = rows.repartition(tasks, "chunk_id", "copy").join(texts.repartition(tasks, "chunk_id", "copy"), ["chunk_id", "copy"])
    scored = scored.select("qid", "chunk_id", F.size(F.filter("low", lambda t: F.contains(F.col("text"), t))).alias("matches"))
    order = Window.partitionBy("qid").orderBy(F.desc("matches"), "chunk_id")
    return scored.withColumn("k_rank", F.row_number().over(order))


def rrf_fuse(vector: DataFrame, keyword: DataFrame, k: int = RETRIEVAL.rrf_k, top_k: int = RETRIEVAL.top_k, min_score: float = RETRIEVAL.min_rrf_score) -> DataFrame:
    """(qid, chunk_id, score, rank, from_vector): reciprocal rank fusion, cut to top_k, then filtered."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = vector.select("qid", "chunk_id", "v_rank").join(keyword.select("qid", "chunk_id", "k_rank"), ["qid", "chunk_id"], "full")
    both = both.withColumn("score", part("v_rank") + part("k_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("v_rank").isNull(), F.coalesce("v_rank", "k_rank"))
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.filter(F.col("score") >= min_score).select("qid", "chunk_id", "score", "rank", F.col("v_rank").isNotNull().alias("from_vector"))


def adjacent_chunks(hits: DataFrame, points: DataFrame, window: int = RETRIEVAL.adjacent_window) -> DataFrame:
    """(qid, chunk_id): neighbours within `window` of the hits that come from the vector list, without
    chunks that are hits already.  The band is spelled out, so the join is an equi-join."""
    place = points.select("chunk_id", "document_id", "chunk_index")
    near = hits.filter("from_vector").join(place, "chunk_id").select("qid", "document_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("chunk_index"))
    found = near.distinct().join(place, ["document_id", "chunk_index"]).select("qid", "chunk_id")
    return found.join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


def hybrid_search(questions: DataFrame, points: DataFrame, top_k: int = RETRIEVAL.top_k, min_score: float = RETRIEVAL.min_score, rrf_k: int = RETRIEVAL.rrf_k, min_rrf_score: float = RETRIEVAL.min_rrf_score, keyword_index: KeywordIndex | None = None, vector_index: VectorIndex | None = None) -> DataFrame:
    """(qid, position, chunk_id, score, from_vector, adjacent).

    With keyword hits the two lists are fused and min_score isn't applied; without, the vector list is
    cut at min_score.  Neighbours follow with score 0.  The two lists are put one under the other and
    grouped; the hits, a few a question, are written once, as they are read for the neighbours too.
    With stored indexes neither all vectors nor all texts are read."""
    none = lambda kind: F.lit(None).cast(kind)
    nearest = vector_topk(questions, points, top_k) if vector_index is None else vector_index.search(questions, top_k)
    vector = nearest.select("qid", "chunk_id", "score", "v_rank", none("int").alias("k_rank"))
    keyword = keyword_search(questions, points, index=keyword_index).select("qid", "chunk_id", none("double").alias("score"), none("int").alias("v_rank"), "k_rank")
    both = vector.unionByName(keyword).groupBy("qid", "chunk_id").agg(F.max("score").alias("s"), F.max("v_rank").alias("v_rank"), F.max("k_rank").alias("k_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    fused = F.max(F.col("k_rank").isNotNull()).over(Window.partitionBy("qid"))
    rows = both.withColumn("fused", fused).withColumn("score", F.when(F.col("fused"), part("v_rank") + part("k_rank")).otherwise(F.col("s")))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("fused"), -F.col("score")).otherwise(F.col("v_rank")), F.col("v_rank").isNull(), F.coalesce("v_rank", "k_rank"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= top_k) & (F.col("score") >= F.when(F.col("fused"), min_rrf_score).otherwise(min_score)))
    hits = materialised(ranked.select("qid", "chunk_id", "score", "rank", F.col("v_rank").isNotNull().alias("from_vector")), "hits")
    near = adjacent_chunks(hits, points).withColumn("rank", F.lit(top_k) + F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")))
    return hits.withColumn("adjacent", F.lit(False)).unionByName(near.select("qid", "chunk_id", F.lit(0.0).alias("score"), "rank", F.lit(True).alias("from_vector"), F.lit(True).alias("adjacent"))).withColumnRenamed("rank", "position")


def dedup_sources(found: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, url, title, score, source_rank): the best score of each URL among the chunks that came
    from vectors, the first of equals, by falling score."""
    rows = found.filter(F.coalesce("from_vector", F.lit(True))).join(points.select("chunk_id", "url", "title"), "chunk_id")
    best = rows.groupBy("qid", "url").agg(F.max_by(F.struct("score", "position", "title"), F.struct("score", -F.col("position"))).alias("b"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "position")
    return best.select("qid", "url", "b.*").withColumn("source_rank", F.row_number().over(order)).select("qid", "url", "title", "score", "source_rank")


def context_block(found: DataFrame, points: DataFrame) -> DataFrame:
    """(qid, n_chunks, context): the numbered chunk texts that a prompt gets, in order."""
    rows = found.filter(F.coalesce("from_vector", F.lit(True))).join(points.select("chunk_id", "url", "title", "text"), "chunk_id")
    ordered = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", "title", "url", "text"))).alias("c"))  # a few chunks a question
    part = lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["title"], F.lit("Untitled")), F.lit(" — "), F.coalesce(x["url"], F.lit("")), F.lit("\n"), without_images(x["text"]))
    return ordered.select("qid", F.size("c").alias("n_chunks"), F.array_join(F.transform("c", part), "\n\n---\n\n").alias("context"))


def embed_context(title: Column, headings: Column, text: Column) -> Column:
    """What is embedded of a chunk: title, section and path lines, a blank line, the text."""
    some = F.size(headings) > 0
    section = F.when(some, F.concat(F.lit("Section: "), F.element_at(headings, -1)))
    path = F.when(some, F.concat(F.lit("Path: "), F.array_join(headings, " > ")))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), section, path, F.lit(""), text)
