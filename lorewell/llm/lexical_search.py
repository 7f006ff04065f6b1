"""Ranked lexical search as a threshold-seeded join of items and documents.

A term's impact on a document is its weight times a saturated frequency (`impact`); a document's score
for an item is the sum of its terms' impacts.  Per item the `k` best documents are wanted, exactly.

1 One pass over the documents keeps, per document, its number of terms and those of the items' terms
  that it has (`postings`): a table in the shared folder, a few bytes a posting.
2 From it come N, L and df, and per term the largest and the k-th largest impact: the stored bounds.
3 An item's k-th score is at least the largest k-th impact of its terms: the seed of its threshold.
4 An item's terms are ordered by their largest impact.  A suffix of small ones whose largest impacts add up
  to less than the threshold can't lift a document to it alone: those terms don't generate candidates.
5 Each task joins its documents with the items through the other terms only, drops a pair whose sum of
  these, with the bound of the suffix, stays below the threshold, and scores what is left exactly with
  all terms.  The k best of a task are candidates of the whole, and its own k-th score raises its threshold.
6 The candidates of all tasks are ranked per item.

Bounds drop only what is strictly below a score that k documents reach, so ties at the k-th place are
all there to be ordered by id.  Documents never leave their task, and no term, however common, is a
shuffle key of its postings.  Items are taken in slices of `slice_items` items and `slice_bytes` bytes at most;
that is what the tasks get to know of them, and each slice is one pass of the above.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, compared by
64-bit hash: for v terms of the items and n terms of documents a mix-up is expected v*n/2**64 times.

Defined cases: a null or empty text has no terms; such a document isn't counted in N and such an item has
no rows; an item's repeated terms count once; items with equal ids are ranked each for itself; documents
with equal ids or texts are documents each for itself; a null doc_id, and 2**63 - 1,
which is taken for it, come after all others at equal scores; empty tables give an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import Words, pieces, runs, texts
from .support import materialised

_NOT_TERM = np.zeros(256, bool)
_NOT_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Cells of documents x items that one step of a task holds.
CELLS = 1 << 21
_NO_ID = np.iinfo(np.int64).max


def terms(column: pa.Array) -> Words:
    return Words(*texts(column), lower=True, separator=_NOT_TERM)


class Items:
    """A slice of items: ids, the distinct terms of each, and the terms of all (sorted hashes)."""

    def __init__(self, ids: list, column: pa.Array):
        words = terms(column)
        self.ids = ids
        self.vocabulary, at = np.unique(words.hash, return_inverse=True)
        pair = np.unique(words.text * max(1, len(self.vocabulary)) + at)
        self.item, self.term = np.divmod(pair, max(1, len(self.vocabulary)))


def postings(docs: DataFrame, doc: str, text: str, items: Items) -> DataFrame:
    """doc_id, n (all terms of the document), term (places in the items' vocabulary) and tf, for documents
    with a term."""
    vocabulary = items.vocabulary

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch, "t"):
                words = terms(batch.column("t").slice(a, b - a))
                at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == words.hash)
                pair, tf = np.unique(words.text[hit] * len(vocabulary) + at[hit], return_counts=True)
                row, term = np.divmod(pair, len(vocabulary))
                some = np.flatnonzero(words.count)
                cut = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").slice(a, b - a).take(pa.array(some)), pa.array(words.count[some], pa.int64()), pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "term", "tf"],
                )

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc].dataType), T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(found, schema)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of each posting, and n of each row."""
    term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
    size = np.diff(batch.column("term").offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), size), term, tf, batch.column("n").to_numpy(zero_copy_only=False)


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's frequency in a document of n terms, saturated: times the term's weight it is the impact."""
    m = 10 + (90 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _best(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group, by smallest tie among equals."""
    order = np.lexsort((tie, -value, group))
    at = runs(group[order])
    size = np.diff(np.append(at, len(order)))
    return order[np.arange(len(order)) - np.repeat(at, size) < k]


def bounds(stored: DataFrame, documents: int, length: int, n_terms: int, k: int) -> DataFrame:
    """Per term: df, and the largest and k-th largest saturated frequency (0 where fewer than k documents have it)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, term, top = np.zeros(n_terms, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            row, t, tf, n = _flat(batch)
            df += np.bincount(t, minlength=n_terms)
            term, top = np.append(term, t), np.append(top, saturated(tf, n[row], documents, length))
            kept = _best(term, top, np.zeros(len(top)), k)
            term, top = term[kept], top[kept]
        at = runs(term)
        cut = pa.array(np.append(at, len(term)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(term[at].astype(np.int32)), pa.array(df[term[at]], pa.int64()), pa.ListArray.from_arrays(cut, pa.array(top, pa.int64()))], names=["term", "df", "top"])

    found = stored.select("n", "term", "tf").mapInArrow(of_task, "term int, df long, top array<long>")
    kth = Window.partitionBy("term").orderBy(F.desc("f"))
    ranked = found.select("term", F.explode("top").alias("f")).withColumn("r", F.row_number().over(kth)).filter(F.col("r") <= k)
    tops = ranked.groupBy("term").agg(F.max("f").alias("most"), F.max(F.when(F.col("r") == k, F.col("f")).otherwise(0)).alias("kth"))
    return found.groupBy("term").agg(F.sum("df").alias("df")).join(tops, "term")


class Plan:
    """What a task needs to know: thresholds, weights, and for each term its items, as one that generates
    candidates for them or as one that only adds to the score."""

    def __init__(self, items: Items, documents: int, length: int, df: np.ndarray, most: np.ndarray, kth: np.ndarray, k: int):
        self.documents, self.length, self.k, self.n = documents, length, k, len(items.ids)
        self.weight = weight(documents, df)
        self.threshold = np.zeros(self.n, np.int64)
        np.maximum.at(self.threshold, items.item, (self.weight * kth)[items.term])
        most = (self.weight * most)[items.term]
        order = np.lexsort((most, items.item))  # each item's terms, small ones first
        at = runs(items.item[order])
        sums = np.cumsum(most[order])
        sums -= np.repeat(sums[at] - most[order][at], np.diff(np.append(at, len(order))))
        small = np.zeros(len(order), bool)
        small[order] = sums < self.threshold[items.item[order]]
        self.slack = np.zeros(self.n, np.int64)  # what the small terms can add
        np.add.at(self.slack, items.item[small], most[small])
        self.leads, self.adds = self._by_term(items, ~small, len(df)), self._by_term(items, small, len(df))

    @staticmethod
    def _by_term(items: Items, chosen: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        term, item = items.term[chosen], items.item[chosen]
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(n_terms + 1)), item[order]


def _sums(row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, by_term: tuple[np.ndarray, np.ndarray], items: int) -> np.ndarray:
    """rows x items: the impacts of postings on the items that have their terms.  Sums stay below 2**53."""
    start, item = by_term
    size = start[term + 1] - start[term]
    at = np.arange(size.sum()) + np.repeat(start[term] - (np.cumsum(size) - size), size)
    return np.bincount(np.repeat(row, size) * items + item[at], np.repeat(impact, size), rows * items).reshape(rows, items)


def scored(stored: DataFrame, plan: Plan) -> DataFrame:
    """item (its place in the slice), doc_id and score of each task's best documents."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold, item, score, doc = plan.threshold.copy(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, CELLS // max(1, plan.n))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                row, term, tf, n = _flat(batch)
                impact = plan.weight[term] * saturated(tf, n[row], plan.documents, plan.length)
                led = _sums(row, term, impact, batch.num_rows, plan.leads, plan.n)
                r, i = np.nonzero((led > 0) & (led + plan.slack >= threshold))
                if not len(r):
                    continue
                left = np.isin(row, r)
                total = led[r, i] + _sums(row[left], term[left], impact[left], batch.num_rows, plan.adds, plan.n)[r, i]
                good = total >= threshold[i]
                ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                item, score, doc = np.append(item, i[good]), np.append(score, total[good].astype(np.int64)), np.append(doc, ids[r[good]])
                kept = _best(item, score, doc, plan.k)
                item, score, doc = item[kept], score[kept], doc[kept]
                at = runs(item)
                full = np.diff(np.append(at, len(item))) == plan.k
                last = at[full] + plan.k - 1
                threshold[item[last]] = np.maximum(threshold[item[last]], score[last])
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], names=["item", "doc_id", "score"])

    return stored.mapInArrow(of_task, "item int, doc_id long, score long")


def sliced(items: DataFrame, item: str, text: str, slice_items: int, slice_bytes: int) -> Iterator[Items]:
    """The items, a bounded slice at a time."""
    ids, held, size = [], [], 0
    for r in items.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if ids and (len(ids) >= slice_items or size + len(r["t"] or "") > slice_bytes):
            yield Items(ids, pa.array(held, pa.string()))
            ids, held, size = [], [], 0
        ids.append(r["i"])
        held.append(r["t"])
        size += len(r["t"] or "")
    if ids:
        yield Items(ids, pa.array(held, pa.string()))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slice_items: int = 4000, slice_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item.  doc_id must be a whole number."""
    spark, out = docs.sparkSession, None
    kind = items.schema[item].dataType
    for part in sliced(items, item, item_text, slice_items, slice_bytes):
        if not len(part.vocabulary):
            continue
        stored = materialised(postings(docs, doc, text, part), "postings")
        documents, length = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        n_terms = len(part.vocabulary)
        known = materialised(bounds(stored, documents, length, n_terms, k), "term-bounds").toPandas()  # one row a term of the slice
        figures = np.zeros((3, n_terms), np.int64)
        figures[:, known["term"]] = known[["df", "most", "kth"]].to_numpy().T
        plan = Plan(part, documents, length, *figures, k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = scored(stored, plan).filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, v) for n, v in enumerate(part.ids)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        found = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return out


def op11_query(spark, sf_dir):
    from .support import table

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT iid, item_id, unnest(w) AS term FROM b),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM t) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY term),
s AS (SELECT q.iid, q.item_id, p.rid, p.doc_id, CAST(sum(i.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * t.n_docs) // t.n_terms)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN i USING (term) CROSS JOIN t GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
