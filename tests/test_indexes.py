"""Stored indexes against searches that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import retrieval
from lorewell.operators.keyword_index import KeywordIndex
from lorewell.operators.vector_index import VectorIndex, recall

WORDS = [f"word{k}" for k in range(30)] + ["two-part", "e_mail", "a-b-c", "Caps"]


def points_of(spark, n=120, seed=2, start=0):
    r = random.Random(seed)
    rows = [(f"c{k:04d}", " ".join(["common", *r.sample(WORDS, 6)])) for k in range(start, start + n)]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "common word1"), (2, "two-part"), (3, "word3 a-b-c Caps"), (4, "nothing here"), (5, "the of"), (6, "e_mail word2?"), (7, "")]
    return spark.createDataFrame(rows, "qid long, qtext string")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def agree(index, points, asked):
    for limit in (10, 3, None):
        a = retrieval.keyword_search(asked, points, limit, index)
        assert rows_of(a, "qid", "chunk_id", "matches", "k_rank") == rows_of(retrieval.keyword_search(asked, points, limit), "qid", "chunk_id", "matches", "k_rank")


def test_keyword_index_through_changes(spark, asked, tmp_path):
    points = points_of(spark).cache()
    index = KeywordIndex(spark, str(tmp_path / "k"), block=7)
    index.upsert(points)
    agree(index, points, asked)
    newer = points_of(spark, 40, seed=9, start=100).cache()  # replaces twenty
    index.upsert(newer)
    points = points.join(newer.select("chunk_id"), "chunk_id", "left_anti").unionByName(newer).cache()
    agree(index, points, asked)
    gone = points.filter("chunk_id < 'c0015' OR chunk_id LIKE '%3'")
    index.delete(gone)
    points = points.join(gone.select("chunk_id"), "chunk_id", "left_anti").cache()
    agree(index, points, asked)
    index.compact(points)
    agree(index, points, asked)
    assert len(index._tables()) == 1 and index.frequencies().filter("token = 'common'").first()["df"] == points.count()


def test_a_common_token_is_many_blocks_and_few_are_read(spark, tmp_path):
    points = points_of(spark, 300)
    index = KeywordIndex(spark, str(tmp_path / "k"), block=16)
    index.upsert(points)
    (_, blocks), = index._tables()
    common = blocks.filter("token = 'common'").orderBy("before").collect()
    assert len(common) >= 300 // 16 and max(b["n"] for b in common) <= 16 and [b["before"] for b in common] == np.cumsum([0, *[b["n"] for b in common[:-1]]]).tolist()
    assert all(a["last"] < b["first"] for a, b in zip(common, common[1:], strict=False))
    one = spark.createDataFrame([(1, "common")], "qid long, qtext string")
    read = blocks.filter("before < 10").filter("token = 'common'").count()
    assert read == 1 and index.candidates(one, 10).count() == 10


def test_an_empty_index(spark, asked, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert retrieval.keyword_search(asked, points_of(spark, 3), 10, index).count() == 0
    index.upsert(points_of(spark, 3).limit(0))
    assert retrieval.keyword_search(asked, points_of(spark, 3), 10, index).count() == 0


def vectors_of(spark, n, seed=1, start=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, 16))
    v = centre[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, 16))
    rows = [(f"v{k:05d}", x.tolist()) for k, x in enumerate(v, start)]
    return spark.createDataFrame([*rows, ("none", None)] if not start else rows, "chunk_id string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    points = vectors_of(spark, 3000).cache()
    return VectorIndex.build(points, str(tmp_path_factory.mktemp("v") / "index"), sample=1000), points


def test_vector_index_reaches_its_recall(spark, indexed):
    index, points = indexed
    asked = points.filter("chunk_id LIKE '%0'").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = retrieval.vector_topk(asked, points)
    found = recall(index.search(asked), exact).first()
    assert found["questions"] == 300 and found["recall"] >= 0.9 and index.probes < len(index.centroids)
    whole = index.search(asked, probes=len(index.centroids))  # all lists: the exact search
    assert rows_of(whole, "qid", "chunk_id", "v_rank") == rows_of(exact, "qid", "chunk_id", "v_rank")
    stored = spark.read.parquet(f"{index.path}/lists")
    assert stored.count() == 3000 and stored.select("list").distinct().count() > 20


def test_vectors_are_not_shuffled_by_a_search(spark, indexed):
    index, points = indexed
    asked = points.limit(3).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]  # from where vectors are compared down to the files
    assert "Exchange" not in below and "list#" in below[below.index("PartitionFilters") :].split("]")[0]


def test_index_grows_and_forgets(spark, tmp_path):
    first, more = vectors_of(spark, 400), vectors_of(spark, 100, seed=5, start=1000)
    index = VectorIndex.build(first, str(tmp_path / "i"), lists=8)
    index.add(more)
    asked = more.limit(20).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = index.search(asked, probes=8)
    assert rows_of(got, "qid", "chunk_id") == rows_of(retrieval.vector_topk(asked, first.unionByName(more)), "qid", "chunk_id")
    left = index.search(asked, probes=8, gone=more)
    assert rows_of(left, "qid", "chunk_id") == rows_of(retrieval.vector_topk(asked, first), "qid", "chunk_id")


def test_few_and_many_questions_give_equal_rows(spark, indexed, monkeypatch):
    _, points = indexed
    asked = points.limit(50).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    few = rows_of(retrieval.vector_topk(asked, points), "qid", "chunk_id", "score", "v_rank")
    monkeypatch.setattr(retrieval, "_BLOCK", 20)
    assert rows_of(retrieval.vector_topk(asked, points), "qid", "chunk_id", "score", "v_rank") == few


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "chunk_id string, embedding array<float>")
    index = VectorIndex.build(none, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    assert index.search(asked.limit(0)).count() == 0


def test_a_term_of_many_questions_is_looked_up_once(spark, tmp_path, monkeypatch):
    """The rows before the limit grow with the postings, not with postings times questions, with and without an index;
    a text with many hits is scored beside several copies."""
    from lorewell.operators import keyword_index

    seen = []
    real = keyword_index.first_hits

    def watched(asked, postings, limit, early=None):
        found = real(asked, postings, limit, early)
        terms = asked.select("term").distinct()
        one = terms.filter(F.size("term") == 1).select(F.col("term")[0].alias("token"))
        seen.append((asked.count(), terms.count(), (postings if early is None else early).join(one, "token").count(), found.count()))
        return found

    monkeypatch.setattr(keyword_index, "first_hits", watched)
    monkeypatch.setattr(retrieval, "first_hits", watched)
    monkeypatch.setattr(retrieval, "_HITS_OF_A_TEXT", 8)
    points = points_of(spark, 200).cache()
    questions = spark.createDataFrame([(i, f"common word{i % 3} two-part e_mail") for i in range(60)], "qid long, qtext string")
    plain = rows_of(retrieval.keyword_search(questions, points), "qid", "chunk_id", "matches", "k_rank")
    index = KeywordIndex(spark, str(tmp_path / "k"), block=16)
    index.upsert(points)
    index.delete(points.filter("chunk_id < 'c0050'"))
    live = points.filter("chunk_id >= 'c0050'")
    assert rows_of(retrieval.keyword_search(questions, live, 10, index), "qid", "chunk_id", "matches", "k_rank") == rows_of(retrieval.keyword_search(questions, live), "qid", "chunk_id", "matches", "k_rank")
    texts = {r["chunk_id"]: r["text"] for r in points.collect()}
    want = []
    for q in range(60):
        tokens = ["common", f"word{q % 3}", "two-part", "e_mail"]
        hits = sorted(sorted(texts)[:10], key=lambda c: (-sum(t in texts[c].lower() for t in tokens), c))
        want += [(q, c, sum(t in texts[c].lower() for t in tokens), k) for k, c in enumerate(hits, 1)]
    assert plain == sorted(want)
    assert all(asked == 240 and terms == 6 and rows <= 200 * 5 and found <= 60 * 200 for asked, terms, rows, found in seen) and len(seen) == 3


def test_the_best_by_rounded_score():
    from lorewell.operators.retrieval import best_rounded

    r = np.random.default_rng(3)
    for n in (1, 4, 19, 20, 21, 400):
        score = r.normal(size=(50, n)).round(r.integers(1, 3)) + r.integers(-6, 7, (50, n)) * 1e-7  # many equal once rounded
        whole = np.round(score, 6)
        want = np.argsort(-whole, axis=1, kind="stable")[:, :5]
        top, value = best_rounded(score, 5)
        assert (top == want).all() and (value == np.take_along_axis(whole, want, 1)).all()
