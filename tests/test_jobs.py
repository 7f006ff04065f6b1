"""Retrieval, sources, streaming and the catalogue."""

import io
import json
import random
import time
import zipfile
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorewell.operators import chat, index, retrieval
from lorewell.plans import catalogue
from lorewell.sources import objects
from lorewell.streaming import jobs

SF = "/root/testdata/sf0.001"


def requests(n=300):
    rng, at = random.Random(1), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 40]))
        rows.append((rng.randrange(4), i, at))
    return rows


def plain_limit(rows, most, seconds):
    seen, out = {}, {}
    for s, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        q = seen.setdefault(s, deque())
        while q and q[0] < t - timedelta(seconds=seconds):
            q.popleft()
        out[i] = len(q) < most
        if out[i]:
            q.append(t)
    return out


def test_rate_limit(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp").repartition(3)
    got = {r.event_id: r.allowed for r in chat.rate_limited(df, 5, 60).collect()}
    assert got == plain_limit(rows, 5, 60) and not all(got.values())


def test_stream_limit_is_batch_limit(spark, tmp_path):
    rows = requests(120)
    schema = "session_id long, event_id long, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = jobs.limited(stream, 5, 60, expires=False).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == plain_limit(rows, 5, 60)


def test_ingest_once(spark, tmp_path):
    schema = "url string, text string"
    for k, rows in enumerate(([("a", "x"), ("b", "x"), ("c", "y")], [("d", "y"), ("e", "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "pages"))
        jobs.ingest(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "table")).count() == 2 + k


def test_first_contents_stream(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "url string, text string").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("url string, text string").parquet(str(tmp_path / "p"))
    q = jobs.first_contents(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "chunks").mkdir()
    chunk = {"chunk_id": "d_0000", "document_id": "d", "chunk_index": 0, "text": "t", "url": "u", "title": "T", "page_type": "general", "headings_path": ["A"], "content_hash": "h", "crawl_timestamp": "s", "token_count": 1}
    (tmp_path / "chunks" / "d.json").write_text(json.dumps([chunk, chunk | {"chunk_id": "d_0001", "chunk_index": 1}], indent=2))
    (tmp_path / "a.md").write_text("# hi\n")
    (tmp_path / "big.md").write_text("x" * 100)
    (tmp_path / "a.meta.json").write_text(json.dumps({"doc_id": "1", "url": "u", "content_hash": "h1", "internal_links": ["x"]}, indent=2))
    (tmp_path / "bad.meta.json").write_text("{nope")
    assert objects.chunk_files(spark, str(tmp_path / "chunks")).count() == 2
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in objects.documents(spark, str(tmp_path), 50).collect()}
    assert got == {"a.md": ("# hi\n", None), "big.md": (None, "too large")}
    assert [(r.content_hash, r.url) for r in objects.hash_index(spark, str(tmp_path)).collect()] == [("h1", "u")]
    assert objects.listing(spark, str(tmp_path), "*.md").count() == 2
    both = objects.chunk_array_json(objects.chunk_files(spark, str(tmp_path / "chunks"))).first()
    assert [c["chunk_id"] for c in json.loads(both.json)] == ["d_0000", "d_0001"]


def test_chunks_of_other_documents_stay(spark, tmp_path):
    """Documents of one bucket, written one after the other, don't touch each other."""
    path = str(tmp_path / "store")
    record = lambda d, k, t: (f"{d}_{k:04d}", d, k, t, "u", None, "general", ["A"], "h", "s", 1)
    frame = lambda rows: spark.createDataFrame([record(*r) for r in rows], objects.CHUNK)
    ids = spark.range(200).select(F.format_string("d%03d", "id").alias("d")).withColumn("b", F.pmod(F.xxhash64("d"), F.lit(64)))
    one, two = next(r.ds[:2] for r in ids.groupBy("b").agg(F.sort_array(F.collect_list("d")).alias("ds")).collect() if len(r.ds) > 1)
    other = next(r.d for r in ids.collect() if r.b != ids.filter(F.col("d") == one).first().b)
    now = lambda: sorted((r.document_id, r.chunk_index, r.text, tuple(r.headings_path)) for r in objects.written_chunks(spark, path).collect())
    assert now() == []
    objects.write_chunks(frame([(one, 0, "a"), (one, 1, "b"), (other, 0, "c")]), path)
    objects.write_chunks(frame([(two, 0, "d\ne")]), path)
    assert now() == sorted([(one, 0, "a", ("A",)), (one, 1, "b", ("A",)), (other, 0, "c", ("A",)), (two, 0, "d\ne", ("A",))])
    (tmp_path / "store" / "snapshot=00000009" / "bucket=1").mkdir(parents=True)  # a write that broke off
    objects.write_chunks(frame([(one, 0, "new")]), path)
    assert now() == sorted([(one, 0, "new", ("A",)), (other, 0, "c", ("A",)), (two, 0, "d\ne", ("A",))])
    objects.write_chunks(objects.written_chunks(spark, path).filter(F.col("document_id") == two).withColumn("text", F.lit("again")), path)
    assert now() == sorted([(one, 0, "new", ("A",)), (other, 0, "c", ("A",)), (two, 0, "again", ("A",))])


def test_document_text(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p></w:p><w:p><w:t xml:space='preserve'>three</w:t></w:p></w:document>")
    rows = [("a.docx", bytearray(b.getvalue())), ("b.docx", bytearray(b"junk")), ("c.pdf", bytearray(b"%PDF")), ("d.doc", bytearray(b"x"))]
    got = {r.path: (r.text, r.error) for r in objects.document_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"] == ("One & two\n\nthree", None) and got["b.docx"][1].startswith("unreadable") and got["c.pdf"][1] == "no PDF reader" and got["d.doc"][1] == "unsupported: doc"


def test_stream_state_expires(spark, tmp_path):
    spark.createDataFrame(requests(20), "session_id long, event_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = jobs.limited(stream, 5, 1).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 90
        held = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        while time.time() < deadline and not (max(held(), default=0) > 0 and held()[-1] == 0):
            time.sleep(0.5)
        assert max(held()) > 0 and held()[-1] == 0 and spark.table("expiring").count() == 20
    finally:
        q.stop()


def test_upsert_and_embedding(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "point_id string, v int")
    assert sorted(map(tuple, index.upsert(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    v = spark.createDataFrame([("a b",), ("b a",), (None,)], "t string").select(index.hash_embedder()("t").alias("v")).collect()
    assert v[0].v == v[1].v and sum(v[2].v) == 0


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid long, chunk_id string, v_rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "z", 1)], "qid long, chunk_id string, k_rank int")
    got = {(r.qid, r.chunk_id): (r["rank"], r.from_vector) for r in retrieval.rrf_fuse(v, k, top_k=2).collect()}
    assert got == {(1, "b"): (1, True), (1, "a"): (2, True), (2, "z"): (1, False)}
    assert retrieval.rrf_fuse(v, k, min_score=0.1).count() == 0


def test_vector_blocks(spark, monkeypatch):
    q, p = spark.range(30).select(F.col("id").alias("qid"), F.array(F.cos("id"), F.sin("id")).alias("qvec")), spark.range(50).select(F.format_string("%03d", "id").alias("chunk_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    one = sorted(map(tuple, retrieval.vector_topk(q, p, 3).collect()))
    monkeypatch.setattr(retrieval, "_BLOCK", 4)
    assert sorted(map(tuple, retrieval.vector_topk(q, p, 3).collect())) == one and len(one) == 90


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


@pytest.mark.parametrize("name", ["build_chunks", "clean_pages", "html_markdown", "hash_embed", "chunk_stats"])
def test_queries_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_catalogue_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and "hybrid_search" in catalogue.QUERIES
