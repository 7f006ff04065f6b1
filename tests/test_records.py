"""Sinks, size limits, run tables, limits and the embedder."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import index, records, retrieval
from lorewell.sources import objects


def test_objects_and_sidecars(spark, tmp_path):
    pages = spark.createDataFrame(
        [("a/b.md", "# Ü\n", "https://x.example.org/a", 3, datetime(2024, 1, 2, 3, 4, 5), {"k": "v"}), ("c.md", None, None, None, None, None)],
        "object_key string, body string, url string, crawl_depth int, crawl_timestamp timestamp, response_headers map<string,string>",
    )
    folder = str(tmp_path / "store")
    sizes = {r.object_key: r["size"] for r in objects.write_objects(pages, folder).collect()}
    assert sizes == {"a/b.md": 5, "c.md": 0} and (tmp_path / "store/a/b.md").read_text() == "# Ü\n"
    objects.write_objects(objects.sidecar_json(pages), f"file://{folder}").collect()
    read = json.loads((tmp_path / "store/a/b.meta.json").read_text())
    assert read == {"url": "https://x.example.org/a", "crawl_depth": 3, "crawl_timestamp": "2024-01-02T03:04:05+00:00", "response_headers": {"k": "v"}}
    assert (tmp_path / "store/a/b.meta.json").read_text().startswith('{\n  "url"')
    objects.write_objects(pages.withColumn("body", F.lit("new")), folder).collect()  # a later write replaces
    found = {r.path.rsplit("/", 1)[1]: r for r in objects.documents(spark, folder).collect()}
    assert {k: r.content for k, r in found.items()} == {"b.md": "new", "c.md": "new"}
    assert {r.url for r in objects.sidecars(spark, folder).collect()} == {"https://x.example.org/a", None}
    for bad in ("../x.md", None):
        with pytest.raises(Exception, match="no object can have the key"):
            objects.write_objects(spark.createDataFrame([(bad, "x")], "object_key string, body string"), folder).collect()
    assert objects.write_objects(pages.limit(0), folder).collect() == []


def test_size_limits_come_from_the_listing(spark, tmp_path):
    (tmp_path / "a.md").write_text("small")
    (tmp_path / "b.md").write_text("large" * 100)
    rows = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in objects.documents(spark, str(tmp_path), 100).collect()}
    assert rows == {"a.md": ("small", None), "b.md": (None, "too large")}
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": "1", "document_id": "d"}] * 20))
    assert objects.chunk_files(spark, str(tmp_path), 100).collect() == []
    assert [(r["size"] > 100, r.error) for r in objects.oversized(spark, str(tmp_path), "*.json", 100).collect()] == [(True, "too large")]


def test_visit_log(spark, tmp_path):
    log = spark.createDataFrame([(i, "SAVED", i % 3, f"u{i}", None) for i in range(40)], "crawl_seq long, status string, depth int, url string, reason string").repartition(5)
    path = objects.write_visit_log(log, str(tmp_path), "2024-01-01T00-00-00")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == sorted(f"SAVED     depth={i % 3} u{i} " for i in range(40))


def test_pdf_reader_is_a_parameter(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"%PDF one")), ("b.pdf", bytearray(b"junk"))], "path string, content binary")

    def reader(data, pages, chars):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return f"{pages} {data.decode()}" + "x" * 2 * chars

    got = {r.path: (r.text, r.error) for r in objects.document_text(files, most_chars=20, most_pages=7, pdf=reader).collect()}
    assert got == {"a.pdf": ("7 %PDF onexxxxxxxxxx", None), "b.pdf": (None, "unreadable: ValueError")}


def test_leaky_bucket(spark):
    rng, at, rows = np.random.default_rng(3), datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(milliseconds=int(rng.choice([0, 0, 10, 60, 900])))
        rows.append((int(rng.integers(3)), i, at))
    got = {r.request_id: r.allowed for r in records.leaky_bucket(spark.createDataFrame(rows, "ip long, request_id long, ts timestamp").repartition(4), 20, 3).collect()}
    level, last, want = {}, {}, {}
    for ip, i, t in rows:
        after = max(0.0, level[ip] - 20 * (t - last[ip]).total_seconds()) + 1 if ip in level else 0.0
        want[i] = after <= 3 + 1e-9
        if want[i]:
            level[ip], last[ip] = after, t
    assert got == want and not all(got.values())


def test_embedder_checks_its_model(spark):
    texts = spark.createDataFrame([("a b",), (None,), ("c",)], "t string").coalesce(1)
    sizes = index.embedder(lambda: lambda ts: [[len(ts), len(t)] for t in ts], 2, batch_size=2)
    assert [r.v for r in texts.select(sizes("t").alias("v")).collect()] == [[2, 3], [2, 0], [1, 1]]
    with pytest.raises(Exception, match="of 3 dimensions"):
        texts.select(index.embedder(lambda: lambda ts: [[0.0, 1.0] for _ in ts], 3)("t")).collect()
    v = texts.select(index.hash_embedder(16)("t").alias("v")).collect()
    assert len(v[0].v) == 16 and abs(np.linalg.norm(v[0].v) - 1) < 1e-6 and not any(v[1].v)


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1)], "point_id string, seq int, v int")
    new = spark.createDataFrame([("a", 2, 9), ("a", 3, 5), ("b", 1, 7)], "point_id string, seq int, v int").repartition(3)
    assert sorted(map(tuple, index.upsert(old, new, order="seq").collect())) == [("a", 3, 5), ("b", 1, 7)]


def test_vector_topk_of_any_ids(spark):
    """Ids of questions may be strings; vectors may be missing on either side."""
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "qid string, qvec array<double>")
    p = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0]), ("c", None)], "chunk_id string, embedding array<double>")
    assert [(r.qid, r.chunk_id, r.v_rank) for r in retrieval.vector_topk(q, p, 1).collect()] == [("x", "a", 1)]
    assert retrieval.vector_topk(q.limit(0), p).collect() == [] == retrieval.vector_topk(q, p.limit(0)).collect()


def test_changes_of_one_key(spark):
    rows = spark.createDataFrame([(1, "new", "me"), (2, "new", "me"), (3, "new", "me")], "id long, status string, owner string")
    changes = spark.createDataFrame(
        [(1, "update", 1, "run", "you"), (2, "update", 1, None, None), (3, "delete", 2, None, None), (4, "update", 2, "late", None), (5, "insert", 3, "again", "you"), (6, "update", 3, "done", "they"), (7, "insert", 4, "first", "they")],
        "seq long, action string, id long, status string, owner string",
    )
    assert sorted(map(tuple, records.applied(rows, changes, ("status",)).collect())) == [(1, "run", "me"), (3, "done", "you"), (4, "first", "they")]
