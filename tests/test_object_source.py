"""Objects as a data source: round trips, pushed filters, commits and aborts, a stream of new ones."""

import os

import pytest
from pyspark.sql import functions as F

from lorewell.sources import object_source as os_
from lorewell.sources.object_source import ObjectSource


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(ObjectSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def put(spark, root, rows):
    df = spark.createDataFrame(rows, "object_key string, body string").repartition(3)
    df.write.format("objects").mode("append").option("path", str(root)).save()


def read(spark, root, **options):
    return spark.read.format("objects").options(path=str(root), **options).load()


def bodies(df):
    return {r.object_key: r.body for r in df.collect()}


def test_round_trip_and_replacement(spark, tmp_path):
    rows = [(f"site/{k % 3}/p{k}.md", f"text é {k}\n") for k in range(20)] + [("empty.md", ""), ("null.md", None)]
    put(spark, tmp_path, rows)
    assert bodies(read(spark, tmp_path)) == {k: b or "" for k, b in rows}
    put(spark, tmp_path, [("site/0/p0.md", "new")])
    got = read(spark, tmp_path)
    assert bodies(got)["site/0/p0.md"] == "new" and got.count() == 22
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".")]  # no staging is left
    assert {r.object_key: r.size for r in got.collect()}["site/1/p1.md"] == len("text é 1\n".encode())


def test_filters_reach_the_listing(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, [(f"{d}/{k}.{e}", "x" * k) for d in ("a", "b") for k in range(8) for e in ("md", "json")])
    got = read(spark, tmp_path)
    for condition, wanted in (
        ("object_key LIKE 'a/%'", lambda k: k.startswith("a/")), ("object_key LIKE '%.json'", lambda k: k.endswith(".json")), ("object_key = 'b/3.md'", lambda k: k == "b/3.md"),
        ("object_key IN ('a/1.md', 'zz')", lambda k: k == "a/1.md"), ("size >= 6", lambda k: int(k[2]) >= 6), ("object_key LIKE 'a/%' AND size < 2", lambda k: k[0] == "a" and int(k[2]) < 2), ("object_key LIKE '%/5%'", lambda k: "/5" in k),
    ):
        some = got.filter(condition)
        assert set(bodies(some)) == {f"{d}/{k}.{e}" for d in ("a", "b") for k in range(8) for e in ("md", "json") if wanted(f"{d}/{k}.{e}")}, condition
    reader = os_.ObjectReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([os_.StringStartsWith(("object_key",), "a/"), os_.LessThan(("size",), 3), unknown := os_.StringStartsWith(("body",), "x")])) == [unknown]
    asked = []
    plain = os_.listed
    monkeypatch.setattr(os_, "listed", lambda root, folder="": asked.append(folder) or plain(root, folder))
    assert sorted(e.key for p in reader.partitions() for e in p.entries) == [f"a/{k}.{e}" for k in range(3) for e in ("json", "md")] and asked == ["a"]


def test_partitions_and_large_objects(spark, tmp_path):
    put(spark, tmp_path, [(f"{k}.md", "x" * 1000) for k in range(10)] + [("large.md", "y" * 5000)])
    got = read(spark, tmp_path, mostBytes=2000, partitionBytes=3 * (1000 + (64 << 10)))
    assert got.rdd.getNumPartitions() == 4
    rows = {r.object_key: r for r in got.collect()}
    assert rows["large.md"].error == "too large" and rows["large.md"].body is None and rows["large.md"].size == 5000 and rows["3.md"].error is None
    (tmp_path / "bytes.md").write_bytes(b"\xff\xfe")
    assert read(spark, tmp_path).filter("error IS NOT NULL").select("object_key", "error").collect() == [("bytes.md", "UnicodeDecodeError")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    put(spark, tmp_path, [("a.md", "old")])
    for bad in ("../out.md", "/root.md", None):
        with pytest.raises(Exception, match="no object can have the key"):
            put(spark, tmp_path, [("a.md", "new"), ("b.md", "new"), (bad, "x")])
    assert bodies(read(spark, tmp_path)) == {"a.md": "old"}
    os_.sweep(str(tmp_path))
    os_.sweep(str(tmp_path), 0)  # other tasks may have gone on after the failure
    assert sorted(os.listdir(tmp_path)) == ["a.md"]
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", "b")], "object_key string, body string").write.format("objects").mode("overwrite").option("path", str(tmp_path)).save()


def test_only_committed_messages_count(tmp_path):
    writer = os_.ObjectWriter({"path": str(tmp_path)})
    lost = writer.write(iter([{"object_key": "a.md", "body": "first attempt"}]))
    kept = writer.write(iter([{"object_key": "a.md", "body": "second attempt"}]))
    assert os_.listed(str(tmp_path)) == []  # staged objects aren't there yet
    writer.commit([kept, None])
    assert (tmp_path / "a.md").read_text() == "second attempt" and not os.path.exists(lost.objects[0][0])


def test_stream_of_new_objects(spark, tmp_path):
    root, out, c = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")

    def drain():
        stream = spark.readStream.format("objects").option("path", str(root)).load()
        q = stream.select("object_key", F.md5("body").alias("m"), F.length("body").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", c).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.object_key, r.n) for r in spark.read.schema("object_key string, m string, n int").parquet(out).collect())

    put(spark, root, [("a.md", "1"), ("b.md", "22")])
    assert drain() == [("a.md", 1), ("b.md", 2)]
    put(spark, root, [("c.md", "333"), ("a.md", "4444")])  # one new, one written again
    assert drain() == [("a.md", 1), ("a.md", 4), ("b.md", 2), ("c.md", 3)]
    assert drain() == [("a.md", 1), ("a.md", 4), ("b.md", 2), ("c.md", 3)]


def test_an_empty_store(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0 and read(spark, tmp_path / "nowhere").count() == 0
