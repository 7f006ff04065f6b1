"""The point store: upserts, deletes, versions, lost and concurrent writers, plans without shuffles."""

import random

import pytest

from lorewell.operators.point_store import PointStore

SCHEMA = "point_id string, document_id string, n int"


def rows(spark, xs):
    return spark.createDataFrame([(f"p{k}", f"d{k // 3}", n) for k, n in xs], SCHEMA)


def got(df):
    return {r.point_id: r.n for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return PointStore(spark, str(tmp_path / "points"), buckets=4)


def test_random_changes_as_a_dict(spark, store):
    r, plain = random.Random(4), {}
    for step in range(6):
        xs = [(r.randrange(40), r.randrange(1000)) for _ in range(25)]
        if step and r.random() < 0.4:
            store.delete(rows(spark, xs))
            for k, _ in xs:
                plain.pop(f"p{k}", None)
        else:
            store.upsert(rows(spark, xs))
            for k in {k for k, _ in xs}:
                plain[f"p{k}"] = max(n for j, n in xs if j == k)
        if step == 3:
            store.compact()
        assert got(store.read()) == plain
    before = store.version()
    store.compact(buckets=7)
    assert got(store.read()) == plain == got(store.read(before))
    store.upsert(rows(spark, [(1, 5000)]))
    assert got(store.read()) == plain | {"p1": 5000}


def test_order_decides_among_equal_keys(spark, store):
    new = spark.createDataFrame([("p1", "d", 9, 1), ("p1", "d", 3, 2)], SCHEMA + ", seq int")
    store.upsert(new.select("point_id", "document_id", "n"))
    assert got(store.read()) == {"p1": 9}
    store.upsert(new, order="seq")
    assert got(store.read()) == {"p1": 3}


def test_a_writer_lost_midway_changes_nothing(spark, store, monkeypatch):
    store.upsert(rows(spark, [(1, 1), (2, 2)]))

    def lost(change, tries=20):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.commits, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows(spark, [(1, 7), (3, 7)]))
    again = PointStore(spark, store.path)
    assert got(again.read()) == {"p1": 1, "p2": 2}
    again.upsert(rows(spark, [(3, 3)]))
    assert got(again.read()) == {"p1": 1, "p2": 2, "p3": 3}
    assert again.vacuum(keep=1) == []  # it might still be at work
    assert len(again.vacuum(keep=1, least_age_seconds=0)) == 1
    assert got(again.read()) == {"p1": 1, "p2": 2, "p3": 3}


def test_an_unfinished_manifest_does_not_count(spark, store):
    store.upsert(rows(spark, [(1, 1)]))
    store.commits.files.create(f"{store.path}/commits/{2:012d}.json", '{"segm')
    assert got(store.read()) == {"p1": 1}
    store.commits.grace_seconds = 0.2
    assert store.upsert(rows(spark, [(2, 2)])) == 3
    assert got(store.read()) == {"p1": 1, "p2": 2}


def test_a_slow_writer_commits_anew(spark, store):
    """Its manifest was taken for that of a lost writer, and another one passed it over."""
    store.upsert(rows(spark, [(1, 1)]))
    other, create = PointStore(spark, store.path), store.commits.files.create
    other.commits.grace_seconds = 0.1

    def slow(path, text):
        if path.endswith(f"{2:012d}.json") and not list(store.commits.files.names(f"{store.path}/commits"))[1:]:
            create(path, '{"segm')
            other.upsert(rows(spark, [(2, 2)]))  # version 3, after version 1
            store.commits.files.remove(path)
        return create(path, text)

    store.commits.files.create = slow
    store.upsert(rows(spark, [(3, 3)]))
    assert got(PointStore(spark, store.path).read()) == {"p1": 1, "p2": 2, "p3": 3}


def test_two_writers_at_once(spark, store):
    store.upsert(rows(spark, [(1, 1)]))
    other = PointStore(spark, store.path)
    write = other._write

    def slow(df, buckets):
        folder = write(df, buckets)
        store.upsert(rows(spark, [(2, 2)]))  # commits first
        return folder

    other._write = slow
    other.upsert(rows(spark, [(3, 3)]))
    assert got(store.read()) == {"p1": 1, "p2": 2, "p3": 3} and store.version() == 3


def test_stale_points_go(spark, store):
    store.upsert(rows(spark, [(k, 1) for k in range(9)]))
    current = rows(spark, [(0, 2), (1, 2), (6, 2)])  # of documents d0 and d2
    store.upsert(current)
    store.remove_stale(current)
    assert got(store.read()) == {"p0": 2, "p1": 2, "p3": 1, "p4": 1, "p5": 1, "p6": 2}


def test_reading_shuffles_nothing(spark, store):
    for k in range(3):
        store.upsert(rows(spark, [(j, k) for j in range(k, 200, k + 1)]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.read()
        assert joined.count() == 200
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_errors(spark, store):
    with pytest.raises(ValueError, match="no points"):
        store.read()
    with pytest.raises(Exception, match="no key"):
        store.upsert(spark.createDataFrame([(None, "d", 1)], SCHEMA))
