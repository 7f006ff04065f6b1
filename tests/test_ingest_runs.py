"""The bounded crawl, the one-pass cleaner, folds over sorted rows, and a chunking run with its counters."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.config import CHROME, Chrome
from lorewell.operators import admin, chunking, cleaning, crawl, records
from lorewell.plans import service
from lorewell.shared import with_rank
from lorewell.sources import objects
from lorewell.streaming.runs import RunLog


def plain_crawl(edges, seeds, max_depth, max_pages, host, expands):
    seen, level, depth = {}, sorted(set(seeds)), 0
    while True:
        turn, n = {}, {}
        for v in level:
            turn[v] = n[host(v)] = n.get(host(v), 0) + 1
        for v in sorted(level, key=lambda v: (turn[v], v)):
            if max_pages is None or len(seen) < max_pages:
                seen[v] = depth
        if not level or depth == max_depth or len(seen) == max_pages:
            return seen
        level = sorted({b for a, b in edges if seen.get(a) == depth and expands(a) and b not in seen})
        depth += 1


@pytest.mark.parametrize("most", [None, 1, 7, 40, 100_000])
def test_crawl_stops_at_its_bound(spark, most):
    r = random.Random(6)
    nodes = [f"h{r.randrange(5)}/{k}" for k in range(150)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(500)]
    table = spark.createDataFrame([*edges, (nodes[0], None)], "src string, dst string")
    seeds = spark.createDataFrame([(nodes[0],), (nodes[1],), (nodes[0],), (None,)], "node string")
    for host, by in ((F.split("node", "/")[0], lambda v: v.split("/")[0]), (None, lambda v: v)):
        plain = plain_crawl(edges, nodes[:2], 3, most, by if host is not None else lambda v: v, lambda v: not v.endswith("3"))
        got = crawl.crawled(table, seeds, 3, most, host, ~F.col("node").endswith("3"))
        assert {x.node: x.depth for x in got.collect()} == plain


def test_crawl_does_not_walk_past_its_bound(spark):
    """Of a chain of levels only those up to the bound are written."""
    edges = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = crawl.crawled(edges, spark.range(1).select(F.col("id").alias("node")), 900, 5)
    assert sorted(r.node for r in got.collect()) == [0, 1, 2, 3, 4] and len(got.inputFiles()) <= 10
    assert {p.split("level=")[1].split("/")[0] for p in got.inputFiles()} == {"0", "1", "2", "3", "4"}


RULES = Chrome(lines=(r"^ad\b",), exact=("Menu", "x y"), contains=("[top]",), pairs=(("log", "in"), ("a", "zz")), echoes=("* ", ""))
LINES = ["Site menu", "* [a](b)", "- [c](d)", "", "# One", "### Two", "Search this site", "## How to search", "ad here", "add", " Menu ", "x y", "go [top]", "log me in", "in log", "azz", "* [q](q)", "[q](q) ", "[q](p)", "### Site footer", "text", "see ![footer map", " * [indented](x)"]


@given(st.lists(st.sampled_from(LINES), max_size=25))
@settings(max_examples=60, deadline=None)
def test_one_pass_is_rule_by_rule(lines):
    by_pass = cleaning.Cleaner(RULES)("\n".join(lines))
    kept, menu, search, footer = [], False, False, False
    for line in lines:
        x = line.strip()
        if menu:
            if not x.startswith(("# ", "## ")) and (x == "" or x.startswith(RULES.menu_items)):
                continue
            menu = False
        if search:
            if not x.startswith("#") or x.startswith("## How to search"):
                if not footer:
                    continue
            else:
                search = False
        if footer:
            continue
        if x == "Site menu":
            menu = True
        elif x == "Search this site" or x.startswith("## How to search"):
            search = True
        elif x.startswith("### Site footer") or "![footer map" in line:
            footer = True
        elif not (line.startswith("ad ") or x in ("Menu", "x y") or "[top]" in line or ("log" in line and "in" in line) or ("a" in line and "zz" in line) or x in ("* [q](q)", "[q](q)")):
            kept.append(line)
    assert by_pass == "\n".join(kept)


def test_one_pass_is_the_expressions(spark):
    r = random.Random(8)
    pages = [[r.choice([*LINES, *["Close", "[Log in] staff only", "Copyright 2020 x", "some text"]]) for _ in range(r.randrange(30))] for _ in range(150)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, lines array<string>")
    for rules in (RULES, CHROME):
        kept = F.filter(cleaning.outside_blocks(F.col("lines"), rules), lambda x: ~cleaning.is_chrome(x, rules))
        both = df.select("i", F.array_join(kept, "\n").alias("a"), cleaning.without_chrome(F.array_join("lines", "\n"), rules).alias("b")).collect()
        assert [x.a for x in both] == [x.b for x in both]
    assert spark.createDataFrame([(None,)], "t string").select(cleaning.without_chrome(F.col("t")).alias("t")).first().t is None


def test_folds(spark):
    r, at = random.Random(3), datetime(2024, 1, 1)
    rows = [(r.randrange(6), i, at + timedelta(seconds=r.randrange(5000)), float(r.randrange(300))) for i in range(400)]
    got = {x.id: x.skipped for x in records.without_overlaps(spark.createDataFrame(rows, "schedule long, id long, start timestamp, seconds double").repartition(5)).collect()}
    until, plain = {}, {}
    for s, i, t, n in sorted(rows, key=lambda x: (x[2], x[1])):
        plain[i] = s in until and t < until[s]
        if not plain[i]:
            until[s] = t + timedelta(seconds=n)
    assert got == plain and set(got.values()) == {True, False}
    events = [(r.randrange(5), i, r.choice(["start", "ok", "ok", "fail", "cancel", "other"])) for i in range(300)]
    df = spark.createDataFrame(events, "run_id long, seq long, event string").repartition(4)
    paths, changes = {k: ["IDLE"] for k in range(5)}, []
    for k, i, e in events:
        new = admin.AFTER.get((paths[k][-1], e), paths[k][-1])
        if new != paths[k][-1]:
            paths[k].append(new)
            changes.append((k, len(paths[k]) - 1, i, new))
    assert {x.run_id: (x.state, x.path) for x in records.run_states(df, admin.AFTER).collect()} == {k: (p[-1], ">".join(p)) for k, p in paths.items()}
    assert sorted(tuple(x) for x in records.state_changes(df, admin.AFTER).collect()) == sorted(changes)
    states = df.select("event").distinct().crossJoin(spark.createDataFrame([(s,) for s in (*admin.TRANSITIONS, *admin.TERMINAL)], "state string"))
    for x in states.select("state", "event", admin.next_state(F.col("state"), F.col("event")).alias("n")).collect():
        assert x.n == admin.AFTER.get((x.state, x.event), x.state)


def test_chunk_run(spark, tmp_path):
    rows = [("d1", "u", "t", "# A\n\n" + "word " * 600 + "\n\n" + "more " * 700, "s", None), ("d2", "u", "t", " \n", "s", None), ("d3", "u", "t", "x", "s", "too large")]
    docs = spark.createDataFrame(rows, "document_id string, url string, title string, body string, crawl_timestamp string, error string")
    log = RunLog(spark, str(tmp_path / "runs"))
    stats = service.chunk_run(docs, str(tmp_path / "chunks"), log)
    written = spark.read.parquet(str(tmp_path / "chunks"))
    assert stats == {"processed": 1, "skipped": 1, "failed": 1, "total_chunks": written.count()} and written.count() > 1
    assert sorted(written.columns) == sorted(chunking.chunk_records(docs).columns)
    assert [(r.name, r.status) for r in log.registry().collect()] == [("chunk", "completed")]


def test_documents_of_statistics(spark):
    texts = ['{"a": {"b": [1, 2]}, "n": 3, "s": "é\\"x", "z": null}', "[1]", "nope", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", records.variant(F.col("t")))
    new = df.withColumn("d", records.patched(F.col("d"), {"n": F.col("i") + 10, "s": None, "new": F.lit("q\"\n")})).select("i", F.to_json("d").alias("j"), records.stat(F.col("d"), "$.a.b[1]", "int").alias("b"), records.stat(F.col("d"), "$.n", "boolean").alias("wrong"))
    got = {r.i: r for r in new.collect()}
    assert {i: json.loads(r.j) for i, r in got.items()} == {0: {"a": {"b": [1, 2]}, "n": 10, "z": None, "new": 'q"\n'}} | {i: {"n": 10 + i, "new": 'q"\n'} for i in range(1, 5)}
    assert got[0].b == 2 and got[1].b is None
    kinds = {(r.field, r.kind): r.n for r in records.stat_fields(df, "d").collect()}
    assert kinds == {("a", "OBJECT<b: ARRAY<BIGINT>>"): 1, ("n", "BIGINT"): 1, ("s", "STRING"): 1, ("z", "VOID"): 1}


def test_rank_over_ranges(spark):
    r = random.Random(5)
    rows = [(r.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    ranked = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert {(x.a, x.b): x.position for x in with_rank(df, F.desc("a"), F.col("b")).collect()} == {x: i for i, x in enumerate(ranked, 1)}
    assert with_rank(df.limit(0), F.col("a")).count() == 0


def test_fetch_by_key(spark, tmp_path):
    objects.write_objects(spark.createDataFrame([("a/b.md", "x"), ("c.json", "{}"), ("d.md", "y" * 50)], "object_key string, body string"), str(tmp_path))
    got = {r.object_key: (r.content_type, r.body, r.error) for r in objects.fetch(spark, str(tmp_path), "a/b.md", "d.md", "none", most_bytes=20).collect()}
    assert got == {"a/b.md": ("text/markdown", "x", None), "d.md": ("text/markdown", None, "too large")}
