"""Ranked lexical search against a plain version, and its bounds."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    sets = [(i, terms_of(t)) for i, t in docs]
    sets = [(i, t) for i, t in sets if t]
    n, length = len(sets), sum(len(t) for _, t in sets)
    df = {}
    for _, t in sets:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for doc, t in sets:
            m = 10 + (90 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in set(terms_of(text)) if w in t)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: f"W{min(int(r.expovariate(0.03)), 200)}"
    out = [" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(300)]
    out += [out[3]] * 30 + [None, "", " ,;\n", "É1 a-b_c", "w1 " * 4000]  # copies, so that scores tie; nulls; a long text
    return out


def test_ranks_as_a_plain_version(spark, make, texts):
    items = [(0, texts[3]), (1, "w1 W1 w2"), (2, None), (3, ""), (4, "nowhere"), (5, "é1 a b-c"), (5, texts[9]), (6, " ".join(texts[20:24]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = make(texts)
    expected = plain(list(enumerate(texts)), items)
    assert rows_of(ls.search(docs, table)) == expected
    assert rows_of(ls.search(docs, table, slice_items=2)) == expected  # several slices
    assert rows_of(ls.search(docs, table, k=1)) == plain(list(enumerate(texts)), items, 1)


def test_null_and_equal_ids(spark, make):
    texts = ["a b", "a b", "a b", "a c", "b"]
    docs = make(texts, [None, 7, 7, 3, 1])
    items = [(1, "a"), (1, "a b")]
    assert rows_of(ls.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == plain(list(zip([None, 7, 7, 3, 1], texts, strict=True)), items)


def test_empty_tables(spark, make):
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(make(["a"]).limit(0), some).count() == 0
    assert ls.search(make(["a"]), some.limit(0)).count() == 0
    assert ls.search(make([None, ""]), some).count() == 0


def test_small_terms_generate_no_candidates():
    items = ls.Items([1], pa.array(["rare common usual"]))
    at = {w: int(np.flatnonzero(items.vocabulary == ls.terms(pa.array([w])).hash[0])[0]) for w in ("rare", "common", "usual")}
    df, most, kth = np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(3, np.int64)
    for w, n, a, b in (("rare", 20, 900, 800), ("common", 900, 500, 400), ("usual", 950, 500, 400)):
        df[at[w]], most[at[w]], kth[at[w]] = n, a, b
    plan = ls.Plan(items, 1000, 50_000, df, most, kth, 10)
    weight = plan.weight
    assert plan.threshold[0] == weight[at["rare"]] * 800
    assert plan.slack[0] == weight[at["common"]] * 500 + weight[at["usual"]] * 500 < plan.threshold[0]
    assert plan.leads[1].tolist() == [0] and plan.leads[0][at["rare"] + 1] - plan.leads[0][at["rare"]] == 1
    assert len(plan.adds[1]) == 2


def test_stored_bounds_are_the_kth_impacts(spark, make, texts):
    items = ls.Items([1], pa.array([" ".join(f"w{k}" for k in range(30))]))
    stored = ls.postings(make(texts), "doc_id", "text", items).cache()
    n, length = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
    got = {r["term"]: (r["df"], r["most"], r["kth"]) for r in ls.bounds(stored, n, length, len(items.vocabulary), 10).collect()}
    for w in ("w0", "w1", "w7"):
        term = int(np.flatnonzero(items.vocabulary == ls.terms(pa.array([w])).hash[0])[0])
        f = sorted(((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 8 * (10 + 90 * len(t) * n // length)) for t in map(terms_of, texts) if w in t), reverse=True)
        assert got[term] == (len(f), f[0], f[9] if len(f) > 9 else 0)
