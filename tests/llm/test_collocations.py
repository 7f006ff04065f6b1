"""Collocations against plain counts, and the automaton against its definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorewell.llm import collocations as co


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(docs, most=3, least=10, top=2000, share=50):
    f = defaultdict(Counter)
    for text, lang in docs:
        for p in pieces(text):
            for d in range(1, most + 1):
                for i in range(len(p) - d + 1):
                    f[lang or "und"][tuple(p[i : i + d])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        often = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = set()
        for k, v in often.items():
            for i in range(len(k)):
                for j in range(i + 2, len(k) + 1):
                    if j - i < len(k) and 100 * v >= share * often.get(k[i:j], 10**18):
                        gone.add(k[i:j])
        rows = []
        for k, a in often.items():
            if k not in gone:
                score, _, l, r = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
                rows.append((-score, -a, " ".join(k).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, b int, key string").repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "w%d" % min(int(r.expovariate(0.15)), 40)
    out = [("".join(word() + r.choice([" ", "  ", "\t", " ", " ", ", ", "\n"]) for _ in range(r.randrange(1, 80))), r.choice(["en", "en", "de", None])) for _ in range(400)]
    out += [("New York City is new york city. " * 12, "en"), ("aé Bé aé bé " * 15, "de"), (None, "en"), ("", None), (" .,; ", "xx"), ("a b", "und"), ("long " * 30_000, "en")]
    return out + [out[5]] * 40


def test_as_a_plain_version(spark, texts):
    docs = docs_of(spark, texts)
    assert rows_of(co.collocations(docs)) == plain(texts)
    assert rows_of(co.collocations(docs, most=4, least=6, top=25, share=80)) == plain(texts, 4, 6, 25, 80)


def test_many_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(co, "blocks_for", lambda total: 7)
    assert rows_of(co.collocations(docs_of(spark, texts))) == plain(texts)


def test_one_row_repeated_is_dealt_apart(spark):
    rows = spark.range(0, 4000, numPartitions=8).selectExpr("1L as doc_id", "'same text here' as text", "'en' as lang")
    assert rows_of(co.collocations(rows)) == plain([("same text here", "en")] * 4000)


def test_empty_tables(spark, texts):
    assert co.collocations(docs_of(spark, texts).limit(0)).count() == 0
    assert co.collocations(docs_of(spark, [(None, None), ("a b", "en")])).count() == 0


def test_states_are_the_classes_of_equal_ends():
    r = np.random.default_rng(2)
    words = r.integers(0, 4, 300).astype(np.uint64)
    start = np.flatnonzero(r.random(300) < 0.1)
    reach = np.array([i - max([s for s in start if s <= i], default=0) for i in range(300)])
    auto = co.Automaton(words, reach, 4)
    ends, node = defaultdict(set), {}
    for i in range(300):
        for d in range(1, 5):
            if reach[i] >= d - 1:
                key = tuple(words[i - d + 1 : i + 1].tolist())
                ends[key].add(i)
                node[key] = (d, auto.at[d][i])
    states = auto.states()
    by_state = defaultdict(set)
    for key, (d, v) in node.items():
        assert auto.count[d][v] == len(ends[key])
        if d > 1:
            assert node[key[1:]] == (d - 1, auto.link[d][v])
            assert auto.inside(d, np.array([v]), 0, d - 1)[0] == node[key[:-1]][1]
        by_state[states[d][v]].add(frozenset(ends[key]))
    assert all(len(x) == 1 for x in by_state.values())  # one set of ends a state
    assert len(by_state) == len({frozenset(e) for e in ends.values()})  # and one state a set
