"""Substring dedup, quality rules and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.llm import columnar, components, jaccard_join, quality_rules, substring_dedup, support

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_windows():
    texts = ["a bb  a", "", None, "bb a", "é\x0bß a"]
    w = columnar.Words(*columnar.texts(pa.array(texts)))
    assert w.count.tolist() == [3, 0, 0, 2, 3]
    h = w.hash
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4
    at, win = w.windows(2)
    assert at.tolist() == [0, 1, 3, 5, 6] and win[1] == win[2]


def brute_counters(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]

    def repeats(k):
        grams = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({i + j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(k)})

    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeats(3), "n_bullets": sum(WORD.findall(x)[0][0] in "-*•" for x in lines), "n_ellipses": sum(WORD.findall(x)[-1].endswith(("...", "…")) for x in lines),
        "top_word": max(Counter(w).values(), default=0), "n_passage_words": repeats(8),
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#-.…•", max_size=40) | st.none(), max_size=6))
def test_counters(texts):
    c = quality_rules.Counters(*columnar.texts(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert {n: int(c[n][i]) for n in quality_rules.COUNTERS} == brute_counters(t)


def brute_dedup(pairs, k):
    least = {}
    for d, t in pairs:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            least[g] = min(least.get(g, 1 << 62), d if d is not None else 1 << 62)
    out = []
    for d, t in pairs:
        w = WORD.findall(t or "")
        gone = {i + j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < (d if d is not None else 1 << 62) for j in range(k)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("ids", [None, "mixed"])
def test_substring_dedup(spark, make, corpus, ids):
    ids = None if ids is None else [None if i % 9 == 0 else (i * 37) % 23 for i in range(len(corpus))]
    docs = make(corpus, ids)
    got = substring_dedup.substring_dedup(docs, window=5)
    assert got.columns == [*docs.columns, "dedup"]
    rows = got.collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.text) for r in rows) == brute_dedup([(i if ids is None else ids[i], t) for i, t in enumerate(corpus)], 5)
    for r in rows:
        assert sum(s.end - s.start for s in r.dedup.spans) == r.dedup.n_removed
        assert all(a.end < b.start for a, b in zip(r.dedup.spans, r.dedup.spans[1:]))


def brute_cut(text, gone):
    """text without the runs of words in gone and the breaks behind them, at the end those before."""
    if not gone:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    drop = set()
    for i in gone:
        drop |= set(range(*at[i]))
        if i + 1 < len(at) and not set(range(i, len(at))) <= gone:
            drop |= set(range(at[i][1], at[i + 1][0]))
        elif i and set(range(i, len(at))) <= gone:
            drop |= set(range(at[i - 1][1], at[i][0]))
    return "".join(c for k, c in enumerate(text) if k not in drop)


@pytest.mark.parametrize("ids", [None, "mixed"])
def test_substring_dedup_cuts_only_passages(spark, make, corpus, ids):
    few = [t for t in corpus if len(t or "") < 5000]
    head = "# Title\n\n\tß  one\r\ntwo "
    texts = [*few, head, head + " ".join(f"z{i}" for i in range(9)) + "\n\nend\n", "a\n" + "  ".join(f"z{i}" for i in range(9)) + " \n\n b\tc ", "z0 z1 z2 z3 z4\n", " y\n\nz0 z1 z2 z3 z4\n"]
    ids = None if ids is None else [None if i % 9 == 0 else (i * 37) % 23 for i in range(len(texts))]
    want, at = Counter(), list(range(len(texts))) if ids is None else ids
    kept = brute_dedup(list(zip(at, texts)), 5)
    rows = substring_dedup.substring_dedup(make(texts, ids), window=5, joined=False).collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, " ".join(WORD.findall(r.text or ""))) for r in rows) == kept
    least = {}
    big = lambda d: 1 << 62 if d is None else d
    for d, t in zip(at, texts):
        w = WORD.findall(t or "")
        for i in range(len(w) - 4):
            least[tuple(w[i : i + 5])] = min(least.get(tuple(w[i : i + 5]), 1 << 62), big(d))
    for d, t in zip(at, texts):
        w = WORD.findall(t or "")
        want[d, brute_cut(t, {i + j for i in range(len(w) - 4) if least[tuple(w[i : i + 5])] < big(d) for j in range(5)})] += 1
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert sum(r.dedup.n_removed > 0 for r in rows) > 10 and any(r.text is None for r in rows)


def test_pipeline_stage_leaves_whole_texts_alone(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    was = {r.doc_id: r.text for r in docs.collect()}
    spans = {r.doc_id: r.dedup.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    now = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, d).collect()}
    assert all(now[i] == t for i, t in was.items() if not spans[i]) and any(t != " ".join(WORD.findall(t)) for t in now.values())
    assert all(len(WORD.findall(now[i])) == len(WORD.findall(t)) - spans[i] for i, t in was.items())


def test_substring_dedup_empty(make):
    assert substring_dedup.substring_dedup(make([])).collect() == []


def brute_verdict(c):
    return not (
        c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] or 10 * c["n_symbols"] > c["word_chars"] or 10 * c["n_dup_lines"] > 3 * c["n_lines"] or not 2 * c["n_words"] <= c["word_chars"] <= 20 * c["n_words"]
        or (c["n_lines"] >= 4 and (10 * c["n_bullets"] > 9 * c["n_lines"] or 10 * c["n_ellipses"] > 3 * c["n_lines"])) or 100 * c["top_word"] > 30 * c["n_words"] or 100 * c["n_passage_words"] > 30 * c["n_words"]
    )


def test_quality_rules(spark, make, corpus):
    many = lambda n, start="", end="": "\n".join(f"{start}{' '.join(f'w{n}{i}{j}' for j in range(9))}{end}" for i in range(n))
    junk = [" ".join(["ab"] * 80), " ".join(f"w{i}##$" for i in range(60)), "\n".join(["same line here"] * 30), many(9, "- "), many(9, "•"), many(9, "", "..."), many(9, "", "… \t"), many(9), " ".join(f"the v{i}" for i in range(60))]
    junk.append(" ".join([*(f"u{i}" for i in range(40)), *(f"x{i}" for i in range(25)), *(f"x{i}" for i in range(25))]))
    junk.append("\n".join("same line" if i % 2 else " ".join(f"q{i}{j}" for j in range(5)) for i in range(30)))
    junk.append(" ".join(chr(0x4E00 + i) for i in range(60)))
    docs = make([*corpus, *junk]).withColumn("a map", F.create_map(F.lit("k"), F.lit("v")))
    reasons = set()
    for order in (None, [r.name for r in quality_rules.RULES], [r.name for r in reversed(quality_rules.RULES)]):
        for r in quality_rules.quality_rules(docs, order=order, counters=quality_rules.COUNTERS).collect():
            q = r.rules
            assert {n: q[n] for n in quality_rules.COUNTERS} == brute_counters(r.text)
            assert q.kept == brute_verdict(brute_counters(r.text)) and (q.rejected_by is None) == q.kept
            reasons.add(q.rejected_by)
        for r in quality_rules.quality_rules(docs, order=order).collect():
            assert r.rules.kept == brute_verdict(brute_counters(r.text))
    assert reasons >= {r.name for r in quality_rules.RULES} - {"passages"} and len(reasons) > 8
    order = quality_rules.cascade_order(docs)
    assert {n for n, *_ in order} == {r.name for r in quality_rules.RULES}
    assert quality_rules.quality_rules(make([])).collect() == []


def test_rules_by_rejection_per_cost():
    """dear rejects most, but cheap comes first; twin rejects nothing of what dear leaves."""
    names, rule = ("cheap", "dear", "twin", "never"), lambda n, reads: quality_rules.Rule(n, reads, None)
    rules = tuple(rule(n, r) for n, r in zip(names, (("n_words",), ("top_word",), ("n_repeat_words",), ("n_symbols",))))
    bad = {"cheap": [1, 1, 0, 0, 0, 0, 0, 0], "dear": [0, 1, 1, 1, 1, 1, 0, 0], "twin": [0, 0, 1, 1, 1, 1, 0, 0], "never": [0] * 8}
    got = quality_rules.ordered({k: np.array(v, bool) for k, v in bad.items()}, {"words": 1e-5, "top": 1e-4, "repeats": 2e-4, "symbols": 1e-6}, rules)
    assert [n for n, *_ in got] == ["cheap", "dear", "never", "twin"]
    assert [round(s, 3) for *_, s in got] == [0.25, round(4 / 6, 3), 0, 0]


def test_later_rules_see_fewer_texts(corpus):
    """A group of counters is computed for the texts only that the rules before let pass."""
    seen = {}

    class Watched(quality_rules.Counters):
        def __getitem__(self, name):
            if name not in self._have:
                seen.setdefault(name, []).append(self.n)
            return super().__getitem__(name)

        def of(self, rows):
            c = super().of(rows)
            c.__class__ = Watched
            return c

    by = {r.name: r for r in quality_rules.RULES}
    ranked = [by[n] for n in ("too_short", "symbols", "top_word", "passages")]
    why = quality_rules.judge(Watched(*columnar.texts(pa.array(corpus, pa.string()))), ranked)
    left = [int(np.sum((why < 0) | (why >= k))) for k in range(4)]
    assert seen == {"n_words": [left[0]], "n_symbols": [left[1]], "top_word": [left[2]], "n_passage_words": [left[3]]} and left[1] < left[0]


def shingles(t, k):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(pairs, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in pairs if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, j in {(i, j) for v in by.values() for i in v for j in v if i < j}:
        (a, x), (b, y) = sets[i], sets[j]
        if den * len(x & y) >= num * len(x | y) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in parent}


@pytest.mark.parametrize(("k", "num", "blocks"), [(3, 90, 8 << 20), (5, 80, 8 << 20), (3, 60, 400)])
def test_jaccard_join(spark, make, corpus, k, num, blocks):
    """With blocks of 400 bytes, clusters are compared in pairs of blocks."""
    pairs = list(enumerate(corpus))
    want = brute_components(pairs, k, num, 100)
    got = {r.node: r.component for r in jaccard_join.jaccard_components(make(corpus), k=k, num=num, cluster_bytes=blocks).collect()}
    assert got == {d: c for d, c in want.items() if list(want.values()).count(c) > 1}
    rows = jaccard_join.shingle_counts(make(corpus), "doc_id", "text", k).collect()
    assert {(r.doc_id, r.n_shingles) for r in rows} == {(d, len(shingles(t, k))) for d, t in pairs}


def test_jaccard_without_broadcasts(make, corpus, monkeypatch):
    """Beyond the bound of broadcasts tables meet by merge joins, with the same result."""
    monkeypatch.setattr(support, "BROADCAST_ROWS", -1)
    want = brute_components(list(enumerate(corpus)), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(make(corpus), k=3, num=90).collect()} == want


def test_jaccard_large_groups_and_repeated_ids(make, corpus):
    """Groups of more than three sets are dealt into pairs of blocks; ids that several texts have."""
    pairs = [(i % 61, t) for i, t in enumerate(corpus)]
    sets = {}
    for d, t in pairs:
        sets.setdefault(d, []).append(shingles(t, 3))
    parent = {d: d for d in sets}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for d, x in sets.items():
        for e, y in sets.items():
            if d < e and any(a and b and 10 * len(a & b) >= 6 * len(a | b) for a in x for b in y) and root(d) != root(e):
                parent[max(root(d), root(e))] = min(root(d), root(e))
    got = jaccard_join.jaccard_components(make(corpus, [d for d, _ in pairs]), k=3, num=60, cluster_bytes=400, group_rows=3).collect()
    want = {d: root(d) for d in sets}
    assert {r.node: r.component for r in got} == {d: c for d, c in want.items() if list(want.values()).count(c) > 1} and len(got) > 10


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (3, 60)])
def test_jaccard_split_groups(make, corpus, k, num):
    """Groups of more than two sets meet by rare elements; near copies of one text beside them."""
    rng = random.Random(31)
    base = [f"c{i}" for i in range(120)]
    near = [" ".join(base[:i] + [f"n{rng.randrange(9)}"] + base[i + 1 :]) for i in range(0, 120, 9)]
    texts = corpus + near
    want = brute_components(list(enumerate(texts)), k, num, 100)
    got = jaccard_join.jaccard_join(make(texts), k=k, num=num, split_rows=2, group_rows=6).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_shared_passage(make):
    """Documents that share most of their words, no two of them alike: few comparisons, and linear growth."""
    rng = random.Random(32)
    passage = [f"p{i}" for i in range(250)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(600)]
    docs = make(texts + [texts[0] + " tail"])
    pairs = []
    for split_rows in (100, 10**9):
        table = jaccard_join._table(docs, "doc_id", "text", 3)
        nodes = table.select("w", F.col("d").alias("r"))
        groups = jaccard_join.materialised(jaccard_join.candidate_groups(docs, "text", 3, 90, 100), "g")
        split = jaccard_join.split_groups(docs, nodes, groups, "doc_id", "text", 3, 90, 100, split_rows)
        pairs.append(sum(r["count"] * (r["count"] - 1) // 2 for r in split.groupBy("g").count().collect()))
    assert pairs[0] < 2_000 < 100_000 < pairs[1]
    linked = {(r.node, r.component) for r in jaccard_join.jaccard_components(docs, k=3, num=90).collect()}
    assert linked == {(0, 0), (600, 0)}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10_000), st.sampled_from([60, 80, 90]))
def test_linked_sets_share_a_first_element(n, seed, num):
    """Whatever the table of common elements says."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    out = int(rng.integers(0, len(a) * (100 - num) // 100 + 1))
    more = int(rng.integers(0, max(1, (len(a) - out) * 100 // num - len(a) + 1)))
    b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, more, dtype=np.int64).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    common = rng.integers(0, 4, 64).astype(np.uint8)
    e, of = jaccard_join.first_elements(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), common, num, 100)
    if len(b) and 100 * both >= num * (len(a) + len(b) - both):
        assert set(e[of == 0].tolist()) & set(e[of == 1].tolist())


def test_hashes_tell_opposites_apart(spark, make):
    """Two words of 1,024 letters that polynomials modulo 2**64 over bytes can't tell apart."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    docs = make([f"{one} {rest}", f"{two} {rest}", one, two, f"{one}\n{two}\n", f"{one * 40}\n{two * 40}"])
    rows = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert [rows[i].dedup.n_removed for i in range(6)] == [0] * 6
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, k=3, num=90).collect()}
    assert all(found[i] == i for i in range(6))
    assert all(r.rules.n_dup_lines == 0 for r in quality_rules.quality_rules(docs, counters=("n_dup_lines",)).collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 900), st.integers(0, 10_000))
def test_sketches_never_lie(n, seed):
    """Folded sketches differ in no more cells than the sets in elements, and linked sets always pass."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, len(a) // 3 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.int64).astype(np.uint64)]))
    size = np.array([len(a), len(b)])
    flat, at = jaccard_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    rows = [flat[i:j].tobytes() for i, j in zip(at, at[1:])]
    x, y = jaccard_join._folded(rows)
    both = len(np.intersect1d(a, b))
    assert int(np.bitwise_count(x ^ y).sum()) <= size.sum() - 2 * both
    if 10 * both >= 8 * (size.sum() - both):
        assert [v.tolist() for v in jaccard_join.alike(size, rows, 80, 100)] == [[0], [1]]


def test_sketches_are_folded_for_each_pair():
    """Sets of other sizes in a group don't make unlike sets look alike."""
    rng = np.random.default_rng(33)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)) for n in [40] * 3 + [900] * 70 + [3000] * 40]
    sets += [sets[5][:-20], sets[80][:-1000]]  # linked with the 6th, and the 81st of too different a size
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    flat, cut = jaccard_join.sketches(np.concatenate(sets), at)
    rows = [flat[i:j].tobytes() for i, j in zip(cut, cut[1:])]
    assert [v.tolist() for v in jaccard_join.alike(np.diff(at), rows, 80, 100)] == [[5], [113]]


@pytest.mark.parametrize("most", [-1, 2_000_000])
def test_jaccard_shortened_hashes(make, corpus, monkeypatch, most):
    """Keys and sets that are mistaken for each other cost comparisons, no link; so do elements of all sets."""
    monkeypatch.setattr(jaccard_join, "_dropped", lambda bits: 58)
    monkeypatch.setattr(support, "BROADCAST_ROWS", most)
    want = brute_components(list(enumerate(corpus)), 3, 80, 100)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(make(corpus), k=3, num=80, split_rows=2).collect()} == want


def test_jaccard_splits_without_elements_on_disk(make, monkeypatch):
    """Splitting groups writes groups only, no elements of their sets."""
    rng, written = random.Random(34), []
    passage = [f"p{i}" for i in range(250)]
    docs = make([" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(300)])
    kept = support.materialised
    monkeypatch.setattr(jaccard_join, "materialised", lambda df, name: written.append((name, kept(df, name))) or written[-1][1])
    jaccard_join.jaccard_components(docs, k=3, num=90, split_rows=20).collect()
    assert "split-groups" in dict(written)
    assert [name for name, df in written if "binary" in dict(df.dtypes).values()] == ["shingle-sets"]
    assert sum(df.count() for name, df in written if name != "shingle-sets") < 300 * 40


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_without_ids(spark, monkeypatch, most):
    """Beyond the bound of broadcasts ids that lie close together go as bitmaps, and wide rows aren't dealt out."""
    monkeypatch.setattr(support, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(support, "BITMAP_BYTES", most)
    ids = [None, -70_000, -32_769, -32_768, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 500_000]
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*ids, *[i + 1 for i in ids[1:]], 3]], "doc_id long, text string")
    gone = support.materialised(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "gone")
    left = support.without(docs, gone, "doc_id")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.join(gone, "doc_id", "left_anti").collect())
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert left.columns == docs.columns and ("SortMergeJoin" in plan) == (not most)


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, most):
    """With most=0, nodes of more than two edges are hot and the rest is merged."""
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, 500 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in edges:
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = components.components(spark.createDataFrame(edges, "a long, b long"), most=most, hot=2).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: root(x) for x in linked} and len(found) == len(linked)


def test_jaccard_null_and_equal_ids(make):
    t = " ".join(f"w{i}" for i in range(30))
    got = jaccard_join.jaccard_join(make([t, t, t, "other text", "third one"], [None, 5, 7, 7, 9]), k=3).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(False, 5, 5), (False, 7, 5), (False, 7, 5), (False, 9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_join(make([])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10_000), st.sampled_from([60, 80, 90]))
def test_linked_sets_share_a_signature(n, seed, num):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    out = int(rng.integers(0, len(a) * (100 - num) // 100 + 1))
    more = int(rng.integers(0, max(1, (len(a) - out) * 100 // num - len(a) + 1)))
    b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 63, more, dtype=np.int64).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    sig, of = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
    if len(b) and 100 * both >= num * (len(a) + len(b) - both):
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_digest_of_kept_words(spark, make):
    docs = make([" ".join(f"w{i}" for i in range(20)), "x " + " ".join(f"w{i}" for i in range(20)) + " y"])
    text = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs).collect()}
    assert text[1] == "x y" and hashlib.sha256(text[1].encode()).hexdigest() == hashlib.sha256(b"x y").hexdigest()


def test_hash_of_random_windows_is_stable():
    rng = random.Random(1)
    w = [str(rng.randrange(50)) for _ in range(500)]
    x = columnar.Words(*columnar.texts(pa.array([" ".join(w), "pad " + " ".join(w)])))
    at, h = x.windows(13)
    one, two = h[x.text[at] == 0], h[x.text[at] == 1]
    assert (one == two[1:]).all() and len(set(one.tolist())) == len({tuple(w[i : i + 13]) for i in range(488)})
