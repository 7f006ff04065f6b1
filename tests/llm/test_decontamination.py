"""Probes that many items share: pieces are laid elsewhere, and results stay those of a plain search."""

import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lorewell.llm import decontamination as de

OPENING = "which of the following is"


def distance(item, passage):
    """Least edit distance of item to any run of passage."""
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(passage, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_items_that_begin_alike(monkeypatch):
    r = random.Random(1)
    items = [f"{OPENING} " + " ".join(f"w{r.randrange(5000)}" for _ in range(15)) for _ in range(1000)]
    text = " ".join(f"{OPENING} " + " ".join(f"x{r.randrange(5000)}" for _ in range(3)) for _ in range(500))
    known = de.Items(list(range(1000)), pa.array(items), 0.15, 5, 8)
    tried = []
    plain = de.myers
    monkeypatch.setattr(de, "myers", lambda *a: tried.append(1) or plain(*a))
    began = time.perf_counter()
    assert de.matches(known, pa.array([text])) == []
    assert time.perf_counter() - began < 0.2 and not tried
    assert de.matches(known, pa.array([f"{text} {items[7]} end"])) == [(0, 7, 0, 4000, 4020)]


def test_items_of_one_common_run_still_match():
    items = [f"{OPENING} {OPENING} {OPENING} {OPENING} w{k}" for k in range(30)]  # no probe is rare
    known = de.Items(list(range(30)), pa.array(items), 0.15, 5, 8)
    got = de.matches(known, pa.array([f"so {OPENING} {OPENING} {OPENING} {OPENING} w3"]))
    assert {(i, d) for _, i, d, _, _ in got} == {(k, int(k != 3)) for k in range(30)}


@given(st.lists(st.integers(1, 5), min_size=4, max_size=14), st.integers(1, 3), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_runs_are_laid_at_the_least_cost(cost, pieces, probe):
    if len(cost) + probe - 1 < pieces * probe:
        return
    total, starts = de.laid(np.array(cost, float), pieces, probe)

    def every(first, left):
        if not left:
            yield ()
        for i in range(first, len(cost)) if left else ():
            yield from ((i, *rest) for rest in every(i + probe, left - 1))

    assert total == min(sum(cost[i] for i in x) for x in every(0, pieces)) == sum(cost[i] for i in starts)
    assert all(b - a >= probe for a, b in zip(starts, starts[1:], strict=False))


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_matches_are_those_of_a_plain_search(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh")
    opening = [word() for _ in range(4)]
    items = [opening + [word() for _ in range(r.randrange(6, 20))] for _ in range(12)]
    texts = []
    for _ in range(6):
        t = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            x = list(r.choice(items))
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = r.choice(["new", *x])
            t += x + [word() for _ in range(r.randrange(5))]
        texts.append(t)
    known = de.Items(list(range(12)), pa.array([" ".join(x) for x in items]), 0.15, 5, 8)
    got = {(row, i): d for row, i, d, _, _ in de.matches(known, pa.array([" ".join(t) for t in texts]))}
    expected = {}
    for row, t in enumerate(texts):
        for i, x in enumerate(items):
            d = distance(x, t)
            if len(x) >= 8 and d <= int(len(x) * 0.15):
                expected[row, i] = d
    assert got == expected
