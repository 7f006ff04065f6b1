import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, b int, x string, dd string, q int, c0 string, virtual_slot int"


def rows(texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    return [(i if ids is None else ids[i], t, "en", "src0", None if t is None else len(t), 1, "x", None, 2, "c", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None: spark.createDataFrame(rows(texts, ids), DOCS).repartition(3)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and blank texts, a long text, ties, copies, near copies and shared passages."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    shared = words(rng, 30)
    out = [None, "", " \t\n ", "one", "one two", "One TWO", "éa ß", " ".join(words(rng, 20_000))]
    for w in base:
        out.append(" ".join(w))
        if rng.random() < 0.4:
            out.append("\n".join(w))
        if rng.random() < 0.5 and len(w) > 20:
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = "changed"
            out.append("  ".join(v))
        if rng.random() < 0.3:
            out.append(" ".join(w[: len(w) // 2] + shared + w[len(w) // 2 :]))
    out += [out[9], None, ""]
    return out
