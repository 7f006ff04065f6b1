"""Personal data against Python's regular expressions, validators and context."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorewell.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in p.finditer(text or "") if fits(k, m.group())]


def found(docs, **options):
    return {r["doc_id"]: [tuple(s) for s in r["pii"]] for r in pii.pii(docs, **options).select("doc_id", "pii").collect()}


def test_base_spans_as_the_patterns_say(make):
    r = random.Random(11)
    parts = ["a@.b-", "0123 -", "1.2", "+1 ()-.", "ab@c.d _x", "é😀1", "0  1", "a.b@c.de ", "4111 1111 1111 1111 ", "10.0.0.255 "]
    texts = [None, ""] + ["".join(r.choice(r.choice(parts)) if r.random() < 0.8 else r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    got = found(make(texts))
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[0] in BASE] == plain(t), t
        assert all(s[3] == (t or "")[s[1] : s[2]] for s in got[i])


def test_many_matches_and_long_runs(make):
    texts = ["1.2.3.4 " * 3000, "x@y.z," * 3000, "a@b" + ".c" * 50_000, "a" * 200_000, "1" * 200_000, "+1" * 50_000]
    got = found(make(texts))
    assert [s[1:3] for s in got[0] if s[0] == "ip"] == [(8 * k, 8 * k + 7) for k in range(3000)]
    assert [s[1:3] for s in got[1] if s[0] == "email"] == [(6 * k, 6 * k + 5) for k in range(3000)]
    assert [s[1:3] for s in got[2] if s[0] == "email"] == [(0, 100_003)]
    assert got[3] == [] and got[4] == [] and got[5] == []


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("pay to DE89370400440532013000 now", [("iban", 7, 29)]),
        ("pay to DE89370400440532013001 now", []),
        ("konto DE89 3704 0044 0532 0130 00.", [("iban", 6, 33)]),
        ("xDE89370400440532013000", []),
        ("her ssn 123-45-6789", [("national_id", 8, 19)]),
        ("no. 123-45-6789", []),
        ("her ssn 000-45-6789", []),
        ("model part ssn 123-45-6789", []),
        ("call (415) 555-2671 or so", [("local_phone", 5, 19)]),
        ("room (415) 555-2671 or so", []),
        ('token = "59ea3612aa6fdb1d4556"', [("secret", 9, 29)]),
        ("see 59ea3612aa6fdb1d4556", []),
        ("token = abcdefghijabcdefghijk", []),
    ],
)
def test_words_nearby_decide(make, text, spans):
    assert [s[:3] for s in found(make([text]))[0] if s[0] not in BASE] == spans


def test_scores(make):
    got = found(make(["mail a@b.cc", "a@b.cc", "version 1.2.3.4", "server 1.2.3.4"]))
    assert [got[k][0][4] for k in range(4)] == [1.0, 0.6, 0.2, 0.9]
    strict = found(make(["DE89370400440532013000", "a@b.cc"]), threshold=0.9)
    assert strict[0] == [] and len(strict[1]) == 1  # base kinds stay


def test_masked(make):
    docs = make(["to a@b.cc, +1 (487) 555-7209", None, "", "nothing"])
    assert {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()} == {0: "to <email>, <phone>", 1: None, 2: "", 3: "nothing"}
    assert pii.masked(docs).columns == docs.columns


def test_columns_copies_and_empty_tables(make):
    docs = make(["a@b.cc", "a@b.cc"], [1, 1]).withColumn("pii", F.lit(1))
    done = pii.pii(docs)
    assert done.columns == [*[c for c in docs.columns if c != "pii"], "pii"] and done.count() == 2
    assert pii.pii(docs.limit(0)).count() == 0
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
