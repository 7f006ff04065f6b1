"""Sections, windows and chunks against plain statements of the rules."""

import random
import re

from pyspark.sql import functions as F

from lorewell.operators import chunking


def plain_sections(body):
    out, stack, at = [], [], []

    def flush():
        text = "\n".join(at).strip()
        if text:
            out.append(([t for _, t in stack], text))

    for line in body.split("\n"):
        m = re.match(r"(#{1,3})\s+(\S.*)", line)
        if m:
            flush()
            at = []
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
        at.append(line)
    flush()
    return out


def plain_windows(text, p, o):
    if len(text) // 4 <= p:
        return [text.strip()]
    out, parts, size = [], [], 0
    for x in [y.strip() for y in text.split("\n\n") if y.strip()]:
        if size + len(x) + 2 > 4 * p and parts:
            out.append("\n\n".join(parts))
            tail = out[-1][-4 * o :]
            parts, size = ([tail] if tail.strip() else []), len(tail)
        parts.append(x)
        size += len(x) + 2
    return out + (["\n\n".join(parts)] if parts else [])


def plain_chunks(sections, p, o, least):
    out, wait = [], []

    def flush():
        if wait:
            out.append((wait[0][0], "\n\n".join(t for _, t in wait)))
            wait.clear()

    for path, text in sections:
        t, held = len(text) // 4, sum(len(x) // 4 for _, x in wait)
        if t > p:
            flush()
            out.extend((path, w) for w in plain_windows(text, p, o))
        elif t < least:
            wait.append((path, text))
            if held + t >= least:
                flush()
        elif wait and held + t <= p:
            wait.append((path, text))
            flush()
        else:
            flush()
            out.append((path, text))
    flush()
    return out


def bodies():
    rng = random.Random(11)
    docs = ["", "   ", "# only", "text before\n## B\nx\n# A\ny\n### C\nz\n#### not\n#nor", "##\n# \nx"]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 25)):
            head = rng.choice(["", "", "", "# ", "## ", "### ", "#### "])
            lines.append(head + " ".join("abc" for _ in range(1 + rng.randrange(12 if head else rng.choice([3, 30, 90])))))
            lines.append("")
        docs.append("\n".join(lines))
    return docs


def test_chunks(spark):
    docs = bodies()
    df = spark.createDataFrame(list(enumerate(docs)), "i int, body string")
    p, o, least = 40, 8, 12
    s = chunking.sections(F.col("body"))
    rows = df.select("i", s.alias("s"), chunking.windows(F.col("body"), p, o).alias("w"), chunking.built(s, p, o, least).alias("c")).collect()
    for r in rows:
        want = plain_sections(docs[r.i])
        assert [(list(x.headings_path), x.text) for x in r.s] == want
        assert r.w == plain_windows(docs[r.i], p, o)
        assert [(list(x.headings_path), x.text) for x in r.c] == plain_chunks(want, p, o, least)
