"""Quality rules as a short-circuit cascade.

A document is kept if it passes every rule.  Rules read counters, which are computed group by group
when a rule first needs them.  On a sample the seconds of each group and each rule's verdicts are
taken; the rules are then ordered one by one: next comes the rule that rejects most of the documents
that the rules before it let pass, per second of the groups that it needs and they didn't.  A document
that a rule rejects is not shown to the later ones: counters of a later group are computed for the
documents left only.  The verdict is the same in any order, only the work differs.

  words     n_words, word_chars
  symbols   n_symbols, of ``[#*$%&|<>]``
  lines     n_lines (lines with a word), n_dup_lines (equal to an earlier line with a word)
  repeats   n_repeat_words, words in 3-word windows found twice or more in the text
  marks     n_bullets and n_ellipses, lines that start with ``-``, ``*`` or a bullet, or end with an ellipsis
  top       top_word, how often the commonest word is there
  passages  n_passage_words, words in 8-word windows found twice or more in the text
Windows, words and lines are compared by 64-bit hash.

Defined cases: null text counts as empty and fails `too_short`; empty tables give empty results;
repeated rows are judged each for itself; other columns, of any type, pass through, except one named
like `out`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import U, Words, hashed, mix, pieces, runs, texts
from .support import numbered

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
GROUPS = {
    "words": ("n_words", "word_chars"),
    "symbols": ("n_symbols",),
    "lines": ("n_lines", "n_dup_lines"),
    "repeats": ("n_repeat_words",),
    "marks": ("n_bullets", "n_ellipses"),
    "top": ("top_word",),
    "passages": ("n_passage_words",),
}
COUNTERS = tuple(c for group in GROUPS.values() for c in group)
_GROUP = {c: g for g, cs in GROUPS.items() for c in cs}


class Counters:
    """Counters of a run of texts, each group computed when first asked for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, have: dict[str, np.ndarray] | None = None):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        self._have, self._split = dict(have or {}), None

    @property
    def words(self) -> Words:
        if self._split is None:
            self._split = Words(self.buf, self.offsets)
        return self._split

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._have:
            getattr(self, f"_{_GROUP[name]}")()
        return self._have[name]

    def has(self, names: tuple[str, ...]) -> bool:
        return all(n in self._have for n in names)

    def of(self, rows: np.ndarray) -> Counters:
        """The counters of some of the texts, with what is known of them."""
        size = np.diff(self.offsets)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        buf = self.buf[np.arange(at[-1]) + np.repeat(self.offsets[:-1][rows] - at[:-1], size)]
        return Counters(buf, at, {k: v[rows] for k, v in self._have.items()})

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.words.offsets[1:]] - sums[self.words.offsets[:-1]]

    def _words(self) -> None:
        w = self.words
        self._have["n_words"] = w.count.astype(np.int64)
        lead = (w.raw & 0xC0) != 0x80  # first bytes of code points
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        self._have["word_chars"] = self._per_text(lead & ~space[w.raw])

    def _symbols(self) -> None:
        self._have["n_symbols"] = self._per_text(_SYMBOL[self.words.raw])

    def _lines_with_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line that has a word."""
        w = self.words
        cut = np.flatnonzero(w.raw == 0x0A)
        start = np.sort(np.concatenate([w.offsets[:-1], cut + 1]))
        end = np.append(start[1:], len(w.raw))
        end = np.where(np.isin(end, cut + 1), end - 1, end)
        text = np.searchsorted(w.offsets, start, "right") - 1
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        return start[has], end[has], text[has]

    def _lines(self) -> None:
        start, end, text = self._lines_with_words()
        h = hashed(self.words.raw, start, end)
        self._have["n_lines"] = np.bincount(text, minlength=self.n).astype(np.int64)
        key = mix(h ^ mix(text.astype(U)))
        order = np.argsort(key, kind="stable")
        first = np.zeros(len(key), bool)
        first[order[runs(key[order])]] = True
        self._have["n_dup_lines"] = np.bincount(text[~first], minlength=self.n).astype(np.int64)

    def _marks(self) -> None:
        w = self.words
        start, end, text = self._lines_with_words()
        first, last = w.start[np.searchsorted(w.start, start)], w.end[np.searchsorted(w.start, end) - 1]
        raw = np.concatenate([np.zeros(3, np.uint8), w.raw, np.zeros(3, np.uint8)])  # three bytes on either side
        at = lambda place, mark: np.logical_and.reduce([raw[place + 3 + k] == b for k, b in enumerate(mark)])
        bullet = at(first, b"-") | at(first, b"*") | at(first, "•".encode())
        ellipsis = (at(last - 3, b"...") & (last - 3 >= start)) | at(last - 3, "…".encode())
        self._have["n_bullets"] = np.bincount(text[bullet], minlength=self.n).astype(np.int64)
        self._have["n_ellipses"] = np.bincount(text[ellipsis], minlength=self.n).astype(np.int64)

    def _top(self) -> None:
        w = self.words
        key = mix(w.hash ^ mix(w.text.astype(U) + U(1)))
        order = np.argsort(key)
        start = runs(key[order])
        top = np.zeros(self.n, np.int64)
        np.maximum.at(top, w.text[order[start]], np.diff(np.append(start, len(key))))
        self._have["top_word"] = top

    def _repeats(self) -> None:
        self._have["n_repeat_words"] = self._in_repeats(3)

    def _passages(self) -> None:
        self._have["n_passage_words"] = self._in_repeats(8)

    def _in_repeats(self, size: int) -> np.ndarray:
        """Words in windows of that size which are found twice or more in the text."""
        w = self.words
        at, h = w.windows(size)
        key = mix(h ^ mix(w.text[at].astype(U) + U(1)))
        order = np.argsort(key)
        start = runs(key[order])
        many = np.diff(np.append(start, len(key)))
        at = at[order][np.repeat(many > 1, many)]
        step = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + size, -1)
        return np.bincount(w.text[np.cumsum(step[:-1]) > 0], minlength=self.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """A rule rejects where `rejects(counters)` is true; it looks at the counters that it `reads` only."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


RULES = (
    Rule("too_short", ("n_words",), lambda c: c["n_words"] < 50),
    Rule("repetitive", ("n_repeat_words", "n_words"), lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
    Rule("symbols", ("n_symbols", "word_chars"), lambda c: 10 * c["n_symbols"] > c["word_chars"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda c: 10 * c["n_dup_lines"] > 3 * c["n_lines"]),
    Rule("word_length", ("word_chars", "n_words"), lambda c: (c["word_chars"] > 20 * c["n_words"]) | (c["word_chars"] < 2 * c["n_words"])),
    Rule("bullets", ("n_bullets", "n_lines"), lambda c: (c["n_lines"] >= 4) & (10 * c["n_bullets"] > 9 * c["n_lines"])),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda c: (c["n_lines"] >= 4) & (10 * c["n_ellipses"] > 3 * c["n_lines"])),
    Rule("top_word", ("top_word", "n_words"), lambda c: 100 * c["top_word"] > 30 * c["n_words"]),
    Rule("passages", ("n_passage_words", "n_words"), lambda c: 100 * c["n_passage_words"] > 30 * c["n_words"]),
)


def ordered(bad: dict[str, np.ndarray], seconds: dict[str, float], rules: tuple[Rule, ...], paid: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected of the documents that reach it) in the order to run the
    rules, from each rule's verdicts on one sample and the seconds a document of each group of counters;
    `paid` are groups that are computed anyway.  A rule that reads only what is there costs a microsecond."""
    left, have, out, todo = np.ones(len(next(iter(bad.values()), ())), bool), set(paid), [], list(rules)
    while todo:
        cost = lambda r: 1e-6 + sum(seconds.get(g, 0.0) for g in {_GROUP[c] for c in r.reads} - have)  # noqa: E731, B023
        share = lambda r: float(bad[r.name][left].mean()) if left.any() else 0.0  # noqa: E731, B023
        best = min(todo, key=lambda r: (-share(r) / cost(r), cost(r), r.name))
        out.append((best.name, cost(best), share(best)))
        todo.remove(best)
        have |= {_GROUP[c] for c in best.reads}
        left &= ~bad[best.name]
    return out


def cascade_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, counters: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """ordered() by a sample of at most `sample_rows` documents; `counters` are computed anyway."""
    share = min(1.0, 1.5 * sample_rows / max(1, docs.count()))  # so that no task sees more than its share of the sample
    sample = docs.select(F.col(text).alias("t")).sample(share, seed=5).limit(sample_rows)

    def timed(batches):
        for batch in batches:
            for a, b in pieces(batch, "t"):
                c = Counters(*texts(batch.column("t").slice(a, b - a)))
                spent = []
                for names in GROUPS.values():
                    began = time.perf_counter()
                    c[names[0]]
                    spent.append(time.perf_counter() - began)
                # one row of a few numbers for each document of the bounded sample
                verdicts = np.array([np.asarray(r.rejects(c), bool) for r in rules]).T
                yield pa.RecordBatch.from_pydict({"bad": pa.array(verdicts.tolist(), pa.list_(pa.bool_())), "s": pa.array([[x / (b - a) for x in spent]] * (b - a), pa.list_(pa.float64()))})

    seen = sample.mapInArrow(timed, "bad array<boolean>, s array<double>").collect()
    bad = np.array([r["bad"] for r in seen], bool).reshape(-1, len(rules))
    mean = np.array([r["s"] for r in seen]).reshape(-1, len(GROUPS)).mean(0) if seen else np.zeros(len(GROUPS))
    return ordered({r.name: bad[:, k] for k, r in enumerate(rules)}, dict(zip(GROUPS, mean.tolist(), strict=True)), rules, tuple({_GROUP[c] for c in counters}))


def judge(whole: Counters, ranked: list[Rule]) -> np.ndarray:
    """The place of the rule that rejects each text, or -1.  Counters that aren't there yet are computed
    for the texts that are left."""
    why, left, now, place = np.full(whole.n, -1), np.arange(whole.n), whole, np.arange(whole.n)
    for k, rule in enumerate(ranked):
        if not len(left):
            break
        if len(place) < now.n and not now.has(rule.reads):
            now, place = now.of(place), np.arange(len(place))
        bad = np.asarray(rule.rejects({c: now[c][place] for c in rule.reads}), bool)
        why[left[bad]] = k
        left, place = left[~bad], place[~bad]
    return why


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, counters: tuple[str, ...] = (), out: str = "rules") -> DataFrame:
    """docs with a struct `out` of kept, rejected_by (a rule that rejects it, null if kept), n_rules (the
    rules that it was shown to) and the counters asked for, which are computed for all rows.
    order: names of rules, from cascade_order() on docs if none is given."""
    docs = docs.drop(out)
    order = order or [x[0] for x in cascade_order(docs, text, rules, counters=counters)]
    by_name = {r.name: r for r in rules}
    ranked = [by_name[n] for n in order]
    plain, names = numbered(docs)
    t = f"c{names.index(text)}"
    passed = plain.columns
    fields = T.StructType([T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), T.StructField("n_rules", T.LongType()), *[T.StructField(c, T.LongType()) for c in counters]])
    schema = T.StructType([*plain.schema.fields, T.StructField("q", fields)])

    def judged(batches):
        for batch in batches:
            for a, b in pieces(batch, t):
                part = batch.slice(a, b - a)
                whole = Counters(*texts(part.column(t)))
                asked = [pa.array(whole[c], pa.int64()) for c in counters]
                why = judge(whole, ranked)
                shown = pa.array(np.where(why < 0, len(ranked), why + 1).astype(np.int64))
                values = [pa.array(why < 0), pa.array([None if k < 0 else ranked[k].name for k in why], pa.string()), shown, *asked]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(values, names=fields.names)], names=[*passed, "q"])

    return plain.mapInArrow(judged, schema).toDF(*names, out)


def op5_query(spark, sf_dir):
    from .support import table

    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    done = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), counters=base)
    q = [F.col(f"rules.{c}").alias(c) for c in base]
    failed = (F.col("rules.n_words") < 50) | (100 * F.col("rules.n_repeat_words") > 50 * F.col("rules.n_words"))
    return done.select("doc_id", *q, failed.alias("base_failed"), F.col("rules.kept").alias("kept"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullets,
             count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipses
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
top AS (SELECT rid, max(k) AS top_word FROM (SELECT rid, v, count(*) AS k FROM (SELECT rid, unnest(w) AS v FROM d) GROUP BY rid, v) GROUP BY rid),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS k
      FROM (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
z AS (SELECT rid, count(DISTINCT j) AS n_passage_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM y WHERE k > 1) GROUP BY rid),
x AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2]) AS k FROM x),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM c WHERE k > 1) GROUP BY rid),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(top_word, 0) AS top_word, coalesce(n_passage_words, 0) AS n_passage_words
      FROM d LEFT JOIN n USING (rid) LEFT JOIN r USING (rid) LEFT JOIN top USING (rid) LEFT JOIN z USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
           OR (n_lines >= 4 AND 10 * n_bullets > 9 * n_lines) OR (n_lines >= 4 AND 10 * n_ellipses > 3 * n_lines)
           OR 100 * top_word > 30 * n_words OR 100 * n_passage_words > 30 * n_words) AS kept
FROM b
"""
