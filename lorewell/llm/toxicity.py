"""Toxicity by a fuzzy lexicon.

The lexicon (whole words, and stems whose words vary) is learned from labelled documents, and so
are exceptions: words like an entry that clean documents have.  Its trie
is intersected with Levenshtein automata into one deterministic automaton, determinised as words
are read, that finds lexicon entries with up to one edit (two for entries of nine letters or more).
Each hit gets a context score from the window around it, 1 for quotation and 0 for abuse: 1 between a
pair of quotation marks of one line, and after a word of reporting the more the nearer that is.  The
hit counts as quotation by that score and as abuse by the rest.  A logistic model over the sums gives
the score.

Learning uses a bounded sample (`most_toxic` and `most_clean` labelled documents, chosen by hash,
one of each group of near copies): half of it proposes entries, the other half confirms them and
fits the model.  An entry is in a hundredth of the half's toxic documents at least, so the sample bounds
the lexicon, and its words bound the exceptions.  Scoring covers every whole text.

Defined cases: null, empty and wordless texts score like any text without hits; repeated rows score
alike; a label of null is not used; without usable labels the lexicon is empty and all score alike;
other columns pass through, except one named like `out`.  A pair of quotation marks with more than
LONGEST_QUOTE words between them doesn't make a quotation; entries under five letters are found as they
are written only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import WORD_BASE, Words, mix, pieces, ranged, running, texts
from .support import materialised, numbered

WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
#: Quotation marks that open, close, and do either.
OPENING, CLOSING, EITHER = "\u201e\u00ab\u2039", "\u00bb\u203a", "\"\u201c\u201d"
QUOTES = re.compile(f"[{OPENING}{CLOSING}{EITHER}\\n]")
#: Log-odds that a hit of each kind is taken to add before the sample speaks.
PRIOR = (10.0, 9.0, 10.0, 6.0, 1.0)
#: Words of reporting or of talk about words, in English, German, French and Spanish; a parameter of the scorer.
REPORTING = frozenset(
    "said says wrote writes quoted quote called term word slur quoting reported "
    "sagte sagt schrieb schreibt zitierte zitiert zitat genannt wort begriff "
    "dit disait écrit écrivait cité citation appelé mot terme "
    "dijo dice escribió escribe citó cita llamado palabra término".split()
)
CONTEXT = 5
#: Words that a pair of quotation marks may have between them.
LONGEST_QUOTE = 60
KINDS = ("exact", "fuzzy", "stem", "fuzzy_stem", "quoted")


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automata intersected with the trie of a lexicon, determinised state by state.

    A state is a set of (trie node, edits so far), of each node with the fewest edits."""

    def __init__(self, words: list[str], stems: list[str], most_states: int = 20_000):
        self.child: list[dict[str, int]] = [{}]
        self.limit, self.stem, self.reach = [-1], [-1], [0]
        for entries, kind in ((words, self.limit), (stems, self.stem)):
            for entry in entries:
                node, budget = 0, edits_for(len(entry) if kind is self.limit else len(entry) - 1)
                self.reach[0] = max(self.reach[0], budget)
                for ch in entry:
                    if ch not in self.child[node]:
                        self.child[node][ch] = len(self.child)
                        self.child.append({})
                        self.limit.append(-1)
                        self.stem.append(-1)
                        self.reach.append(0)
                    node = self.child[node][ch]
                    self.reach[node] = max(self.reach[node], budget)
                kind[node] = budget
        self.letters = frozenset(ch for c in self.child for ch in c)
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.verdict: list[tuple[int, int]] = []
        self.root = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # an edit may skip a letter of the entry
            n = todo.pop()
            e = nodes[n] + 1
            for c in self.child[n].values():
                if e <= self.reach[c] and e < nodes.get(c, 99):
                    nodes[c] = e
                    todo.append(c)
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            word = min((e for n, e in nodes.items() if e <= self.limit[n]), default=9)
            stem = min((e for n, e in nodes.items() if e <= self.stem[n]), default=9)
            self.verdict.append((word, stem))
        return self.ids[key]

    def _next(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.sets[state]:
            c = self.child[n].get(ch)
            if c is not None and e < out.get(c, 99):
                out[c] = e
            if e < self.reach[n]:
                if e + 1 < out.get(n, 99):  # an extra letter in the word
                    out[n] = e + 1
                for c in self.child[n].values():  # a changed letter
                    if e + 1 <= self.reach[c] and e + 1 < out.get(c, 99):
                        out[c] = e + 1
        got = self.step[state][ch] = self._state(out)
        return got

    def match(self, word: str) -> int:
        """The kind of hit as an index of KINDS, or -1."""
        if len(self.sets) > self.most_states:
            self._reset()
        state, stem = self.root, 9
        for ch in word:
            if ch not in self.letters:
                ch = ""
            after = self.step[state].get(ch)
            state = self._next(state, ch) if after is None else after
            if not self.sets[state]:
                break
            stem = min(stem, self.verdict[state][1])
        else:
            exact = self.verdict[state][0]
            if exact < 9:
                return 0 if exact == 0 else 1
        return 2 if stem == 0 else 3 if stem < 9 else -1


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    bias: float = -3.0


class Scorer:
    """Hit counts of texts; one a Python worker, with a bounded memory of words seen."""

    def __init__(self, model: Model, most_words: int = 200_000, reporting: frozenset[str] = REPORTING):
        self.reporting = reporting
        self.automaton = Automaton(model.words, model.stems)
        self.exceptions = frozenset(model.exceptions)
        self.seen: dict[str, int] = {}
        self.most_words = most_words

    def kind(self, word: str) -> int:
        k = self.seen.get(word)
        if k is None:
            if len(self.seen) >= self.most_words:
                self.seen.clear()
            k = self.seen[word] = -1 if word in self.exceptions else self.automaton.match(word)
        return k

    def counts(self, text: str | None) -> list[float]:
        """Hits of each of KINDS, each shared between its kind and quotation by its context score."""
        out = [0.0] * len(KINDS)
        low = (text or "").lower()
        hits = {w: k for w in set(WORD.findall(low)) if (k := self.kind(w)) >= 0}
        if not hits:
            return out
        tokens = list(WORD.finditer(low))
        spans = quotations(low)
        for i, m in enumerate(tokens):
            k = hits.get(m[0])
            if k is not None:
                quoted = self.context(tokens, spans, i)
                out[k] += 1 - quoted
                out[4] += quoted
        return out

    def context(self, tokens: list[re.Match], spans: list[tuple[int, int]], i: int) -> float:
        """The context score of the i-th word: 1 within a quotation of LONGEST_QUOTE words at most; else by
        the nearest word of reporting before it, from 1 next to it down to 1 / CONTEXT."""
        at = bisect_right(spans, (tokens[i].start(), 1 << 60)) - 1
        if at >= 0 and tokens[i].end() <= spans[at][1]:
            first, last = max(0, i - LONGEST_QUOTE), min(len(tokens) - 1, i + LONGEST_QUOTE)
            if tokens[first].start() <= spans[at][0] or first == 0:
                if spans[at][1] <= tokens[last].end() + 1 or last == len(tokens) - 1:
                    return 1.0
        near = next((d for d in range(1, min(CONTEXT, i) + 1) if tokens[i - d][0] in self.reporting), None)
        return 0.0 if near is None else 1 - (near - 1) / CONTEXT


def quotations(text: str) -> list[tuple[int, int]]:
    """The places between paired quotation marks, in order; a pair stands in one line."""
    out: list[tuple[int, int]] = []
    start = -1
    for m in QUOTES.finditer(text):
        if m[0] == "\n":
            start = -1
        elif m[0] in OPENING or (m[0] in EITHER and start < 0):
            start = m.end()
        elif start >= 0:
            out.append((start, m.start()))
            start = -1
    return out


def _features(counts: np.ndarray) -> np.ndarray:
    """0 without hits, 1 for one hit, slowly more for more."""
    counts = np.asarray(counts, float)
    return np.minimum(counts, 1) + 0.25 * np.log(np.maximum(counts, 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float = -5.0, ridge: float = 0.5, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Damped Newton steps, with weights and bias drawn to their priors: a kind of hit that the
    sample doesn't have keeps its prior weight.  x is a bounded sample with few columns."""
    x1, goal = np.hstack([x, np.ones((len(x), 1))]), np.append(prior, bias)
    w = goal.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w)), x1.T @ (p - y) + ridge * (w - goal))
        w -= step * min(1.0, 1 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _pieces(batches, text: str):
    """Batches of a few texts each, so that what Python holds at once is bounded by bytes."""
    for b in batches:
        for i, j in pieces(b, text):
            yield b.slice(i, j - i)


def _near_copy_key(batch: pa.RecordBatch) -> list[int]:
    """The least hash of a text's 5-word windows, the same for most near copies; of a shorter text the
    hash of its words."""
    words = Words(*texts(batch.column("t")), lower=True)
    at, h = words.windows(5)
    out = np.zeros(batch.num_rows, np.uint64)
    if len(at):
        of = words.text[at]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[first]] = np.minimum.reduceat(h, first)
    whole = ranged(running(words.hash, WORD_BASE), words.first[:-1], words.first[1:], WORD_BASE) + words.count.astype(np.uint64)
    short = words.count < 5
    out[short] = mix(whole)[short]
    return out.view(np.int64).tolist()


def training_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, most_toxic: int, most_clean: int) -> DataFrame:
    """(y, k, t) of at most that many labelled documents, one of each group of near copies."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("d"), (F.col(label) > 0).cast("int").alias("y")).groupBy("d").agg(F.max("y").alias("y"))
    pick = lambda y, n: usable.filter(F.col("y") == y).orderBy(F.xxhash64("d"), "d").limit(n)
    ids = pick(1, most_toxic).unionByName(pick(0, most_clean))  # bounded, so it may be broadcast
    rows = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).join(F.broadcast(ids), "d")

    def keyed(batches):
        for b in _pieces(batches, "t"):
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "k": pa.array(_near_copy_key(b), pa.int64()), "t": b.column("t")})

    # of near copies the first text stays, with the label that most of them have: no run differs from another
    one = rows.mapInArrow(keyed, "y int, k long, t string").groupBy("k").agg(F.round(F.avg("y")).cast("int").alias("y"), F.min("t").alias("t"))
    return materialised(one.select("y", "k", "t"), "toxicity-sample")


def learn(sample: DataFrame) -> Model:
    """A lexicon and its weights from a training_sample()."""
    half = F.pmod(F.xxhash64("k"), F.lit(2))

    def words_of(batches):
        for b in _pieces(batches, "t"):
            toxic, clean = Counter(), Counter()
            for y, t in zip(b.column("y").to_pylist(), b.column("t").to_pylist(), strict=True):
                (toxic if y else clean).update({w for w in WORD.findall((t or "").lower()) if w.isalpha() and len(w) < 40})
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_pydict({"w": keys, "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]}, schema=pa.schema([("w", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    counted = lambda part: part.select("y", "t").mapInArrow(words_of, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    words = materialised(counted(sample.filter(half == 0)), "toxicity-words")
    # toxic documents of the first half; an entry must be in a hundredth of them, three at least
    n_toxic = sample.filter((half == 0) & (F.col("y") == 1)).count()
    least, confirm = max(3, n_toxic // 100), max(2, n_toxic // 200)
    pure = F.col("a") >= 19 * F.col("b")
    listed = lambda df: [r["w"] for r in df.select("a", "w").orderBy(F.desc("a"), "w").collect()]  # noqa: E731  words of the bounded sample
    whole = listed(words.filter((F.col("a") >= least) & pure & (F.length("w") >= 4)))
    prefixes = words.select("w", "a", "b", F.explode(F.expr("transform(sequence(4, greatest(4, least(7, length(w) - 1))), n -> left(w, n))")).alias("p")).filter(F.length("w") > 4)
    family = prefixes.groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    stems = listed(family.withColumnRenamed("p", "w").filter((F.col("a") >= 2 * least) & (F.col("n") >= 5) & pure))
    stems = [s for s in stems if not any(s != p and s.startswith(p) for p in stems)]
    whole = [w for w in whole if not any(w.startswith(p) for p in stems)]

    def entries_in(batches):  # which entries the other half has, in how many documents of each class
        known, starts = set(whole), {n: {s for s in stems if len(s) == n} for n in (4, 5, 6, 7)}
        for b in _pieces(batches, "t"):
            toxic, clean = Counter(), Counter()
            for y, t in zip(b.column("y").to_pylist(), b.column("t").to_pylist(), strict=True):
                ws = set(WORD.findall((t or "").lower()))
                (toxic if y else clean).update((ws & known) | {f"{w[:n]}*" for w in ws for n, s in starts.items() if w[:n] in s})
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_pydict({"w": keys, "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]}, schema=pa.schema([("w", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    other = sample.filter(half == 1)
    found = other.select("y", "t").mapInArrow(entries_in, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter((F.col("a") >= confirm) & (F.col("a") >= 9 * F.col("b"))).collect()  # entries
    confirmed = {r["w"] for r in found}
    model = Model([w for w in whole if w in confirmed], [s for s in stems if f"{s}*" in confirmed])

    def near(batches):
        automaton = Automaton(model.words, model.stems)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"w": pa.array([w for w in b.column("w").to_pylist() if automaton.match(w) in (1, 3)], pa.string())})

    # words like an entry that clean documents of the first half have: ordinary words
    ordinary = words.filter((F.col("b") > 0) & (F.col("b") >= F.col("a"))).orderBy(F.desc("b"), "w").select("w")
    model.exceptions = [r["w"] for r in ordinary.mapInArrow(near, "w string").collect()]

    def hits(batches):
        scorer = Scorer(model)
        for b in _pieces(batches, "t"):
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array([scorer.counts(t) for t in b.column("t").to_pylist()], pa.list_(pa.float64()))})

    rows = other.select("y", "t").mapInArrow(hits, "y int, x array<double>").groupBy("y", "x").count().collect()  # few distinct counts of a bounded sample
    if rows and model.words + model.stems:
        n = np.array([r["count"] for r in rows])
        x, y = _features([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
        w, b = fit_logistic(np.repeat(x, n, 0), np.repeat(y, n), np.array(PRIOR))
        model.weights, model.bias = [float(max(0, v)) for v in w], b
    return model


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct `out` of score (0 to 1) and the hits of each of KINDS, weighed by their context."""
    plain, names = numbered(docs.drop(out))
    t, passed = f"c{names.index(text)}", plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("x", T.StructType([T.StructField("score", T.DoubleType()), *[T.StructField(k, T.DoubleType()) for k in KINDS]]))])
    w, bias = np.array(model.weights), model.bias

    def scored(batches):
        scorer = Scorer(model)
        for b in _pieces(batches, t):
            counts = np.array([scorer.counts(x) for x in b.column(t).to_pylist()], float).reshape(-1, len(KINDS))
            score = 1 / (1 + np.exp(-np.clip(_features(counts) @ w + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(score), *[pa.array(c) for c in counts.T.copy()]], names=["score", *KINDS])], names=[*passed, "x"])

    return plain.mapInArrow(scored, schema).toDF(*names, out)


def held_out(doc: str = "doc_id"):
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1


def trained(spark, sf_dir, most_toxic: int = 4000, most_clean: int = 6000) -> Model:
    """The model of the labelled rows that are not held out."""
    from .support import table

    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return learn(training_sample(table(spark, sf_dir, "documents"), labels, "doc_id", "text", "toxic", most_toxic, most_clean))


def op1_query(spark, sf_dir):
    from .support import table, text_batches

    text_batches(spark)
    done = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    score = F.col("toxicity.score")
    return done.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))
