"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as word sequences: A-Z lower-cased, words are runs of ASCII
letters, digits and bytes from 0x80.  An item of m words may be matched with up to
e = floor(m * error_share) word edits.  It is split into e + 1 pieces, so a passage within e edits
has at least one piece unchanged.  A piece's probe is a run of `probe` words of it (all of it, if
shorter); pieces are laid so that their probes are rare among the items' runs of words, and where no
way of laying them avoids a run that more than `COMMON` items have, probes may be shorter.  Probes are
looked up at every position of every text by Rabin-Karp hash; a hit places the item.  Places that
overlap are one region, in which the item's words are counted first: fewer of them than the budget
leaves can't be a match.  Myers' bit-parallel algorithm, on words, then gives the least edit distance
of the item to any passage of the region, once.

The items must be few: their hashes go to every executor.  A table of more than `most_items` items, or
`most_bytes` of their texts, is worked off in slices by a hash of the item, each against all documents.
Item ids must be whole numbers.

Defined cases: null or empty texts and items match nothing, as do items of fewer than `least_words`
words; repeated items and documents each give their own rows; empty tables give an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import Words, pieces, texts
from .support import bounded, materialised, numbered

#: Bytes that are not part of a word.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(column: pa.Array) -> Words:
    return Words(*texts(column), lower=True, separator=BREAKS)


def myers(item: list[int], passage: list[int]) -> tuple[int, int]:
    """The least edit distance of item to a run of passage's words that starts anywhere, and the end
    (exclusive) of the first such run.  One machine step a word of passage, whatever the item."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(passage):
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = vn | ~(d0 | vp) & mask, d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & mask, hn << 1 & mask
        vp, vn = hn | ~(d0 | hp) & mask, hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


#: Items that may share a probe before others are tried, and the words that a probe has then at least.
COMMON, LEAST_PROBE = 8, 3


def laid(cost: np.ndarray, pieces: int, probe: int) -> tuple[float, list[int]]:
    """The starts of `pieces` runs of `probe` words that don't overlap and cost least together; cost[i] is that of the
    run at word i.  Of equal ones the earliest."""
    n = len(cost)
    best = np.full((pieces + 1, n + probe + 1), np.inf)
    best[0] = 0
    for k in range(1, pieces + 1):
        for i in range(n - 1, -1, -1):
            best[k, i] = min(best[k, i + 1], cost[i] + best[k - 1, i + probe])
    starts, i = [], 0
    for k in range(pieces, 0, -1):
        while best[k, i] < cost[i] + best[k - 1, i + probe]:
            i += 1
        starts.append(i)
        i += probe
    return float(best[pieces, 0]), starts


class Items:
    """Test items with their pieces' probes, by probe length."""

    def __init__(self, ids: list[int], column: pa.Array, error_share: float, probe: int, least_words: int):
        w = words_of(column)
        self.ids, self.words, self.budget = ids, [w.hash[a:b].tolist() for a, b in zip(w.first, w.first[1:], strict=False)], []
        self.sets = [set(x) for x in self.words]
        runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Runs of n words of all items: first words, hashes, and by how many items each is had."""
            if n not in runs:
                at, h = w.windows(n)
                _, run = np.unique(h, return_inverse=True)
                pairs = np.unique(run * max(1, len(ids)) + w.text[at])
                runs[n] = (at, h, np.bincount(pairs // max(1, len(ids)), minlength=run.max(initial=-1) + 1)[run])
            return runs[n]

        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            m = len(words)
            e = int(m * error_share)
            self.budget.append(e)
            if m < max(1, least_words):
                continue
            most, choice = min(probe, m // (e + 1)), None
            for n in range(most, min(most, LEAST_PROBE) - 1, -1):
                at, _, items_with = shared(n)
                first = np.searchsorted(at, w.first[i])
                held = items_with[first : first + m - n + 1].astype(float)
                starts = [m * k // (e + 1) for k in range(e + 1)]  # pieces of equal length, if their first words will do
                if held[starts].max() > COMMON:
                    _, starts = laid(held * held, e + 1, n)
                worst = held[starts].max()
                if choice is None or worst < choice[0]:
                    choice = (worst, n, starts)
                if worst <= COMMON:
                    break
            for a in choice[2]:
                found.setdefault(choice[1], []).append((w.first[i] + a, i, a))
        self.probes = []
        for n, rows in sorted(found.items()):
            at, h = w.windows(n)
            place = np.array([r[0] for r in rows])
            key = h[np.searchsorted(at, place)]
            order = np.argsort(key, kind="stable")
            self.probes.append((n, key[order], np.array([rows[k][1] for k in order]), np.array([rows[k][2] for k in order])))


def _regions(hits: np.ndarray, items: Items, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, end word) of the words around hits (row, item, start); those that overlap are one."""
    if not len(hits):
        return []
    row, i, start = np.unique(hits, axis=0).T
    size, e = np.array([len(x) for x in items.words]), np.array(items.budget)
    a, b = np.maximum(first[row], start - e[i]), np.minimum(first[row + 1], start + size[i] + e[i])
    new = np.ones(len(a), bool)
    new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (a[1:] >= b[:-1])  # of one item all are as long, so ends ascend
    at = np.flatnonzero(new)
    return list(zip(row[at].tolist(), i[at].tolist(), a[at].tolist(), np.maximum.reduceat(b, at).tolist(), strict=True))


def matches(items: Items, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, end word) of each text and item that match: the best match."""
    w = words_of(column)
    hits = [np.zeros((0, 3), np.int64)]
    for n, keys, item, offset in items.probes:
        at, h = w.windows(n)
        low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
        some = np.flatnonzero(high > low)
        size = high[some] - low[some]
        k = np.arange(size.sum()) + np.repeat(low[some] - (np.cumsum(size) - size), size)
        p = np.repeat(at[some], size)
        hits.append(np.column_stack([w.text[p], item[k], p - offset[k]]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, i, a, b in _regions(np.concatenate(hits), items, w.first):
        e, passage = items.budget[i], w.hash[a:b].tolist()
        if sum(map(items.sets[i].__contains__, passage)) < len(items.words[i]) - e:
            continue
        distance, end = myers(items.words[i], passage)
        if distance <= e and distance < best.get((row, i), (e + 1,))[0]:
            back, size = myers(items.words[i][::-1], passage[:end][::-1])
            size = size if back == distance else len(items.words[i])
            best[row, i] = (distance, int(a + end - size - w.first[row]), int(a + end - w.first[row]))
    return [(row, i, *v) for (row, i), v in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", error_share: float = 0.15, probe: int = 5, least_words: int = 8, most_items: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word) of every document and item that match."""
    slices = _slices(benchmark, item, item_text, most_items, most_bytes)
    return reduce(DataFrame.unionByName, [_against(docs, *_rows(part), doc, text, error_share, probe, least_words) for part in slices])


def _slices(benchmark: DataFrame, item: str, item_text: str, most_items: int, most_bytes: int) -> list[DataFrame]:
    """(i, x) of the benchmark in parts of about most_items items and most_bytes of text at most."""
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("x"))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("x")).alias("b")).first()
    slices = max(1, -(-total["n"] // most_items), -(-(total["b"] or 0) // most_bytes))
    return [items.filter(F.pmod(F.xxhash64("i", "x"), F.lit(slices)) == k) for k in range(slices)] if slices > 1 else [items]


def _rows(part: DataFrame) -> tuple[list[int], list[str]]:
    rows = part.collect()  # a slice of short texts
    return [r["i"] for r in rows], [r["x"] for r in rows]


def _against(docs: DataFrame, ids: list[int], item_texts: list[str], doc: str, text: str, error_share: float, probe: int, least_words: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Items(ids, pa.array(item_texts, pa.string()), error_share, probe, least_words))
    rows = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def found(batches):
        items = sent.value
        for batch in batches:
            hit = [(a + r, *m) for a, b in pieces(batch, "t") for r, *m in matches(items, batch.column("t").slice(a, b - a))]
            r, i, distance, start, end = zip(*hit, strict=True) if hit else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(pa.array(r, pa.int64())), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(distance, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "item_id", "distance", "start_word", "end_word"],
            )

    from pyspark.sql import types as T

    long = lambda n: T.StructField(n, T.LongType())
    return rows.mapInArrow(found, T.StructType([T.StructField("doc_id", rows.schema["d"].dataType), *map(long, ("item_id", "distance", "start_word", "end_word"))]))


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", error_share: float = 0.15, probe: int = 5, least_words: int = 8, most_items: int = 20_000, most_bytes: int = 32 << 20, out: str = "matches") -> DataFrame:
    """docs with `out`, the ids of the items that a document matches.  Up to `most_items` items that is one
    pass without a shuffle.  Of more, each slice is a pass that keeps the texts with matches, by their
    SHA-256, and the lists are joined to the documents."""
    docs = docs.drop(out)
    slices = _slices(benchmark, item, item_text, most_items, most_bytes)
    if len(slices) == 1:
        return _listed(docs, *_rows(slices[0]), text, error_share, probe, least_words, out)
    plain, names = numbered(docs)
    t = f"c{names.index(text)}"
    key = F.sha2(F.coalesce(F.col(t), F.lit("")), 256)  # what a document matches depends on its text only
    found = []
    for part in slices:
        listed = _listed(plain.select(t), *_rows(part), t, error_share, probe, least_words, "x").filter(F.size("x") > 0)
        found.append(listed.select(key.alias("k"), "x").dropDuplicates(["k"]))
    lists = reduce(DataFrame.unionByName, found).groupBy("k").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
    joined = plain.withColumn("k", key).join(bounded(materialised(lists, "benchmark-matches")), "k", "left")
    return joined.select(*plain.columns, F.coalesce("x", F.array().cast("array<long>"))).toDF(*names, out)


def _listed(docs: DataFrame, ids: list[int], item_texts: list[str], text: str, error_share: float, probe: int, least_words: int, out: str) -> DataFrame:
    """docs with `out`, the ids of these items that a document matches: one pass, no shuffle."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(Items(ids, pa.array(item_texts, pa.string()), error_share, probe, least_words))
    plain, names = numbered(docs)
    t, passed = f"c{names.index(text)}", plain.columns

    def found(batches):
        items = sent.value
        for batch in batches:
            got: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for a, b in pieces(batch, t):
                for r, i, *_ in matches(items, batch.column(t).slice(a, b - a)):
                    got[a + r].append(items.ids[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int64()))], names=[*passed, "x"])

    schema = T.StructType([*plain.schema.fields, T.StructField("x", T.ArrayType(T.LongType()))])
    return plain.mapInArrow(found, schema).toDF(*names, out)


def op4_query(spark, sf_dir):
    from .support import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
