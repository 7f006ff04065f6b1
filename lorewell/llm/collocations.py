"""Phrase collocations from bounded suffix automata.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``.  Documents are dealt into blocks; a block's texts, in runs of bounded size, are the
shards.  A shard's generalised suffix automaton, bounded to `most` words, has one state for all
substrings that end at the same places: sorting the places by the word there, the word before it and
so on gives the tree of suffix links, level by level; the places of a node are its endpos count, and a
node with as many places as its suffix link is the same state.

Substrings are enumerated with their counts and go, by a 64-bit hash of language and words, to ranges that
add them up.  A range tells each block the counts of those that reach `least`, and which block is to
speak for each.  That block walks its automata again: the words' prefixes and suffixes, and so the
counts of both sides of every cut, come from the states on the way and from the suffix links.
A phrase inside a longer one is found by the same links, and dropped by a join on the hash.

A word that makes up a third of all text is one entry a block; a block sends every substring once.
No key gathers more than the number of blocks.  The product of two counts is taken in decimals, exactly.
For n distinct substrings a mix-up of hashes is expected n*n/2**65 times.

Defined cases: null or empty texts have no words; a null language is `und`; repeated rows count each;
an empty table gives an empty result; equal scores and counts go by the phrase's bytes; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columnar import U, Words, mix, pack, pieces, runs, texts, unpack
from .support import blocks_for, materialised, text_bytes

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _BREAK.copy()
_APART[list(b" \t")] = True
#: Bytes of text in one automaton.
SHARD = 4_000_000


class Automaton:
    """The generalised suffix automaton of word sequences, for substrings of up to `most` words.

    words: a 64-bit hash at each place; reach: how many words of the same sequence stand before it.  Level d
    has a node for each distinct substring of d words: at[d][i] is that of the words that end at place i
    (-1 if there aren't d), link[d] its suffix link in level d - 1, count[d] its number of places, first[d]
    one of them, key[d] a hash of its words."""

    def __init__(self, words: np.ndarray, reach: np.ndarray, most: int):
        distinct, at = np.unique(words, return_inverse=True)
        at = at.astype(np.int64)
        self.at, self.link, self.first, self.count, self.key = [None, at], [None, None], [None], [None], [None]
        self._node(np.arange(len(words)), at, len(distinct))
        self.key.append(mix(distinct))
        for d in range(2, most + 1):
            place = np.flatnonzero(reach >= d - 1)
            pair = self.at[d - 1][place] * len(distinct) + at[place - d + 1]
            ids, inverse = np.unique(pair, return_inverse=True)
            level = np.full(len(words), -1, np.int64)
            level[place] = inverse
            self.at.append(level)
            self._node(place, inverse, len(ids))
            up, word = (np.divmod(ids, len(distinct)) if len(ids) else (ids, ids))
            self.link.append(up)
            self.key.append(mix(self.key[d - 1][up] * U(0x9E3779B97F4A7C15) + distinct[word] + U(d)))
        self.most = most

    def _node(self, place: np.ndarray, node: np.ndarray, n: int) -> None:
        self.count.append(np.bincount(node, minlength=n).astype(np.int64))
        first = np.zeros(n, np.int64)
        first[node[::-1]] = place[::-1]
        self.first.append(first)

    def states(self) -> list[np.ndarray | None]:
        """The state of each node, by level.  A node that has a continuation to the left with as many places is
        in that one's state: they end at the same places."""
        out, made = [None] * (self.most + 1), 1
        for d in range(self.most, 0, -1):
            own = np.arange(made, made + len(self.count[d]))
            made += len(own)
            if d < self.most:
                same = np.flatnonzero(self.count[d + 1] == self.count[d][self.link[d + 1]])
                own[self.link[d + 1][same]] = out[d + 1][same]
            out[d] = own
        return out

    def inside(self, d: int, node: np.ndarray, i: int, j: int) -> np.ndarray:
        """The nodes of words i to j of nodes of d words: a suffix by its links, else from the state on the way."""
        if j < d:
            return self.at[j - i][self.first[d][node] - (d - j)]
        for k in range(d, d - i, -1):
            node = self.link[k][node]
        return node

    def substrings(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and count of every substring."""
        return np.concatenate(self.key[1:]), np.concatenate(self.count[1:])


def _shards(table: pa.Table, text: str, lang: str, most: int):
    """Words, automaton and the languages' row numbers of each run of texts."""
    import xxhash

    langs = table.column(lang).combine_chunks().dictionary_encode()
    names = [x or "" for x in langs.dictionary.to_pylist()]
    salt = np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names] or [0], U)
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(langs) else np.zeros(0, np.int64)
    for a, b in pieces(table, text, SHARD):
        words = Words(*texts(table.column(text).slice(a, b - a)), lower=True, separator=_APART)
        if not len(words.start):
            continue
        piece = np.cumsum(_BREAK[words.buf])[words.start]
        new = np.ones(len(words.start), bool)
        new[1:] = (words.text[1:] != words.text[:-1]) | (piece[1:] != piece[:-1])
        start = np.flatnonzero(new)
        reach = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
        row = code[a:b][words.text]
        yield words, Automaton(mix(words.hash ^ salt[row]), reach, most), row, names


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = runs(keys)
    return (keys[at], np.add.reduceat(counts, at)) if len(at) else (keys, counts)


def _counted(table: pa.Table, text: str, lang: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    found = [_added(*x[1].substrings()) for x in _shards(table, text, lang, most)]
    return _added(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 3, least: int = 10) -> DataFrame:
    """Phrases of 2 to `most` words that occur `least` times or more in their language: lang, phrase, key, a, cuts (l
    and r of each cut), parts (keys of the shorter phrases inside).  Also, with a null phrase, one row a block
    and language whose a is the number of words there."""
    plain = docs.select(F.col(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    blocks = blocks_for(text_bytes(plain, "t"))
    # equal rows are dealt apart by the partition that they are read in, so that no group of them is one block
    dealt = plain.withColumn("b", F.pmod(F.xxhash64("t", "lang", F.spark_partition_id(), F.length("t")), F.lit(blocks)).cast("int"))
    shift = U(64 - max(1, (blocks - 1).bit_length()))

    def sent(x: pa.Table) -> pa.Table:
        key, count = _counted(x, "t", "lang", most)
        at = runs(key >> shift)
        cut = [*at, len(key)]
        return pa.table({
            "r": pa.array((key[at] >> shift).astype(np.int32)),
            "b": pa.array([x.column("b")[0].as_py()] * len(at), pa.int32()),
            "p": pa.array([pack(key[i:j], count[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
        })

    def summed(x: pa.Table) -> pa.Table:
        b = x.column("b").to_numpy()
        got = [unpack(p, 2) for p in x.column("p").to_pylist()]
        key = np.concatenate([g[0] for g in got])
        count = np.concatenate([g[1] for g in got]).view(np.int64)
        of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        order = np.lexsort((mix(key ^ mix(b[of].astype(U))), key))  # among the blocks that have it, chance says which speaks for it
        key, count, of = key[order], count[order], of[order]
        at = runs(key)
        size = np.diff(np.append(at, len(key)))
        total = np.add.reduceat(count, at)
        speaks = np.zeros(len(key), np.int64)
        speaks[at] = 1
        often = np.repeat(total >= least, size)
        key, value, of = key[often], (2 * np.repeat(total, size) + speaks)[often], of[often]
        order = np.argsort(of, kind="stable")
        key, value, of = key[order], value[order], of[order]
        at = runs(of)
        cut = [*at, len(key)]
        return pa.table({"b": pa.array(b[of[at]], pa.int32()), "p": pa.array([pack(key[i:j], value[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})

    pair = pa.struct([("l", pa.int64()), ("r", pa.int64())])
    names = ("lang", "phrase", "key", "a", "cuts", "parts")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pair), pa.list_(pa.int64()))

    def spoken(x: pa.Table, y: pa.Table) -> pa.Table:
        told = [unpack(p, 2) for p in y.column("p").to_pylist()]
        key = np.concatenate([g[0] for g in told]) if told else np.zeros(0, U)
        value = np.concatenate([g[1] for g in told]).view(np.int64) if told else np.zeros(0, np.int64)
        order = np.argsort(key)
        key, value = key[order], value[order]
        todo, out, words_in = (value & 1).astype(bool), {n: [] for n in names}, {}
        for words, auto, row, langs in _shards(x, "t", "lang", most):
            for code, n in zip(*np.unique(row, return_counts=True), strict=True):
                words_in[langs[code]] = words_in.get(langs[code], 0) + int(n)
            if not len(key):
                continue
            place = [None] + [np.minimum(np.searchsorted(key, k), len(key) - 1) for k in auto.key[1:]]  # where each node's count stands
            for d in range(2, most + 1):
                mine = np.flatnonzero((key[place[d]] == auto.key[d]) & todo[place[d]])
                todo[place[d][mine]] = False  # another shard of the block may have it too
                end = auto.first[d][mine]
                sides = [(value[place[k][auto.inside(d, mine, 0, k)]] >> 1, value[place[d - k][auto.inside(d, mine, k, d)]] >> 1) for k in range(1, d)]
                parts = [auto.key[j - i][auto.inside(d, mine, i, j)].view(np.int64) for i in range(d) for j in range(i + 2, d + 1) if j - i < d]
                raw = words.buf.tobytes() if len(mine) else b""
                for m, e in enumerate(end.tolist()):
                    out["phrase"].append(b" ".join(raw[words.start[w] : words.end[w]] for w in range(e - d + 1, e + 1)).decode())
                    out["cuts"].append([{"l": int(s[0][m]), "r": int(s[1][m])} for s in sides])
                    out["parts"].append([int(p[m]) for p in parts])
                out["lang"] += [langs[c] for c in row[end].tolist()]
                out["key"] += auto.key[d][mine].view(np.int64).tolist()
                out["a"] += (value[place[d][mine]] >> 1).tolist()
        for name, n in words_in.items():
            for column, v in zip(names, (name, None, None, n, None, None), strict=True):
                out[column].append(v)
        return pa.table({n: pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)})

    schema = "lang string, phrase string, key long, a long, cuts array<struct<l:long,r:long>>, parts array<long>"
    told = dealt.groupBy("b").applyInArrow(sent, "r int, b int, p binary").groupBy("r").applyInArrow(summed, "b int, p binary")
    return dealt.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(spoken, schema)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.  A phrase goes if a longer one
    that has it inside occurs in at least `share` per cent of its places."""
    found = materialised(phrases(docs, text, lang, most, least), "phrases")
    words = found.filter("phrase is null").groupBy("lang").agg(F.sum("a").alias("n"))
    found = found.filter("phrase is not null")
    longer = found.select(F.explode("parts").alias("key"), F.col("a").alias("b")).groupBy("key").agg(F.max("b").alias("b"))
    exact = lambda c: f"cast({c} as decimal(38,0))"
    cut = F.array_min(F.expr(f"transform(cuts, (c, i) -> struct((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))) as score, i as k, c.l as l, c.r as r))"))
    left = found.join(longer, "key", "left").filter(F.col("b").isNull() | (F.lit(100).cast("decimal(3,0)") * F.expr(exact("b")) < F.lit(share).cast("decimal(3,0)") * F.expr(exact("a"))))
    scored = left.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_query(spark, sf_dir):
    from .support import table

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(range(1, len(s) + 1)) AS j, s FROM (SELECT rid, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS s FROM d)),
w AS (SELECT lang, regexp_extract_all(s[j], '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS d, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
      UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
f AS (SELECT lang, d, phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c) AS n FROM f WHERE d = 1 GROUP BY lang),
c AS (SELECT lang, d, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE d >= 2 AND c >= 10),
k AS (SELECT lang, d, phrase, a, 1 AS k, w[1] AS x, CASE d WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS y FROM c
      UNION ALL SELECT lang, d, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE d = 3),
s AS (SELECT k.lang, k.d, k.phrase, k.a, k.k, l.c AS l, r.c AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
b AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE d = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE d = 3) GROUP BY lang, phrase),
q AS (SELECT m.lang, m.phrase, m.a, m.l, m.r, m.score, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank
      FROM m LEFT JOIN b ON b.lang = m.lang AND b.phrase = m.phrase WHERE m.o = 1 AND (b.b IS NULL OR 100 * b.b < 50 * m.a))
SELECT q.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
