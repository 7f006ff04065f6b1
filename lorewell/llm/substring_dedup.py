"""Substring deduplication: words of passages that an earlier document already has are removed.

Every window of `window` consecutive words gets a Rabin-Karp hash.  Documents are dealt into
blocks by id; each block sends every distinct window hash once, with the smallest document id
that has it there, to the hash's range.  A range finds the smallest id over all blocks and tells
a block which of its windows an earlier document of another block has; within a block the block
itself sees.  The windows found merge into maximal removal intervals.

A passage that a third of all documents share is one entry per block and hash, not one per
document, so no key gathers more than the number of blocks.  Windows are compared by 64-bit hash:
for n distinct windows a wrong removal is expected n*n/2**65 times.

With `joined` the kept words of every text, also of one that loses nothing, are joined by one space,
which is op2's digest contract; null text becomes empty.  Without it a text that loses nothing stays
as it is, byte for byte, and null stays null; from the others only the removed passages go.  Of the
breaks around a passage those before it stay, at the end of a text those behind it.

Ids must be whole numbers.

Defined cases: null or empty text has no words; texts shorter than the window lose no words;
documents with equal ids are never "smaller" than each other; a null id
counts as 2**63 - 1, larger than any other id; an empty table gives an empty result; other columns pass through,
whatever their names, except that a column called like `out` is replaced.
"""

from __future__ import annotations

from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import U, Words, pack, pieces, runs, texts, unpack
from .support import block_of, blocks_for, numbered, text_bytes

_NO_ID = np.iinfo(np.int64).max
_SPANS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def _ids(table: pa.Table, doc: str) -> np.ndarray:
    return table.column(doc).cast(pa.int64()).fill_null(_NO_ID).combine_chunks().to_numpy(zero_copy_only=False)


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the smallest id of each."""
    order = np.argsort(hashes)
    hashes, ids = hashes[order], ids[order]
    at = runs(hashes)
    return (hashes[at], np.minimum.reduceat(ids, at)) if len(at) else (hashes, ids)


def _windows(table: pa.Table, doc: str, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of a block with the smallest document id of each."""
    ids, found = _ids(table, doc), []
    for a, b in pieces(table, text):
        words = Words(*texts(table.column(text).slice(a, b - a)))
        at, h = words.windows(k)
        found.append(_least(h, ids[a:b][words.text[at]]))
    return _least(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def _without(raw: bytes, edge: list[int], start: np.ndarray, end: np.ndarray) -> bytes:
    """raw without the passages of words [edge[0], edge[1]), [edge[2], edge[3]), ...; words are at start, end."""
    cut = [0]
    for u, v in zip(edge[::2], edge[1::2], strict=True):
        last = v == len(start)
        cut += [int(end[u - 1] if last and u else start[u]), int(end[-1] if last else start[v])]
    cut.append(len(raw))
    return b"".join(raw[i:j] for i, j in list(pairwise(cut))[::2])


def substring_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = 13, out: str = "dedup", joined: bool = True) -> DataFrame:
    """docs with `text` rid of repeated windows (see above for `joined`), and a struct `out` of n_words, n_removed and the
    removed word ranges [start, end)."""
    docs = docs.drop(out)
    total = text_bytes(docs, text)
    blocks = blocks_for(total)
    plain, names = numbered(docs)
    d, t = f"c{names.index(doc)}", f"c{names.index(text)}"
    passed = plain.columns
    dealt = plain.withColumn("b", block_of(d, t, blocks))
    shift = U(64 - max(1, (blocks - 1).bit_length()))

    def ranges(x: pa.Table) -> pa.Table:
        h, ids = _windows(x, d, t, window)
        block = x.column("b")[0].as_py()
        at = runs(h >> shift)
        cut = [*at, len(h)]
        return pa.table({
            "r": pa.array((h[at] >> shift).astype(np.int32)),
            "b": pa.array([block] * len(at), pa.int32()),
            "p": pa.array([pack(h[i:j], ids[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
        })

    def elsewhere(x: pa.Table) -> pa.Table:
        got = [unpack(p, 2) for p in x.column("p").to_pylist()]
        b = x.column("b").to_numpy()
        h = np.concatenate([g[0] for g in got])
        ids = np.concatenate([g[1] for g in got]).view(np.int64)
        of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        order = np.argsort(h)
        h, ids, of = h[order], ids[order], of[order]
        at = runs(h)
        size = np.diff(np.append(at, len(h)))
        later = ids > np.repeat(np.minimum.reduceat(ids, at), size)
        h, of = h[later], of[later]
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        at = runs(of)
        cut = [*at, len(h)]
        return pa.table({"b": pa.array(b[of[at]], pa.int32()), "p": pa.array([pack(h[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary())})

    def removed(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return pa.table({n: pa.array([], f.type) for n, f in zip(schema.names, target, strict=True)})
        seen, least = _windows(x, d, t, window)
        known = np.zeros(len(seen), bool)
        for p in y.column("p").to_pylist():
            known[np.searchsorted(seen, unpack(p, 1)[0])] = True
        ids, kept, n_words, n_removed, spans = _ids(x, d), [], [], [], []
        for a, b in pieces(x, t):
            words = Words(*texts(x.column(t).slice(a, b - a)))
            at, h = words.windows(window)
            k = np.searchsorted(seen, h)
            at = at[known[k] | (least[k] < ids[a:b][words.text[at]])]
            step = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            rows, null = words.raw.tobytes(), x.column(t).slice(a, b - a).is_null().to_pylist()
            for i in range(b - a):
                s, e = words.first[i], words.first[i + 1]
                raw, g = rows[words.offsets[i] : words.offsets[i + 1]], gone[s:e]
                m = int(g.sum())
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist() if m else []
                if joined:
                    parts = raw.split()
                    kept.append(b" ".join(compress(parts, ~g) if m else parts).decode())
                elif null[i]:
                    kept.append(None)
                else:
                    kept.append(_without(raw, edge, words.start[s:e] - words.offsets[i], words.end[s:e] - words.offsets[i]).decode())
                n_words.append(e - s)
                n_removed.append(m)
                spans.append([{"start": u, "end": v} for u, v in zip(edge[::2], edge[1::2], strict=True)])
        cols = {n: x.column(n) for n in passed} | {t: pa.array(kept, x.schema.field(t).type)}
        dedup = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, target[-1].type.field(2).type)], fields=list(target[-1].type))
        return pa.table({**cols, "dd": dedup})

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*plain.schema.fields, T.StructField("dd", _SPANS)])
    target = to_arrow_schema(schema)
    sent = dealt.groupBy("b").applyInArrow(ranges, "r int, b int, p binary")
    told = sent.groupBy("r").applyInArrow(elsewhere, "b int, p binary")
    return dealt.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(removed, schema).toDF(*names, out)


def op2_query(spark, sf_dir):
    from .support import table

    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("dedup.n_words").alias("n_words"), F.col("dedup.n_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM x),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM h),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM m WHERE least < doc_id),
a AS (SELECT rid, list(j) AS gone FROM g GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda j: CASE WHEN list_contains(gone, j) THEN NULL ELSE w[j] END), lambda v: v IS NOT NULL) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""
