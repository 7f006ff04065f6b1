"""Quality by ordinal (cumulative-link) regression on graded ratings.

With grades 0 < 1 < ... < K-1, P(grade <= k | x) = sigmoid(theta_k - w.x): one vector of hashed-text
weights is shared by all grades, and the thresholds theta are ordered.  The expected grade and the
tail probability P(grade >= select_grade) follow, and a document is kept if the tail reaches
`select_at`.

Features of a text: frequencies of hashed byte 3-grams, and hashed flags for its length and for the
shares of repeated lines, repeated words and symbols.  The model is fitted on at most `most_rated`
rated documents, chosen by hash, one of each text; scoring covers every whole text.

Defined cases: null text counts as empty; a null rating isn't used; without ratings, or with ratings of
one grade only, every document has the expected grade 0 and the tail probability 1; the tail of grade 0
is 1; repeated rows score alike; an empty table gives an empty result;
other columns pass through, except one named like `out`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columnar import pieces, texts
from .quality_rules import Counters
from .support import materialised, numbered

DIMS = 2048
FLAGS = 64  # the first dimensions are the flags'


def gram_hash(buf: np.ndarray) -> np.ndarray:
    """A dimension for each byte 3-gram."""
    b = buf.astype(np.uint32)
    h = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
    return FLAGS + ((h >> np.uint32(12)) % np.uint32(DIMS - FLAGS)).astype(np.int64)


def flags(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Dimensions of the flags that each text has, one array a flag."""
    c = Counters(buf, offsets)
    n = np.maximum(c["n_words"], 1)
    part = lambda x, of: np.minimum(15, (16 * x) // np.maximum(of, 1)).astype(np.int64)
    return [np.minimum(15, np.log2(n).astype(np.int64)), 16 + part(c["n_dup_lines"], c["n_lines"]), 32 + part(c["n_repeat_words"], n), 48 + part(10 * c["n_symbols"], c["word_chars"])]


def vectors(column: pa.Array) -> np.ndarray:
    """Dense features of a few texts, for fitting."""
    buf, offsets = texts(column)
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    if len(buf) > 2:
        g = gram_hash(buf)
        for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
            if b - a > 2:
                out[i] = np.bincount(g[a : b - 2], minlength=DIMS) / (b - a - 2)
    out *= 30
    for f in flags(buf, offsets):
        out[np.arange(len(out)), f] = 1
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, z: np.ndarray) -> np.ndarray:
        """Tail probabilities P(grade >= k) for k = 1 .. K-1, a row a text."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))

    def linear(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w.x for whole texts, without building x."""
        z = np.zeros(len(offsets) - 1)
        if len(buf) > 2:
            sums = np.concatenate([[0.0], np.cumsum(self.weights[gram_hash(buf)])])
            a, n = offsets[:-1], np.diff(offsets) - 2
            has = n > 0
            z[has] = 30 * (sums[a[has] + n[has]] - sums[a[has]]) / n[has]
        for f in flags(buf, offsets):
            z += self.weights[f]
        return z


def fit(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 2e-3, rounds: int = 400) -> Model:
    """Adam on the cumulative-link likelihood.  Thresholds are a first value and positive gaps, so
    they stay in order."""
    share = np.array([np.clip((y <= k).mean(), 0.01, 0.99) for k in range(grades - 1)])
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    x = np.ascontiguousarray(x, np.float32)  # products stay in single precision, sums over few numbers don't
    w, t = np.zeros(x.shape[1]), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    p = np.concatenate([w, t])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda u: 1 / (1 + np.exp(-np.clip(u, -30, 30)))
    for i in range(1, rounds + 1):
        w, t = p[: x.shape[1]], p[x.shape[1] :]
        gaps = np.exp(t[1:])
        theta = np.concatenate([[-np.inf], t[0] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = (x @ w.astype(np.float32)).astype(float)
        hi, lo = sig(theta[y + 1] - z), sig(theta[y] - z)
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gz = (dhi - dlo) / len(y)
        gtheta = np.bincount(y + 1, -dhi / len(y), grades + 1)[1:-1] + np.bincount(y, dlo / len(y), grades + 1)[1:-1]
        after = np.cumsum(gtheta[::-1])[::-1]
        g = np.concatenate([gz.astype(np.float32) @ x + ridge * w, [after[0]], after[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    w, t = p[: x.shape[1]], p[x.shape[1] :]
    return Model(w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def trained(docs: DataFrame, ratings: DataFrame, doc: str = "doc_id", text: str = "text", rating: str = "rating", most_rated: int = 5000) -> Model:
    """A model from (doc, rating) rows; ratings are any ordered numbers, graded by rank."""
    rated = ratings.filter(F.col(rating).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("d"), F.col(rating).alias("y")).groupBy("d").agg(F.max("y").alias("y"))
    picked = rated.orderBy(F.xxhash64("d"), "d").limit(most_rated)  # bounded, so it may be broadcast
    rows = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "d").groupBy("t").agg(F.max("y").alias("y"))

    def featured(batches):
        for batch in batches:
            for i, j in pieces(batch, "t"):
                b = batch.slice(i, j - i)
                x = vectors(b.column("t"))
                yield pa.RecordBatch.from_pydict({"y": b.column("y").cast(pa.float64()), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})

    got = materialised(rows.select("t", F.col("y").cast("double").alias("y")).mapInArrow(featured, "y double, x binary"), "quality-sample").collect()  # most_rated rows of 4 KB
    if not got:
        return Model(np.zeros(DIMS), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    levels, y = np.unique([r["y"] for r in got], return_inverse=True)
    return fit(x, y, len(levels)) if len(levels) > 1 else Model(np.zeros(DIMS), np.zeros(0))


def ordinal_quality(docs: DataFrame, model: Model, text: str = "text", select_grade: int = 1, select_at: float = 0.5, out: str = "quality") -> DataFrame:
    """docs with a struct `out` of expected_grade, tail_probability and kept."""
    plain, names = numbered(docs.drop(out))
    t, passed = f"c{names.index(text)}", plain.columns
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    schema = T.StructType([*plain.schema.fields, T.StructField("x", kind)])

    def scored(batches):
        for batch in batches:
            for i, j in pieces(batch, t):
                b = batch.slice(i, j - i)
                tail = model.grades(model.linear(*texts(b.column(t))))
                chosen = tail[:, min(select_grade, tail.shape[1]) - 1] if select_grade > 0 and tail.shape[1] else np.ones(len(tail))
                x = pa.StructArray.from_arrays([pa.array(tail.sum(1)), pa.array(chosen), pa.array(chosen >= select_at)], names=kind.names)
                yield pa.RecordBatch.from_arrays([*b.columns, x], names=[*passed, "x"])

    return plain.mapInArrow(scored, schema).toDF(*names, out)


def op3_query(spark, sf_dir):
    """Grades: 0 poor, 1 fair but toxic, 2 good; kept are those likely of grade 1 or better.  A third of
    the documents, `held_out` by a hash of their ids, gives no ratings to the fit."""
    from .support import table

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2)).otherwise(0).alias("rating"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = ordinal_quality(docs, trained(docs, labels))
    return done.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("quality.expected_grade").alias("expected_grade"), F.col("quality.tail_probability").alias("tail_probability"), F.col("quality.kept").alias("kept"))
