"""The point index: validation of chunk records, hash embedding, key merges, stale points."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

PAYLOAD_DEFAULTS = {"page_type": "general", "chunk_index": 0, "token_count": 0, "url": "", "title": "", "content_hash": "", "crawl_timestamp": ""}


def validated(chunks: DataFrame) -> DataFrame:
    """chunks with `reason`, the first failing check (null: valid), and the title's fallback."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = (
        F.when(blank("chunk_id"), "missing chunk_id")
        .when(blank("document_id"), "missing document_id")
        .when(F.col("text").isNull() | (strip(F.col("text")) == ""), "empty text")
        .when(blank("url"), "missing url")
    )
    return chunks.withColumn("reason", reason).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Payload columns filled as the index expects them."""
    return chunks.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in PAYLOAD_DEFAULTS.items() if c in chunks.columns})


def embedder(load, dims: int, batch_size: int = 32):
    """A column function that embeds texts with a model.  load() gives a function from a list of texts to
    their vectors; it is called once a Python worker, and the model gets at most `batch_size` texts at a
    time.  A model that gives vectors of another size, or another number of them, is an error.  A null
    text counts as empty."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:  # of a batch only what the model gets at a time are Python strings
            out = [np.zeros((0, dims), np.float32)]
            for i in range(0, len(texts), batch_size):
                rows = [t or "" for t in texts.slice(i, batch_size).to_pylist()]
                got = np.asarray(model(rows), np.float32)
                if got.shape != (len(rows), dims):
                    raise ValueError(f"the model gave {got.shape} for {len(rows)} texts of {dims} dimensions")
                out.append(got)
            flat = np.concatenate(out).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))

    return embed


def _hash_model(dims: int):
    """Tokens hashed with signs into `dims`, then normalised."""

    def model(texts: list[str]) -> np.ndarray:
        v = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):  # the words of one text at a time
            h = np.fromiter((zlib.crc32(w.encode()) for w in t.lower().split()), np.int64)
            v[i] = np.bincount(h % dims, np.where(h & 0x10000, 1.0, -1.0), dims)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    return model


def hash_embedder(dims: int = 64, batch_size: int = 128):
    """A stand-in for an embedding model."""
    return embedder(lambda: _hash_model(dims), dims, batch_size)


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id", order: str | None = None) -> DataFrame:
    """new rows, and the old ones whose key new doesn't have.  Of new rows with equal keys the last by
    `order` stays; without an order, the largest row."""
    rest = [c for c in new.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest))
    new = new.groupBy(key).agg(last.alias("_n")).select(key, *[F.col(f"_n.{c}").alias(c) for c in rest]).select(new.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def stale_points(index: DataFrame, current: DataFrame, document: str = "document_id", point: str = "point_id") -> DataFrame:
    """Points of documents that were processed now, but not of their present chunks."""
    return index.join(current.select(document).distinct(), document, "left_semi").join(current.select(point), point, "left_anti")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `repeat`: whether an earlier row has the key."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1)
