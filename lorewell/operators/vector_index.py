"""Approximate nearest neighbours: an inverted file of vectors, stored by list.

Centroids come from a bounded sample; every vector is put into the list of its nearest one, and the
lists are a partitioned table.  A question looks at the lists of its `probes` nearest centroids only
and ranks what stands in them exactly.  How many lists are enough for the recall that is asked for is
measured on the sample when the index is built, and `recall` measures it against the exact search.

Questions go out in blocks of bounded size and vectors stay where they are stored: a search reads the
files of the lists that its block probes, and shuffles its few best rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL

#: Questions in one block, which is what goes to every task.
BLOCK = 2048
#: Lists at most, whatever the number of vectors: the centroids go to every task.
MOST_LISTS = 4096


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors scaled to length one, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centroids_of(vectors: np.ndarray, n: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Spherical k-means on the rows of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(n, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        empty = np.bincount(near, minlength=len(centres)) == 0
        sums[empty] = vectors[rng.choice(len(vectors), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def best_rows(score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k best of each row; of equal scores the smallest name.  names must ascend."""
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return top, np.take_along_axis(score, top, 1)


class VectorIndex:
    """An index of points (a key and a vector) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.key, self.probes, self.k, self.kinds = meta["key"], meta["probes"], meta["k"], meta["kinds"]
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        self.centroids = np.array([r["centroid"] for r in rows])

    @classmethod
    def build(cls, points: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", lists: int | None = None, sample: int = 20_000, k: int = RETRIEVAL.top_k, recall: float = 0.95) -> VectorIndex:
        """Indexes all points that have a vector.  Centroids and the number of probes are fitted on at most `sample`
        vectors, chosen by a hash of the key; lists defaults to the square root of the number of vectors."""
        spark, root = points.sparkSession, path.rstrip("/")
        rows = points.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
        total = rows.count()
        n = max(1, min(MOST_LISTS, lists or round(total**0.5)))
        share = max(1, total // sample)
        chosen = rows.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).limit(sample).select("v").toArrow()
        seen = unit(chosen.column("v"))
        centres = centroids_of(seen, n) if len(seen) else np.zeros((1, 1))
        probes = cls._enough(seen, centres, k, recall)
        meta = spark.range(1).select(F.lit(key).alias("key"), F.lit(probes).alias("probes"), F.lit(k).alias("k"), F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)).alias("kinds"), F.lit(total).cast("long").alias("points"))
        meta.write.parquet(f"{root}/meta")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centroid array<double>").write.parquet(f"{root}/centroids")
        cls._dealt(rows, centres).write.partitionBy("list").parquet(f"{root}/lists")
        return cls(spark, root)

    @staticmethod
    def _dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """rows with `list`, in files by list; a list of very many vectors is split over tasks."""

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = np.argmax(unit(b.column("v")) @ centres.T, axis=1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["key", "v", "list"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return rows.mapInArrow(nearest, f"key {kinds['key']}, v {kinds['v']}, list int").hint("rebalance", "list")

    @staticmethod
    def _enough(seen: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
        """The fewest lists that give the recall on the sample, of which the first `asked` rows are questions."""
        if len(seen) <= k:
            return len(centres)
        questions = seen[:asked]
        near = np.argmax(seen @ centres.T, axis=1)
        exact = np.argsort(-(questions @ seen.T), axis=1)[:, :k]
        order = np.argsort(-(questions @ centres.T), axis=1)
        place = np.argsort(order, axis=1)  # of each list in a question's order
        needed = np.take_along_axis(place, near[exact], 1) + 1
        for probes in range(1, len(centres) + 1):
            if (needed <= probes).mean() >= recall:
                return probes
        return len(centres)

    def add(self, points: DataFrame, vector: str = "embedding") -> None:
        """Indexes further points, whose keys the index doesn't have yet."""
        rows = points.where(F.col(vector).isNotNull()).select(F.col(self.key).alias("key"), F.col(vector).alias("v"))
        self._dealt(rows, self.centroids).write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def search(self, questions: DataFrame, k: int | None = None, probes: int | None = None, gone: DataFrame | None = None) -> DataFrame:
        """(qid, key, score, v_rank): the k best of each question (qid, qvec) in its lists.  Keys in `gone` don't count:
        they are taken out of the candidates of each task before these are cut to k."""
        k, probes = k or self.k, min(probes or self.probes, len(self.centroids))
        asked = questions.where(F.col("qvec").isNotNull()).select("qid", "qvec")
        blocks = max(1, -(-asked.count() // BLOCK))
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
        found = [self._block(asked.filter(block == b).toArrow(), asked, k, probes, gone) for b in range(blocks)]
        both = reduce(DataFrame.unionByName, found)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), self.key)
        return both.withColumn("v_rank", F.row_number().over(order)).filter(F.col("v_rank") <= k)

    def _block(self, block: pa.Table, asked: DataFrame, k: int, probes: int, gone: DataFrame | None) -> DataFrame:
        ids, vectors = block.column("qid").combine_chunks(), unit(block.column("qvec"))
        near = np.argsort(-(vectors @ self.centroids.T), axis=1)[:, :probes] if len(vectors) else np.zeros((0, probes), int)
        of_list = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        stored = self.spark.read.schema(f"{self.kinds}, list int").parquet(f"{self.path}/lists").filter(F.col("list").isin(*of_list) if of_list else F.lit(False))
        if gone is not None:
            stored = stored.join(gone.select(F.col(self.key).alias("key")).distinct(), "key", "left_anti")

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column("list").to_numpy(zero_copy_only=False)
                for c in np.unique(lists):
                    part = b.take(pa.array(np.flatnonzero(lists == c)))
                    part = part.take(pa.compute.sort_indices(part.column("key")))
                    rows, who = unit(part.column("v")), of_list[int(c)]
                    score = np.round(vectors[who] @ rows.T, 6)
                    top, value = best_rows(score, np.arange(len(rows)), k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(who, top.shape[1]))), part.column("key").take(pa.array(top.ravel())), pa.array(value.ravel())], names=["qid", "key", "score"])

        kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *stored.schema]}
        return stored.select("key", "v", "list").mapInArrow(ranked, f"qid {kinds['qid']}, key {kinds['key']}, score double").withColumnRenamed("key", self.key)


def recall(approximate: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(questions, wanted, found, recall): how many of the exact search's rows the approximate one has too."""
    both = exact.select("qid", key).join(approximate.select("qid", key).withColumn("_f", F.lit(True)), ["qid", key], "left")
    return both.agg(F.countDistinct("qid").alias("questions"), F.count(F.lit(1)).alias("wanted"), F.count("_f").alias("found"), (F.count("_f") / F.count(F.lit(1))).alias("recall"))
