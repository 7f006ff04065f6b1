"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the
next.  Every stage but the last returns the columns of `documents`.

1 toxicity            documents with a score of 0.7 or more go
2 jaccard_join        of documents that are alike in 0.8 or more of their 5-word shingles, directly or
                      by others, the one with the smallest doc_id stays
3 substring_dedup     words of 13-word windows that an earlier document has are removed; all else in a
                      text, line breaks too, stays as it is
4 decontamination     documents with a passage within a benchmark item's error budget go
5 bpe                 texts become token ids, and are decoded again as a check
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import bpe, decontamination, jaccard_join, substring_dedup, toxicity
from lorewell.llm.support import materialised, shared_folder, table, text_batches, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    scored = toxicity.toxicity(docs, toxicity.trained(spark, sf_dir), out="_toxicity")
    return scored.filter(F.col("_toxicity.score") < 0.7).drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    found = jaccard_join.jaccard_components(docs, k=5, num=80, den=100)
    later = materialised(found.filter("node <> component").select(F.col("node").alias("doc_id")), "near-copies")
    return without(docs, later, "doc_id").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    done = substring_dedup.substring_dedup(docs, window=13, out="_dedup", joined=False).drop("_dedup")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return decontamination.matched(docs, table(spark, sf_dir, "benchmark"), out="_matches").filter(F.size("_matches") == 0).drop("_matches")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    done = bpe.bpe_encode(docs.select("doc_id", "text"), decoded="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express the learned score, edit matching or the automaton; the tests compare each stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
