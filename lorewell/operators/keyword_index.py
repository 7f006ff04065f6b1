"""A stored inverted index of points' texts: posting blocks, maintained by upserts and deletes.

Each write adds a segment.  Its points are dealt into ranges of their keys, and a range's postings of a
token are cut into blocks of at most `block` keys in order, with first and last key, their number, and how
many postings of the token stand before them.  So a token that all texts have is many blocks in many
tasks.  Blocks are stored by a hash of the token; beside them each segment has its keys, and the index
which keys of older segments later ones replaced.

A keyword search wants the first `limit` keys that have all index tokens of one of the question's tokens.
These tokens are a term, and a term is looked up once, however many questions have it.  For a term of one
token the hits are the first postings: of each segment, blocks are read until `limit` and as many as the segment
has dead keys have gone by, and no further.  Only terms of several tokens read all blocks of theirs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RETRIEVAL
from ..functions.text import index_tokens, query_tokens
from ..shared import Commits, materialised

_TOKEN_BUCKETS = 64
_BROADCAST_TERMS = 500_000  # terms of questions, or their tokens, that are sent to all executors at most


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term): the index tokens, sorted, of each of a question's tokens that has some.  Written once."""
    tokens = questions.select("qid", F.explode(query_tokens(F.col("qtext"))).alias("t"))
    return materialised(tokens.select("qid", F.array_sort(index_tokens(F.col("t"))).alias("term")).filter(F.size("term") > 0).distinct(), "terms")


def _sent(terms: DataFrame) -> DataFrame:
    """terms, sent to all executors if they are few: then a frequent token is no key that all its postings meet under."""
    return F.broadcast(terms) if terms.count() <= _BROADCAST_TERMS else terms


def first_hits(asked: DataFrame, postings: DataFrame, limit: int | None, early: DataFrame | None = None) -> DataFrame:
    """(qid, k): the first `limit` keys, in order, that have all tokens of one of a question's terms.

    asked: (qid, term); postings: (token, k); early: those that may be among the first of their token.  Each
    distinct term gets its first `limit` keys, among which are those of every question with it, so that the
    rows grow with the postings, not with postings times questions.  For a term of several tokens the
    postings of its rarest are looked up among those of the others."""
    terms = materialised(asked.select("term").distinct(), "distinct-terms")
    one, several = terms.filter(F.size("term") == 1).withColumn("token", F.col("term")[0]), terms.filter(F.size("term") > 1)

    def first(rows: DataFrame, group: str) -> DataFrame:
        return rows if limit is None else rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("k"))).filter(F.col("_r") <= limit).drop("_r")

    found = first((postings if early is None else early).join(_sent(one), "token").select("term", "k"), "term")
    if several.limit(1).count():
        held = materialised(postings.join(_sent(several.select(F.explode("term").alias("token")).distinct()), "token").select("token", "k"), "postings")
        sizes = several.select("term", F.explode("term").alias("token")).join(held.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
        rarest = sizes.groupBy("term").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.count(F.lit(1)).alias("have")).filter(F.col("have") == F.size("term")).select("term", "token")
        others = held.join(_sent(rarest), "token").select("term", "k", F.explode(F.array_remove("term", F.col("token"))).alias("token"))
        whole = others.join(held, ["token", "k"], "left_semi").groupBy("term", "k").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") == F.size("term") - 1)
        found = found.unionByName(first(whole.select("term", "k"), "term"))
    return first(asked.join(found, "term").select("qid", "k").distinct(), "qid")


class KeywordIndex:
    """The index of points (key, text) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", block: int = 256):
        self.spark, self.path, self.key, self.block = spark, path.rstrip("/"), key, block
        self.commits = Commits(spark, self.path)

    def _blocks(self, points: DataFrame) -> DataFrame:
        """token, first, last, n, before, keys: the posting blocks of a segment."""
        ranges = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = points.repartitionByRange(ranges, "k").withColumn("r", F.spark_partition_id())
        tokens = dealt.select("k", "r", F.explode(index_tokens(F.col("text"))).alias("token"))
        # a group is one token in one range of keys: bounded by the range, however common the token
        held = tokens.groupBy("token", "r").agg(F.sort_array(F.collect_list("k")).alias("keys"))
        starts = F.sequence(F.lit(1), F.size("keys"), F.lit(self.block))
        cut = held.select("token", "r", F.posexplode(F.transform(starts, lambda s: F.slice("keys", s, self.block))).alias("i", "keys"))
        order = Window.partitionBy("token").orderBy("r", "i").rowsBetween(Window.unboundedPreceding, -1)
        return cut.select(
            "token", F.element_at("keys", 1).alias("first"), F.element_at("keys", -1).alias("last"), F.size("keys").alias("n"), F.coalesce(F.sum(F.size("keys")).over(order), F.lit(0)).alias("before"), "keys",
            F.pmod(F.xxhash64("token"), F.lit(_TOKEN_BUCKETS)).cast("int").alias("bucket"),
        )

    def upsert(self, points: DataFrame) -> int:
        """Indexes points (key, text), each key once; keys that the index has already are replaced."""
        rows = points.select(F.col(self.key).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        rows.select("k").write.parquet(f"{folder}/keys")
        blocks = self._blocks(rows)
        blocks.repartition(F.col("bucket"), F.pmod(F.xxhash64("first"), F.lit(4))).sortWithinPartitions("bucket", "token", "before").write.partitionBy("bucket").parquet(f"{folder}/blocks")
        return self._commit(name, self.spark.read.parquet(f"{folder}/keys"))

    def delete(self, keys: DataFrame) -> int:
        """Takes keys out of the index."""
        return self._commit(None, keys.select(F.col(self.key).alias("k")).distinct())

    def _commit(self, name: str | None, keys: DataFrame) -> int:
        """A manifest with a new segment, and the keys of older segments that it, or a delete, makes dead."""

        def change(manifest: dict) -> dict:
            segments = []
            for s in manifest["segments"]:
                dead = keys.join(self.spark.read.parquet(f"{self.path}/data/{s['name']}/keys"), "k", "left_semi")
                fresh = f"data/{s['name']}/dead-{uuid.uuid4().hex}"
                known = self._dead(s)
                (dead if known is None else dead.unionByName(known).distinct()).write.parquet(f"{self.path}/{fresh}")
                n = self.spark.read.parquet(f"{self.path}/{fresh}").count()
                segments.append({**s, "dead": n, "dead_keys": fresh} if n else s)
            return {"segments": [*segments, *([{"name": name, "dead": 0, "dead_keys": None, "kind": keys.schema["k"].dataType.simpleString()}] if name else [])]}

        return self.commits.commit(change)

    def _dead(self, segment: dict) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{segment['dead_keys']}") if segment["dead_keys"] else None

    def _tables(self) -> list[tuple[dict, DataFrame]]:
        schema = "token string, first {0}, last {0}, n int, before long, keys array<{0}>, bucket int"
        return [(s, self.spark.read.schema(schema.format(s["kind"])).parquet(f"{self.path}/data/{s['name']}/blocks")) for s in self.commits.latest()[1]["segments"]]

    def frequencies(self) -> DataFrame:
        """(token, df): in how many points a token is.  Dead keys are counted until compact()."""
        rows = [b.select("token", "n") for _, b in self._tables()]
        return reduce(DataFrame.unionByName, rows).groupBy("token").agg(F.sum("n").alias("df"))

    def compact(self, points: DataFrame) -> int:
        """Builds the index anew, as one segment of the given live points."""
        old = {s["name"] for s in self.commits.latest()[1]["segments"]}
        self.upsert(points)
        return self.commits.commit(lambda m: {"segments": [s for s in m["segments"] if s["name"] not in old]})

    def candidates(self, questions: DataFrame, limit: int | None = RETRIEVAL.keyword_limit) -> DataFrame:
        """(qid, key): the first `limit` keys, in order, that have all index tokens of one of a question's tokens."""
        tables = self._tables()
        if not tables:
            return questions.select("qid", F.lit(None).cast("string").alias(self.key)).limit(0)
        asked = question_terms(questions)
        wanted = asked.select(F.size("term").alias("parts"), F.explode("term").alias("token")).distinct().withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(_TOKEN_BUCKETS)).cast("int"))

        def postings(several: bool) -> DataFrame:
            of = _sent(wanted.filter((F.col("parts") > 1) == F.lit(several)).select("token", "bucket").distinct())
            found = []
            for segment, blocks in tables:
                read = blocks if several or limit is None else blocks.filter(F.col("before") < limit + segment["dead"])
                rows, dead = read.join(of, ["bucket", "token"]).select("token", F.explode("keys").alias("k")), self._dead(segment)
                found.append(rows if dead is None else rows.join(dead, "k", "left_anti").select("token", "k"))
            return reduce(DataFrame.unionByName, found)

        return first_hits(asked, postings(True), limit, postings(False)).withColumnRenamed("k", self.key)
