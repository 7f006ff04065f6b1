"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the smallest neighbour of its end.  The smallest neighbours are
broadcast while there are few edges.  Beyond that, nodes with more than `hot` edges, which are few,
have theirs broadcast, so that their edges stay where they are, and the rest meets by a merge join.
Tables are cut from their lineage by files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import BROADCAST_ROWS, materialised


def _with_least(edges: DataFrame, least: DataFrame, few: bool, hot: int) -> DataFrame:
    if few:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    busy = F.broadcast(least.filter(F.col("n") > hot).select("u", "m"))
    rest = edges.join(busy.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= hot).select("u", "m").hint("merge"), "u")
    return edges.join(busy, "u").unionByName(rest)


def _star(edges: DataFrame, large: bool, few: bool, hot: int) -> DataFrame:
    """edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    if large:
        moved = _with_least(both.filter("v > u"), least, few, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = _with_least(edges, least, few, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = BROADCAST_ROWS, hot: int = 100_000) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest node."""
    now = materialised(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(now)
    while before[0]:
        few = 2 * before[0] <= most
        now = materialised(_star(_star(now, True, few, hot), False, few, hot), "edges")
        after = digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
