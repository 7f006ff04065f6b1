"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, one of a few thousand that never change.  Bytes and rows are
aggregated per slot, and a versioned slot-to-shard map says which shard holds which slot.
Rebalancing and growing edit the map, so whole slots move and nothing else.  The map has `slots`
rows whatever the input, so the driver may plan it and every join with it may broadcast it.

Slots go by a hash of the id, so records with equal texts are dealt apart and no group of copies,
however large, makes a slot heavy; the price is that copies aren't found in one shard.

Defined cases: a null text has no bytes; sizes are UTF-8 bytes plus one; documents without an id
are dealt by their text; repeated rows each take a place of their own; an empty table gives an
empty result and an even map; other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(doc: str, text: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(F.col(doc).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(doc))), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_bytes(docs: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each slot that has any."""
    return docs.groupBy(slot_of(doc, text, slots).alias("slot")).agg(F.sum(size_of(text)).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def planned(load: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap, out = [(0, 0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-load.get(s, 0), s)):
        held, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + load.get(slot, 0), n + 1, shard))
    return out


def dealt(shards: int, slots: int = SLOTS) -> list[int]:
    """A map before anything is known of the slots: they are dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(current: list[int], load: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The map with slots moved from the fullest to the emptiest shard until they differ by at most
    `tolerance` of the mean, or no move helps.  More shards than before start out empty."""
    out, held, own = list(current), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        held[shard] += load.get(slot, 0)
        own[shard].append((load.get(slot, 0), slot))
    for x in own:
        x.sort()
    mean = sum(held) / shards
    for _ in range(4 * len(out)):
        a, b = max(range(shards), key=held.__getitem__), min(range(shards), key=held.__getitem__)
        gap = held[a] - held[b]
        fits = [x for x in own[a] if 0 < x[0] < gap]
        if gap <= tolerance * mean or not fits:
            break
        best = min(fits, key=lambda x: abs(gap / 2 - x[0]))
        own[a].remove(best)
        own[b].append(best)
        held[a], held[b] = held[a] - best[0], held[b] + best[0]
        out[best[1]] = b
    return out


def grown(current: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The map with one shard more, `shards` in number before: it takes its share of slots from the
    fullest shards, and no slot moves anywhere else."""
    out, held, own = list(current), [0] * (shards + 1), [[] for _ in range(shards + 1)]
    for slot, shard in enumerate(out):
        held[shard] += load.get(slot, 0)
        own[shard].append((load.get(slot, 0), slot))
    for x in own:
        x.sort()
    goal = sum(held) / (shards + 1)
    while held[shards] < goal:
        fullest = sorted(range(shards), key=lambda s: (-held[s], s))
        found = next(((a, x) for a in fullest for x in reversed(own[a]) if 0 < x[0] <= goal - held[shards]), None)
        if found is None:
            break
        a, (size, slot) = found
        own[a].remove((size, slot))
        held[a], held[shards] = held[a] - size, held[shards] + size
        out[slot] = shards
    return out


def map_frame(spark: SparkSession, shards: list[int]) -> DataFrame:
    """A map as rows of slot and shard, from one literal."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, shards))), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def store_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Adds a version of the map; earlier versions stay as they are."""
    map_frame(spark, shards).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, the latest one by default."""
    found = spark.read.parquet(path)
    version = found.agg(F.max("version")).first()[0] if version is None else version
    return found.filter(F.col("version") == version).select("slot", "shard")


def assigned(docs: DataFrame, slot_map: DataFrame, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs' ids with size, text_crc32, virtual slot, shard, and a place in the shard, gapless from
    0: slots stand one after another, and within a slot ids ascend.  Places are counted per slot
    and offset by the rows of the slots before, so no task sorts a whole shard."""
    rows = docs.select(
        F.col(doc).alias("doc_id"), size_of(text).alias("size"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"), slot_of(doc, text, slots).alias("virtual_slot")
    )
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(slot_map.withColumnRenamed("slot", "virtual_slot").join(counts, "virtual_slot"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    start = whole.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(F.broadcast(start), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("place") - 1).alias("place"))


def op8_query(spark, sf_dir):
    import uuid

    from .support import shared_folder, table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/slot_map-{uuid.uuid4().hex}"
    store_map(spark, path, 1, dealt(8))
    load = {r["slot"]: r["bytes"] for r in slot_bytes(docs).collect()}  # SLOTS rows at most
    current = [r["shard"] for r in load_map(spark, path, 1).orderBy("slot").collect()]
    store_map(spark, path, 2, rebalanced(current, load, 8, tolerance=0.001))  # the map edited: only the slots that must move do
    done = assigned(docs, load_map(spark, path))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
