"""Small things that the operators share: table reading, sizing, tables cut from their lineage."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one under the warehouse where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return folder.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start from files that
    survive a lost executor."""
    spark = df.sparkSession
    path = str(shared_folder(spark)) + f"/{PurePosixPath(name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one column scan, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def blocks_for(total: int, least: int = 6 << 20, most: int = 128 << 20) -> int:
    """How many blocks to deal total bytes into.  Blocks grow with the square root of the input
    between the two bounds, so that blocks x hash ranges stays far below the number of words."""
    size = min(most, max(least, int(least * (total / (1 << 30)) ** 0.5)))
    return max(1, -(-total // size))


def block_of(doc: str, text: str, blocks: int) -> Column:
    """A block by document id; documents without an id are dealt by their text."""
    key = F.when(F.col(doc).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(doc)))
    return F.pmod(key, F.lit(blocks)).cast("int")


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under the names c0, c1, ...: no column that is added can clash with its own."""
    names = docs.columns
    return docs.toDF(*[f"c{k}" for k in range(len(names))]), names


#: Rows of a few numbers that a broadcast may have: some tens of megabytes.
BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, to be joined: broadcast if it is counted to have BROADCAST_ROWS at most, else by a merge
    join.  df should be read from files and have narrow rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


#: Bytes of bitmaps of ids that a broadcast may have; a bitmap tells 32,768 neighbouring ids.
BITMAP_BYTES = 64 << 20


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose whole number `key` is not in ids, read from files, under the same name.  More ids than may be
    broadcast are sent as bitmaps if they lie close enough together, so that the wide rows of df stay where they are; only
    if they don't, both sides meet by a merge join."""
    if ids.count() > BROADCAST_ROWS:
        of = F.col(key).cast("long")
        bits = ids.groupBy(F.bitmap_bucket_number(of).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("_bits"))
        bits = materialised(bits.filter("_bucket is not null"), "ids")
        if bits.count() * 4096 <= BITMAP_BYTES:
            at = F.bitmap_bit_position(of)
            byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            told = df.join(F.broadcast(bits), F.bitmap_bucket_number(of) == F.col("_bucket"), "left")
            return told.filter(F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 0).drop("_bucket", "_bits")
    return df.join(bounded(ids), key, "left_anti")


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows and bytes that go to a Python worker at once in this session, fewer than Spark's default: texts
    are long, and a worker and its executor each hold a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
