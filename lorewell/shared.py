"""The folder that driver and executors share, tables cut from their lineage, and a log of commits."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Without it there is none on a cluster; on one machine, as in tests, it is a folder
    below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start from files that survive a lost
    executor."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df with each row's place from 1 in a total order, without one task that sees all rows: rows are dealt into ranges
    of the order, and a range's places start behind the rows of the ranges before it."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialised(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*df.columns, name)


class Files:
    """The few file operations that tables of our own need, in whatever store Spark knows for a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def age_ms(self, path: str, now: int) -> int:
        return now - self._fs.getFileStatus(self._path(path)).getModificationTime()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if it is."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Commits:
    """Numbered manifests below a folder.  What isn't in the latest manifest doesn't count, so a writer that is
    lost midway leaves nothing but files that nobody reads.  Two writers can't take the same number: the later
    one looks at the manifest of the first and tries again.  A manifest that isn't finished is waited for, and after
    `grace_seconds` taken for that of a lost writer; a writer that was only slow finds its commit passed over
    and commits anew."""

    grace_seconds = 30.0

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.files = root.rstrip("/"), Files(spark, root)

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/commits") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, number: int) -> dict | None:
        """A manifest; None while its writer hasn't finished it."""
        try:
            return json.loads(self.files.read(f"{self.root}/commits/{number:012d}.json"))
        except ValueError:
            return None

    def latest(self) -> tuple[int, dict]:
        """Number and manifest of the last commit; 0 and an empty one before the first."""
        for n in reversed(self.numbers()):
            found = self.manifest(n)
            if found is not None:
                return n, found
        return 0, {"segments": []}

    def _settled(self) -> tuple[int, dict]:
        """latest(), once no other writer is at its manifest."""
        until = time.time() + self.grace_seconds
        while True:
            number, manifest = self.latest()
            if number == max([number, *self.numbers()]) or time.time() >= until:
                return number, manifest
            time.sleep(0.1)

    def commit(self, change, tries: int = 20) -> int:
        """Adds change(latest manifest); change is asked again if another writer was faster."""
        for _ in range(tries):
            number, manifest = self._settled()
            own = max([number, *self.numbers()]) + 1
            text = json.dumps({**change(json.loads(json.dumps(manifest))), "after": number})
            if self.files.create(f"{self.root}/commits/{own:012d}.json", text):
                later = [m for m in (self.manifest(n) for n in self.numbers() if n > own) if m]
                if all(m["after"] >= own for m in later):
                    return own
        raise RuntimeError(f"{self.root}: other writers were faster {tries} times")

    def vacuum(self, folders: list[str], kept: set[str], now: int, least_age_ms: int) -> list[str]:
        """Removes those of the folders that aren't kept and are old enough not to be a running writer's."""
        gone = []
        for f in folders:
            if f not in kept and self.files.age_ms(f"{self.root}/{f}", now) >= least_age_ms:
                self.files.remove(f"{self.root}/{f}")
                gone.append(f)
        return gone
