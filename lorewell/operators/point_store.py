"""A store of points that takes upserts and deletes: segments of equal buckets, and a log of commits.

A write adds one segment with the changed rows only, dealt into the store's buckets by key; a deleted
key is a row that says so.  Of a key the newest segment counts.  All segments are bucketed alike, so reading
them together joins bucket with bucket and shuffles nothing.  compact() folds the segments into one, in
new buckets if asked.  A segment counts once a commit names it; what a lost writer left behind is never
read, and vacuum() removes it."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Commits
from .index import stale_points

_DEAD = "_dead"


class PointStore:
    """Rows by a key, in a folder that driver and executors share.

    The first write fixes the columns; `buckets` is that of a new store (a bucket should be some hundreds of
    megabytes at most), else the stored number counts."""

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id", buckets: int = 32):
        self.spark, self.path, self.key, self._buckets = spark, path.rstrip("/"), key, buckets
        self.commits = Commits(spark, self.path)

    # reading

    def version(self) -> int:
        return self.commits.latest()[0]

    def _manifest(self, version: int | None) -> dict:
        found = self.commits.latest()[1] if version is None else self.commits.manifest(version)
        if not found or "schema" not in found:
            raise ValueError(f"{self.path} has no points" + ("" if version is None else f" of version {version}"))
        return found

    def _segment(self, folder: str, manifest: dict) -> DataFrame:
        """A segment as a bucketed table, known to this session's catalogue by its folder's name."""
        name, schema = f"points_{folder.rsplit('/', 1)[-1]}", T.StructType.fromJson(manifest["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(_DEAD, T.BooleanType())])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {manifest['buckets']} BUCKETS LOCATION '{self.path}/{folder}'")
        return self.spark.table(name)

    def _live(self, manifest: dict, segments: list[str], dead_too: bool = False) -> DataFrame:
        """The rows of segments that no later one of them replaces, each joined with the later ones bucket by bucket."""
        tables = [self._segment(s, manifest) for s in segments]
        own = []
        for i, t in enumerate(tables):
            for later in tables[i + 1 :]:
                t = t.join(later.select(self.key), self.key, "left_anti")
            own.append(t if dead_too else t.filter(~F.col(_DEAD)).drop(_DEAD))
        return reduce(DataFrame.unionByName, own)

    def read(self, version: int | None = None) -> DataFrame:
        """The points of the latest version or an earlier one."""
        manifest = self._manifest(version)
        return self._live(manifest, manifest["segments"])

    # writing

    def _write(self, rows: DataFrame, buckets: int) -> str:
        """rows, with _dead, as a segment that no commit names yet."""
        name = uuid.uuid4().hex
        dealt = rows.repartition(buckets, self.key)
        dealt.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.path}/data/{name}").saveAsTable(f"points_{name}")
        return f"data/{name}"

    def _shape(self, rows: DataFrame) -> tuple[T.StructType, int]:
        latest = self.commits.latest()[1]
        return (T.StructType.fromJson(latest["schema"]), latest["buckets"]) if "schema" in latest else (rows.schema, self._buckets)

    def _add(self, rows: DataFrame, schema: T.StructType, buckets: int) -> int:
        segment = self._write(rows, buckets)

        def change(manifest: dict) -> dict:
            if manifest.get("buckets", buckets) != buckets:
                raise RuntimeError("the store was dealt into other buckets meanwhile; write again")
            return {"segments": [*manifest["segments"], segment], "schema": schema.jsonValue(), "buckets": buckets}

        return self.commits.commit(change)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Adds rows or replaces those of their keys, and gives the new version.  Of rows with equal keys the last by
        `order` counts; without an order, the largest.  Rows without a key are an error."""
        schema, buckets = self._shape(rows.drop(order) if order and order not in rows.columns else rows)
        rest = [c for c in schema.names if c != self.key]
        last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest))
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit("a point has no key"))).alias(self.key)
        one = rows.groupBy(key).agg(last.alias("_n")).select(self.key, *[F.col(f"_n.{c}").alias(c) for c in rest]).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        return self._add(one.withColumn(_DEAD, F.lit(False)), schema, buckets)

    def delete(self, keys: DataFrame) -> int:
        """Takes points away by their keys, and gives the new version."""
        schema, buckets = self._shape(keys)
        gone = keys.select(self.key).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in schema]
        return self._add(gone.select(*empty, F.lit(True).alias(_DEAD)), schema, buckets)

    def remove_stale(self, current: DataFrame, document: str = "document_id") -> int:
        """Takes away the points of documents that were processed now but that aren't among their present ones."""
        return self.delete(stale_points(self.read().select(document, self.key), current, document, self.key))

    def compact(self, buckets: int | None = None) -> int:
        """Folds the segments into one without the deleted keys.  Segments that come meanwhile stay beside it, unless
        the number of buckets changes: then the writer is told to write again."""
        _, manifest = self.commits.latest()
        old, new = manifest["segments"], buckets or manifest["buckets"]
        merged = self._write(self._live(manifest, old).withColumn(_DEAD, F.lit(False)), new)

        def change(now: dict) -> dict:
            rest = [s for s in now["segments"] if s not in old]
            if len(rest) + len(old) != len(now["segments"]) or (rest and new != now["buckets"]):
                raise RuntimeError("the store was changed meanwhile; compact again")
            return {**now, "segments": [merged, *rest], "buckets": new}

        return self.commits.commit(change)

    def vacuum(self, keep: int = 2, least_age_seconds: int = 86_400) -> list[str]:
        """Removes the segments that none of the last `keep` versions names, if they are older than any writer that
        may still be at work."""
        named = [m for m in (self.commits.manifest(n) for n in self.commits.numbers()[-keep:]) if m]
        kept = {s for m in named for s in m["segments"]}
        there = [f"data/{n}" for n in self.commits.files.names(f"{self.path}/data")]
        gone = self.commits.vacuum(there, kept, int(time.time() * 1000), least_age_seconds * 1000)
        for folder in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS points_{folder.rsplit('/', 1)[-1]}")
        return gone
