"""Objects of a store as a Spark data source: batch reads, committed writes, and a stream of new ones.

    spark.dataSource.register(ObjectSource)
    spark.read.format("objects").option("path", root).load().filter("object_key LIKE 'chunks/%'")
    rows.write.format("objects").mode("append").option("path", root).save()
    spark.readStream.format("objects").option("path", root).load()

Reading lists the store once, without contents, and deals the objects into partitions of `partitionBytes`; a
filter on the key (prefix, suffix, equality, a list) or on the size is applied to the listing, so what it
leaves out is never opened.  An object over `mostBytes` isn't opened either: it has an error and no body.

Writing puts each task's objects into a staging folder; when all tasks have ended the driver moves them to
their keys, and a failed write removes the staging folder; `sweep` removes what tasks that went on after
that, or a lost driver, left.  A task that runs again writes under other
names, and only the one whose message is committed counts.  Of rows with equal keys the last commit wins.

The stream's offset is the time and key of the last object seen; an object that is written again is new again."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

_STAGING = ".staging-"


def _store(root: str):
    """The file system of a root, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", root)) if ":/" in root else f"file://{root}")


@dataclass(frozen=True)
class Entry:
    key: str
    size: int
    modified: int  # nanoseconds


def listed(root: str, folder: str = "") -> list[Entry]:
    """All objects below root, or below one of its folders, without their contents."""
    from pyarrow import fs

    store, base = _store(root)
    base = base.rstrip("/")
    at = f"{base}/{folder}".rstrip("/")
    if store.get_file_info(at).type != fs.FileType.Directory:
        return []
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    keys = ((f.path[len(base) + 1 :], f) for f in found if f.type == fs.FileType.File)
    return [Entry(k, f.size, f.mtime_ns or 0) for k, f in keys if _STAGING not in k and not k.rsplit("/", 1)[-1].startswith((".", "_"))]


def sweep(root: str, least_age_seconds: int = 86_400) -> list[str]:
    """Removes staging folders that lost writers left, if they are older than any write that may still run.  Nobody reads
    them meanwhile."""
    from pyarrow import fs

    store, base = _store(root)
    now = datetime.datetime.now(datetime.timezone.utc)
    gone = [f.path for f in store.get_file_info(fs.FileSelector(base.rstrip("/"))) if f.base_name.startswith(_STAGING) and (f.mtime is None or (now - f.mtime).total_seconds() >= least_age_seconds)]
    for path in gone:
        store.delete_dir(path)
    return gone


@dataclass
class Objects(InputPartition):
    entries: list[Entry]

    def __init__(self, entries: list[Entry]):
        super().__init__(None)
        self.entries = entries


def dealt(entries: list[Entry], most: int, cost: int = 64 << 10) -> list[Objects]:
    """Partitions of about `most` bytes; opening an object counts as `cost`."""
    out, held, size = [], [], 0
    for e in sorted(entries, key=lambda e: e.key):
        if held and size + e.size + cost > most:
            out.append(Objects(held))
            held, size = [], 0
        held.append(e)
        size += e.size + cost
    return [*out, Objects(held)] if held else out


def _tests(f: Filter):
    """What a filter asks of an entry; None if it can't be told from the listing."""
    column = getattr(f, "attribute", None)
    if column == ("object_key",):
        if isinstance(f, StringStartsWith):
            return lambda e: e.key.startswith(f.value)
        if isinstance(f, StringEndsWith):
            return lambda e: e.key.endswith(f.value)
        if isinstance(f, EqualTo):
            return lambda e: e.key == f.value
        if isinstance(f, In):
            return lambda e: e.key in f.value
    if column == ("size",):
        for kind, test in ((LessThan, int.__lt__), (LessThanOrEqual, int.__le__), (GreaterThan, int.__gt__), (GreaterThanOrEqual, int.__ge__), (EqualTo, int.__eq__)):
            if type(f) is kind:
                return lambda e, test=test: test(e.size, f.value)
    return None


class _Reads:
    """What batch and stream share: options, and how a partition is read."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("mostbytes", 10 << 20))
        self.target = int(options.get("partitionbytes", 32 << 20))

    def read(self, partition: Objects) -> Iterator[tuple]:
        store, base = _store(self.root)
        for e in partition.entries if partition else []:  # Spark asks once even if there are none
            at = datetime.datetime.fromtimestamp(e.modified / 1e9, datetime.timezone.utc)
            if e.size > self.most:
                yield (e.key, e.size, at, None, "too large")
                continue
            try:
                with store.open_input_stream(f"{base.rstrip('/')}/{e.key}", compression=None) as f:
                    yield (e.key, e.size, at, f.read().decode(), None)
            except (FileNotFoundError, UnicodeDecodeError) as x:
                yield (e.key, e.size, at, None, type(x).__name__)


class ObjectReader(_Reads, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _tests(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Objects]:
        prefixes = [f.value for f in self.filters if isinstance(f, StringStartsWith) and f.attribute == ("object_key",)]
        folder = max((p.rpartition("/")[0] for p in prefixes), key=len, default="")
        tests = [_tests(f) for f in self.filters]
        return dealt([e for e in listed(self.root, folder) if all(t(e) for t in tests)], self.target)


@dataclass
class Staged(WriterCommitMessage):
    objects: list[tuple[str, str]]  # where an object is, and its key


class ObjectWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, base = _store(self.root)
        folder = f"{base.rstrip('/')}/{_STAGING}{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        out = []
        try:
            for n, row in enumerate(iterator):
                key, body = row["object_key"], row["body"]
                if not key or key.startswith("/") or ".." in key.split("/"):
                    raise ValueError(f"no object can have the key {key!r}")
                with store.open_output_stream(f"{folder}/{n}", compression=None) as f:
                    f.write((body or "").encode())
                out.append((f"{folder}/{n}", key))
        except BaseException:
            store.delete_dir(folder)
            raise
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = _store(self.root)
        moves = {key: at for m in messages if m for at, key in m.objects}
        for parent in {key.rpartition("/")[0] for key in moves}:
            store.create_dir(f"{base.rstrip('/')}/{parent}".rstrip("/"), recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(x[1], f"{base.rstrip('/')}/{x[0]}"), moves.items()))
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, base = _store(self.root)
        try:
            store.delete_dir(f"{base.rstrip('/')}/{_STAGING}{self.job}")
        except FileNotFoundError:
            pass


class ObjectStream(_Reads, DataSourceStreamReader):
    """Offsets are the time and key of an object; a batch has what lies after one and up to another."""

    def initialOffset(self) -> dict:
        return {"at": -1, "key": ""}

    def latestOffset(self) -> dict:
        last = max(((e.modified, e.key) for e in listed(self.root)), default=(-1, ""))
        return {"at": last[0], "key": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Objects]:
        a, b = (start["at"], start["key"]), (end["at"], end["key"])
        return dealt([e for e in listed(self.root) if a < (e.modified, e.key) <= b], self.target)

    def commit(self, end: dict) -> None:
        pass


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "object_key string, size long, modified timestamp, body string, error string"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are replaced one by one: write with mode('append')")
        return ObjectWriter(self.options)

    def streamReader(self, schema) -> ObjectStream:
        return ObjectStream(self.options)
