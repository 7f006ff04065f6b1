"""Token-ID files: independent zstandard frames with a trailing seek table.

A file follows the public zstd seekable format.  Its frames hold the ids of whole documents as
little-endian unsigned 32-bit integers; each is compressed by itself.  A skippable frame then holds
the document index (ids, frame, place in the frame, number of tokens), and the last skippable frame
is the seek table: compressed size, decompressed size and checksum (low 32 bits of XXH64) of every
frame.  A reader opens the end of the file and decompresses only the frames it is asked for.

Files are written in ascending document id by one task a range of ids, in the shared folder, under
a name of the task's own and then moved, so a task that runs again replaces what it wrote.

Ids must be whole numbers.  A folder without a scheme is one of Spark's default store.

Defined cases: a null text counts as empty (its only id is the end id); documents without an id come
first; rows with equal ids stand in the order of their texts' hashes; an empty table writes no
documents; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import public_path
from .columnar import pieces, texts
from .presplit import WordIds
from .support import materialised, shared_folder, text_bytes

#: Fixed values of the seekable format.
_SKIPPABLE_INDEX, _SKIPPABLE_TABLE, _FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NO_ID = np.iinfo(np.int64).min


class Writer:
    """Writes one file to a stream; documents come in order."""

    def __init__(self, stream, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.index.append((doc_id, len(self.frames), self.size, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        data = self.zstd.compress(raw)
        self._put(data, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.held, self.size = [], 0

    def _put(self, data: bytes, raw: int, check: int) -> None:
        self.stream.write(data)
        self.written += len(data)
        self.frames.append((len(data), raw, check))

    def close(self) -> None:
        if self.held:
            self._frame()
        columns = np.array(self.index, np.int64).reshape(-1, 4)
        data = self.zstd.compress(np.ascontiguousarray(columns.T).astype("<i8").tobytes())
        self._put(struct.pack("<II", _SKIPPABLE_INDEX, len(data)) + data, 0, 0)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.stream.write(struct.pack("<II", _SKIPPABLE_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, _FOOTER))


class Reader:
    """Reads a file that can seek.  documents() has the index; ids(i) decompresses one frame, unless
    it is the last one used."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        size = stream.seek(0, 2)
        frames, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _FOOTER or kind != 0x80:
            raise ValueError("not a seekable file with checksums")
        table = self._at(size - 9 - 12 * frames, 12 * frames)
        self.frames = [struct.unpack_from("<III", table, 12 * k) for k in range(frames)]
        self.start = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).tolist()
        raw = self.zstd.decompress(self._at(self.start[-2] + 8, self.frames[-1][0] - 8))
        self.index = np.frombuffer(raw, "<i8").reshape(4, -1)
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._last[0] != k:
            raw = self.zstd.decompress(self._at(self.start[k], self.frames[k][0]))
            if len(raw) != self.frames[k][1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k][2]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, raw)
        return self._last[1]

    def ids(self, i: int) -> bytes:
        """The ids of the i-th document."""
        _, k, at, n = self.index[:, i].tolist()
        return self.frame(k)[at : at + 4 * n] if n else b""

    def documents(self) -> Iterator[tuple[int, bytes]]:
        for i, d in enumerate(self.index[0].tolist()):
            yield d, self.ids(i)


def _qualified(spark, folder: str) -> str:
    """folder with the scheme and host of the store that Spark would write it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _open(uri: str, how: str):
    """A file of any store that the URI names; (stream, file system, path)."""
    from pyarrow import fs

    uri = re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", uri))
    store, path = fs.FileSystem.from_uri(uri)
    if how == "w":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path, compression=None), store, path
    return store.open_input_file(path), store, path


@lru_cache(maxsize=4)
def _library(name: str) -> WordIds:
    """The tokenizers library on distinct pre-split words."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    t.no_truncation()
    t.no_padding()
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 50_000):  # words of one sequence, which is cut again by word
            some = [w.decode("utf-8", "surrogatepass") for w in words[i : i + 50_000]]
            e = t.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    return WordIds(encode, special, most=300_000)


def write_tokens(docs: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 0, file_bytes: int = 64 << 20, files: int | None = None) -> DataFrame:
    """Encodes docs and writes them, in ascending order of id, as files of about file_bytes of ids
    under `folder`.  Returns the manifest: path, part, file (their order), n_docs, n_tokens."""
    rows = docs.select(F.col(doc).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = files or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text) // file_bytes))
    order = (F.col("d").asc_nulls_first(), F.xxhash64("t").asc())  # rows with equal or no ids are dealt by their texts
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    folder = _qualified(docs.sparkSession, folder)

    def written(batches):
        from pyspark import TaskContext

        task, own = TaskContext.get(), uuid.uuid4().hex
        part, ids_of, writer, done = task.partitionId(), _library(vocabulary), None, []

        def finish():
            writer.close()
            stream.close()
            final = f"{path.rsplit('/', 1)[0]}/part-{part:06d}-{len(done):04d}.ids.zst"
            store.move(path, final)
            done.append((f"{folder}/part-{part:06d}-{len(done):04d}.ids.zst", part, len(done), len(writer.index), sum(x[3] for x in writer.index)))

        for b in batches:
            for i, j in pieces(b, "t"):
                ids, offsets = ids_of(*texts(b.column("t").slice(i, j - i)))
                for k, d in enumerate(b.column("d").slice(i, j - i).to_pylist()):
                    if writer is None:
                        stream, store, path = _open(f"{folder}/_{own}-{part}-{len(done)}", "w")
                        writer, held = Writer(stream), 0
                    one = ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() + (struct.pack("<I", end_id) if end_id is not None else b"")
                    writer.add(_NO_ID if d is None else d, one)
                    held += len(one)
                    if held >= file_bytes:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "part", "file", "n_docs", "n_tokens"])

    return materialised(ordered.mapInArrow(written, "path string, part long, file long, n_docs long, n_tokens long"), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the tokens in all files before: one row a file is ordered."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of the files' documents, or of those with the ids wanted."""
    files = placed(manifest).select("path", "start")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keep = None if wanted is None else np.array(sorted(wanted), np.int64)

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                with _open(path, "r")[0] as stream:
                    reader = Reader(stream)
                    first = start + np.concatenate([[0], np.cumsum(reader.index[3])])
                    rows = range(reader.index.shape[1]) if keep is None else np.flatnonzero(np.isin(reader.index[0], keep)).tolist()
                    for at in range(0, len(rows), 2000):
                        some = list(rows[at : at + 2000])
                        ids = [None if d == _NO_ID else d for d in reader.index[0, some].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first[some], pa.int64()), pa.array([reader.ids(i) for i in some], pa.binary())], names=["doc_id", "start", "ids"])

    return files.repartition(n, "path").mapInArrow(read, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]))


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)


def op10_query(spark, sf_dir):
    from .support import table

    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    done = read_tokens(manifest)
    return done.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
