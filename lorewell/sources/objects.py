"""Object stores as tables: listings, documents, sidecars, chunk files, and their sinks."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIMITS
from ..operators.records import content_type
from ..shared import Files, materialised
from .object_source import ObjectSource

_S, _L = T.StringType(), T.ArrayType(T.StringType())
CHUNK = T.StructType([T.StructField(n, t) for n, t in (("chunk_id", _S), ("document_id", _S), ("chunk_index", T.IntegerType()), ("text", _S), ("url", _S), ("title", _S), ("page_type", _S), ("headings_path", _L), ("content_hash", _S), ("crawl_timestamp", _S), ("token_count", T.IntegerType()))])
PAGE = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _S), ("url", _S), ("title", _S), ("crawl_depth", T.IntegerType()), ("crawl_timestamp", T.TimestampType()), ("content_hash", _S), ("markdown_size_bytes", T.IntegerType()), ("status_code", T.IntegerType()), ("response_headers", T.MapType(_S, _S)), ("internal_links", _L), ("external_links", _L), ("last_modified", _S), ("etag", _S))])
PDF = "pdf"


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified) of all files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def oversized(spark: SparkSession, path: str, glob: str, most_bytes: int) -> DataFrame:
    """(path, size, error) of the files over a limit, from the listing."""
    return listing(spark, path, glob).filter(F.col("size") > most_bytes).select("path", "size", F.lit("too large").alias("error"))


def documents(spark: SparkSession, path: str, most_bytes: int = LIMITS.document_bytes) -> DataFrame:
    """(path, content, error) of all Markdown files; a file over the limit has an error instead of text,
    and is not read: the listing tells its size."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    fine = rows.filter(F.col("_metadata.file_size") <= most_bytes).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.lit(None).cast("string").alias("error"))
    return fine.unionByName(oversized(spark, path, "*.md", most_bytes).select("path", F.lit(None).cast("string").alias("content"), "error"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Page metadata files; what can't be parsed is in _corrupt."""
    schema = T.StructType([*PAGE.fields, T.StructField("_corrupt", _S)])
    return spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").json(path)


def chunk_files(spark: SparkSession, path: str, most_bytes: int = LIMITS.chunk_file_bytes) -> DataFrame:
    """Chunk records of all chunk files, each a JSON array; files over the limit, which
    oversized() has, are not read."""
    rows = spark.read.schema(CHUNK).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.filter(F.col("_metadata.file_size") <= most_bytes).select(*CHUNK.names)


def _bucket_folders(spark: SparkSession, path: str) -> tuple[dict[int, str], int]:
    """The newest folder of each bucket of chunks, and the number of the next snapshot.  Snapshots that
    weren't written to the end don't count; buckets outside a snapshot are older than all."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    found = lambda pattern: [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []]
    number = lambda folder, name: int(re.search(rf"/{name}=(\d+)(?:/|$)", folder)[1])
    done = {number(f, "snapshot") for f in found("snapshot=*/_SUCCESS")}
    inside = [f for f in found("snapshot=*/bucket=*") if number(f, "snapshot") in done]
    newest = {number(f, "bucket"): f for f in [*found("bucket=*"), *sorted(inside, key=lambda f: number(f, "snapshot"))]}
    return newest, 1 + max((number(f, "snapshot") for f in found("snapshot=*")), default=-1)


def _lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.text(folders) if folders else spark.createDataFrame([], "value string")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunk records by document, as JSON lines; a later write of a document replaces its earlier chunks
    only.  The buckets that are touched are written anew, with their other documents, into a snapshot
    folder; what was there is only read, and counts no more.  One writer at a time.  `buckets` is that of a
    new folder, some hundreds of megabytes each at most; later writes take the number that was stored."""
    spark, files = chunks.sparkSession, Files(chunks.sparkSession, path)
    if "buckets.json" not in files.names(path):
        files.create(f"{path}/buckets.json", json.dumps(64 if files.names(path) else buckets))
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(json.loads(files.read(f"{path}/buckets.json")))).cast("int").alias("bucket")
    newest, snapshot = _bucket_folders(spark, path)
    touched = [r["bucket"] for r in chunks.select(bucket).distinct().collect()]  # no more than there are buckets
    held = _lines(spark, [newest[b] for b in touched if b in newest]).withColumn("document_id", F.get_json_object("value", "$.document_id"))
    written = chunks.select(F.col("document_id").alias("d")).distinct()
    others = held.join(written, F.col("document_id").eqNullSafe(F.col("d")), "left_anti").select("value", bucket)
    rows = chunks.select(F.to_json(F.struct("*")).alias("value"), bucket).unionByName(others)
    rows.repartition("bucket").write.partitionBy("bucket").text(f"{path}/snapshot={snapshot:08d}")


def written_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of all documents that write_chunks() has written to path, as last written."""
    lines = _lines(spark, list(_bucket_folders(spark, path)[0].values()))
    return lines.select(F.from_json("value", CHUNK).alias("c")).select("c.*")


def chunk_array_json(chunks: DataFrame) -> DataFrame:
    """(document_id, json): the chunks of each document as one JSON array, in order."""
    row = F.struct("chunk_index", F.struct(*CHUNK.names).alias("c"))
    return chunks.groupBy("document_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["c"])).alias("json"))


def hash_index(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, url) of all sidecars that can be parsed; of equal hashes the last path wins."""
    rows = sidecars(spark, path).withColumn("path", F.col("_metadata.file_path")).filter("content_hash IS NOT NULL")
    return rows.groupBy("content_hash").agg(F.max_by("url", "path").alias("url"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and host of the store that Spark would write it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def write_objects(rows: DataFrame, folder: str, key: str = "object_key", body: str = "body") -> DataFrame:
    """Writes each row's text as an object of its own under its key, now, and gives (object_key, size) of what was
    written.  Of rows with equal keys one stays.  Rows without a key or with one that leaves the folder are
    errors, and then nothing is written."""
    spark = rows.sparkSession
    spark.dataSource.register(ObjectSource)
    one = materialised(rows.select(F.col(key).alias("object_key"), F.coalesce(F.col(body), F.lit("")).alias("body")).groupBy("object_key").agg(F.max("body").alias("body")), "objects")
    one.write.format("objects").mode("append").option("path", _qualified(spark, folder)).save()
    return one.select("object_key", F.octet_length("body").cast("long").alias("size"))


def fetch(spark: SparkSession, folder: str, *keys: str, most_bytes: int = LIMITS.document_bytes) -> DataFrame:
    """(object_key, size, content_type, body, error) of the objects with these keys; others aren't opened."""
    spark.dataSource.register(ObjectSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("objects").option("path", _qualified(spark, folder)).option("mostBytes", most_bytes).load().filter(F.col("object_key").isin(*keys))
    return rows.select("object_key", "size", content_type(F.col("object_key")).alias("content_type"), "body", "error")


def sidecar_json(pages: DataFrame, key: str = "object_key") -> DataFrame:
    """(object_key, body): the metadata of each page as JSON that is indented by two, under the sidecar's key."""
    fields = [f for f in PAGE.names if f in pages.columns]
    stamp = lambda f: F.date_format(f, "yyyy-MM-dd'T'HH:mm:ssxxx").alias(f) if isinstance(PAGE[f].dataType, T.TimestampType) else F.col(f)

    @F.pandas_udf("string")
    def indented(x: pd.Series) -> pd.Series:
        return x.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    record = F.to_json(F.struct(*[stamp(f) for f in fields]), {"ignoreNullFields": "false"})
    return pages.select(F.regexp_replace(key, r"\.md$", ".meta.json").alias("object_key"), indented(record).alias("body"))


def visit_log_lines(log: DataFrame) -> DataFrame:
    """One text line a visit, in crawl order."""
    return log.orderBy("crawl_seq").select(F.format_string("%-9s depth=%d %s %s", "status", "depth", "url", F.coalesce("reason", F.lit(""))).alias("value"))


def write_visit_log(log: DataFrame, folder: str, stamp: str) -> str:
    """Writes the log's lines as text files in order, in a folder that is named by the run's time stamp."""
    path = f"{folder.rstrip('/')}/{stamp}"
    visit_log_lines(log).write.text(path)
    return path


def _docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    paragraphs = ("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))
    plain = (p.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&") for p in paragraphs)
    return "\n\n".join(p.strip() for p in plain if p.strip())


def _pdf_text(data: bytes, most_pages: int, most_chars: int) -> str:
    """Text of a PDF's first pages, by a reader library where one is installed."""
    import pypdf

    parts, size = [], 0
    for page in pypdf.PdfReader(io.BytesIO(data)).pages[:most_pages]:
        parts.append((page.extract_text() or "").strip())
        size += len(parts[-1])
        if size >= most_chars:
            break
    return "\n\n".join(p for p in parts if p)


def document_text(files: DataFrame, most_bytes: int = LIMITS.download_bytes, most_chars: int = LIMITS.document_chars, most_pages: int = LIMITS.document_pages, pdf=_pdf_text) -> DataFrame:
    """(path, text, error) of binary document files (path, content): word-processor files, and PDFs by
    `pdf`, a function of the bytes and the two bounds; other kinds and too large files are errors, and so
    is a PDF where no reader is installed."""

    @F.pandas_udf("text string, error string")
    def extract(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for path, data in zip(paths, contents, strict=True):
            kind = path.rsplit(".", 1)[-1].lower()
            try:
                if data is None or len(data) > most_bytes:
                    out.append((None, "too large"))
                elif kind == "docx":
                    out.append((_docx_text(data)[:most_chars], None))
                elif kind == PDF:
                    out.append((pdf(bytes(data), most_pages, most_chars)[:most_chars], None))
                else:
                    out.append((None, f"unsupported: {kind}"))
            except ImportError:
                out.append((None, "no PDF reader"))
            except (zipfile.BadZipFile, KeyError, ValueError) as e:
                out.append((None, f"unreadable: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.select("path", extract("path", "content").alias("x")).select("path", "x.text", "x.error")
