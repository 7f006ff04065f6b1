"""Markdown sections and token-bounded chunks, as expressions within one document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNKING
from ..functions.ids import chunk_id, short_hash
from ..functions.text import page_type, strip, token_estimate

_HEADING = r"^(#{1,3})[^\S\n]+(\S.*)"


def sections(body: Column) -> Column:
    """array<struct<headings_path, text>>: the text from each heading of level 1 to 3 to the next, and
    what stands before the first; blank sections are left out.  A heading's path is the last heading of
    each smaller level that no other one has closed, and itself."""
    pieces = F.filter(F.transform(F.split(body, r"(?m)(?=^#{1,3}[^\S\n]+\S)"), strip), lambda x: x != "")
    marked = F.transform(pieces, lambda x: F.struct(F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), strip(F.regexp_extract(x, _HEADING, 2)).alias("title"), x.alias("text")))
    entry = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast("array<struct<headings_path:array<string>,text:string>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        higher = F.filter(state["stack"], lambda h: h["level"] < s["level"])
        stack = F.when(s["level"] == 0, state["stack"]).otherwise(F.concat(higher, F.array(F.struct(s["level"].alias("level"), s["title"].alias("title")))))
        path = F.transform(stack, lambda h: h["title"])
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(path.alias("headings_path"), s["text"].alias("text")))).alias("out"))

    return F.aggregate(marked, start, step, lambda s: s["out"])


def windows(text: Column, preferred: int = CHUNKING.preferred_tokens, overlap: int = CHUNKING.overlap_tokens) -> Column:
    """array<string>: runs of paragraphs of up to 4 * preferred characters; each starts with the tail of
    the one before.  A paragraph is never split.  overlap must be positive."""
    if overlap <= 0:
        raise ValueError("overlap must be positive")
    most, tail_chars = 4 * preferred, 4 * overlap
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("parts"), F.lit(0).alias("size"), none.alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["size"] + F.length(p) + 2 > most) & (F.size(s["parts"]) > 0)
        window = F.array_join(s["parts"], "\n\n")
        tail = F.right(window, F.lit(tail_chars))
        kept = F.when(strip(tail) != "", F.array(tail)).otherwise(none)
        return F.struct(
            F.concat(F.when(full, kept).otherwise(s["parts"]), F.array(p)).alias("parts"),
            (F.when(full, F.length(tail)).otherwise(s["size"]) + F.length(p) + 2).cast("int").alias("size"),
            F.when(full, F.concat(s["out"], F.array(window))).otherwise(s["out"]).alias("out"),
        )

    many = F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["parts"]) > 0, F.concat(s["out"], F.array(F.array_join(s["parts"], "\n\n")))).otherwise(s["out"]))
    return F.when(token_estimate(text) <= preferred, F.array(strip(text))).otherwise(many)


def built(parts: Column, preferred: int = CHUNKING.preferred_tokens, overlap: int = CHUNKING.overlap_tokens, least: int = CHUNKING.min_tokens) -> Column:
    """array<struct<headings_path, text>>: chunks of a document's sections.  Small sections wait and are
    merged with what follows while it fits; large ones are cut into windows; others stand alone."""
    kind = "struct<headings_path:array<string>,text:string>"
    none, path = F.array().cast(f"array<{kind}>"), "array<string>"
    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(None).cast(path).alias("path"), F.lit(0).alias("n"), none.alias("out"))
    chunk = lambda p, t: F.struct(p.alias("headings_path"), t.alias("text"))
    no_text = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        t = token_estimate(x["text"])
        waiting = F.size(s["texts"]) > 0
        flushed = F.when(waiting, F.array(chunk(s["path"], F.array_join(s["texts"], "\n\n")))).otherwise(none)
        joined, first = F.concat(s["texts"], F.array(x["text"])), F.when(waiting, s["path"]).otherwise(x["headings_path"])
        merged = F.array(chunk(first, F.array_join(joined, "\n\n")))
        large = F.transform(windows(x["text"], preferred, overlap), lambda w: chunk(x["headings_path"], w))
        state = lambda texts, p, n, out: F.struct(texts.alias("texts"), p.cast(path).alias("path"), n.cast("int").alias("n"), F.concat(s["out"], out).alias("out"))
        empty = (no_text, F.lit(None), F.lit(0))
        small = F.when(s["n"] + t >= least, state(*empty, merged)).otherwise(state(joined, first, s["n"] + t, none))
        return F.when(t > preferred, state(*empty, F.concat(flushed, large))).when(t < least, small).when(waiting & (s["n"] + t <= preferred), state(*empty, merged)).otherwise(state(*empty, F.concat(flushed, F.array(chunk(x["headings_path"], x["text"])))))

    end = lambda s: F.when(F.size(s["texts"]) > 0, F.concat(s["out"], F.array(chunk(s["path"], F.array_join(s["texts"], "\n\n"))))).otherwise(s["out"])
    return F.aggregate(parts, start, step, end)


def chunked(docs: DataFrame) -> DataFrame:
    """docs with `chunks`, the headings' path and text of each chunk of `body`; null where `error`, if there is such a
    column, isn't."""
    fine = F.col("error").isNull() if "error" in docs.columns else F.lit(True)
    return docs.withColumn("chunks", F.when(fine, built(sections(F.col("body")))))


def chunk_records(docs: DataFrame) -> DataFrame:
    """Chunk records of documents (document_id, url, title, body, crawl_timestamp)."""
    return records_of(chunked(docs))


def records_of(docs: DataFrame) -> DataFrame:
    """Chunk records of documents that have their `chunks`."""
    rows = docs.select("document_id", "url", "title", "crawl_timestamp", F.posexplode("chunks").alias("chunk_index", "c"))
    text = F.col("c.text")
    return rows.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", text.alias("text"), "url", "title",
        page_type(F.col("url")).alias("page_type"), F.col("c.headings_path").alias("headings_path"), short_hash(text).alias("content_hash"), "crawl_timestamp", token_estimate(text).alias("token_count"),
    )
