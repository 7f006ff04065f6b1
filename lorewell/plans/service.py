"""Whole jobs: pages to index points, and batches of questions to answers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import ids
from ..functions import text as tx
from ..operators import chat, chunking, cleaning, index, retrieval
from ..operators.point_store import PointStore
from ..streaming.runs import RunLog, observed_write


def chunk_pages(pages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Chunk records of pages (url, title, body, crawl_timestamp): cleaned, without error pages, long past
    events and empty bodies."""
    as_of = F.current_date() if as_of is None else as_of
    rows = cleaning.cleaned(pages)
    kept = rows.filter(~tx.is_error_page(F.col("body")) & ~tx.is_stale(F.col("url"), F.col("body"), as_of) & (tx.strip(F.col("body")) != ""))
    return chunking.chunk_records(kept.withColumn("document_id", ids.doc_id(F.col("url"))))


def chunk_run(docs: DataFrame, path: str, log: RunLog) -> dict:
    """Writes the chunk records of documents (document_id, url, title, body, crawl_timestamp, error) to path, and gives
    the run's counters: documents processed, skipped (without chunks) and failed, and all chunks.  They are
    observed in the plan that writes, and logged."""
    n, fine = F.size("chunks"), F.col("error").isNull()
    counters = {"processed": F.count_if(fine & (n > 0)), "skipped": F.count_if(fine & (n <= 0)), "failed": F.count_if(~fine), "total_chunks": F.coalesce(F.sum(F.when(fine, n)), F.lit(0))}
    return observed_write(chunking.chunked(docs), path, log, "chunk", chunking.records_of, **counters)


def index_chunks(chunks: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of chunk records: points have point_id and embedding, rejects a reason."""
    checked = index.validated(index.with_defaults(chunks))
    context = retrieval.embed_context(F.col("title"), F.coalesce("headings_path", F.array().cast("array<string>")), F.col("text"))
    good = checked.filter("reason IS NULL").drop("reason")
    return good.withColumns({"point_id": ids.point_id(F.col("chunk_id")), "embedding": embed(context)}), checked.filter("reason IS NOT NULL")


def index_run(chunks: DataFrame, store: PointStore, embed, path: str, log: RunLog) -> dict:
    """Indexes chunk records: valid ones are embedded, written to path and put into the store, and points of their documents
    that are no longer there go.  Gives the run's counters, which are logged: documents with a valid chunk, documents
    with none (failed), chunks embedded and skipped, and stale points.  Chunks are counted in the plan that writes."""
    checked = index.validated(index.with_defaults(chunks))
    context = retrieval.embed_context(F.col("title"), F.coalesce("headings_path", F.array().cast("array<string>")) if "headings_path" in chunks.columns else F.array().cast("array<string>"), F.col("text"))
    good = F.col("reason").isNull()
    rows = checked.withColumns({"point_id": ids.point_id(F.col("chunk_id")), "embedding": F.when(good, embed(context))})
    stats = observed_write(rows, path, log, "embed", chunks=F.count_if(good), skipped=F.count_if(~good))
    written = chunks.sparkSession.read.parquet(path)
    points = written.filter("reason IS NULL").drop("reason")
    store.upsert(points)
    stale = index.stale_points(store.read().select("document_id", "point_id"), points)
    stats["stale"] = stale.count()
    if stats["stale"]:
        store.delete(stale)
    by_doc = written.groupBy("document_id").agg(F.count_if(good).alias("n"))
    documents, failed = by_doc.agg(F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 0)).first()
    log.add(f"counters-{path.rsplit('/', 1)[-1]}", "completed", "embed-counters", stats=stats | {"documents": documents, "failed": failed})
    return stats | {"documents": documents, "failed": failed}


def rewritten(question: Column, history: Column, rewrite=None) -> Column:
    """The search text of a question: rewritten if it refers back and a rewriter is given."""
    if rewrite is None:
        return question
    return F.when(chat.needs_rewrite(question, history), F.coalesce(rewrite(chat.rewrite_messages(question, history)), question)).otherwise(question)


def extractive(messages: Column, context: Column) -> Column:
    """A stand-in for a language model: the first lines of the context."""
    return F.when(F.coalesce(context, F.lit("")) == "", "I don't have enough context to answer that.").otherwise(F.substring_index(context, "\n", 3))


def answer(requests: DataFrame, points: DataFrame, embed, rewrite=None, generate=extractive) -> DataFrame:
    """(qid, reason, answer, sources, messages) of requests (qid, question, history).

    Requests that are turned away have a reason and nothing else; only the others are searched."""
    rows = requests.withColumn("reason", F.coalesce(chat.request_check(F.col("question"), F.col("history")), chat.guard(F.col("question"))))
    asked = rows.filter("reason IS NULL").select("qid", rewritten(F.col("question"), F.col("history"), rewrite).alias("qtext"))
    asked = asked.withColumn("qvec", embed(chat.query_text(F.col("qtext"))))
    found = retrieval.hybrid_search(asked, points)
    context = retrieval.context_block(found, points).select("qid", "context")
    source = F.struct("source_rank", "title", "url", "score")
    sources = retrieval.dedup_sources(found, points).groupBy("qid").agg(F.sort_array(F.collect_list(source)).alias("sources"))  # a few a question
    full = rows.join(context, "qid", "left").join(sources, "qid", "left")
    ok = F.col("reason").isNull()
    messages = chat.chat_messages(F.col("question"), F.col("history"), F.col("context"))
    return full.select("qid", "reason", F.when(ok, generate(messages, F.col("context"))).alias("answer"), F.when(ok, F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType))).alias("sources"), F.when(ok, messages).alias("messages"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(qid, seq, line): the event stream of each answer: its tokens, its sources, done; or an error."""
    event = lambda kind, **x: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in x.items()]))
    tokens = F.transform(F.filter(F.split("answer", r"(?<=\s)"), lambda t: t != ""), lambda t: event("token", content=t))
    fine = F.concat(tokens, F.array(event("sources", sources=F.col("sources")), F.to_json(F.struct(F.lit("done").alias("type")))))
    events = F.when(F.col("reason").isNull(), fine).otherwise(F.array(event("error", message=F.col("reason"))))
    return answers.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", F.concat(F.lit("data: "), "e", F.lit("\n\n")).alias("line"))


def parsed_events(lines: DataFrame) -> DataFrame:
    """(qid, seq, type, content) of event lines; lines that aren't events, or not JSON, are dropped."""
    rows = lines.filter(F.col("line").startswith("data: ")).select("qid", "seq", F.from_json(F.regexp_replace("line", r"^data: |\s+$", ""), "type string, content string, message string").alias("e"))
    return rows.filter("e.type IS NOT NULL").select("qid", "seq", "e.type", F.coalesce("e.content", "e.message").alias("content"))


def sessions(minted: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with `known`: whether their session was minted here."""
    return requests.join(minted.select("session_id").distinct().withColumn("_m", F.lit(True)), "session_id", "left").withColumn("known", F.coalesce("_m", F.lit(False))).drop("_m")


def run_row(stage: str, observed: dict) -> dict:
    """A run's row from the counters that a stage observed."""
    failed = int(observed.get("failed", 0))
    return {"stage": stage, "status": "FAILED" if failed else "DONE", "stats": observed | {"failed": failed}, "request_limit": LIMITS.requests}
