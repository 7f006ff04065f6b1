"""The question plane: guard, request checks, history windows, prompts, rate limiting, sessions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GUARD_PATTERNS, LIMITS, QUERY_PREFIX, RETRIEVAL
from ..functions.text import strip

SYSTEM_PROMPT = "You answer questions from the retrieved context only and name your sources."
CONTEXT_INTRO = "\n\n---\n\nRetrieved context:\n\n"
NO_CONTEXT = "\n\n---\n\nNo relevant information was found for this question. Say that you don't have enough context to answer."
REWRITE_PROMPT = "Rewrite the question so that it stands alone; return it unchanged if it already does."
# Words by which a question refers back.
FOLLOW_UP = r"\b(he|she|they|them|it|his|her|their|its|who|that|this|those|these|tell me more|what about|elaborate|the same|mentioned above)\b"


def guard(text: Column, patterns=GUARD_PATTERNS, most: int = LIMITS.question_chars) -> Column:
    """Why a prompt is turned away: empty, too_long, injection; null if it isn't."""
    low, hit = F.lower(text), F.lit(False)
    for p in patterns:
        hit = hit | low.rlike(p)
    return F.when(text.isNull() | (strip(text) == ""), "empty").when(F.length(text) > most, "too_long").when(hit, "injection")


def request_check(question: Column, history: Column, most_chars: int = LIMITS.question_chars, most_items: int = LIMITS.history_items) -> Column:
    """Why a chat request is invalid: question_blank, question_long, history_long, role, content_blank."""
    q = strip(question)
    return (
        F.when(q.isNull() | (q == ""), "question_blank")
        .when(F.length(q) > most_chars, "question_long")
        .when(F.size(history) > most_items, "history_long")
        .when(F.exists(history, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))), "role")
        .when(F.exists(history, lambda m: F.coalesce(strip(m["content"]), F.lit("")) == ""), "content_blank")
    )


def last_n(items: Column, n: int) -> Column:
    """The last n items; all of them if there are fewer, none for n = 0."""
    size = F.size(items)
    return F.slice(items, F.greatest(F.lit(1), size - n + 1), F.lit(n))


def history_window(turns: DataFrame, n: int = RETRIEVAL.max_history, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def chats(turns: DataFrame, keep: int = LIMITS.history_items + 1) -> DataFrame:
    """(conv_id, question, history) of the last user turn of each conversation, from at most `keep`
    turns before it, so that a conversation of any length makes a row of bounded size."""
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("at"))
    rows = turns.join(last, "conv_id").filter(F.col("turn") <= F.col("at"))
    near = history_window(rows, keep + 1)
    folded = near.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return folded.select("conv_id", F.element_at("m", -1)["content"].alias("question"), F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.struct(x["role"], x["content"])).alias("history"))


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def rewrite_messages(question: Column, history: Column, n: int = RETRIEVAL.rewrite_history) -> Column:
    lines = F.transform(last_n(history, n), lambda m: F.concat(F.when(m["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), m["content"]))
    content = F.concat(F.lit("Recent conversation:\n"), F.array_join(lines, "\n"), F.lit("\n\nCurrent question: "), question, F.lit("\n\nOutput only the rewritten query:"))
    return F.array(message("system", F.lit(REWRITE_PROMPT)), message("user", content))


def needs_rewrite(question: Column, history: Column) -> Column:
    """Whether a question refers back: there is a history, and a word that points to it."""
    return (F.size(history) > 0) & F.lower(question).rlike(FOLLOW_UP)


def chat_messages(question: Column, history: Column, context: Column, n: int = RETRIEVAL.max_history) -> Column:
    """System prompt with the context or a notice, the last n messages, the question."""
    system = F.concat(F.lit(SYSTEM_PROMPT), F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(F.concat(F.lit(CONTEXT_INTRO), context)))
    return F.concat(F.array(message("system", system)), F.transform(last_n(history, n), lambda m: message(m["role"], m["content"])), F.array(message("user", question)))


def query_text(question: Column) -> Column:
    """What is embedded of a question; passages are embedded without the prefix."""
    return F.concat(F.lit(QUERY_PREFIX), question)


def rate_limited(events: DataFrame, most: int = LIMITS.requests, window_seconds: int = LIMITS.window_seconds, key: str = "session_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, order, allowed, remaining): a sliding-window limit in which only allowed requests count.

    A partition is read in order of key and time, and holds the last `most` allowed times of one key:
    a session with any number of requests is never gathered."""
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "t", "o")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times = None, deque()
        for b in batches:
            ok, left = [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                if k != now:
                    now, times = k, deque()
                while times and times[0] < t - window_seconds * 1_000_000:
                    times.popleft()
                ok.append(len(times) < most)
                if ok[-1]:
                    times.append(t)
                left.append(max(0, most - len(times)))
            yield pd.DataFrame({"k": b["k"], "o": b["o"], "allowed": ok, "remaining": left})

    k, o = rows.schema["k"].dataType.simpleString(), rows.schema["o"].dataType.simpleString()
    return sorted_rows.mapInPandas(fold, f"k {k}, o {o}, allowed boolean, remaining long").select(F.col("k").alias(key), F.col("o").alias(order), "allowed", "remaining")
