"""Chats, channel messages, session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.operators import ordered as O


def chat_stats(messages: DataFrame, chats: DataFrame | None = None, order: str = "turn") -> DataFrame:
    """Messages per chat and role, first and last activity; a chat without messages is ``created``."""
    stats = messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.min(order).alias("first_at"), F.max(order).alias("last_at"),
    )
    if chats is not None:
        stats = chats.select("chat_id").distinct().join(stats, "chat_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("messages", "user_messages", "assistant_messages")]
    status = F.when(F.coalesce("messages", F.lit(0)) == 0, "created").otherwise("active")
    return stats.select("chat_id", *zero, "first_at", "last_at", status.alias("status"))


def chat_context_window(messages: DataFrame, first: int, last: int, order: str = "turn") -> DataFrame:
    """First ``first`` and last ``last`` messages per chat, each once, with the number left out between.

    Both ends are row-number limits, cut map-side; a chat of any length sends only these rows.
    """
    head = O.top_per_key(messages, ["chat_id"], [F.col(order)], first).drop("rank")
    tail = O.top_per_key(messages, ["chat_id"], [F.col(order).desc()], last).drop("rank")
    size = messages.groupBy("chat_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = head.unionByName(tail).dropDuplicates(["chat_id", order])
    return kept.join(size, "chat_id").withColumn(
        "elided", F.greatest(F.col("_n") - (first + last), F.lit(0)).cast("long")
    ).drop("_n")


def pending_delivery(messages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Undelivered messages of sessions whose host is back, in session order.

    ``messages``: ``session_id, seq, processed`` (and ``host`` when ``hosts`` is given).
    """
    waiting = messages.filter("NOT processed")
    if hosts is not None:
        waiting = waiting.join(hosts.filter("status = 'online'").select("host").distinct(), "host", "left_semi")
    return waiting.orderBy("session_id", "seq")


def tail_logs(logs: DataFrame, n: int, key: str = "session_id", order: str = "seq", since: Column | None = None) -> DataFrame:
    """Last ``n`` lines per session, oldest first by ``order``; optionally only those after ``since``."""
    rows = logs if since is None else logs.filter(F.col("ts") >= since)
    return O.top_per_key(rows, [key], [F.col(order).desc()], n).drop("rank").orderBy(key, order)
