"""Channel messages: duplicates, permission verdicts, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_BELOW = 500


def dedup_messages(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """Each message id once. On a stream ids are remembered as long as the watermark allows repeats."""
    if messages.isStreaming:
        return messages.dropDuplicatesWithinWatermark([key])
    return messages.dropDuplicates([key])


def match_verdicts(requests: DataFrame, verdicts: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """Permission requests with the verdict given within ``timeout``; unanswered ones follow with nulls.

    ``requests``: ``request_id, ts``; ``verdicts``: ``request_id, ts, verdict``. On streams both sides need a
    watermark, which bounds the state and decides when a request counts as unanswered.
    """
    r = requests.select(F.col("request_id"), F.col("ts").alias("requested_at"))
    v = verdicts.select(F.col("request_id").alias("_rid"), F.col("ts").alias("answered_at"), "verdict")
    in_time = (F.col("answered_at") >= F.col("requested_at")) & (
        F.col("answered_at") <= F.col("requested_at") + F.expr(f"INTERVAL {timeout}")
    )
    return r.join(v, (F.col("request_id") == F.col("_rid")) & in_time, "left").select(
        "request_id", "requested_at", "verdict", "answered_at"
    )


def payload(content: Column) -> Column:
    """Content below 500 characters is sent inline, from 500 on only referenced (ruling for the boundary)."""
    return F.when(F.length(content) < INLINE_BELOW, content)


def notifications(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and recipient subscribed to its type.

    ``events``: ``event_id, type, content``; ``subscriptions`` (a table): ``type, recipient``. Stateless.
    """
    return events.join(subscriptions.select("type", "recipient").distinct(), "type").select(
        "event_id", "type", "recipient", payload(F.col("content")).alias("inline"),
        F.when(F.length("content") < INLINE_BELOW, "inline").otherwise("reference").alias("delivery"),
    )
