"""Event-time windows and sessions. Every function accepts a stream or a table.

On a stream the caller declares the watermark first (``event_time``); rows later than it are dropped by
Spark, and running the same function over the stored log is the correction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Periods of activity per key separated by more than ``gap`` without events; ``end`` includes the gap.

    On a table the rows of a key are first reduced, map-side, to one span per stretch of time no longer than
    the gap: rows that close together always share a session, and a key with very many events shrinks to a
    few spans before anything is sorted. On a stream the session settings merge locally
    (``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``, set by ``get_session``).

    The bounds are computed from the events and not taken from the window column: a later filter on the
    window column would be pushed below the merging of sessions and change them.
    """
    if events.isStreaming:
        spans = events.select(key, "ts", F.col("ts").alias("_hi"), F.lit(1).cast("long").alias("_n"))
        length = gap
    else:
        spans = (
            events.groupBy(key, F.window("ts", gap).alias("_w"))
            .agg(F.min("ts").alias("ts"), F.max("ts").alias("_hi"), F.count(F.lit(1)).alias("_n"))
            .drop("_w")
        )
        micros = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_hi") + F.expr(f"INTERVAL {gap}"))
        length = F.concat(micros.cast("string"), F.lit(" microseconds"))
    s = spans.groupBy(key, F.session_window("ts", length).alias("s")).agg(
        F.min("ts").alias("start"), F.max("_hi").alias("last_at"), F.sum("_n").alias("events")
    )
    return s.select(key, "start", (F.col("last_at") + F.expr(f"INTERVAL {gap}")).alias("end"), "last_at", "events")


def idle_sessions(events: DataFrame, key: str = "project_id", gap: str = "10 minutes") -> DataFrame:
    """Activity sessions of each project; the project is idle from ``end`` on."""
    return sessions(events, key, gap)


def liveness(heartbeats: DataFrame, key: str = "agent", timeout: str = "120 seconds") -> DataFrame:
    """Online periods: an agent is back at ``online_at`` and counts as offline at ``offline_at``,
    ``timeout`` after its last heartbeat."""
    s = sessions(heartbeats, key, timeout)
    return s.select(key, F.col("start").alias("online_at"), F.col("last_at").alias("last_seen"), F.col("end").alias("offline_at"))


def inactive_chats(messages: DataFrame, key: str = "chat_id", after: str = "7 days") -> DataFrame:
    """Chats without a message for ``after``: abandoned at that moment (a later message starts a new period)."""
    s = sessions(messages, key, after)
    return s.select(key, F.col("last_at").alias("last_message_at"), F.col("end").alias("abandoned_at"), "events")


def _windowed(events: DataFrame, length: str, slide: str | None, keys: list[str]):
    return events.groupBy(*keys, F.window("ts", length, slide).alias("w"))


def _out(df: DataFrame, alert: str, keys: list[str]) -> DataFrame:
    """``ts`` is the time of the window, by which a second stage on a stream goes on."""
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    return df.select(
        F.lit(alert).alias("alert"), subject.alias("subject"), F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"), F.col("figure"), F.window_time("w").alias("ts"),
    )


def _stage(staged: bool, df: DataFrame, alert: str, keys: list[str]) -> DataFrame:
    out = _out(df, alert, keys)
    return out if staged else out.drop("ts")


def error_rate(requests: DataFrame, keys: list[str], length: str = "5 minutes", slide: str | None = "1 minute", above: float = 0.05, staged: bool = False) -> DataFrame:
    """Windows in which more than ``above`` of the requests failed with a 5xx code.

    ``staged`` alerts, here and below, keep the time ``ts`` of the window, for ``sustained``.
    """
    bad = F.count_if(F.col("status_code") >= 500)
    return _stage(staged, 
        _windowed(requests, length, slide, keys).agg((bad / F.count(F.lit(1))).alias("figure")).filter(F.col("figure") > above),
        "error_rate", keys,
    )


def count_alert(events: DataFrame, alert: str, keys: list[str], above: int, length: str, slide: str | None = None, staged: bool = False) -> DataFrame:
    """Windows with more than ``above`` events (health-check failures, evictions)."""
    n = _windowed(events, length, slide, keys).agg(F.count(F.lit(1)).cast("double").alias("figure"))
    return _stage(staged, n.filter(F.col("figure") > above), alert, keys)


def slow_alert(samples: DataFrame, keys: list[str], value: str = "latency", above: float = 30.0, length: str = "5 minutes", slide: str | None = None, staged: bool = False) -> DataFrame:
    """Windows whose P99 exceeds ``above``; the quantile is a mergeable sketch, so state stays small."""
    p = _windowed(samples, length, slide, keys).agg(F.percentile_approx(value, 0.99, 10_000).alias("figure"))
    return _stage(staged, p.filter(F.col("figure") > above), "slow", keys)


def alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sustained(windows: DataFrame, slide: str, at_least: str) -> DataFrame:
    """Alerts that fire in consecutive windows for ``at_least``: a second stage of sessions over the windows.

    Windows start ``slide`` apart; a session of their times with that gap is an unbroken run. On a stream the
    windows must be staged: both stages then run in one query, the second with the watermark that the first passes on.
    """
    w = windows if "ts" in windows.columns else windows.withColumn("ts", F.col("window_start"))
    runs = w.groupBy("alert", "subject", F.session_window("ts", slide_gap(slide)).alias("s")).agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_start").alias("since"), F.max("window_end").alias("until")
    )
    lasted = F.col("until") - F.col("since")
    return runs.filter(lasted >= F.expr(f"INTERVAL {at_least}")).select(
        "alert", "subject", "since", "until", "windows"
    )


def slide_gap(slide: str) -> str:
    """The slide plus a millisecond: starts exactly one slide apart belong to the same run."""
    return f"{slide} 1 millisecond"
