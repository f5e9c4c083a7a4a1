"""Operational rollups: status, metrics, quotas, rate limits, health, containers, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.functions.status import is_terminal, lookup
from coord.operators import ordered as O
from coord.operators.graph import climb
from coord.operators.skew import hot_join
from coord.session import cut_lineage


def system_status(agents: DataFrame, tasks: DataFrame, as_of: Column, timeout_s: int = 120) -> DataFrame:
    """One row per figure (section, name, value).

    ``agents``: ``name, last_seen, current_task``; ``tasks``: ``status, updated_at``. Finished figures cover
    the 24 hours before ``as_of``.
    """
    offline = F.col("last_seen").isNull() | (F.timestamp_diff("SECOND", F.col("last_seen"), as_of) > timeout_s)
    busy = F.col("current_task").isNotNull()
    a = agents.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~offline & busy).alias("active"),
        F.count_if(~offline & ~busy).alias("idle"), F.count_if(offline).alias("offline"),
    ).unpivot([], ["total", "active", "idle", "offline"], "name", "value")
    day = F.col("updated_at").between(as_of - F.expr("INTERVAL 24 HOURS"), as_of)
    t = tasks.agg(
        F.count_if(~is_terminal(F.col("status"))).alias("active"),
        F.count_if((F.col("status") == "completed") & day).alias("completed_today"),
        F.count_if((F.col("status") == "failed") & day).alias("failed_today"),
    ).unpivot([], ["active", "completed_today", "failed_today"], "name", "value")
    by = tasks.filter(~is_terminal(F.col("status"))).groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    tag = lambda df, s: df.select(F.lit(s).alias("section"), "name", "value")
    return tag(a, "agents").unionByName(tag(t, "tasks")).unionByName(tag(by, "tasks_by_status"))


def counter_rollup(
    samples: DataFrame, labels: Sequence[str], window: str, value: str = "value", order: Sequence[str] = ("ts", "seq"),
    window_s: int | None = None, chunks: int | None = None,
) -> DataFrame:
    """Increase and per-second rate of counters per label set and window; a drop means a restart from 0."""
    prev = O.over_order(samples, labels, order, O.lag("_prev", F.col(value)), chunks=chunks)
    v, p = F.col(value), F.col("_prev")
    delta = F.when(p.isNull(), 0.0).when(v < p, v).otherwise(v - p)
    out = prev.groupBy(*labels, F.window(order[0], window).alias("w")).agg(
        F.sum(delta).alias("_inc"), F.count(F.lit(1)).alias("samples")
    )
    start, end = F.col("w.start"), F.col("w.end")
    secs = F.lit(window_s) if window_s else F.timestamp_diff("SECOND", start, end)
    return out.select(
        *labels, start.alias("window_start"), "samples", F.round("_inc", 6).alias("increase"),
        F.round(F.round("_inc", 6) / secs, 9).alias("rate"),
    )


def gauge_rollup(samples: DataFrame, labels: Sequence[str], window: str, value: str = "value", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last value of a gauge per label set and window."""
    out = samples.groupBy(*labels, F.window(order[0], window).alias("w")).agg(F.max_by(value, F.struct(*order)).alias("last_value"))
    return out.select(*labels, F.col("w.start").alias("window_start"), "last_value")


def latency_percentiles(requests: DataFrame, keys: Sequence[str], value: str = "latency", exact: bool = True) -> DataFrame:
    """P50, P95 and P99 per key.

    ``exact`` interpolates from counted values without holding a group in memory; otherwise mergeable
    sketches of bounded size answer in one pass.
    """
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        return O.exact_quantiles(requests, keys, value, fractions)
    q = F.percentile_approx(value, list(fractions.values()), 10_000)
    got = requests.groupBy(*keys).agg(F.count(value).alias("samples"), q.alias("_q"))
    return got.select(*keys, "samples", *[F.col("_q")[i].alias(n) for i, n in enumerate(fractions)])


def quota_status(samples: DataFrame) -> DataFrame:
    """Latest usage against the limit per project (``project_id, ts, seq, used, quota``): above 0.9 warning,
    above 1.0 exceeded."""
    last = samples.groupBy("project_id").agg(F.max_by(F.struct("used", "quota"), F.struct("ts", "seq")).alias("s"))
    ratio = F.col("s.used") / F.col("s.quota")
    state = F.when(ratio > 1.0, "exceeded").when(ratio > 0.9, "warning").otherwise("ok")
    return last.select("project_id", F.round(ratio, 6).alias("ratio"), state.alias("status"))


def authorize_requests(requests: DataFrame, grants: DataFrame, ttl_s: int = 300) -> DataFrame:
    """Access level of each request and whether its cached grant is fresh; without a grant it is denied."""
    g = grants.select("user_id", "project_id", "access_level", "cached_at")
    age = F.timestamp_diff("SECOND", F.col("cached_at"), F.col("ts"))
    decision = F.when(F.col("access_level").isNull(), "denied").when((age >= 0) & (age <= ttl_s), "fresh").otherwise("stale")
    return requests.join(g, ["user_id", "project_id"], "left").select(
        "request_id", "user_id", "project_id", F.coalesce("access_level", F.lit("none")).alias("access_level"), decision.alias("decision")
    )


def crash_loops(
    restarts: DataFrame, interval: str = "1 HOUR", threshold: int = 3, budget: int = 3, key: str = "project_id",
    chunks: int | None = None,
) -> DataFrame:
    """Restarts in the trailing interval at each restart time, whether that is a loop, and the budget left."""
    n = O.trailing_count(restarts, [key], "ts", interval, "restarts", chunks)
    return n.select(
        key, "ts", "restarts", (F.col("restarts") >= threshold).alias("looping"),
        F.greatest(F.lit(0), budget - F.col("restarts")).cast("long").alias("budget_left"),
    )


def failure_streaks(
    checks: DataFrame, key: str = "project_id", max_failures: int = 3, order: Sequence[str] = ("ts", "seq"),
    chunks: int | None = None,
) -> DataFrame:
    """Consecutive failed health checks at each check; a success or ``degraded`` resets, ``failed`` from the limit on."""
    bad = F.col("health") == "unhealthy"
    counted = cut_lineage(
        O.over_order(checks, [key], order, O.running_sum("_bad", bad.cast("long")), chunks=chunks)
    )
    marked = O.over_order(
        counted, [key], order, O.last_known("_at_reset", F.when(~bad, F.col("_bad"))), chunks=chunks
    )
    streak = F.col("_bad") - F.coalesce("_at_reset", F.lit(0))
    return marked.select(
        *checks.columns, streak.alias("streak"), (streak >= max_failures).alias("failed"),
        (F.col("health") == "degraded").alias("alert"),
    )


# Requests per minute and whether the project is part of the key.
RATE_LIMITS = {"execute": (10, True), "credentials": (30, False), "query": (60, False), "admin": (30, False)}


def rate_limit_audit(
    requests: DataFrame, limits: dict[str, tuple[int, bool]] = RATE_LIMITS, chunks: int | None = None
) -> DataFrame:
    """Position of each request in its fixed minute, what remains, and when the window resets.

    ``requests``: ``request_id, ts, user_id, project_id, category``.
    """
    limit = lookup(F.col("category"), {c: n for c, (n, _) in limits.items()})
    per_project = F.col("category").isin([c for c, (_, p) in limits.items() if p])
    keyed = requests.withColumns(
        {
            "_minute": F.date_trunc("minute", F.col("ts")),
            "_project": F.when(per_project, F.col("project_id").cast("string")).otherwise(""),
        }
    )
    ranked = O.over_order(
        keyed, ["user_id", "category", "_project", "_minute"], ["ts", "request_id"], O.rank("n"), chunks=chunks,
    )
    return ranked.select(
        "request_id", "user_id", "category", "n", limit.alias("rate_limit"), (F.col("n") > limit).alias("over"),
        F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"),
        (F.col("_minute") + F.expr("INTERVAL 1 MINUTE")).cast(requests.schema["ts"].dataType).alias("resets_at"),
    )


def eviction_candidates(containers: DataFrame, needed: int | None = None) -> DataFrame:
    """Paused or stopped containers without active sessions, longest idle first, unknown idle time last."""
    c = containers.filter("container_status IN ('paused', 'stopped') AND coalesce(active_sessions, 0) = 0")
    out = c.orderBy(F.col("idle_since").asc_nulls_last(), "project_id")
    return out.limit(needed) if needed is not None else out


def idle_and_retention(
    containers: DataFrame, as_of: Column, pause: str = "10 MINUTES", stop: str = "24 HOURS", purge: str = "30 DAYS", cache: str = "7 DAYS"
) -> DataFrame:
    """Action due for each container at ``as_of``: pause, stop, purge; ``clear_cache`` flags an unused cache."""
    s, idle = F.col("container_status"), F.col("idle_since")
    older = lambda iv: idle < as_of - F.expr(f"INTERVAL {iv}")
    action = (
        F.when((s == "running") & older(pause), "pause").when((s == "paused") & older(stop), "stop")
        .when((s == "terminated") & older(purge), "purge").otherwise("keep")
    )
    return containers.select(
        "project_id", "container_status", action.alias("action"), F.coalesce(older(cache), F.lit(False)).alias("clear_cache")
    )


def recent_activity(events: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` events over all (top-k)."""
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def recent_activity_per(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    return O.top_per_key(events, [key], [F.col("ts").desc(), F.col("seq").desc()], n)


# Lifecycle event that opens an interval -> the one that closes it.
LIFECYCLE_PAIRS = {"creating": "running", "paused": "resumed", "failed": "restarted"}


def lifecycle_durations(
    events: DataFrame, key: str = "project_id", pairs: dict[str, str] = LIFECYCLE_PAIRS, chunks: int | None = None
) -> DataFrame:
    """Intervals between an opening event and the closing one that directly follows it in the project."""
    nxt = O.over_order(
        events, [key], ["ts", "seq"], O.lead("_next", F.struct(F.col("type").alias("type"), F.col("ts").alias("ts"))),
        chunks=chunks,
    )
    return nxt.filter(lookup(F.col("type"), pairs) == F.col("_next.type")).select(
        key, F.col("type").alias("opened_by"), F.col("_next.type").alias("closed_by"), F.col("ts").alias("opened_at"),
        F.timestamp_diff("MILLISECOND", F.col("ts"), F.col("_next.ts")).alias("duration_ms"),
    )


def liveness_gaps(heartbeats: DataFrame, timeout_s: int, as_of: Column, key: str = "agent", chunks: int | None = None) -> DataFrame:
    """Offline periods: a heartbeat with no other within the timeout; ``back_at`` is null while it lasts."""
    nxt = O.over_order(heartbeats, [key], ["ts", "seq"], O.lead("_next", F.col("ts")), chunks=chunks)
    until = F.coalesce("_next", as_of)
    offline = F.col("ts") + F.expr(f"INTERVAL {timeout_s} SECONDS")
    return nxt.filter(offline < until).select(key, F.col("ts").alias("last_seen"), offline.alias("offline_at"), F.col("_next").alias("back_at"))


def span_depths(spans: DataFrame, keys: Sequence[str] = ("trace_id", "span_id")) -> DataFrame:
    """Depth of every span in its trace, roots and orphans 0; null when parents form a cycle.

    Parents are climbed by doubling, so a trace of depth d takes log d rounds.
    """
    t, s = keys
    rows = cut_lineage(spans.select(t, s, "parent_id"))
    ids = rows.select(t, F.col(s).alias("parent_id")).distinct().withColumn("_has", F.lit(True))
    known = hot_join(rows, ids, [t, "parent_id"]).withColumn("orphan", F.col("parent_id").isNotNull() & F.col("_has").isNull())
    known = cut_lineage(known.select(t, s, "parent_id", "orphan"))
    has_parent = F.col("parent_id").isNotNull() & ~F.col("orphan")
    ways = climb(known.select(F.struct(F.col(t).alias("t"), F.col(s).alias("s")).alias("node"), F.when(has_parent, F.struct(F.col(t).alias("t"), F.col("parent_id").alias("s"))).alias("up")))
    depth = F.when(F.col("top").isNotNull(), F.col("dist").cast("int")).alias("depth")
    return known.select(t, s, "orphan").join(ways.select(F.col("node.t").alias(t), F.col("node.s").alias(s), depth), [t, s])


def correlate_traces(spans: DataFrame, logs: DataFrame | None = None, error_status: str = "error") -> DataFrame:
    """Per trace: spans, orphans, depth, start, total and longest duration, error flag, log lines by level."""
    tree = span_depths(spans)
    per = spans.join(tree, ["trace_id", "span_id"]).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if("orphan").alias("orphans"), F.max("depth").alias("max_depth"),
        F.min("ts").alias("started_at"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"),
        F.bool_or(F.col("status") == error_status).alias("has_error"),
    )
    if logs is None:
        return per
    lines = logs.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("log_lines"), F.count_if(F.col("level") == "error").alias("error_lines")
    )
    return per.join(lines, "trace_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("log_lines", "error_lines")}
    )
