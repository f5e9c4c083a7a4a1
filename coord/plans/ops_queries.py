"""Registered queries over operational records."""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.operators import ops
from coord.plans.registry import AS_OF, query
from coord.sources import files


def _as_of():
    return F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(
    "system_status", "heartbeats", "tasks",
    sql=f"""WITH a AS (SELECT agent, max(ts) AS last_seen, arg_max(seq, seq) % 2 = 0 AS busy FROM heartbeats GROUP BY agent),
      x AS (SELECT *, date_sub('second', last_seen, {AS_OF}) > 43200 AS off FROM a), t AS (SELECT * FROM tasks)
      SELECT 'agents' AS section, 'total' AS name, count(*) AS value FROM x UNION ALL SELECT 'agents', 'active', count(*) FROM x WHERE NOT off AND busy
      UNION ALL SELECT 'agents', 'idle', count(*) FROM x WHERE NOT off AND NOT busy UNION ALL SELECT 'agents', 'offline', count(*) FROM x WHERE off
      UNION ALL SELECT 'tasks', 'active', count(*) FROM t WHERE status <> 'completed'
      UNION ALL SELECT 'tasks', 'completed_today', count(*) FROM t WHERE status = 'completed' AND updated_at BETWEEN {AS_OF} - INTERVAL 24 HOURS AND {AS_OF}
      UNION ALL SELECT 'tasks', 'failed_today', 0 UNION ALL SELECT 'tasks_by_status', status, count(*) FROM t WHERE status <> 'completed' GROUP BY status""",
)
def system_status(spark, heartbeats, tasks):
    agents = heartbeats.groupBy(F.col("agent").alias("name")).agg(
        F.max("ts").alias("last_seen"), F.when(F.max("seq") % 2 == 0, "t").alias("current_task")
    )
    return ops.system_status(agents, tasks, _as_of(), 43200)


@query(
    "counter_rollup", "requests",
    sql="""WITH d AS (SELECT user_id, ts, latency AS v, lag(latency) OVER (PARTITION BY user_id ORDER BY ts, request_id) AS p FROM requests)
      SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS samples,
        round(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END), 6) AS increase,
        round(round(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END), 6) / 86400, 9) AS rate FROM d GROUP BY 1, 2""",
)
def counter_rollup(spark, requests):
    return ops.counter_rollup(requests, ["user_id"], "1 day", "latency", ["ts", "request_id"])


@query(
    "gauge_rollup", "requests",
    sql="""SELECT project_id, time_bucket(INTERVAL '5 minutes', ts) AS window_start, arg_max(latency, request_id) AS last_value FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, time_bucket(INTERVAL '5 minutes', ts) ORDER BY ts DESC, request_id DESC) AS n FROM requests)
      WHERE n = 1 GROUP BY 1, 2""",
)
def gauge_rollup(spark, requests):
    return ops.gauge_rollup(requests, ["project_id"], "5 minutes", "latency", ["ts", "request_id"])


@query(
    "latency_percentiles", "requests",
    sql="""SELECT endpoint, project_id, count(latency) AS samples, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95,
      round(quantile_cont(latency, 0.99), 6) AS p99 FROM requests GROUP BY 1, 2""",
)
def latency_percentiles(spark, requests):
    got = ops.latency_percentiles(requests, ["endpoint", "project_id"])
    return got.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


@query(
    "quota_status", "quota_samples",
    sql="""WITH l AS (SELECT project_id, used / quota AS r, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, seq DESC) AS n FROM quota_samples)
      SELECT project_id, round(r, 6) AS ratio, CASE WHEN r > 1 THEN 'exceeded' WHEN r > 0.9 THEN 'warning' ELSE 'ok' END AS status FROM l WHERE n = 1""",
)
def quota_status(spark, samples):
    return ops.quota_status(samples)


@query(
    "authorize_requests", "requests", "access_grants",
    sql="""SELECT r.request_id, r.user_id, r.project_id, coalesce(g.access_level, 'none') AS access_level, CASE WHEN g.access_level IS NULL THEN 'denied'
      WHEN r.ts >= g.cached_at AND date_sub('second', g.cached_at, r.ts) <= 864000 THEN 'fresh' ELSE 'stale' END AS decision
      FROM requests r LEFT JOIN access_grants g ON g.user_id = r.user_id AND g.project_id = r.project_id""",
)
def authorize_requests(spark, requests, grants):
    return ops.authorize_requests(requests, grants, ttl_s=864000)


@query(
    "crash_loops", "lifecycle_events",
    sql="""WITH f AS (SELECT project_id, ts, count(*) OVER (PARTITION BY project_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
        FROM lifecycle_events WHERE type = 'failed')
      SELECT DISTINCT project_id, ts, n AS restarts, n >= 3 AS looping, greatest(0, 3 - n) AS budget_left FROM f""",
)
def crash_loops(spark, events):
    return ops.crash_loops(events.filter("type = 'failed'"), "24 HOURS")


@query(
    "failure_streaks", "health_checks",
    sql="""WITH i AS (SELECT *, sum(CASE WHEN health <> 'unhealthy' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ts, seq) AS isl FROM health_checks),
      s AS (SELECT *, sum(CASE WHEN health = 'unhealthy' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, isl ORDER BY ts, seq) AS streak FROM i)
      SELECT project_id, ts, seq, health, CAST(streak AS BIGINT) AS streak, streak >= 3 AS failed, health = 'degraded' AS alert FROM s""",
)
def failure_streaks(spark, checks):
    return ops.failure_streaks(checks)


@query(
    "rate_limit_audit", "api_requests",
    sql="""WITH k AS (SELECT *, CASE WHEN category = 'execute' THEN CAST(project_id AS VARCHAR) ELSE '' END AS p,
        CASE category WHEN 'execute' THEN 10 WHEN 'query' THEN 60 ELSE 30 END AS rate_limit FROM api_requests),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id, category, p, date_trunc('minute', ts) ORDER BY ts, request_id) AS n FROM k)
      SELECT request_id, user_id, category, n, rate_limit, n > rate_limit AS over, greatest(0, rate_limit - n) AS remaining,
        date_trunc('minute', ts) + INTERVAL 1 MINUTE AS resets_at FROM r""",
)
def rate_limit_audit(spark, requests):
    return ops.rate_limit_audit(requests)


@query(
    "eviction_candidates", "containers",
    sql="SELECT * FROM containers WHERE container_status IN ('paused', 'stopped')",
)
def eviction_candidates(spark, containers):
    got = ops.eviction_candidates(containers.withColumn("active_sessions", F.lit(0)))
    return got.drop("active_sessions")


@query(
    "idle_and_retention", "containers",
    sql="""SELECT project_id, container_status, CASE WHEN container_status = 'running' AND idle_since < TIMESTAMP '1998-11-25 00:00:00' - INTERVAL 10 MINUTES THEN 'pause'
        WHEN container_status = 'paused' AND idle_since < TIMESTAMP '1998-11-25 00:00:00' - INTERVAL 24 HOURS THEN 'stop'
        WHEN container_status = 'terminated' AND idle_since < TIMESTAMP '1998-11-25 00:00:00' - INTERVAL 30 DAYS THEN 'purge' ELSE 'keep' END AS action,
      coalesce(idle_since < TIMESTAMP '1998-11-25 00:00:00' - INTERVAL 7 DAYS, false) AS clear_cache FROM containers""",
)
def idle_and_retention(spark, containers):
    return ops.idle_and_retention(containers, F.expr("TIMESTAMP_NTZ '1998-11-25 00:00:00'"))


@query("recent_activity", "task_commands", sql="SELECT * FROM task_commands ORDER BY ts DESC, seq DESC LIMIT 10")
def recent_activity(spark, commands):
    return ops.recent_activity(commands)


@query(
    "recent_activity_per_agent", "task_commands",
    sql="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY by_agent ORDER BY ts DESC, seq DESC) AS rank FROM task_commands) WHERE rank <= 10",
)
def recent_activity_per_agent(spark, commands):
    return ops.recent_activity_per(commands, "by_agent")


@query(
    "lifecycle_durations", "lifecycle_events",
    sql="""WITH n AS (SELECT *, lead(type) OVER w AS t2, lead(ts) OVER w AS ts2 FROM lifecycle_events WINDOW w AS (PARTITION BY project_id ORDER BY ts, seq))
      SELECT project_id, type AS opened_by, t2 AS closed_by, ts AS opened_at, date_sub('millisecond', ts, ts2) AS duration_ms FROM n
      WHERE (type, t2) IN (('creating', 'running'), ('paused', 'resumed'), ('failed', 'restarted'))""",
)
def lifecycle_durations(spark, events):
    return ops.lifecycle_durations(events)


@query(
    "liveness_gaps", "heartbeats",
    sql=f"""WITH n AS (SELECT agent, ts, lead(ts) OVER (PARTITION BY agent ORDER BY ts, seq) AS nx FROM heartbeats)
      SELECT agent, ts AS last_seen, ts + INTERVAL 43200 SECONDS AS offline_at, nx AS back_at FROM n WHERE ts + INTERVAL 43200 SECONDS < coalesce(nx, {AS_OF})""",
)
def liveness_gaps(spark, heartbeats):
    return ops.liveness_gaps(heartbeats, 43200, _as_of())


@query(
    "correlate_traces", "spans", "trace_logs",
    sql="""WITH RECURSIVE p AS (SELECT s.*, s.parent_id IS NOT NULL AND q.span_id IS NULL AS orphan FROM spans s
        LEFT JOIN spans q ON q.trace_id = s.trace_id AND q.span_id = s.parent_id),
      d AS (SELECT trace_id, span_id, 0 AS depth FROM p WHERE parent_id IS NULL OR orphan UNION ALL
        SELECT p.trace_id, p.span_id, d.depth + 1 FROM d JOIN p ON p.trace_id = d.trace_id AND p.parent_id = d.span_id),
      l AS (SELECT trace_id, count(*) AS n, count(*) FILTER (level = 'error') AS e FROM trace_logs GROUP BY trace_id)
      SELECT p.trace_id, count(*) AS spans, count(*) FILTER (orphan) AS orphans, max(depth) AS max_depth, min(ts) AS started_at, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
        max(duration_ms) AS longest_ms, bool_or(status = 'R') AS has_error, coalesce(max(n), 0) AS log_lines, coalesce(max(e), 0) AS error_lines
      FROM p JOIN d USING (trace_id, span_id) LEFT JOIN l ON l.trace_id = p.trace_id GROUP BY p.trace_id""",
)
def correlate_traces(spark, spans, logs):
    return ops.correlate_traces(spans, logs, error_status="R")


@query("event_payload", "events", sql="SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_payload(spark, events):
    """A field of the open payload of every event."""
    return files.payload_values(events, {"k": "$.k bigint"}, "props").select("event_id", "event_type", "k")


@query(
    "payload_schemas", "events",
    sql="""SELECT event_type, count(*) AS events, count(*) FILTER (json_valid(props)) AS parsed,
      'OBJECT<' || (SELECT string_agg(DISTINCT key || ': BIGINT', ', ') FROM (SELECT unnest(json_keys(e.props)) AS key FROM events e WHERE e.event_type = o.event_type)) || '>' AS schema
      FROM events o GROUP BY event_type""",
)
def payload_schemas(spark, events):
    """What the payloads of each type hold."""
    return files.payload_schemas(events, "event_type", "props")
