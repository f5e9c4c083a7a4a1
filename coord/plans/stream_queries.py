"""Registered streaming queries, each run to the end of its input, and their batch twins.

A stream emits what its watermark has closed; the SQL of a stream leaves out what is still open at the end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.plans.registry import query
from coord.plans.task_queries import FOLD_SQL
from coord.streaming import messages, state, windows
from coord.streaming.io import event_time, open_stream, run_available, run_folder

DELAY = "1 hour"
MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _plain(df):
    """Instants back to zone-less timestamps, as in the tables."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name)
        for f in df.schema
    ])


def _run(df, name):
    return _plain(run_available(df, name))


@query(
    "stream_task_state", "task_commands", stream=("task_commands",),
    sql=FOLD_SQL + """SELECT slug, seq, cmd, from_status, to_status, CASE WHEN ok THEN 'ok' ELSE 'invalid_transition' END AS outcome FROM walk""",
)
def stream_task_state(spark, commands):
    live = state.stream_task_state(commands.select("slug", "seq", "ts", "cmd"))
    return live.outcomes(spark).select("slug", "seq", "cmd", "from_status", "to_status", "outcome")


@query(
    "stream_task_current", "task_commands", stream=("task_commands",),
    sql=FOLD_SQL + "SELECT slug, arg_max(to_status, rn) AS status, max(ts) AS last_ts FROM walk GROUP BY slug",
)
def stream_task_current(spark, commands):
    live = state.stream_task_state(commands.select("slug", "seq", "ts", "cmd"))
    return _plain(live.current(spark).select("slug", "status", "last_ts"))


def sessions_sql(table: str, key: str, gap: str, out: str, closed: bool) -> str:
    end = f"max(ts) + INTERVAL {gap}"
    tail = f" HAVING {end} <= {MARK}" if closed else ""
    return f"""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts) < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM {table}),
      s AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM n)
      SELECT {out} FROM s GROUP BY {key}, sid{tail}"""


IDLE = 'project_id, min(ts) AS "start", max(ts) + INTERVAL 10 MINUTES AS "end", max(ts) AS last_at, count(*) AS events'
LIVE = "agent, min(ts) AS online_at, max(ts) AS last_seen, max(ts) + INTERVAL 12 HOURS AS offline_at"
CHAT = "chat_id, max(ts) AS last_message_at, max(ts) + INTERVAL 2 DAYS AS abandoned_at, count(*) AS events"


@query("idle_sessions", "requests", sql=sessions_sql("requests", "project_id", "10 MINUTES", IDLE, False))
def idle_sessions(spark, requests):
    return windows.idle_sessions(requests)


@query("stream_idle_sessions", "requests", stream=("requests",), sql=sessions_sql("requests", "project_id", "10 MINUTES", IDLE, True))
def stream_idle_sessions(spark, requests):
    return _run(windows.idle_sessions(event_time(requests, DELAY)), "idle")


@query("liveness_sessions", "heartbeats", sql=sessions_sql("heartbeats", "agent", "12 HOURS", LIVE, False))
def liveness_sessions(spark, heartbeats):
    return windows.liveness(heartbeats, timeout="12 hours")


@query("stream_liveness", "heartbeats", stream=("heartbeats",), sql=sessions_sql("heartbeats", "agent", "12 HOURS", LIVE, True))
def stream_liveness(spark, heartbeats):
    return _run(windows.liveness(event_time(heartbeats, DELAY), timeout="12 hours"), "liveness")


@query("chat_timeouts", "chat_activity", sql=sessions_sql("chat_activity", "chat_id", "2 DAYS", CHAT, False))
def chat_timeouts(spark, activity):
    return windows.inactive_chats(activity, after="2 days")


@query(
    "stream_chat_timeouts", "chat_activity", stream=("chat_activity",),
    sql=sessions_sql("chat_activity", "chat_id", "2 DAYS", CHAT, True).replace("FROM events", "FROM chat_activity"),
)
def stream_chat_timeouts(spark, activity):
    return _run(windows.inactive_chats(event_time(activity, DELAY), after="2 days"), "chat-timeouts")


ALERTS_SQL = """w AS (SELECT 'error_rate' AS alert, 'all' AS subject, time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS window_start, status_code FROM requests, range(0, 5) r(k)),
      a AS (SELECT alert, subject, window_start, window_start + INTERVAL 5 MINUTES AS window_end, avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) AS figure
        FROM w GROUP BY ALL HAVING avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) > 0.05),
      c AS (SELECT 'errors' AS alert, user_id AS subject, time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY AS window_end,
        CAST(count(*) AS DOUBLE) AS figure FROM requests WHERE status_code >= 500 GROUP BY ALL HAVING count(*) > 2),
      alerts AS (SELECT * FROM a UNION ALL SELECT * FROM c)"""


def _alerts(requests):
    rate = windows.error_rate(requests, [])
    many = windows.count_alert(requests.filter("status_code >= 500"), "errors", ["user_id"], 2, "1 day")
    return windows.alerts([rate, many])


@query("alert_windows", "requests", sql=f"WITH {ALERTS_SQL} SELECT alert, subject, window_start, window_end, round(figure, 6) AS figure FROM alerts")
def alert_windows(spark, requests):
    return _alerts(requests).withColumn("figure", F.round("figure", 6))


@query(
    "stream_alerts", "requests", stream=("requests",),
    sql=f"WITH {ALERTS_SQL} SELECT alert, subject, window_start, window_end, round(figure, 6) AS figure FROM alerts WHERE window_end <= {MARK}",
)
def stream_alerts(spark, requests):
    return _run(_alerts(event_time(requests, DELAY)).withColumn("figure", F.round("figure", 6)), "alerts")


RUNS_SQL = """n AS (SELECT *, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY alert, subject ORDER BY window_start) <= INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS new FROM a),
      s AS (SELECT *, sum(new) OVER (PARTITION BY alert, subject ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS sid FROM n),
      runs AS (SELECT alert, subject, min(window_start) AS since, max(window_end) AS until, count(*) AS windows FROM s GROUP BY alert, subject, sid
        HAVING max(window_end) - min(window_start) >= INTERVAL 10 MINUTES)"""


@query("sustained_alerts", "requests", sql=f"WITH {ALERTS_SQL}, {RUNS_SQL} SELECT * FROM runs")
def sustained_alerts(spark, requests):
    return windows.sustained(windows.error_rate(requests, []), "1 minute", "10 minutes")


@query(
    "stream_sustained_alerts", "requests", stream=("requests",),
    sql=f"WITH {ALERTS_SQL}, {RUNS_SQL} SELECT * FROM runs WHERE until + INTERVAL 1 MINUTE + INTERVAL 999 MICROSECONDS <= {MARK}",
)
def stream_sustained_alerts(spark, requests):
    rates = windows.error_rate(event_time(requests, DELAY), [], staged=True)
    return _run(windows.sustained(rates, "1 minute", "10 minutes"), "sustained")


SLOW_SQL = """SELECT 'slow' AS alert, 'all' AS subject, time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY AS window_end,
      round(quantile_disc(latency, 0.99), 6) AS figure FROM requests GROUP BY ALL HAVING quantile_disc(latency, 0.99) > 30"""


@query(
    "slow_windows", "requests",
    sql=SLOW_SQL,
)
def slow_windows(spark, requests):
    return windows.slow_alert(requests, [], length="1 day").withColumn("figure", F.round("figure", 6))


@query("stream_slow_windows", "requests", stream=("requests",), sql=f"SELECT * FROM ({SLOW_SQL}) WHERE window_end <= {MARK}")
def stream_slow_windows(spark, requests):
    return _run(windows.slow_alert(event_time(requests, DELAY), [], length="1 day").withColumn("figure", F.round("figure", 6)), "slow")


@query("dedup_messages", "messages", sql="SELECT DISTINCT message_id FROM messages")
def dedup_messages(spark, rows):
    return messages.dedup_messages(rows).select("message_id")


@query("stream_dedup_messages", "messages", stream=("messages",), sql="SELECT DISTINCT message_id FROM messages")
def stream_dedup_messages(spark, rows):
    return _run(messages.dedup_messages(event_time(rows, DELAY)).select("message_id"), "dedup")


VERDICT_SQL = """SELECT r.request_id, r.ts AS requested_at, v.verdict, v.ts AS answered_at FROM permission_requests r LEFT JOIN verdicts v
      ON v.request_id = r.request_id AND v.ts BETWEEN r.ts AND r.ts + INTERVAL 10 MINUTES"""


@query("match_verdicts", "permission_requests", "verdicts", sql=VERDICT_SQL)
def match_verdicts(spark, requests, verdicts):
    return messages.match_verdicts(requests, verdicts)


@query(
    "stream_match_verdicts", "permission_requests", "verdicts", stream=("permission_requests", "verdicts"),
    sql=f"""SELECT * FROM ({VERDICT_SQL}) WHERE answered_at IS NOT NULL OR requested_at + INTERVAL 10 MINUTES <
      least((SELECT max(ts) FROM permission_requests), (SELECT max(ts) FROM verdicts)) - INTERVAL 1 HOUR""",
)
def stream_match_verdicts(spark, requests, verdicts):
    return _run(messages.match_verdicts(event_time(requests, DELAY), event_time(verdicts, DELAY)), "verdicts")


NOTICE_SQL = """SELECT event_id, n.type, recipient, CASE WHEN length(content) < 500 THEN content END AS inline,
      CASE WHEN length(content) < 500 THEN 'inline' ELSE 'reference' END AS delivery FROM notices n JOIN (SELECT DISTINCT * FROM subscriptions) s ON s.type = n.type"""


@query("notifications", "notices", "subscriptions", sql=NOTICE_SQL)
def notifications(spark, notices, subscriptions):
    return messages.notifications(notices, subscriptions)


@query("stream_notifications", "notices", "subscriptions", stream=("notices",), sql=NOTICE_SQL)
def stream_notifications(spark, notices, subscriptions):
    return _run(messages.notifications(notices, subscriptions), "notices")


DECISIONS_SQL = """WITH decision_events AS (SELECT * FROM decision_requests
        UNION ALL SELECT decision, min(ts) AS ts, who, any_value(needed) AS needed, any_value(timeout_s) AS timeout_s FROM decision_answers GROUP BY decision, who),
      d AS (SELECT decision, ts AS asked, needed, ts + to_seconds(timeout_s) AS due FROM decision_events WHERE who IS NULL),
      r AS (SELECT d.decision, e.ts, row_number() OVER (PARTITION BY d.decision ORDER BY e.ts) AS n FROM d JOIN decision_events e ON e.decision = d.decision AND e.who IS NOT NULL),
      g AS (SELECT d.decision, d.needed, d.due, max(r.ts) FILTER (r.n = d.needed) AS at_, count(r.n) FILTER (r.ts <= d.due) AS early FROM d LEFT JOIN r ON r.decision = d.decision GROUP BY ALL)
      SELECT decision, CASE WHEN at_ IS NOT NULL AND (due IS NULL OR at_ <= due) THEN 'completed' ELSE 'failed' END AS status,
        CASE WHEN at_ IS NOT NULL AND (due IS NULL OR at_ <= due) THEN at_ ELSE due END AS at_time,
        CASE WHEN at_ IS NOT NULL AND (due IS NULL OR at_ <= due) THEN needed ELSE early END AS responses FROM g
      WHERE (at_ IS NOT NULL AND (due IS NULL OR at_ <= due)) OR due <= (SELECT max(ts) - INTERVAL 1 HOUR FROM decision_answers)"""


@query("stream_decision_timeouts", "decision_requests", "decision_answers", stream=("decision_requests", "decision_answers"), sql=DECISIONS_SQL)
def stream_decision_timeouts(spark, requests, answers):
    with state.keyed_store(spark):
        out = state.decision_timeouts(event_time(requests.unionByName(answers), DELAY), keep_days=3650, groups=4_096)
        return _run(out, "decisions").withColumnRenamed("at", "at_time")


RUNNER_SQL = f"""WITH RECURSIVE ev AS (
        SELECT runner, date_trunc('milliseconds', ts) AS ms, kind, session, row_number() OVER (PARTITION BY runner ORDER BY date_trunc('milliseconds', ts), seq) AS rn
        FROM runner_events WHERE date_trunc('milliseconds', ts) < date_trunc('milliseconds', {MARK})),
      walk AS (
        SELECT DISTINCT runner, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ms, '' AS cause, '' AS s0, '' AS s1, '' AS s2, '' AS s3, CAST(NULL AS TIMESTAMP) AS lost, 'registered' AS status, CAST(NULL AS TIMESTAMP) AS beat, CAST([] AS VARCHAR[]) AS open FROM ev
        UNION ALL
        SELECT runner, rn, ms, kind, s0, s1, s2, CASE WHEN s2 = 'draining' AND len(open) = 0 THEN 'offline' ELSE s2 END, lost,
               CASE WHEN s2 = 'deregistered' THEN 'registered' WHEN s2 = 'draining' AND len(open) = 0 THEN 'offline' ELSE s2 END,
               CASE WHEN s2 = 'deregistered' THEN NULL WHEN kind = 'heartbeat' AND s1 IN ('registered', 'online', 'offline') THEN ms ELSE beat END,
               CASE WHEN s2 = 'deregistered' THEN [] ELSE open END
        FROM (SELECT *, CASE WHEN kind = 'heartbeat' AND s1 IN ('registered', 'online', 'offline') THEN 'online' WHEN kind = 'drain' AND s1 = 'online' THEN 'draining'
                             WHEN kind = 'deregister' AND s1 IN ('online', 'offline') THEN 'deregistered' ELSE s1 END AS s2
              FROM (SELECT w.runner, ev.rn, ev.ms, ev.kind, w.status AS s0, CASE WHEN w.status = 'online' AND w.beat + INTERVAL 6 HOUR < ev.ms THEN 'offline' ELSE w.status END AS s1,
                           w.beat + INTERVAL 6 HOUR AS lost, w.beat,
                           CASE ev.kind WHEN 'session_opened' THEN list_append(list_filter(w.open, lambda x: x <> ev.session), ev.session)
                                        WHEN 'session_closed' THEN list_filter(w.open, lambda x: x <> ev.session) ELSE w.open END AS open
                    FROM walk w JOIN ev ON ev.runner = w.runner AND ev.rn = w.rn + 1))),
      moves AS (
        SELECT runner, lost AS at_time, s0 AS from_status, s1 AS to_status, 'timeout' AS cause FROM walk WHERE s0 <> s1
        UNION ALL SELECT runner, ms, s1, s2, cause FROM walk WHERE s1 <> s2
        UNION ALL SELECT runner, ms, s2, s3, 'sessions_closed' FROM walk WHERE s2 <> s3
        UNION ALL SELECT runner, beat + INTERVAL 6 HOUR, 'online', 'offline', 'timeout'
          FROM (SELECT runner, arg_max(status, rn) AS status, arg_max(beat, rn) AS beat FROM walk WHERE rn > 0 GROUP BY runner)
          WHERE status = 'online' AND beat + INTERVAL 6 HOUR < {MARK})
      SELECT runner, at_time, from_status, to_status, cause FROM moves"""


@query("stream_runner_status", "runner_events", stream=("runner_events",), sql=RUNNER_SQL.replace("FROM events", "FROM runner_events"))
def stream_runner_status(spark, events):
    with state.keyed_store(spark):
        out = state.runner_status(event_time(events, DELAY), timeout_s=6 * 3600)
        return _run(out, "runners").withColumnRenamed("at", "at_time")
