"""Registered queries over tasks and their command logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.operators import history, tasks
from coord.plans.registry import AS_OF, query
from coord.session import cut_lineage
from coord.sources.standins import STANDINS

# The task transitions as rows for SQL.
TRANSITION_ROWS = ", ".join(f"('{s}', '{c}', '{t}')" for (s, c), t in history.TASK_TRANSITIONS.items())

FOLD_SQL = f"""
WITH RECURSIVE tr(s, c, t) AS (VALUES {TRANSITION_ROWS}),
cmds AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts, seq) AS rn FROM task_commands),
walk AS (
  SELECT c.slug, c.rn, c.seq, c.ts, c.cmd, c.by_agent, 'planning' AS from_status,
         coalesce(tr.t, 'planning') AS to_status, tr.t IS NOT NULL AS ok
  FROM cmds c LEFT JOIN tr ON tr.s = 'planning' AND tr.c = c.cmd WHERE c.rn = 1
  UNION ALL
  SELECT c.slug, c.rn, c.seq, c.ts, c.cmd, c.by_agent, w.to_status, coalesce(tr.t, w.to_status), tr.t IS NOT NULL
  FROM walk w JOIN cmds c ON c.slug = w.slug AND c.rn = w.rn + 1
  LEFT JOIN tr ON tr.s = w.to_status AND tr.c = c.cmd
)
"""


@query(
    "fold_task_state", "task_commands",
    sql=FOLD_SQL + """SELECT slug, seq, ts, cmd, from_status, to_status,
      CASE WHEN ok THEN 'ok' ELSE 'invalid_transition' END AS outcome FROM walk""",
)
def fold_task_state(spark, task_commands):
    return history.fold(task_commands.select("slug", "seq", "ts", "cmd"))


@query(
    "task_current_state", "task_commands",
    sql=FOLD_SQL + """SELECT slug, coalesce(arg_max(to_status, rn) FILTER (WHERE ok), 'planning') AS status,
      max(ts) FILTER (WHERE ok) AS updated_at,
      CASE WHEN arg_max(cmd, rn) FILTER (WHERE ok AND cmd IN ('claim', 'release')) = 'claim'
           THEN arg_max(by_agent, rn) FILTER (WHERE ok AND cmd IN ('claim', 'release')) END AS agent,
      count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected
      FROM walk GROUP BY slug""",
)
def task_current_state(spark, task_commands):
    states = history.task_states(history.fold(task_commands))
    return states.select("slug", "status", "updated_at", "agent", "accepted", "rejected")


@query(
    "status_counts", "task_commands",
    sql=FOLD_SQL + """SELECT status, count(*) AS tasks FROM (
      SELECT slug, arg_max(to_status, rn) AS status FROM walk GROUP BY slug) GROUP BY status""",
)
def status_counts(spark, task_commands):
    states = history.task_states(history.fold(task_commands))
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


@query(
    "list_tasks", "tasks",
    sql="SELECT * FROM tasks WHERE status = 'queued' AND project = 'proj7'",
)
def list_queued(spark, t):
    return tasks.list_tasks(t, status="queued", project="proj7")


@query("select_fields", "tasks", sql="SELECT slug, status, requester, updated_at FROM tasks")
def select_fields(spark, t):
    return tasks.select_fields(t, ["slug", "status", "requester", "updated_at"])


@query(
    "page_after", "tasks",
    sql="""SELECT slug, ordinal, max(CASE WHEN n = 20 THEN ordinal END) OVER () AS next_cursor, total > 20 AS has_more
      FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS n, count(*) OVER () AS total
            FROM tasks WHERE status = 'queued' AND ordinal > 100) WHERE n <= 20""",
)
def page_after(spark, t):
    page = tasks.page_after(t.filter("status = 'queued'"), "ordinal", cursor=100)
    return page.select("slug", "ordinal", "next_cursor", "has_more")


@query(
    "rebuild_board", "task_docs", "board",
    sql="""SELECT d.slug, CASE WHEN b.slug IS NULL THEN 'planning' ELSE b.status END AS status,
      CASE WHEN b.slug IS NULL THEN d.depends_on ELSE b.depends_on END AS depends_on, b.branch, b.agent
      FROM task_docs d LEFT JOIN board b ON b.slug = d.slug""",
)
def rebuild_board(spark, docs, board):
    return tasks.rebuild_board(docs, board)


UNMET = """SELECT d.slug, CAST(d.dep AS VARCHAR) AS dep, t.status AS dep_status FROM task_deps d
      LEFT JOIN tasks t ON t.slug = CAST(d.dep AS VARCHAR) WHERE t.status IS DISTINCT FROM 'completed'"""


@query(
    "ready_tasks", "tasks", "task_deps",
    sql=f"""WITH u AS ({UNMET}) SELECT t.slug, count(u.dep) AS unmet, count(u.dep) = 0 AS ready
      FROM tasks t LEFT JOIN u ON u.slug = t.slug WHERE t.status = 'queued' GROUP BY t.slug""",
)
def ready_tasks(spark, t, d):
    return tasks.ready_tasks(t, d)


@query("unmet_dependencies", "tasks", "task_deps", sql=UNMET)
def unmet_dependencies(spark, t, d):
    return tasks.unmet_dependencies(t, d)


@query(
    "resolve_task_refs", "task_refs", "task_paths",
    sql="""WITH r AS (SELECT path, ref, CASE WHEN ref LIKE '%://%' THEN 'external' WHEN ref LIKE '%/%' THEN 'path'
        ELSE 'sibling' END AS kind FROM task_refs),
      x AS (SELECT *, CASE kind WHEN 'sibling' THEN split_part(path, '/', 1) || '/' || ref ELSE ref END AS target FROM r)
      SELECT x.*, CASE WHEN kind <> 'external' THEN target IN (SELECT path FROM task_paths) END AS resolved FROM x""",
)
def resolve_task_refs(spark, refs, paths):
    return tasks.resolve_task_refs(refs, paths)


@query(
    "plan_progress", "plan_tasks", "tasks", "task_tree",
    sql="""WITH l AS (SELECT plan, plan_task, task AS slug FROM plan_tasks UNION
        SELECT p.plan, p.plan_task, t.slug FROM plan_tasks p JOIN task_tree t ON t.parent = p.task),
      c AS (SELECT plan, plan_task, count(t.status) AS n, count(*) FILTER (t.status = 'completed') AS done,
        count(*) FILTER (t.status = 'in_progress') AS run FROM l LEFT JOIN tasks t USING (slug) GROUP BY ALL)
      SELECT plan, plan_task, NULL AS task, CASE WHEN n = 0 THEN 'not_started' WHEN done = n THEN 'completed'
        WHEN run > 0 OR done > 0 THEN 'in_progress' ELSE 'queued' END AS status, done, n AS linked, false AS unplanned FROM c
      UNION ALL SELECT NULL, NULL, slug, status, CAST(status = 'completed' AS BIGINT), 1, true FROM tasks
      WHERE slug NOT IN (SELECT slug FROM l)""",
)
def plan_progress(spark, plan_tasks, t, tree):
    return tasks.plan_progress(plan_tasks, t, tree.filter("parent IS NOT NULL"))


def _changes(task_commands):
    """Accepted changes, stored once: what follows reads them more than once."""
    return cut_lineage(history.fold(task_commands).filter("outcome = 'ok'"))


@query(
    "state_as_of", "task_commands",
    sql=FOLD_SQL + """SELECT slug, arg_max(to_status, rn) AS status, max(ts) AS since FROM walk
      WHERE ok AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY slug""",
)
def state_as_of(spark, c):
    changes = history.fold(c).filter("outcome = 'ok'")
    return tasks.state_as_of(changes, F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'"))


@query(
    "states_at_each_log", "task_commands",
    sql=FOLD_SQL + """, q AS (SELECT DISTINCT slug, ts FROM task_commands)
      SELECT q.slug, q.ts, w.to_status AS status FROM q ASOF LEFT JOIN (SELECT * FROM walk WHERE ok) w
      ON q.slug = w.slug AND q.ts >= w.ts""",
)
def states_at_each_log(spark, c):
    return tasks.states_as_of(_changes(c), c)


@query(
    "task_context", "task_tree", "task_deps", "plan_tasks",
    sql="""SELECT t.slug, t.status, t.parent, p.status AS parent_status,
        (SELECT count(*) FROM task_tree s WHERE s.parent = t.parent AND s.slug <> t.slug) AS siblings,
        (SELECT count(*) FROM task_tree s WHERE s.parent = t.parent AND s.slug <> t.slug AND s.status = 'completed') AS siblings_completed,
        (SELECT count(*) FROM task_deps d WHERE d.slug = t.slug) AS deps,
        (SELECT count(*) FROM task_deps d JOIN task_tree x ON x.slug = CAST(d.dep AS VARCHAR)
         WHERE d.slug = t.slug AND x.status = 'completed') AS deps_completed,
        (SELECT min(plan) FROM plan_tasks l WHERE l.task = t.slug) AS plan
      FROM task_tree t LEFT JOIN task_tree p ON p.slug = t.parent""",
)
def task_context(spark, tree, deps, plan_tasks):
    return tasks.task_context(tree, deps, plan_tasks)


@query(
    "task_context_asked", "task_tree", "task_deps", "plan_tasks", "plan_states",
    sql="""WITH RECURSIVE asked AS (SELECT slug FROM task_tree WHERE status = 'queued'),
      r AS (SELECT slug AS root, CAST(dep AS VARCHAR) AS node FROM task_deps WHERE slug IN (SELECT slug FROM asked)
        UNION SELECT r.root, CAST(d.dep AS VARCHAR) FROM r JOIN task_deps d ON d.slug = r.node),
      f AS (SELECT r.root, count(*) AS all_deps, count(*) FILTER (t.status = 'completed') AS all_deps_completed FROM r LEFT JOIN task_tree t ON t.slug = r.node GROUP BY r.root),
      l AS (SELECT task, min(plan) AS plan FROM plan_tasks GROUP BY task)
      SELECT a.slug, l.plan, coalesce(f.all_deps, 0) AS all_deps, coalesce(f.all_deps_completed, 0) AS all_deps_completed, s.plan AS feature, s.feature_status
      FROM asked a LEFT JOIN f ON f.root = a.slug LEFT JOIN l ON l.task = a.slug LEFT JOIN plan_states s ON s.plan = l.plan""",
)
def task_context_asked(spark, tree, deps, plan_tasks, plans):
    """Context of the queued tasks with all they depend on, and the feature their plan references."""
    features = plans.select(F.col("plan").alias("id"), F.col("feature_status").alias("status"))
    got = tasks.task_context(tree, deps, plan_tasks, features, tree.filter("status = 'queued'"), plans.select("plan", F.col("plan").alias("feature")))
    return got.select("slug", "plan", "all_deps", "all_deps_completed", "feature", "feature_status")


@query(
    "arbitrate_claims", "claim_requests", "tasks", "task_deps",
    sql=f"""WITH u AS ({UNMET}), c AS (SELECT r.*, t.status, r.slug IN (SELECT slug FROM u) AS waiting,
        row_number() OVER (PARTITION BY r.slug ORDER BY r.ts, r.seq) AS n FROM claim_requests r LEFT JOIN tasks t USING (slug))
      SELECT slug, seq, ts, agent, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'queued' OR waiting
        THEN 'invalid_transition' WHEN n = 1 THEN 'ok' ELSE 'conflict' END AS outcome FROM c""",
)
def arbitrate_claims(spark, requests, t, d):
    return history.arbitrate_claims(requests, t, d)


@query(
    "guard_updates", "updates", "tasks",
    sql="""WITH j AS (SELECT u.*, t.status, t.slug IS NOT NULL AND coalesce(u.expected_status = t.status, true)
        AND coalesce(u.expected_updated_at = t.updated_at, true) AS fresh FROM updates u LEFT JOIN tasks t USING (slug)),
      n AS (SELECT *, row_number() OVER (PARTITION BY slug, fresh ORDER BY ts, seq) AS k FROM j)
      SELECT slug, seq, ts, expected_status, expected_updated_at, CASE WHEN status IS NULL THEN 'not_found'
        WHEN (expected_status IS NULL AND expected_updated_at IS NULL) OR (fresh AND k = 1) THEN 'ok' ELSE 'conflict' END AS outcome FROM n""",
)
def guard_updates(spark, updates, t):
    return history.guard_updates(updates, t)


@query(
    "fold_guarded", "task_commands",
    sql=f"""WITH RECURSIVE tr(s, c, t) AS (VALUES {TRANSITION_ROWS}),
      cmds AS (SELECT *, CASE seq % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'claimed' END AS want,
        row_number() OVER (PARTITION BY slug ORDER BY ts, seq) AS rn FROM task_commands),
      walk AS (SELECT slug, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, 'planning' AS st, '' AS outcome
        FROM cmds WHERE rn = 1 UNION ALL
        SELECT c.slug, c.rn, c.seq, CASE WHEN coalesce(c.want, w.st) = w.st THEN coalesce(tr.t, w.st) ELSE w.st END,
          CASE WHEN coalesce(c.want, w.st) <> w.st THEN 'conflict' WHEN tr.t IS NULL THEN 'invalid_transition' ELSE 'ok' END
        FROM walk w JOIN cmds c ON c.slug = w.slug AND c.rn = w.rn + 1 LEFT JOIN tr ON tr.s = w.st AND tr.c = c.cmd)
      SELECT slug, seq, st AS to_status, outcome FROM walk WHERE rn > 0""",
)
def fold_guarded(spark, c):
    want = F.expr("CASE seq % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'claimed' END")
    return history.fold(c.withColumn("want", want), expected="want").select("slug", "seq", "to_status", "outcome")


@query(
    "time_in_status", "task_commands",
    sql=FOLD_SQL + f"""SELECT slug, seq, to_status AS status, ts AS entered_at,
      lead(ts) OVER (PARTITION BY slug ORDER BY rn) AS left_at,
      date_sub('second', ts, coalesce(lead(ts) OVER (PARTITION BY slug ORDER BY rn), {AS_OF})) AS dwell_s FROM walk WHERE ok""",
)
def time_in_status(spark, c):
    return history.time_in_status(_changes(c), F.expr(AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


@query(
    "run_durations", "task_commands",
    sql=FOLD_SQL + """, e AS (SELECT slug, min(ts) FILTER (to_status = 'in_progress') AS started_at,
        min(ts) FILTER (to_status IN ('completed', 'failed', 'aborted')) AS finished_at FROM walk WHERE ok GROUP BY slug)
      SELECT *, date_sub('second', started_at, finished_at) AS duration_s FROM e
      WHERE started_at IS NOT NULL AND finished_at IS NOT NULL""",
)
def run_durations(spark, c):
    return history.run_durations(history.fold(c).filter("outcome = 'ok'"))


RECORDED = """SELECT slug, seq, ts, CASE WHEN seq % 17 = 0 THEN 'queued' ELSE lag(cmd_status, 1, 'planning')
      OVER (PARTITION BY slug ORDER BY ts, seq) END AS from_status, cmd_status AS to_status
      FROM (SELECT *, CASE cmd WHEN 'enqueue' THEN 'queued' WHEN 'claim' THEN 'claimed' WHEN 'start' THEN 'in_progress'
        WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'block' THEN 'blocked' WHEN 'unblock' THEN 'in_progress'
        WHEN 'release' THEN 'queued' ELSE 'aborted' END AS cmd_status FROM task_commands)"""


@query(
    "validate_history", "task_commands",
    sql=f"""WITH tr(s, c, t) AS (VALUES {TRANSITION_ROWS}), r AS ({RECORDED})
      SELECT slug, seq, from_status, to_status,
        lag(to_status, 1, 'planning') OVER (PARTITION BY slug ORDER BY ts, seq) = from_status AS continuous,
        EXISTS (SELECT 1 FROM tr WHERE tr.s = from_status AND tr.t = to_status) AS legal FROM r""",
)
def validate_history(spark, c):
    return history.validate_history(spark.sql(RECORDED.replace("FROM task_commands", "FROM {c}"), c=c))


@query(
    "split_board", "tasks",
    sql="""SELECT *, 'active' AS section FROM tasks WHERE status <> 'completed' UNION ALL
      SELECT * EXCLUDE (n), 'recently_finished' FROM (SELECT *, row_number() OVER (PARTITION BY project
        ORDER BY updated_at DESC, slug) AS n FROM tasks WHERE status = 'completed') WHERE n <= 10""",
)
def split_board(spark, t):
    return history.split_board(t, F.lit(None), limit=10, board="project")


@query(
    "task_timeline", "task_commands",
    sql=FOLD_SQL + """SELECT slug, ts, seq, by_agent, 'status_change' AS type, from_status, to_status, NULL AS message
      FROM walk WHERE ok UNION ALL
      SELECT slug, ts, seq, by_agent, 'log', NULL, NULL, 'rejected ' || cmd FROM walk WHERE NOT ok""",
)
def task_timeline(spark, c):
    folded = cut_lineage(history.fold(c))
    moved = folded.filter("outcome = 'ok'").select("slug", "ts", "seq", "by_agent", "from_status", "to_status")
    noted = folded.filter("outcome <> 'ok'").select(
        "slug", "ts", "seq", "by_agent", F.concat(F.lit("rejected "), "cmd").alias("message")
    )
    return tasks.task_timeline(moved, noted)


# ---- the other state machines, through the same fold ----

MACHINES = {"chat": history.CHATS, "session": history.SESSIONS, "runner": history.RUNNERS, "proposal": history.PROPOSALS}


def _register_machine(name: str, m: history.Machine) -> None:
    cmds = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(m.commands))
    STANDINS[f"{name}_commands"] = f"""
SELECT concat('{name}', CAST(user_id AS STRING), '/', CAST(day(ts) AS STRING)) AS slug, ts, event_id AS seq,
       CASE event_id % {len(m.commands)} {cmds} END AS cmd FROM events
"""
    rows = ", ".join(f"('{s}', '{c}', '{t}')" for (s, c), t in m.transitions.items())
    sql = f"""WITH RECURSIVE tr(s, c, t) AS (VALUES {rows}),
      cmds AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts, seq) AS rn FROM {name}_commands),
      walk AS (SELECT slug, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, '{m.initial}' AS st, true AS ok FROM cmds WHERE rn = 1 UNION ALL
        SELECT c.slug, c.rn, c.seq, coalesce(tr.t, w.st), tr.t IS NOT NULL FROM walk w JOIN cmds c ON c.slug = w.slug AND c.rn = w.rn + 1
        LEFT JOIN tr ON tr.s = w.st AND tr.c = c.cmd)
      SELECT slug, seq, st AS to_status, CASE WHEN ok THEN 'ok' ELSE 'invalid_transition' END AS outcome FROM walk WHERE rn > 0"""

    @query(f"fold_{name}_state", f"{name}_commands", sql=sql)
    def run(spark, commands):
        return history.fold(commands, m).select("slug", "seq", "to_status", "outcome")


for _name, _machine in MACHINES.items():
    _register_machine(_name, _machine)
