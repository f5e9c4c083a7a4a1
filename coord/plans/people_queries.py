"""Registered queries over stakeholders, decisions, plans and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.operators import chats, people, planning
from coord.operators import tasks as T
from coord.plans.registry import AS_OF, query

NTZ = AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")
ROLES_SQL = """s AS (SELECT id AS feature, '' AS scope, 0 AS lv FROM feature_paths UNION ALL
    SELECT id, split_part(id, '/', 1), 1 FROM feature_paths UNION ALL
    SELECT id, split_part(id, '/', 1) || '/' || split_part(id, '/', 2), 2 FROM feature_paths WHERE id LIKE '%/%' UNION ALL
    SELECT id, id, 3 FROM feature_paths WHERE id LIKE '%/%/%'),
  o AS (SELECT s.feature, role, split_part(stakeholder, ':', 1) AS stakeholder, op,
    row_number() OVER (PARTITION BY s.feature, role, split_part(stakeholder, ':', 1) ORDER BY lv DESC, op DESC) AS n
    FROM s JOIN role_overrides r ON r.scope = s.scope),
  roles AS (SELECT feature, role, stakeholder FROM o WHERE n = 1 AND op = 'add')"""


@query("resolve_roles", "feature_paths", "role_overrides", sql=f"WITH {ROLES_SQL} SELECT * FROM roles")
def resolve_roles(spark, features, overrides):
    return people.resolve_roles(features, overrides)


@query(
    "combine_role_sets", "gates", "feature_paths", "role_overrides",
    sql=f"WITH {ROLES_SQL} SELECT DISTINCT gate, feature, stakeholder FROM gates JOIN roles USING (feature, role)",
)
def combine_role_sets(spark, gates, features, overrides):
    return people.combine_role_sets(gates, people.resolve_roles(features, overrides))


@query(
    "applicable_rules", "contexts", "rules",
    sql="""SELECT c.context, r.rule, r.scope, r.scope_id FROM contexts c JOIN rules r ON (r.scope = 'human' AND r.scope_id = c.human)
      OR (r.scope = 'org' AND r.scope_id = c.org) OR (r.scope = 'project' AND r.scope_id = c.project) OR (r.scope = 'repo' AND r.scope_id = c.repo)""",
)
def applicable_rules(spark, contexts, rules):
    return people.applicable_rules(contexts, rules)


@query(
    "route_by_skill", "skill_tasks", "skilled_agents",
    sql="""SELECT task, skill, (SELECT name FROM skilled_agents a WHERE status = 'active' AND list_contains(string_split(skill_list, ','), t.skill)
      ORDER BY load, name LIMIT 1) AS agent FROM skill_tasks t""",
)
def route_by_skill(spark, tasks, agents):
    return people.route_by_skill(tasks, agents.withColumn("skills", F.split("skill_list", ",")))


@query(
    "select_model", "model_requests",
    sql="""WITH c AS (SELECT *, coalesce(model_class, assessed_class) AS k FROM model_requests)
      SELECT task, CASE WHEN override IS NOT NULL THEN override WHEN suggested_model IS NOT NULL THEN suggested_model
        WHEN platform = 'claude' THEN CASE k WHEN 'small' THEN 'Haiku 4.5' WHEN 'medium' THEN 'Sonnet 4.5' WHEN 'large' THEN 'Opus 4' END
        ELSE CASE k WHEN 'small' THEN 'GPT-4o-mini' WHEN 'medium' THEN 'GPT-4o' WHEN 'large' THEN 'o1/o3' END END AS model,
        CASE WHEN override IS NOT NULL THEN 'override' WHEN suggested_model IS NOT NULL THEN 'suggested' WHEN model_class IS NOT NULL THEN 'class'
        WHEN assessed_class IS NOT NULL THEN 'assessed' ELSE 'none' END AS decided_by FROM c""",
)
def select_model(spark, requests):
    return people.select_model(requests).select("task", "model", "decided_by")


@query(
    "resolvable_questions", "questions", "tasks",
    sql="SELECT id, doc, q.status, linked_task FROM questions q WHERE status IN ('open', 'linked') AND linked_task IN (SELECT slug FROM tasks WHERE status = 'completed')",
)
def resolvable_questions(spark, questions, tasks):
    return people.resolvable_questions(questions, tasks).select("id", "doc", "status", "linked_task")


@query(
    "recently_resolved", "questions",
    sql="""SELECT id, doc, resolved_at FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY resolved_at DESC, id) AS n
      FROM questions WHERE status = 'resolved') WHERE n <= 3""",
)
def recently_resolved(spark, questions):
    return people.recently_resolved(questions, F.expr(NTZ)).select("id", "doc", "resolved_at")


@query(
    "effective_micro_tasks", "micro_targets", "micro_configs",
    sql="""WITH j AS (SELECT t.task, c.phase, c.level, c.name, CASE c.level WHEN 'global' THEN 0 WHEN 'project' THEN 1 WHEN 'module' THEN 2 ELSE 3 END AS r
        FROM micro_targets t JOIN micro_configs c ON c.level = 'global' OR (c.level = 'project' AND c.scope = t.project)
          OR (c.level = 'module' AND c.scope = t.module) OR (c.level = 'task' AND c.scope = t.task))
      SELECT task, phase, level, name FROM (SELECT *, max(r) OVER (PARTITION BY task, phase) AS m FROM j) WHERE r = m""",
)
def effective_micro_tasks(spark, targets, configs):
    return people.effective_micro_tasks(targets, configs)


TALLY_SQL = """a AS (SELECT DISTINCT decision, split_part(stakeholder, ':', 1) AS who FROM assigned),
  v AS (SELECT r.decision, r.stakeholder AS who, r.response, r.ts, r.seq, row_number() OVER (PARTITION BY r.decision, r.stakeholder ORDER BY r.ts, r.seq) AS k
    FROM responses r JOIN a ON a.decision = r.decision AND a.who = r.stakeholder),
  n AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY ts, seq) AS n FROM v WHERE k = 1),
  b AS (SELECT d.decision, policy, count(a.who) AS assigned, CASE policy WHEN 'all' THEN count(a.who) WHEN 'any' THEN 1 WHEN 'min' THEN max(min_n)
    ELSE count(a.who) // 2 + 1 END AS needed FROM decisions d LEFT JOIN a USING (decision) GROUP BY d.decision, policy),
  g AS (SELECT b.decision, policy, assigned, needed, count(n.n) AS responses, max(ts) FILTER (n.n = needed) AS at_,
    count(DISTINCT response) FILTER (n.n <= needed) AS kinds, min(response) FILTER (n.n <= needed) AS one, min(ts) AS first_response_at
    FROM b LEFT JOIN n USING (decision) GROUP BY ALL),
  tally AS (SELECT decision, policy, assigned, needed, responses, CASE WHEN assigned = 0 THEN 'unassigned' WHEN needed > assigned THEN 'invalid'
    WHEN responses < needed THEN 'pending' WHEN kinds = 1 AND one <> 'custom' THEN one ELSE 'mixed' END AS outcome,
    CASE WHEN assigned > 0 AND needed <= assigned AND responses >= needed THEN at_ END AS resolved_at, first_response_at FROM g)"""


@query("tally_decisions", "decisions", "assigned", "responses", sql=f"WITH {TALLY_SQL} SELECT * FROM tally")
def tally_decisions(spark, decisions, assigned, responses):
    return people.tally_decisions(decisions, assigned, responses)


@query(
    "decision_state", "decisions", "assigned", "responses",
    sql=f"""WITH {TALLY_SQL}, x AS (SELECT t.*, d.requested_at + to_seconds(d.timeout_s) AS due FROM tally t JOIN decisions d USING (decision))
      SELECT decision, CASE WHEN due <= TIMESTAMP '1996-01-01 00:00:00' AND NOT coalesce(resolved_at <= due, false) THEN 'failed'
        WHEN resolved_at <= TIMESTAMP '1996-01-01 00:00:00' THEN 'completed' WHEN first_response_at <= TIMESTAMP '1996-01-01 00:00:00' THEN 'in_progress'
        ELSE 'queued' END AS status FROM x""",
)
def decision_state(spark, decisions, assigned, responses):
    tally = people.tally_decisions(decisions, assigned, responses)
    return people.decision_state(tally, decisions, F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))


# ---- plans ----


@query(
    "roadmap_status", "plans", "plan_states",
    sql="""SELECT p.roadmap, count(*) AS plans, CASE WHEN bool_or(s.state = 'in_progress') THEN 'in_progress' WHEN bool_or(p.status = 'draft') THEN 'draft'
      WHEN bool_and(p.status = 'approved') THEN 'approved' ELSE 'in_review' END AS status FROM plans p JOIN plan_states s USING (plan) GROUP BY p.roadmap""",
)
def roadmap_status(spark, plans, states):
    live = plans.join(states.select("plan", (F.col("state") == "in_progress").alias("active")), "plan")
    return planning.roadmap_status(live)


@query(
    "plan_estimate_check", "plans", "plan_tasks",
    sql="""WITH n AS (SELECT plan, count(*) AS steps FROM plan_tasks GROUP BY plan),
      j AS (SELECT p.plan, p.effort, coalesce(n.steps, 0) AS steps FROM plans p LEFT JOIN n USING (plan)),
      k AS (SELECT *, CASE WHEN steps <= 3 THEN 'S' WHEN steps <= 6 THEN 'M' WHEN steps <= 10 THEN 'L' ELSE 'XL' END AS inferred FROM j)
      SELECT *, effort <> inferred AS mismatch FROM k""",
)
def plan_estimate_check(spark, plans, plan_tasks):
    return planning.plan_estimate_check(plans, plan_tasks)


@query(
    "summary_digest", "proposals",
    sql="SELECT feature % 25 AS root, status, count(*) AS n FROM proposals GROUP BY CUBE (1, 2)",
)
def summary_digest(spark, proposals):
    return planning.summary_digest(proposals.select((F.col("feature") % 25).alias("root"), "status"))


@query(
    "latest_proposals", "proposals",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY created DESC, proposal DESC) AS k FROM proposals)
      SELECT feature, proposal, created, status, row_number() OVER (PARTITION BY feature ORDER BY k DESC) AS position FROM r WHERE k <= 3""",
)
def latest_proposals(spark, proposals):
    return planning.latest_n(proposals, ["feature"], "created", "proposal", 3)


@query(
    "whats_next", "plan_states", "plan_deps",
    sql="""WITH d AS (SELECT p.plan, count(*) FILTER (x.state IS DISTINCT FROM 'completed') AS open_, max(CASE WHEN x.state = 'completed' THEN x.completed_at END) AS last_
        FROM plan_deps p LEFT JOIN plan_states x ON x.plan = p.dep GROUP BY p.plan),
      m AS (SELECT roadmap, bool_or(state = 'in_progress') AS momentum FROM plan_states GROUP BY roadmap)
      SELECT p.plan, p.roadmap, CASE impact WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS impact_rank,
        CASE effort WHEN 'S' THEN 1 WHEN 'M' THEN 2 WHEN 'L' THEN 3 WHEN 'XL' THEN 4 ELSE 9 END AS effort_rank,
        coalesce(last_ >= TIMESTAMP '2024-01-15 00:00:00', false) AS newly_unblocked, momentum,
        CASE feature_status WHEN 'Conceptual' THEN 1 WHEN 'In Progress' THEN 4 ELSE 6 END AS closeness
      FROM plan_states p LEFT JOIN d USING (plan) JOIN m USING (roadmap) WHERE state = 'open' AND coalesce(open_, 0) = 0""",
)
def whats_next(spark, plans, deps):
    return planning.whats_next(plans, deps, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))


@query("completed_since", "plan_states", sql="SELECT plan, completed_at FROM plan_states WHERE state = 'completed' AND completed_at >= TIMESTAMP '2024-01-15 00:00:00'")
def completed_since(spark, plans):
    return planning.completed_since(plans, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))


@query(
    "plans_in_progress", "plan_states", "plan_tasks", "tasks",
    sql="""WITH g AS (SELECT l.plan, l.plan_task, bool_and(t.status IS NOT DISTINCT FROM 'completed') AND count(t.status) > 0 AS done
        FROM plan_tasks l LEFT JOIN tasks t ON t.slug = l.task WHERE t.status IS NOT NULL OR true GROUP BY ALL)
      SELECT p.plan, count(*) FILTER (done) AS done, count(plan_task) AS steps, 0 AS blockers
      FROM plan_states p LEFT JOIN g USING (plan) WHERE state = 'in_progress' GROUP BY p.plan""",
)
def plans_in_progress(spark, plans, plan_tasks, tasks):
    return planning.in_progress(plans, T.plan_progress(plan_tasks, tasks))


# ---- chats ----


@query(
    "chat_stats", "chat_messages",
    sql="""SELECT chat_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
      min(turn) AS first_at, max(turn) AS last_at, 'active' AS status FROM chat_messages GROUP BY chat_id""",
)
def chat_stats(spark, messages):
    return chats.chat_stats(messages)


@query(
    "chat_context_window", "chat_messages",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS b,
        count(*) OVER (PARTITION BY chat_id) AS n FROM chat_messages)
      SELECT chat_id, turn, role, content, greatest(n - 3, 0) AS elided FROM r WHERE a <= 1 OR b <= 2""",
)
def chat_context_window(spark, messages):
    return chats.chat_context_window(messages, 1, 2)


@query(
    "pending_delivery", "channel_messages", "hosts",
    sql="SELECT * FROM channel_messages WHERE NOT processed AND host IN (SELECT host FROM hosts WHERE status = 'online')",
)
def pending_delivery(spark, messages, hosts):
    return chats.pending_delivery(messages, hosts)


@query(
    "tail_logs", "chat_messages",
    sql="""SELECT chat_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS n FROM chat_messages) WHERE n <= 2""",
)
def tail_logs(spark, messages):
    return chats.tail_logs(messages, 2, "chat_id", "turn")
