"""Coordination records derived from the benchmark tables, as SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

STANDINS: dict[str, str] = {
    "task_commands": """
SELECT concat('u', CAST(user_id AS STRING), CASE WHEN day(ts) <= 10 THEN '/p0' WHEN day(ts) <= 20 THEN '/p1' ELSE '/p2' END) AS slug,
       event_id AS seq, ts, concat('a', CAST(event_id % 7 AS STRING)) AS by_agent,
       CASE WHEN event_id % 53 = 0 THEN 'confirm_abort'
            WHEN event_type = 'signup' THEN 'enqueue'
            WHEN event_type = 'view' THEN 'claim'
            WHEN event_type = 'click' THEN 'start'
            WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'release'
            WHEN event_type = 'purchase' THEN 'complete'
            WHEN event_id % 3 = 0 THEN 'fail'
            WHEN event_id % 3 = 1 THEN 'block'
            ELSE 'unblock' END AS cmd
FROM events
""",
    "tasks": """
SELECT CAST(o_orderkey AS STRING) AS slug, concat('proj', CAST(o_custkey % 50 AS STRING)) AS project,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'queued' END AS status,
       concat('c', CAST(o_custkey AS STRING)) AS requester, o_orderpriority AS priority,
       o_orderdate AS updated_at, o_orderkey AS ordinal
FROM orders
""",
    "task_deps": """
SELECT CAST(o_orderkey AS STRING) AS slug, CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT) AS dep
FROM orders WHERE o_orderkey > 0 AND o_orderkey % 3 <> 0
""",
    "feature_edges": """
SELECT p_partkey AS src, CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS dst FROM part WHERE p_partkey > 0
UNION
SELECT p_partkey AS src, CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) AS dst FROM part WHERE p_partkey > 0
""",
    "feature_paths": """
SELECT r_name AS id FROM region
UNION ALL SELECT concat(r_name, '/', n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat(r_name, '/', n_name, '/', c_name)
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "spec_docs": """
SELECT concat('spec/features/', source, '/f', CAST(doc_id AS STRING), '/README.md') AS path,
       concat('# Feature ', CAST(doc_id AS STRING), chr(10), chr(10), '**Status:** ',
              CASE doc_id % 3 WHEN 0 THEN 'Conceptual' WHEN 1 THEN 'In Progress' ELSE 'Stable' END,
              chr(10), chr(10), '## Summary', chr(10), chr(10), text, chr(10), chr(10),
              CASE WHEN doc_id % 5 = 0 THEN '#### Details' ELSE '### Details' END, chr(10), chr(10),
              '## Dependencies', chr(10), chr(10), '- ', source, '/f', CAST((doc_id - doc_id % 2) / 2 AS BIGINT), chr(10),
              CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1
                   THEN concat(chr(10), '## Outstanding Questions', chr(10))
                   WHEN doc_id % 7 = 2 THEN concat(chr(10), '## Outstanding Questions', chr(10), chr(10), 'None at this time.', chr(10))
                   ELSE concat(chr(10), '## Outstanding Questions', chr(10), chr(10), '- Question ', lang, chr(10)) END) AS text
FROM documents
""",
    "requests": """
SELECT event_id AS request_id, ts, concat('u', CAST(user_id AS STRING)) AS user_id,
       concat('proj', CAST(user_id % 20 AS STRING)) AS project_id, event_type AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS latency
FROM events
""",
    "heartbeats": """
SELECT concat('a', CAST(user_id AS STRING)) AS agent, ts, event_id AS seq FROM events
""",
    "responses": """
SELECT concat('d', CAST(o_custkey AS STRING)) AS decision,
       concat('s', CAST(o_orderkey % 5 AS STRING)) AS stakeholder,
       CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'reject' ELSE 'custom' END AS response,
       o_orderdate AS ts, o_orderkey AS seq
FROM orders
""",
    "chat_messages": """
SELECT conv_id AS chat_id, turn, role, text AS content FROM conversations
""",
    "plans": """
SELECT p_partkey AS plan, p_brand AS roadmap, CASE WHEN p_partkey > 0 THEN CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) END AS depends_on,
       CASE WHEN p_size <= 10 THEN 'S' WHEN p_size <= 25 THEN 'M' WHEN p_size <= 40 THEN 'L' ELSE 'XL' END AS effort,
       CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS impact,
       CASE p_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'draft' ELSE 'in_review' END AS status
FROM part
""",
    "containers": """
SELECT s_suppkey AS project_id,
       CASE s_suppkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' WHEN 2 THEN 'stopped' ELSE 'terminated' END AS container_status,
       CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE max(l_shipdate) END AS idle_since, count(*) AS commands
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey
""",
    "plan_tasks": """
SELECT l_orderkey % 2000 AS plan, l_linenumber AS plan_task, CAST(l_orderkey AS STRING) AS task
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "spans": """
SELECT CAST(l_orderkey AS STRING) AS trace_id, l_linenumber AS span_id,
       CASE WHEN l_linenumber > 1 THEN CAST((l_linenumber - l_linenumber % 2) / 2 AS INT) END AS parent_id,
       min(l_shipdate) AS ts, sum(CAST(l_quantity AS BIGINT)) AS duration_ms, max(l_returnflag) AS status
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "proposals": """
SELECT l_partkey AS feature, l_orderkey AS proposal, min(l_shipdate) AS created,
       CASE max(l_returnflag) WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'submitted' END AS status
FROM lineitem GROUP BY l_partkey, l_orderkey
""",
    "access_grants": """
SELECT concat('u', CAST(user_id AS STRING)) AS user_id, concat('proj', CAST(user_id % 20 AS STRING)) AS project_id,
       CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'read_write' END AS access_level, min(ts) AS cached_at
FROM events WHERE user_id % 7 <> 0 GROUP BY user_id
""",
}

# Further records in the same manner.
STANDINS |= {
    "claim_requests": """
SELECT CAST((user_id * 131) % 20000 AS STRING) AS slug, event_id AS seq, ts, concat('a', CAST(user_id % 7 AS STRING)) AS agent
FROM events
""",
    "updates": """
SELECT CAST((user_id * 131) % 20000 AS STRING) AS slug, event_id AS seq, ts,
       CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' END AS expected_status,
       CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '1995-01-01 00:00:00' END AS expected_updated_at
FROM events
""",
    "board": """
SELECT CASE WHEN o_orderkey % 4 = 0 THEN concat('gone', CAST(o_orderkey AS STRING)) ELSE CAST(o_orderkey AS STRING) END AS slug,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'queued' END AS status,
       CAST(NULL AS STRING) AS depends_on, concat('agent/r', CAST(o_custkey AS STRING)) AS branch,
       concat('a', CAST(o_custkey % 7 AS STRING)) AS agent
FROM orders
""",
    "task_docs": """
SELECT CAST(o_orderkey + 50 AS STRING) AS slug,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS depends_on
FROM orders
""",
    "task_tree": """
SELECT CAST(o_orderkey AS STRING) AS slug,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey - o_orderkey % 10 AS STRING) END AS parent,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'queued' END AS status
FROM orders
""",
    "task_paths": """
SELECT concat('t', CAST(o_custkey % 100 AS STRING), '/s', CAST(o_orderkey AS STRING)) AS path FROM orders
""",
    "task_refs": """
SELECT concat('t', CAST(o_custkey % 100 AS STRING), '/s', CAST(o_orderkey AS STRING)) AS path,
       CASE o_orderkey % 4 WHEN 0 THEN concat('s', CAST(o_orderkey + 1 AS STRING))
            WHEN 1 THEN concat('t', CAST(o_custkey % 100 AS STRING), '/s', CAST(o_orderkey AS STRING))
            WHEN 2 THEN concat('https://git.example/org/repo/tasks/t', CAST(o_custkey AS STRING))
            ELSE concat('t', CAST(o_custkey % 50 AS STRING), '/s', CAST(o_orderkey - 1 AS STRING)) END AS ref
FROM orders
""",
    "wiki_docs": """
SELECT concat('spec/features/', source, '/f', CAST(doc_id AS STRING), '/README.md') AS path,
       concat('# Feature ', CAST(doc_id AS STRING), chr(10), chr(10), '## Contents', chr(10), chr(10),
              CASE WHEN doc_id % 3 = 0 THEN concat('- [sub](sub/README.md)', chr(10)) ELSE '' END,
              CASE WHEN doc_id % 5 = 0 THEN concat('- [gone](gone/)', chr(10)) ELSE '' END,
              chr(10), '## Notes', chr(10), chr(10), text, chr(10), chr(10),
              'See [home](../f', CAST(doc_id - doc_id % 4 AS STRING), '/README.md#notes) and [here](#',
              CASE WHEN doc_id % 2 = 0 THEN 'contents' ELSE 'nowhere' END, '), [site](https://git.example/acme/r',
              CAST(doc_id % 9 AS STRING), '.git)', chr(10),
              CASE WHEN doc_id % 6 = 0 THEN concat('Bad [ref](../F 1//x)', chr(10)) ELSE '' END,
              '```', chr(10), '# not a heading [x](y.md)', chr(10), '```', chr(10)) AS text
FROM documents
UNION ALL
SELECT concat('spec/features/', source, '/f', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '/sub' ELSE '/part' END, '/README.md') AS path,
       concat('# Sub ', CAST(doc_id AS STRING), chr(10), chr(10), '## Outstanding Questions', chr(10)) AS text
FROM documents
""",
    "plan_docs": """
SELECT concat('spec/plans/p', CAST(p_partkey AS STRING), '/README.md') AS path,
       concat('# Plan ', p_name, chr(10), chr(10), '**Status:** ', CASE p_partkey % 3 WHEN 0 THEN 'approved' ELSE 'draft' END,
              chr(10), '**Effort:** ', CASE WHEN p_size <= 25 THEN 'M' ELSE 'XL' END, chr(10),
              '**Features:** src', CAST(p_partkey % 20 AS STRING), '/f', CAST(p_partkey % 300 AS STRING),
              ', [src1/f1](../../features/src1/f1/README.md)', chr(10)) AS text
FROM part
""",
    "source_files": """
SELECT concat('src/', source, '/m', CAST(doc_id AS STRING), '.go') AS path,
       concat('package m', chr(10),
              CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('// Features implemented: x', chr(10)) END,
              '// spec:feature/', source, '/f', CAST(doc_id AS STRING), chr(10),
              CASE WHEN doc_id % 3 = 0 THEN concat('  // see https://spec.example/plan/p', CAST(doc_id AS STRING), ' and spec:feature/none/x', chr(10)) ELSE '' END,
              CASE WHEN doc_id % 7 = 0 THEN concat('# spec:doc/api@git.example/acme/r', CAST(doc_id % 9 AS STRING), chr(10)) ELSE '' END,
              'x := "spec:feature/in/string"', chr(10), '/* ', text, ' */', chr(10)) AS text
FROM documents
""",
    "board_docs": """
SELECT concat('tasks/t', CAST(o_orderkey AS STRING), '/README.md') AS path,
       concat('# Tasks', chr(10), chr(10), '| Task | Status | Depends on | Branch | Agent | Requester | Time |', chr(10),
              '|---|---|---|---|---|---|---|', chr(10),
              '| [a', CAST(o_orderkey AS STRING), '](a', CAST(o_orderkey AS STRING), '/) | ✅ `',
              CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'complete' ELSE 'done' END,
              '` | — | `b1` | GPT-5 | @c', CAST(o_custkey AS STRING), ' | 2026-03-12 10:15 (4m', CAST(o_orderkey % 60 AS STRING), 's) |', chr(10),
              '| [b](b/) | 🔵&nbsp;`in_progress` | a', CAST(o_orderkey AS STRING), ', z | — | — | — | 2026-03-12<br>10:22 |', chr(10),
              CASE WHEN o_orderkey % 5 = 0 THEN concat('| c | queued | — | — | — | — | — |', chr(10)) ELSE '' END) AS text
FROM orders
""",
    "task_files": """
SELECT concat('tasks/', source, '/t', CAST(doc_id AS STRING), '.md') AS path,
       concat(CASE WHEN doc_id % 11 = 0 THEN 'Task' ELSE '# Task' END, ' ', CAST(doc_id AS STRING), chr(10), chr(10), 'About ', lang, '.', chr(10), chr(10), coalesce(text, ''), chr(10), chr(10),
              CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('## Dependencies', chr(10), chr(10),
                CASE WHEN doc_id % 2 = 0 THEN 'None' ELSE concat('- t', CAST(doc_id - 1 AS STRING), chr(10), '- other') END, chr(10), chr(10)) END,
              CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('## Summary', chr(10), chr(10),
                CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE concat('Did ', source) END, chr(10)) END) AS text
FROM documents
""",
    "listed_children": """
SELECT concat(r_name, '/', n_name) AS parent,
       concat(r_name, '/', n_name, '/', CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE '' END, c_name) AS child
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "scenarios": """
SELECT CAST(l_orderkey AS STRING) AS scenario, concat('f', CAST(l_partkey AS STRING)) AS feature,
       CASE WHEN l_orderkey % 5 = 0 THEN '*' ELSE concat('ac', CAST(l_linenumber AS STRING)) END AS ac
FROM lineitem
""",
    "criteria": """
SELECT concat('f', CAST(p_partkey AS STRING)) AS feature, concat('ac', CAST(r_regionkey + 1 AS STRING)) AS ac
FROM part JOIN region ON r_regionkey <= p_size % 6
""",
    "repo_refs": """
SELECT concat('p', CAST(o_custkey % 40 AS STRING)) AS source,
       CASE o_orderkey % 6 WHEN 0 THEN concat('git.example/acme/r', CAST(o_orderkey % 20 AS STRING))
            WHEN 1 THEN concat('https://git.example/acme/r', CAST(o_orderkey % 20 AS STRING), '.git')
            WHEN 2 THEN concat('git@git.example:acme/r', CAST(o_orderkey % 20 AS STRING), '.git')
            WHEN 3 THEN concat('  https://git.example/acme/r', CAST(o_orderkey % 20 AS STRING), '/ ')
            WHEN 4 THEN concat('https://git.example/a/b/c', CAST(o_orderkey % 3 AS STRING))
            ELSE 'acme/r' END AS raw
FROM orders
""",
    "stakeholder_refs": """
SELECT concat('d', CAST(o_custkey AS STRING)) AS decision,
       CASE o_orderkey % 4 WHEN 0 THEN concat('alex', CAST(o_orderkey % 5 AS STRING), '@github')
            WHEN 1 THEN concat('alex', CAST(o_orderkey % 5 AS STRING), '@github:timezone=UTC')
            WHEN 2 THEN concat('agent-', CAST(o_orderkey % 3 AS STRING), ':model=opus,temp=1')
            ELSE 'lint-bot' END AS ref
FROM orders
""",
    "include_edges": """
SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % 97 AS dst FROM part
""",
    "feature_plans": """
SELECT p_partkey AS feature, concat('plan', CAST(p_partkey % 40 AS STRING)) AS id FROM part
""",
    "leaf_tasks": """
SELECT concat('proj', CAST(o_custkey % 50 AS STRING), '/c', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING)) AS path,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'queued' END AS status
FROM orders
""",
    "docs_before": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS n, source FROM documents WHERE lang <> 'de'
""",
    "docs_after": """
SELECT doc_id, n_chars AS n, source FROM documents WHERE source <> 'src3'
""",
    "role_overrides": """
SELECT '' AS scope, concat('role', CAST(n_nationkey % 4 AS STRING)) AS role, 'add' AS op, concat('p', CAST(n_nationkey AS STRING), '@github') AS stakeholder FROM nation
UNION ALL
SELECT concat(r_name, '/', n_name) AS scope, concat('role', CAST(n_nationkey % 4 AS STRING)) AS role, 'remove' AS op,
       concat('p', CAST((n_nationkey * 5) % 25 AS STRING), '@github:tz=UTC') AS stakeholder
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat(r_name, '/', n_name, '/', c_name) AS scope, concat('role', CAST(c_custkey % 4 AS STRING)) AS role,
       CASE WHEN c_custkey % 3 = 0 THEN 'remove' ELSE 'add' END AS op, concat('p', CAST(c_custkey % 25 AS STRING), '@github') AS stakeholder
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "gates": """
SELECT concat('g', CAST(c_custkey AS STRING)) AS gate, concat(r_name, '/', n_name, '/', c_name) AS feature, concat('role', CAST(c_custkey % 4 AS STRING)) AS role
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('g', CAST(c_custkey AS STRING)) AS gate, concat(r_name, '/', n_name, '/', c_name) AS feature, concat('role', CAST(c_nationkey % 4 AS STRING)) AS role
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "contexts": """
SELECT CAST(o_orderkey AS STRING) AS context, concat('c', CAST(o_custkey AS STRING)) AS human, concat('org', CAST(o_custkey % 10 AS STRING)) AS org,
       concat('proj', CAST(o_custkey % 50 AS STRING)) AS project, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('r', CAST(o_orderkey % 20 AS STRING)) END AS repo
FROM orders
""",
    "rules": """
SELECT concat('rule', CAST(p_partkey AS STRING)) AS rule, CASE p_partkey % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'org' WHEN 2 THEN 'project' ELSE 'repo' END AS scope,
       CASE p_partkey % 4 WHEN 0 THEN concat('c', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('org', CAST(p_partkey AS STRING))
            WHEN 2 THEN concat('proj', CAST(p_partkey AS STRING)) ELSE concat('r', CAST(p_partkey AS STRING)) END AS scope_id
FROM part
""",
    "skilled_agents": """
SELECT s_name AS name, concat('skill', CAST(s_nationkey AS STRING), ',skill', CAST(s_suppkey % 30 AS STRING)) AS skill_list,
       CASE WHEN s_suppkey % 5 = 0 THEN 'offline' ELSE 'active' END AS status, s_suppkey % 4 AS load
FROM supplier
""",
    "skill_tasks": """
SELECT CAST(o_orderkey AS STRING) AS task, concat('skill', CAST(o_custkey % 35 AS STRING)) AS skill FROM orders
""",
    "model_requests": """
SELECT o_orderkey AS task, CASE WHEN o_custkey % 2 = 0 THEN 'claude' ELSE 'openai' END AS platform,
       CASE WHEN o_orderkey % 10 = 0 THEN 'my-model' END AS override, CASE WHEN o_orderkey % 7 = 0 THEN 'hint-model' END AS suggested_model,
       CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'small' WHEN 2 THEN 'large' END AS model_class,
       CASE WHEN o_orderkey % 6 = 3 THEN 'medium' END AS assessed_class
FROM orders
""",
    "questions": """
SELECT doc_id AS id, source AS doc, CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'linked' WHEN 2 THEN 'resolved' ELSE 'linked' END AS status,
       CASE WHEN doc_id % 4 <> 0 THEN CAST(n_chars AS STRING) END AS linked_task,
       CASE WHEN doc_id % 4 = 2 THEN (CASE doc_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-01-29 00:00:00' END) END AS resolved_at
FROM documents
""",
    "micro_targets": """
SELECT CAST(o_orderkey AS STRING) AS task, concat('m', CAST(o_custkey % 100 AS STRING)) AS module, concat('proj', CAST(o_custkey % 50 AS STRING)) AS project FROM orders
""",
    "micro_configs": """
SELECT 'global' AS level, '' AS scope, CASE r_regionkey % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' ELSE 'background' END AS phase, r_name AS name FROM region
UNION ALL
SELECT 'project' AS level, concat('proj', CAST(n_nationkey AS STRING)) AS scope, CASE WHEN n_regionkey % 2 = 0 THEN 'pre' ELSE 'post' END AS phase, n_name AS name FROM nation
UNION ALL
SELECT 'module' AS level, concat('m', CAST(s_suppkey % 60 AS STRING)) AS scope, CASE WHEN s_suppkey % 2 = 0 THEN 'post' ELSE 'extra' END AS phase, s_name AS name FROM supplier
UNION ALL
SELECT 'task' AS level, CAST(p_partkey * 3 AS STRING) AS scope, 'pre' AS phase, p_name AS name FROM part
""",
    "decisions": """
SELECT concat('d', CAST(c_custkey AS STRING)) AS decision, CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'any' WHEN 2 THEN 'min' ELSE 'majority' END AS policy,
       CASE WHEN c_custkey % 4 = 2 THEN 2 END AS min_n, TIMESTAMP '1992-06-01 00:00:00' AS requested_at,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 31536000 * (c_custkey % 6) END AS timeout_s
FROM customer
""",
    "assigned": """
SELECT concat('d', CAST(c_custkey AS STRING)) AS decision, concat('s', CAST(r_regionkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN ':tz=UTC' ELSE '' END) AS stakeholder
FROM customer JOIN region ON r_regionkey < c_custkey % 5
""",
    "plan_states": """
SELECT p_partkey AS plan, p_brand AS roadmap, CASE p_partkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'in_progress' ELSE 'open' END AS state,
       CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' WHEN p_partkey % 5 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' END AS completed_at,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_size <= 10 THEN 'S' WHEN p_size <= 25 THEN 'M' WHEN p_size <= 40 THEN 'L' ELSE 'XL' END AS effort,
       CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS impact,
       CASE p_partkey % 3 WHEN 0 THEN 'Conceptual' WHEN 1 THEN 'In Progress' ELSE 'Stable' END AS feature_status
FROM part
""",
    "plan_deps": """
SELECT p_partkey AS plan, CAST((p_partkey - p_partkey % 2) / 2 AS BIGINT) AS dep FROM part WHERE p_partkey > 1
""",
    "lifecycle_events": """
SELECT user_id AS project_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'creating' ELSE 'running' END
       WHEN 'view' THEN 'paused' WHEN 'click' THEN 'resumed' WHEN 'error' THEN 'failed' ELSE 'restarted' END AS type
FROM events
""",
    "health_checks": """
SELECT user_id AS project_id, ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'view' THEN 'unhealthy' WHEN 'purchase' THEN 'unhealthy' WHEN 'click' THEN 'degraded' ELSE 'ok' END AS health
FROM events
""",
    "api_requests": """
SELECT event_id AS request_id, date_trunc('hour', ts) AS ts, user_id % 5 AS user_id, user_id % 3 AS project_id,
       CASE event_type WHEN 'signup' THEN 'credentials' WHEN 'view' THEN 'query' WHEN 'error' THEN 'admin' ELSE 'execute' END AS category
FROM events
""",
    "quota_samples": """
SELECT user_id AS project_id, ts, event_id AS seq, value AS used, CAST(20 + user_id % 50 AS DOUBLE) AS quota FROM events
""",
    "channel_messages": """
SELECT conv_id AS session_id, turn AS seq, concat('h', CAST(conv_id % 10 AS STRING)) AS host, role, turn % 2 = 0 AS processed FROM conversations
""",
    "hosts": """
SELECT concat('h', CAST(n_nationkey AS STRING)) AS host, CASE WHEN n_nationkey % 3 = 0 THEN 'offline' ELSE 'online' END AS status FROM nation
""",
    "trace_logs": """
SELECT CAST(event_id % 4000 AS STRING) AS trace_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level FROM events
""",
    "permission_requests": """
SELECT event_id AS request_id, ts FROM events WHERE event_type <> 'click'
""",
    "verdicts": """
SELECT event_id - 1 AS request_id, ts, CASE WHEN event_type = 'click' THEN 'allow' ELSE 'deny' END AS verdict FROM events WHERE event_type IN ('click', 'view')
""",
    "messages": """
SELECT event_id - event_id % 3 AS message_id, ts, event_type AS kind FROM events
""",
    "notices": """
SELECT event_id, event_type AS type, concat(props, repeat('x', CAST(event_id % 1000 AS INT))) AS content FROM events
""",
    "subscriptions": """
SELECT CASE n_regionkey WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'error' ELSE 'other' END AS type, n_name AS recipient FROM nation
""",
    "chat_activity": """
SELECT user_id AS chat_id, ts FROM events
""",
    "decision_requests": """
SELECT concat('d', CAST(c_custkey AS STRING)) AS decision, TIMESTAMP '1992-01-01 00:00:00' AS ts, CAST(NULL AS STRING) AS who,
       CAST(1 + c_custkey % 4 AS INT) AS needed, CASE WHEN c_custkey % 3 > 0 THEN CAST(15768000 * (c_custkey % 12) AS BIGINT) END AS timeout_s
FROM customer
""",
    "decision_answers": """
SELECT concat('d', CAST(o_custkey AS STRING)) AS decision, o_orderdate AS ts, concat('s', CAST(o_orderkey % 5 AS STRING)) AS who,
       CAST(NULL AS INT) AS needed, CAST(NULL AS BIGINT) AS timeout_s
FROM orders
""",
    "runner_events": """
SELECT concat('h', CAST(user_id % 15 AS STRING)) AS runner, ts, event_id AS seq,
       CASE WHEN event_type = 'click' THEN 'heartbeat' WHEN event_type = 'view' THEN 'session_opened' WHEN event_type = 'purchase' THEN 'session_closed'
            WHEN event_type = 'error' THEN 'drain' WHEN event_id % 3 = 0 THEN 'deregister' ELSE 'heartbeat' END AS kind,
       CASE WHEN event_type IN ('view', 'purchase') THEN concat('s', CAST(event_id % 3 AS STRING)) END AS session
FROM events
""",
}

_TABLE_USE = re.compile(r"\b(FROM|JOIN) (" + "|".join(BASE_TABLES) + r")\b")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived record table as a lazy DataFrame."""
    return run_sql(spark, sf_dir, STANDINS[name])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {m.group(2) for m in _TABLE_USE.finditer(sql)}
    tables = {name: base(spark, sf_dir, name) for name in used}
    return spark.sql(_TABLE_USE.sub(r"\1 {\2}", sql), **tables)


def standin_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same record table as a stream over the stored files (for tables that only project and filter)."""
    from coord.streaming.io import open_stream

    sql = STANDINS[name]
    tables = {t: open_stream(spark, f"{sf_dir}/{t}.parquet") for t in {m.group(2) for m in _TABLE_USE.finditer(sql)}}
    return spark.sql(_TABLE_USE.sub(r"\1 {\2}", sql), **tables)
