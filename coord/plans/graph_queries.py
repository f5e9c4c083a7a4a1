"""Registered queries over dependency graphs and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.operators import graph
from coord.plans.registry import query

REACH = """r AS (SELECT DISTINCT {a} AS root, {b} AS node, 1 AS depth FROM {t} UNION
      SELECT r.root, e.{b}, r.depth + 1 FROM r JOIN {t} e ON e.{a} = r.node)"""


@query(
    "transitive_deps", "feature_edges",
    sql=f"WITH RECURSIVE {REACH.format(a='src', b='dst', t='feature_edges')} SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL",
)
def transitive_deps(spark, edges):
    return graph.transitive_deps(edges)


@query(
    "transitive_refs", "feature_edges",
    sql=f"WITH RECURSIVE {REACH.format(a='dst', b='src', t='feature_edges')} SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL",
)
def transitive_refs(spark, edges):
    return graph.transitive_refs(edges)


@query(
    "dependency_paths", "task_deps",
    sql="""WITH RECURSIVE e AS (SELECT DISTINCT slug AS src, CAST(dep AS VARCHAR) AS dst FROM task_deps),
      r AS (SELECT src AS root, dst AS node, 1 AS depth, src || '>' || dst AS path FROM e
      UNION ALL SELECT r.root, e.dst, r.depth + 1, r.path || '>' || e.dst FROM r JOIN e ON e.src = r.node)
      SELECT root, node, depth, path, false AS cycle FROM r""",
)
def dependency_paths(spark, deps):
    edges = deps.select(F.col("slug").alias("src"), F.col("dep").cast("string").alias("dst"))
    roots = edges.select(F.col("src").alias("root"))
    return graph.paths(edges, roots).withColumn("path", F.array_join("path", ">"))


@query(
    "impact", "feature_edges", "feature_plans",
    sql=f"""WITH RECURSIVE {REACH.format(a='dst', b='src', t='feature_edges')},
      p AS (SELECT DISTINCT root AS feature, node AS ref FROM r), a AS (SELECT * FROM p UNION SELECT feature, feature FROM p)
      SELECT feature, count(*) AS refs, (SELECT count(DISTINCT l.id) FROM a JOIN feature_plans l ON l.feature = a.ref WHERE a.feature = p.feature) AS plans
      FROM p WHERE ref <> feature GROUP BY feature""",
)
def impact(spark, edges, plans):
    return graph.impact(edges, plans)


@query(
    "find_cycles", "include_edges",
    sql="""WITH RECURSIVE r AS (SELECT DISTINCT src AS root, dst AS node FROM include_edges UNION
        SELECT r.root, e.dst FROM r JOIN include_edges e ON e.src = r.node),
      m AS (SELECT a.root, a.node FROM r a JOIN r b ON a.root = b.node AND a.node = b.root)
      SELECT src, dst, (SELECT min(node) FROM m WHERE m.root = src) AS cycle_group
      FROM (SELECT DISTINCT src, dst FROM include_edges) WHERE (src, dst) IN (SELECT root, node FROM m)""",
)
def find_cycles(spark, edges):
    return graph.find_cycles(edges)


@query(
    "dependency_waves", "tasks", "task_deps",
    sql="""WITH RECURSIVE e AS (SELECT DISTINCT slug AS src, CAST(dep AS VARCHAR) AS dst FROM task_deps WHERE CAST(dep AS VARCHAR) IN (SELECT slug FROM tasks)),
      r AS (SELECT slug AS node, 0 AS wave FROM tasks UNION SELECT e.src, r.wave + 1 FROM r JOIN e ON e.dst = r.node)
      SELECT node, max(wave) AS wave FROM r GROUP BY node""",
)
def dependency_waves(spark, tasks, deps):
    nodes = tasks.select(F.col("slug").alias("node"))
    return graph.dependency_waves(nodes, deps.select(F.col("slug").alias("src"), F.col("dep").cast("string").alias("dst")))


INCLUDE_PATHS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM include_edges),
      r AS (SELECT src AS root, dst AS node, 1 AS depth, [src, dst] AS path, src = dst AS cycle FROM e
        UNION ALL SELECT r.root, e.dst, r.depth + 1, list_append(r.path, e.dst), list_contains(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT r.cycle)"""


@query("cyclic_paths", "include_edges", sql=f"{INCLUDE_PATHS} SELECT root, node, depth, array_to_string(path, '>') AS path, cycle FROM r")
def cyclic_paths(spark, edges):
    """Dependency tree of every feature that includes others, cycles marked."""
    roots = edges.select(F.col("src").alias("root"))
    return graph.paths(edges, roots).withColumn("path", F.array_join("path", ">"))


@query(
    "simple_cycles", "include_edges",
    sql=f"""{INCLUDE_PATHS}, c AS (SELECT path[list_position(path, node):len(path) - 1] AS loop FROM r WHERE cycle)
      SELECT DISTINCT array_to_string(loop[list_position(loop, list_min(loop)):] || loop[:list_position(loop, list_min(loop)) - 1], '>') AS cycle FROM c""",
)
def simple_cycles(spark, edges):
    roots = edges.select(F.col("src").alias("root"))
    return graph.simple_cycles(graph.paths(edges, roots)).select(F.array_join("cycle", ">").alias("cycle"))


@query(
    "plan_transitive_deps", "feature_edges", "feature_plans",
    sql="""WITH RECURSIVE r AS (SELECT DISTINCT src AS root, dst AS node, 1 AS depth FROM feature_edges WHERE src IN (SELECT feature FROM feature_plans WHERE id = 'plan7')
        UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN feature_edges e ON e.src = r.node)
      SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL""",
)
def plan_transitive_deps(spark, edges, plans):
    """Transitive dependencies of the features of one plan."""
    return graph.transitive_deps(edges, plans.filter("id = 'plan7'").select(F.col("feature").alias("root")))


@query(
    "include_waves", "include_edges",
    sql="""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM include_edges), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
      w AS (SELECT node AS src, (node * 7) % 101 AS dst FROM n UNION SELECT src, dst FROM e WHERE src > 40),
      k AS (SELECT DISTINCT w.src, w.dst FROM w JOIN n ON n.node = w.dst WHERE w.src > 40 AND w.dst < w.src),
      r AS (SELECT node, 0 AS wave FROM n UNION SELECT k.src, r.wave + 1 FROM r JOIN k ON k.dst = r.node)
      SELECT node, max(wave) AS wave FROM r GROUP BY node""",
)
def include_waves(spark, edges):
    """Waves of a graph whose nodes have up to two dependencies."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    more = nodes.select(F.col("node").alias("src"), ((F.col("node") * 7) % 101).alias("dst")).unionByName(edges.filter("src > 40"))
    return graph.dependency_waves(nodes, more.filter("src > 40 AND dst < src"))


@query(
    "focus_tree", "feature_paths",
    sql="""SELECT id, length(id) - length(replace(id, '/', '')) AS depth, id = 'ASIA' AS focus FROM feature_paths WHERE id = 'ASIA' OR id LIKE 'ASIA/%'""",
)
def focus_tree(spark, features):
    return graph.focus_tree(features, "ASIA").drop("sort_key")


@query(
    "full_tree", "feature_paths",
    sql="""SELECT id, row_number() OVER (ORDER BY string_split(id, '/')) AS place, repeat('  ', length(id) - length(replace(id, '/', ''))) || regexp_extract(id, '([^/]*)$', 1) AS line
      FROM (SELECT DISTINCT id FROM feature_paths)""",
)
def full_tree(spark, features):
    return graph.tree_lines(graph.focus_tree(features))


@query(
    "rollup_parent_status", "leaf_tasks",
    sql="""WITH u AS (SELECT split_part(path, '/', 1) AS parent, status FROM leaf_tasks UNION ALL
        SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), status FROM leaf_tasks)
      SELECT parent, count(*) FILTER (status = 'completed') AS done, count(*) AS total,
        CASE WHEN count(*) FILTER (status = 'completed') = count(*) THEN 'completed' WHEN count(*) FILTER (status <> 'queued') > 0
        THEN 'in_progress' ELSE 'queued' END AS status FROM u GROUP BY parent""",
)
def rollup_parent_status(spark, leaves):
    return graph.rollup_parent_status(leaves)
