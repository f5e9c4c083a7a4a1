"""Registered queries over a specification corpus: extraction, relations, lint, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from coord.operators import corpus, extract, lint, search
from coord.operators.search_index import index_of
from coord.plans.registry import query
from coord.session import cut_lineage
from coord.sources import files


def lines_sql(table: str) -> str:
    """CTEs: lines of a document table with fence state, headings with their ranges."""
    return f"""arr AS (SELECT path, string_split(replace(regexp_replace(text, '\\n\\z', ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {table}),
ln AS (SELECT path, len(ls) AS nl, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM arr),
fe AS (SELECT *, regexp_matches(t, '^ {{0,3}}(```|~~~)') AS fence FROM ln),
pr AS (SELECT *, NOT fence AND coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS prose FROM fe),
it AS (SELECT path, line FROM pr WHERE prose AND regexp_matches(t, '^([-*+]|\\d+[.)])[ \\t]+\\S')),
nn AS (SELECT path, line FROM pr WHERE prose AND trim(t) = 'None at this time.'),
h0 AS (SELECT path, nl, line, length(regexp_extract(t, '^(#{{1,6}})', 1)) AS level, trim(regexp_extract(t, '^#{{1,6}}[ \\t]+(.*)$', 1)) AS title
  FROM pr WHERE prose AND regexp_matches(t, '^#{{1,6}}[ \\t]+\\S')),
h AS (SELECT a.*, coalesce((SELECT min(b.line) - 1 FROM h0 b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level), a.nl) AS end_line,
  coalesce((SELECT min(b.line) - 1 FROM h0 b WHERE b.path = a.path AND b.line > a.line), a.nl) AS own_end,
  (SELECT max(b.line) FROM h0 b WHERE b.path = a.path AND b.line < a.line AND b.level < a.level) AS parent_line FROM h0 a)"""


SECTIONS_SQL = """SELECT h.path, h.level, h.title, h.line AS start_line, h.end_line, h.parent_line, p.title AS parent_title,
  (SELECT count(*) FROM it WHERE it.path = h.path AND it.line BETWEEN h.line AND h.own_end) AS items,
  (SELECT count(*) FROM it WHERE it.path = h.path AND it.line BETWEEN h.line AND h.end_line) AS range_items,
  (SELECT count(*) FROM nn WHERE nn.path = h.path AND nn.line BETWEEN h.line AND h.end_line) AS range_nones
  FROM h LEFT JOIN h0 p ON p.path = h.path AND p.line = h.parent_line"""


@query("extract_sections", "spec_docs", sql=f"WITH {lines_sql('spec_docs')} {SECTIONS_SQL}")
def extract_sections(spark, docs):
    return extract.sections(docs)


@query("extract_sections_fenced", "wiki_docs", sql=f"WITH {lines_sql('wiki_docs')} {SECTIONS_SQL}")
def extract_sections_fenced(spark, docs):
    return extract.sections(docs)


@query(
    "extract_metadata", "spec_docs",
    sql=r"""SELECT path, trim(regexp_extract(text, '(?m)^[ \t]*#[ \t]+([^\r\n]*)', 1)) AS title,
      nullif(trim(regexp_extract(text, '(?m)^\*\*Status:\*\*[ \t]*([^\r\n]*)', 1)), '') AS status FROM spec_docs""",
)
def extract_metadata(spark, docs):
    return extract.metadata(docs, {"status": "Status"})


@query(
    "extract_plan_metadata", "plan_docs",
    sql="""SELECT path, trim(split_part(split_part(text, chr(10), 1), '# ', 2)) AS title,
      split_part(split_part(text, chr(10), 3), ':** ', 2) AS status, split_part(split_part(text, chr(10), 4), ':** ', 2) AS effort FROM plan_docs""",
)
def extract_plan_metadata(spark, docs):
    return extract.metadata(docs, {"status": "Status", "effort": "Effort"})


EDGES_SQL = r"""SELECT DISTINCT regexp_extract(x.path, '^spec/features/(.+)/README\.md$', 1) AS src,
  regexp_extract(x.t, '^- (\S+)', 1) AS dst FROM pr x JOIN it USING (path, line)
  WHERE (SELECT arg_max(h0.title, h0.line) FROM h0 WHERE h0.path = x.path AND h0.line < x.line) = 'Dependencies'"""


@query("extract_edges", "spec_docs", sql=f"WITH {lines_sql('spec_docs')} {EDGES_SQL}")
def extract_edges(spark, docs):
    return extract.dependency_edges(docs)


@query(
    "extract_plan_features", "plan_docs",
    sql=r"""SELECT DISTINCT regexp_extract(path, '^spec/plans/(.+)/README\.md$', 1) AS plan,
      unnest([regexp_extract(text, '\*\*Features:\*\* ([^,]*),', 1), 'src1/f1']) AS feature FROM plan_docs""",
)
def extract_plan_features(spark, docs):
    return extract.plan_features(docs)


def links_sql(table: str) -> str:
    return f"""{lines_sql(table)},
lk AS (SELECT path, line, unnest(regexp_extract_all(t, '\\[([^\\]]*)\\]\\([^)]*\\)', 1)) AS label,
  unnest(regexp_extract_all(t, '\\[[^\\]]*\\]\\(([^)]*)\\)', 1)) AS raw FROM pr WHERE prose),
lx AS (SELECT path, line, label, raw, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external'
  WHEN split_part(raw, '#', 1) = '' THEN 'anchor' ELSE 'internal' END AS kind,
  (SELECT arg_max(h0.title, h0.line) FROM h0 WHERE h0.path = lk.path AND h0.line <= lk.line) AS section FROM lk),
links AS (SELECT path, line, section, label, CASE WHEN kind = 'external' THEN raw ELSE split_part(raw, '#', 1) END AS target,
  CASE WHEN kind <> 'external' THEN nullif(split_part(raw, '#', 2), '') END AS anchor, kind FROM lx)"""


@query("extract_links", "wiki_docs", sql=f"WITH {links_sql('wiki_docs')} SELECT * FROM links")
def extract_links(spark, docs):
    return extract.links(docs)


@query(
    "page_links", "pages",
    sql="""SELECT url AS path, target, count(*) AS n FROM (SELECT url,
      unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""",
)
def page_links(spark, pages):
    found = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.groupBy(F.col("url").alias("path"), "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_refs", "source_files",
    sql=r"""WITH t AS (SELECT path, unnest(string_split(text, chr(10))) AS t FROM source_files),
      r AS (SELECT path, unnest(regexp_extract_all(t, '(?:spec:|https://spec\.example/)((?:feature|plan|doc)/[A-Za-z0-9._/-]+(?:@[A-Za-z0-9.-]+/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+)?)', 1)) AS r
        FROM t WHERE regexp_matches(t, '^\s*(//|#|/\*|--|\*|;|%|<!--)')),
      x AS (SELECT path, split_part(r, '/', 1) AS type, split_part(r, '@', 1) AS head, nullif(split_part(r, '@', 2), '') AS repo FROM r)
      SELECT DISTINCT path AS file, type, CASE type WHEN 'feature' THEN 'spec/features/' WHEN 'plan' THEN 'spec/plans/' ELSE 'docs/' END
        || substr(head, length(type) + 2) AS target, repo FROM x""",
)
def source_refs(spark, src):
    return extract.source_refs(src)


@query(
    "code_spec_trace", "source_files", "spec_docs",
    sql=r"""WITH f AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id FROM spec_docs),
      r AS (SELECT path AS file, regexp_extract(text, '// spec:feature/(\S+)', 1) AS feature FROM source_files UNION
        SELECT path, 'none/x' FROM source_files WHERE text LIKE '% and spec:feature/none/x%')
      SELECT file, feature, CASE WHEN feature IN (SELECT id FROM f) THEN 'ok' ELSE 'unresolved' END AS state FROM r UNION ALL
      SELECT NULL, id, 'unreferenced' FROM f WHERE id NOT IN (SELECT feature FROM r)""",
)
def code_spec_trace(spark, src, docs):
    return corpus.code_spec_trace(extract.source_refs(src), corpus.features_of(docs))


@query(
    "stakeholders", "stakeholder_refs",
    sql="""SELECT DISTINCT decision, split_part(ref, ':', 1) AS identity, split_part(split_part(ref, ':', 1), '@', 1) AS id,
      nullif(split_part(split_part(ref, ':', 1), '@', 2), '') AS platform, ref NOT LIKE '%@%' AS is_agent FROM stakeholder_refs""",
)
def stakeholders(spark, refs):
    return extract.stakeholders(refs, "ref", ("decision",))


@query(
    "link_census", "repo_refs",
    sql=r"""WITH n AS (SELECT source, trim(raw) AS raw FROM repo_refs),
      p AS (SELECT source, raw, regexp_extract(replace(replace(rtrim(raw, '/'), 'https://', ''), 'git@git.example:', 'git.example/'), '^([^/]+/[^/]+/[^/]+?)(\.git)?$', 1) AS t FROM n)
      SELECT source, CASE WHEN t = '' THEN raw ELSE t END AS target, t <> '' AS valid, count(*) AS links FROM p GROUP BY ALL""",
)
def link_census(spark, refs):
    return extract.link_census(refs)


@query(
    "ingest_boards", "board_docs",
    sql=r"""WITH r AS (SELECT path, unnest(list_filter(string_split(text, chr(10)), lambda x: x LIKE '|%' AND x NOT LIKE '|---%' AND x NOT LIKE '| Task |%')) AS raw,
        generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x LIKE '|%' AND x NOT LIKE '|---%' AND x NOT LIKE '| Task |%'), 1) - 1 AS ordinal FROM board_docs),
      c AS (SELECT path AS board, ordinal, list_transform(string_split(trim(raw, '|'), '|'), lambda x: trim(replace(replace(x, '&nbsp;', ' '), '<br>', ' '))) AS c FROM r),
      s AS (SELECT *, regexp_extract(c[2], '`([^`]+)`', 1) AS st FROM c)
      SELECT board, ordinal, CASE WHEN c[1] LIKE '[%' THEN regexp_extract(c[1], '^\[([^\]]*)\]', 1) ELSE c[1] END AS slug,
        CASE st WHEN 'complete' THEN 'completed' WHEN 'done' THEN NULL WHEN '' THEN NULL ELSE st END AS status,
        CASE WHEN c[3] = '—' THEN '' ELSE replace(c[3], ', ', ',') END AS depends_on, nullif(replace(c[4], '`', ''), '—') AS branch,
        nullif(c[5], '—') AS agent, nullif(c[6], '—') AS requester,
        CASE WHEN c[7] <> '—' THEN strptime(c[7][1:16], '%Y-%m-%d %H:%M') END AS started_at,
        CASE WHEN c[7] LIKE '%(%' THEN 240 + CAST(regexp_extract(c[7], 'm(\d+)s', 1) AS BIGINT) END AS duration_s,
        CASE st WHEN 'done' THEN 'unknown status done' WHEN '' THEN 'status without backticks' END AS error FROM s""",
)
def ingest_boards(spark, docs):
    rows = files.ingest_boards(docs).drop("time")
    return rows.withColumns({"depends_on": F.array_join("depends_on", ","), "ordinal": F.col("ordinal").cast("long")})


@query(
    "ingest_task_docs", "task_files",
    sql=r"""SELECT path, nullif(regexp_extract(text, '^# ([^\n]*)', 1), '') AS title,
      CASE WHEN text LIKE '# %' THEN regexp_replace(split_part(substr(text, strpos(text, chr(10)) + 1), chr(10) || '## ', 1), '^\s+|\s+$', '', 'g') ELSE '' END AS description,
      CASE WHEN text LIKE '%- other%' THEN regexp_extract(text, '- (t\d+)', 1) || ',other' ELSE '' END AS depends_on,
      CASE WHEN text LIKE '%Did %' THEN regexp_extract(text, '(Did [^\n]*)', 1) ELSE '' END AS summary,
      CASE WHEN text NOT LIKE '# %' THEN 'missing title' WHEN text NOT LIKE '%## Dependencies%' THEN 'missing Dependencies section'
        WHEN text NOT LIKE '%## Summary%' THEN 'missing Summary section' END AS error FROM task_files""",
)
def ingest_task_docs(spark, docs):
    return files.ingest_task_docs(docs).withColumn("depends_on", F.array_join("depends_on", ","))


@query("discover_features", "spec_docs", sql=r"SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id FROM spec_docs")
def discover_features(spark, docs):
    return files.discover_features(docs)


@query(
    "task_list_csv", "tasks",
    sql="""SELECT slug AS path, status, '' AS title, '' AS run, '' AS model, requester, '' AS depends_on, '' AS claimed_at,
      strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM tasks""",
)
def task_list_csv(spark, tasks):
    return files.task_list_rows(tasks)


@query(
    "render_boards", "tasks",
    sql="""WITH b AS (SELECT project AS board, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS section_no, ordinal,
        '| [' || slug || '](' || slug || '/) | ' || CASE status WHEN 'completed' THEN '✅' WHEN 'queued' THEN '⏳' ELSE '🔵' END
        || ' `' || status || '` | — | — | — | ' || requester || ' | — |' AS line FROM tasks),
      s AS (SELECT DISTINCT board, section_no FROM b UNION SELECT DISTINCT board, 0 FROM b)
      SELECT * FROM b UNION ALL SELECT board, section_no, i - 10, CASE i - section_no WHEN -1 THEN '' WHEN 0 THEN CASE section_no WHEN 0 THEN '# Tasks' ELSE '### Recently Finished' END
        WHEN 1 THEN '' WHEN 2 THEN '| Task | Status | Depends on | Branch | Agent | Requester | Time |' ELSE '|---|---|---|---|---|---|---|' END
      FROM s, range(0, 4 + section_no) r(i)""",
)
def render_boards(spark, tasks):
    done = F.when(F.col("status") == "completed", "recently_finished").otherwise("active")
    none = F.lit(None).cast("string")
    rows = tasks.select(
        F.col("project").alias("board"), done.alias("section"), "ordinal", "slug", "status",
        F.array().cast("array<string>").alias("depends_on"), none.alias("branch"), none.alias("agent"), "requester", none.alias("time"),
    )
    return files.render_boards(rows)


@query(
    "classify_documents", "wiki_docs",
    sql=r"""WITH f AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id,
        nullif(trim(regexp_extract(text, '(?m)^\*\*Status:\*\*[ \t]*([^\r\n]*)', 1)), '') AS status FROM wiki_docs),
      p AS (SELECT path FROM wiki_docs UNION SELECT replace(path, 'README.md', 'proposals/p1/README.md') FROM wiki_docs UNION
        SELECT replace(path, 'spec/features', 'spec/plans') FROM wiki_docs)
      SELECT path, CASE WHEN path LIKE '%/proposals/%' THEN 'proposal' WHEN path LIKE 'spec/features/%' THEN 'feature' ELSE 'plan' END AS type,
        f.id AS feature, f.status FROM p LEFT JOIN f ON path LIKE 'spec/features/%'
        AND f.id = replace(regexp_extract(path, '^spec/features/(.+)/README\.md$', 1), '/proposals/p1', '')""",
)
def classify_documents(spark, docs):
    p = docs.select("path")
    more = p.unionByName(p.select(F.replace("path", F.lit("README.md"), F.lit("proposals/p1/README.md")).alias("path")))
    more = more.unionByName(p.select(F.replace("path", F.lit("spec/features"), F.lit("spec/plans")).alias("path")))
    own = corpus.features_of(docs)
    return corpus.classify_documents(more, own)


@query("normative_only", "wiki_docs", sql="SELECT path FROM wiki_docs WHERE path NOT LIKE '%/sub/%'")
def normative_only(spark, docs):
    renamed = docs.select(F.replace("path", F.lit("/sub/"), F.lit("/proposals/")).alias("path"))
    return corpus.normative_only(renamed)


@query("subtree_filter", "feature_paths", sql="SELECT id FROM feature_paths WHERE id = 'ASIA' OR id LIKE 'ASIA/%'")
def subtree_filter(spark, features):
    return corpus.subtree(features, "ASIA")


@query(
    "reconcile_index", "feature_paths", "listed_children",
    sql=r"""WITH d AS (SELECT regexp_extract(id, '^(.*)/[^/]*$', 1) AS parent, id AS child FROM feature_paths WHERE id LIKE '%/%')
      SELECT coalesce(d.parent, l.parent) AS parent, coalesce(d.child, l.child) AS child, l.child IS NOT NULL AS in_readme,
        CASE WHEN d.child IS NULL THEN 'orphaned' WHEN l.child IS NULL THEN 'missing' ELSE 'ok' END AS state
      FROM d FULL JOIN listed_children l ON d.parent = l.parent AND d.child = l.child""",
)
def reconcile_index(spark, features, listed):
    return corpus.reconcile_index(corpus.children_on_disk(features), listed)


@query(
    "ac_coverage", "scenarios", "criteria",
    sql="""WITH s AS (SELECT DISTINCT * FROM scenarios), k AS (SELECT DISTINCT * FROM criteria),
      c AS (SELECT k.feature, k.ac, count(DISTINCT s.scenario) AS n FROM k LEFT JOIN s ON s.feature = k.feature AND s.ac IN ('*', k.ac) GROUP BY ALL)
      SELECT feature, ac, n AS scenarios, CASE WHEN n > 0 THEN 'covered' ELSE 'uncovered' END AS state FROM c UNION ALL
      SELECT feature, ac, count(*), 'unknown' FROM s WHERE ac <> '*' AND (feature, ac) NOT IN (SELECT feature, ac FROM k) GROUP BY ALL""",
)
def ac_coverage(spark, scenarios, criteria):
    return corpus.ac_coverage(scenarios, criteria)


@query(
    "dangling_dependencies", "spec_docs",
    sql=rf"WITH {lines_sql('spec_docs')}, e AS ({EDGES_SQL}) SELECT * FROM e WHERE 'spec/features/' || dst || '/README.md' NOT IN (SELECT path FROM spec_docs)",
)
def dangling_dependencies(spark, docs):
    return corpus.dangling_dependencies(extract.dependency_edges(docs), corpus.features_of(docs))


@query("feature_refs", "feature_edges", sql="SELECT DISTINCT dst AS feature, src AS ref FROM feature_edges")
def feature_refs(spark, edges):
    return corpus.feature_refs(edges)


@query(
    "ref_counts", "feature_edges",
    sql="SELECT dst AS feature, count(DISTINCT src) AS refs, min(src) AS first_ref, max(src) AS last_ref FROM feature_edges GROUP BY dst",
)
def ref_counts(spark, edges):
    return corpus.ref_counts(edges)


@query(
    "snapshot_diff", "docs_before", "docs_after",
    sql="""SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN w.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM docs_before o FULL JOIN docs_after w ON o.doc_id = w.doc_id WHERE o.n IS DISTINCT FROM w.n""",
)
def snapshot_diff(spark, before, after):
    return corpus.snapshot_diff(before, after, ["doc_id"])


OQ_SQL = r"""SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS feature,
  CASE WHEN text LIKE '%' || chr(10) || '- Question %' AND text LIKE '%## Outstanding Questions%' THEN 1 ELSE 0 END AS oq FROM spec_docs"""


@query("open_question_counts", "spec_docs", sql=OQ_SQL)
def open_question_counts(spark, docs):
    return corpus.open_question_counts(extract.sections(docs))


@query(
    "open_question_subtrees", "spec_docs",
    sql=f"""WITH q AS ({OQ_SQL}) SELECT feature, CAST(sum(oq) AS BIGINT) AS oq FROM (SELECT feature, oq FROM q UNION ALL
      SELECT split_part(feature, '/', 1), oq FROM q) GROUP BY feature UNION ALL SELECT NULL, CAST(sum(oq) AS BIGINT) FROM q""",
)
def open_question_subtrees(spark, docs):
    return corpus.subtree_sums(corpus.open_question_counts(extract.sections(docs)), "oq")


PLAN_LINKS = r"""pl AS (SELECT DISTINCT regexp_extract(path, '^spec/plans/(.+)/README\.md$', 1) AS plan,
  unnest([regexp_extract(text, '\*\*Features:\*\* ([^,]*),', 1), 'src1/f1']) AS feature FROM plan_docs)"""


@query(
    "feature_list", "spec_docs", "plan_docs",
    sql=rf"""WITH {lines_sql('spec_docs')}, e AS ({EDGES_SQL}), q AS ({OQ_SQL}), {PLAN_LINKS},
      f AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id, trim(regexp_extract(text, '\*\*Status:\*\* ([^\n]*)', 1)) AS status FROM spec_docs)
      SELECT f.id, f.status, q.oq, (SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = f.id) AS deps, (SELECT count(*) FROM e WHERE dst = f.id) AS refs,
        (SELECT count(*) FROM pl WHERE pl.feature = f.id) AS plans, 0 AS children, 0 AS proposals FROM f JOIN q ON q.feature = f.id""",
)
def feature_list(spark, docs, plan_docs):
    got = corpus.feature_list(
        docs, ["status", "oq", "deps", "refs", "plans", "children", "proposals"], edges=cut_lineage(extract.dependency_edges(docs)),
        plans=extract.plan_features(plan_docs),
    )
    return got.withColumn("deps", F.array_join("deps", ","))


@query(
    "search_related", "spec_docs", "plan_docs",
    sql=rf"""WITH {lines_sql('spec_docs')}, e AS ({EDGES_SQL}), {PLAN_LINKS},
      m AS (SELECT DISTINCT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS feature FROM spec_docs WHERE contains(lower(text), 'question'))
      SELECT src AS feature, 'dep' AS relation, dst AS other FROM e WHERE src IN (SELECT feature FROM m) UNION
      SELECT dst, 'reverse_dep', src FROM e WHERE dst IN (SELECT feature FROM m) UNION
      SELECT feature, 'plan', plan FROM pl WHERE feature IN (SELECT feature FROM m)""",
)
def search_related(spark, docs, plan_docs):
    found = search.search_specs(docs, "question")
    return search.related(found, extract.dependency_edges(docs), extract.plan_features(plan_docs))


# ---- lint ----

LINT_SPEC_RULES = ["readme-exists", "oq-section", "oq-not-empty", "heading-levels", "forward-refs"]
LINT_SPEC_SQL = rf"""{lines_sql('spec_docs')}, e AS ({EDGES_SQL}), oq AS (SELECT * FROM h WHERE level = 2 AND title = 'Outstanding Questions'),
lv AS (SELECT path, line, level, lag(level) OVER (PARTITION BY path ORDER BY line) AS prev FROM h0),
v AS (
  SELECT d AS file, 0 AS line, 'error' AS severity, 'readme-exists' AS rule, 'missing README.md' AS message FROM (
    SELECT DISTINCT regexp_extract(path, '^(spec/features/[^/]+)/', 1) AS d FROM spec_docs UNION SELECT 'spec/features')
  UNION ALL SELECT path, 0, 'error', 'oq-section', 'missing section Outstanding Questions' FROM spec_docs WHERE path NOT IN (SELECT path FROM oq)
  UNION ALL SELECT path, line, 'warning', 'oq-not-empty', 'empty section Outstanding Questions' FROM oq
    WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.path = oq.path AND it.line BETWEEN oq.line AND oq.end_line)
      AND NOT EXISTS (SELECT 1 FROM nn WHERE nn.path = oq.path AND nn.line BETWEEN oq.line AND oq.end_line)
  UNION ALL SELECT path, line, 'warning', 'heading-levels', 'heading level jumps from ' || prev || ' to ' || level FROM lv WHERE level > prev + 1
  UNION ALL SELECT 'spec/features/' || src || '/README.md', 0, 'warning', 'forward-refs', 'unknown feature: ' || dst FROM e
    WHERE 'spec/features/' || dst || '/README.md' NOT IN (SELECT path FROM spec_docs))"""


@query("lint_spec", "spec_docs", sql=f"WITH {LINT_SPEC_SQL} SELECT * FROM v")
def lint_spec(spark, docs):
    return lint.violations(lint.Corpus(docs, keep=True), rules=LINT_SPEC_RULES, severity="warning")


@query(
    "violation_summary", "spec_docs",
    sql=f"WITH {LINT_SPEC_SQL} SELECT severity, rule, count(*) AS violations, false AS passed FROM v GROUP BY ROLLUP (severity, rule)",
)
def violation_summary(spark, docs):
    return lint.violation_summary(lint.violations(lint.Corpus(docs, keep=True), rules=LINT_SPEC_RULES, severity="warning"))


@query(
    "lint_custom_rule", "spec_docs",
    sql="SELECT path AS file, 0 AS line, 'info' AS severity, 'long-document' AS rule, 'longer than 5000' AS message FROM spec_docs WHERE length(text) > 5000",
)
def lint_custom_rule(spark, docs):
    own: dict = {}
    lint.register_rule(
        "long-document", "info",
        lambda c: c.docs.filter(F.length("text") > 5000).select(
            F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("longer than 5000").alias("message")
        ),
        own,
    )
    return lint.violations(lint.Corpus(docs, keep=True), severity="info", known=own)


@query(
    "lint_index_entries", "wiki_docs",
    sql=r"""WITH d AS (SELECT path, regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id, text FROM wiki_docs WHERE path NOT LIKE '%/sub/%' AND path NOT LIKE '%/part/%'),
      s AS (SELECT replace(path, 'sub/README.md', 'README.md') AS path FROM wiki_docs WHERE path LIKE '%/sub/%'),
      x AS (SELECT path, id, text, path IN (SELECT path FROM s) AS has_sub, text LIKE '%- [sub](sub/README.md)%' AS lists_sub, text LIKE '%- [gone](gone/)%' AS lists_gone FROM d)
      SELECT path AS file, 3 AS line, 'error' AS severity, 'index-entries' AS rule, 'child not listed: ' || id || '/sub' AS message FROM x WHERE has_sub AND NOT lists_sub
      UNION ALL SELECT path, 3, 'error', 'index-entries', 'child not listed: ' || id || '/part' FROM x WHERE NOT has_sub
      UNION ALL SELECT path, 5, 'error', 'index-entries', 'listed child does not exist: ' || id || '/sub' FROM x WHERE lists_sub AND NOT has_sub
      UNION ALL SELECT path, CASE WHEN lists_sub THEN 6 ELSE 5 END, 'error', 'index-entries', 'listed child does not exist: ' || id || '/gone' FROM x WHERE lists_gone""",
)
def lint_index_entries(spark, docs):
    return lint.violations(lint.Corpus(docs, keep=True), rules=["index-entries"])


@query(
    "lint_internal_links", "wiki_docs",
    sql=rf"""WITH {links_sql('wiki_docs')}, r AS (SELECT *, CASE WHEN kind = 'anchor' THEN path
          WHEN target LIKE '../%' THEN regexp_extract(path, '^(.*)/[^/]+/[^/]+$', 1) || '/' || substr(target, 4)
          WHEN target = 'gone/' THEN replace(path, 'README.md', 'gone/README.md') ELSE replace(path, 'README.md', target) END AS doc FROM links WHERE kind <> 'external'),
        q AS (SELECT *, CASE WHEN doc LIKE '%//x' THEN replace(doc, '//x', '/x/README.md') ELSE doc END AS doc2 FROM r),
        a AS (SELECT DISTINCT path, lower(replace(title, ' ', '-')) AS slug FROM h0),
        c AS (SELECT q.path, line, target, anchor, doc2 IN (SELECT path FROM wiki_docs) AS has_doc, a.slug IS NOT NULL AS has_anchor
          FROM q LEFT JOIN a ON a.path = q.doc2 AND a.slug = lower(q.anchor))
      SELECT path AS file, line, 'error' AS severity, 'internal-links' AS rule, CASE WHEN NOT has_doc THEN 'link target not found: ' || target
        ELSE 'anchor not found: #' || anchor END AS message FROM c WHERE NOT has_doc OR (anchor IS NOT NULL AND NOT has_anchor)""",
)
def lint_internal_links(spark, docs):
    return lint.violations(lint.Corpus(docs, keep=True), rules=["internal-links"])


@query(
    "lint_feature_ref_syntax", "wiki_docs",
    sql=rf"""WITH {links_sql('wiki_docs')} SELECT path AS file, line, 'error' AS severity, 'feature-ref-syntax' AS rule,
      'malformed feature reference: ' || target AS message FROM links WHERE kind = 'internal' AND target LIKE '../%' AND (target LIKE '% %' OR target LIKE '%//%')""",
)
def lint_feature_ref_syntax(spark, docs):
    return lint.violations(lint.Corpus(docs, keep=True), rules=["feature-ref-syntax"])


@query(
    "lint_code_annotations", "source_files",
    sql="""SELECT path AS file, 0 AS line, 'warning' AS severity, 'code-annotations' AS rule, 'no feature annotations' AS message
      FROM source_files WHERE text NOT LIKE '%// Features implemented:%'""",
)
def lint_code_annotations(spark, src):
    return lint.violations(lint.Corpus(src, sources=src), rules=["code-annotations"], severity="warning")


# ---- search ----


def search_sql(terms: list[str], whole: str) -> str:
    every = " AND ".join(f"contains(lower(text), '{t}')" for t in terms)
    some = " OR ".join(f"contains(lower(t), '{t}')" for t in terms)
    all_here = " AND ".join(f"contains(lower(t), '{t}')" for t in terms)
    return rf"""{lines_sql('spec_docs')},
m AS (SELECT pr.path, pr.line, pr.t AS text, CASE WHEN h0.line IS NOT NULL AND {all_here} THEN 1 WHEN contains(lower(t), '{whole}') THEN 2 ELSE 3 END AS tier,
  (SELECT arg_max(x.title, x.line) FROM h0 x WHERE x.path = pr.path AND x.line <= pr.line) AS section
  FROM pr LEFT JOIN h0 USING (path, line) WHERE ({some}) AND pr.path IN (SELECT path FROM spec_docs WHERE {every})),
ctx AS (SELECT m.path, m.line, string_agg(x.line || ': ' || x.t, chr(10) ORDER BY x.line) AS context
  FROM m JOIN pr x ON x.path = m.path AND x.line BETWEEN m.line - 2 AND m.line + 2 GROUP BY ALL),
matches AS (SELECT m.*, context, regexp_extract(m.path, '^spec/features/(.+)/README\.md$', 1) AS feature,
  trim(regexp_extract(d.text, '\*\*Status:\*\* ([^\n]*)', 1)) AS status, 'feature' AS type
  FROM m JOIN ctx USING (path, line) JOIN spec_docs d ON d.path = m.path)"""


@query("search_terms", "spec_docs", sql=f"WITH {search_sql(['question', 'details'], 'question details')} SELECT * FROM matches")
def search_terms(spark, docs):
    return index_of(docs, "spec").search("Question details").withColumn("context", search.context_text())


@query(
    "search_scoped", "spec_docs",
    sql=f"""WITH {search_sql(['question'], 'question')} SELECT path, line, tier, section FROM matches
      WHERE section = 'Outstanding Questions' AND status = 'Stable' AND path LIKE 'spec/features/src1/%'""",
)
def search_scoped(spark, docs):
    got = index_of(docs, "spec").search("question", section="oq", status="Stable", type="feature", feature="src1")
    return got.select("path", "line", "tier", "section")


@query(
    "search_phrase_ranked", "spec_docs",
    sql=f"""WITH {search_sql(['feature 1'], 'feature 1')} SELECT path, line, tier, text, row_number() OVER (ORDER BY tier, path, line) AS rank FROM matches""",
)
def search_phrase_ranked(spark, docs):
    return search.ranked(index_of(docs, "spec").search("Feature 1", phrase=True).select("path", "line", "tier", "text"))


@query(
    "search_with_refs", "spec_docs",
    sql=rf"""WITH {search_sql(['question', 'details'], 'question details')}, e AS ({EDGES_SQL})
      SELECT feature, count(*) AS matches, count(DISTINCT path) AS files, min(tier) AS best_tier,
        (SELECT count(*) FROM e WHERE src = feature) AS deps, (SELECT count(*) FROM e WHERE dst = feature) AS reverse_deps, 0 AS plans
      FROM matches GROUP BY feature""",
)
def search_with_refs(spark, docs):
    index = index_of(docs, "spec")
    return search.search_with_refs(index.search("Question details"), index.edges())


@query(
    "search_index", "spec_docs",
    sql=rf"""WITH {lines_sql('spec_docs')}, w AS (SELECT unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS word FROM ln)
      SELECT (SELECT count(*) FROM spec_docs) AS documents, (SELECT count(*) FROM ln) AS lines, count(DISTINCT word) AS words, count(*) AS places FROM w""",
)
def search_index(spark, docs):
    return index_of(docs, "spec").sizes()


@query(
    "search_with_plans", "spec_docs", "plan_docs",
    sql=rf"""WITH {search_sql(['question', 'details'], 'question details')}, e AS ({EDGES_SQL}), {PLAN_LINKS}
      SELECT feature, count(*) AS matches, count(DISTINCT path) AS files, min(tier) AS best_tier,
        (SELECT count(*) FROM e WHERE src = feature) AS deps, (SELECT count(*) FROM e WHERE dst = feature) AS reverse_deps,
        (SELECT count(DISTINCT plan) FROM pl WHERE pl.feature = matches.feature) AS plans
      FROM matches GROUP BY feature""",
)
def search_with_plans(spark, docs, plan_docs):
    index = index_of(docs, "spec")
    return search.search_with_refs(index.search("Question details"), index.edges(), extract.plan_features(plan_docs))


@query(
    "search_plans", "spec_docs", "plan_docs",
    sql=r"""WITH f AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id, trim(regexp_extract(text, '\*\*Status:\*\* ([^
]*)', 1)) AS status FROM spec_docs),
      pl AS (SELECT path, unnest([regexp_extract(text, '\*\*Features:\*\* ([^,]*),', 1), 'src1/f1']) AS id FROM plan_docs),
      o AS (SELECT path, min(id) AS feature FROM pl JOIN f USING (id) GROUP BY path)
      SELECT d.path, 4 AS line, 2 AS tier, feature, status, 'plan' AS type FROM plan_docs d LEFT JOIN o USING (path) LEFT JOIN f ON f.id = o.feature WHERE contains(lower(text), '**effort:** xl')""",
)
def search_plans(spark, docs, plan_docs):
    more = docs.unionByName(plan_docs)
    found = index_of(more, "spec-plans").search("**Effort:** XL", phrase=True, plans=extract.plan_features(plan_docs))
    return found.select("path", "line", "tier", "feature", "status", "type")


@query(
    "feature_info", "wiki_docs", "plan_docs",
    sql=rf"""WITH {lines_sql('wiki_docs')}, {PLAN_LINKS}, d AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id, * FROM wiki_docs),
      c AS (SELECT p.id, string_agg(k.id || CASE WHEN k.id = p.id || '/sub' AND contains(p.text, '- [sub](sub/README.md)') THEN ':true' ELSE ':false' END, ';' ORDER BY k.id) AS children
        FROM d p JOIN d k ON k.id IN (p.id || '/sub', p.id || '/part') GROUP BY p.id),
      s AS (SELECT path, string_agg(title || ':' || line || '-' || end_line, ';' ORDER BY line) AS sections FROM h WHERE level > 1 GROUP BY path)
      SELECT d.id, coalesce(c.children, '') AS children, (SELECT string_agg(DISTINCT plan, ';' ORDER BY plan) FROM pl WHERE pl.feature = d.id) AS plans, s.sections
      FROM d LEFT JOIN c USING (id) LEFT JOIN s USING (path) WHERE d.id IN (SELECT feature FROM pl)""",
)
def feature_info(spark, docs, plan_docs):
    """Info of every feature that a plan references."""
    asked = extract.plan_features(plan_docs).select(F.col("feature").alias("id"))
    info = corpus.feature_info(docs, asked, plan_docs)
    text = lambda col, fn: F.array_join(F.transform(col, fn), ";")
    return info.select(
        "id", text("children", lambda c: F.concat(c["path"], F.lit(":"), c["in_readme"].cast("string"))).alias("children"), F.array_join("plans", ";").alias("plans"),
        text("sections", lambda x: F.concat(x["title"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))).alias("sections"),
    )


@query(
    "forward_refs", "wiki_docs",
    sql=r"""WITH d AS (SELECT regexp_extract(path, '^spec/features/(.+)/README\.md$', 1) AS id, * FROM wiki_docs),
      l AS (SELECT path, regexp_extract(id, '^(src[0-9]+)/', 1) || '/f' || regexp_extract(text, 'See \[home\]\(\.\./f([0-9]+)/README', 1) AS dst,
          len(string_split(split_part(text, 'See [home]', 1), chr(10))) AS line FROM d WHERE contains(text, 'See [home]') UNION ALL
        SELECT path, id || '/sub', len(string_split(split_part(text, '- [sub]', 1), chr(10))) FROM d WHERE contains(text, '- [sub](sub/README.md)') UNION ALL
        SELECT path, id || '/gone', len(string_split(split_part(text, '- [gone]', 1), chr(10))) FROM d WHERE contains(text, '- [gone](gone/)') UNION ALL
        SELECT path, regexp_extract(id, '^(src[0-9]+)/', 1) || '/F 1/x', len(string_split(split_part(text, 'Bad [ref]', 1), chr(10))) FROM d WHERE contains(text, 'Bad [ref]'))
      SELECT path AS file, CAST(line AS INT) AS line, 'warning' AS severity, 'forward-refs' AS rule, 'unknown feature: ' || dst AS message FROM l WHERE dst NOT IN (SELECT id FROM d)""",
)
def forward_refs(spark, docs):
    return lint.violations(lint.Corpus(docs, keep=True), rules=["forward-refs"], severity="warning")
