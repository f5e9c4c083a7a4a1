"""Registered queries of this subpackage: one per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coord.llm import conversation_repair, decontam, filter_audit, fingerprints, hamming_dedup, html_text, language, licenses, line_dedup, mixing, ngram_join, pii, toxicity
from coord.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def _license_sql() -> str:
    rows = []
    for k, (label, whole, at, key, base) in enumerate(licenses._templates()):
        lst = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
        rows.append(f"({k}, '{label}', {lst(whole)}, {at}, {lst(key)}, {str(base).lower()})")
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
t(k, label, whole, koff, key, base) AS (VALUES {', '.join(rows)}),
at_word AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
placed AS (
  SELECT w.r, t.label, t.base, a.i - t.koff AS start, t.whole, w.words
  FROM at_word a JOIN t ON a.word = t.key[1] JOIN w ON w.r = a.r
  WHERE list_slice(w.words, a.i + 1, a.i + len(t.key)) = t.key),
scored AS (
  SELECT r, label, base, start,
         len(list_filter(range(len(whole)), lambda j: start + j >= 0 AND start + j < len(words) AND words[start + j + 1] = whole[j + 1])) / CAST(len(whole) AS DOUBLE) AS share
  FROM placed),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM scored GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN found USING (r)"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


@query("op5_multiset_fingerprint")
def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, many.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN many USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_weighted_mix", r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS BIGINT) + 1] AS w, 2 * source_size AS cap, sum(source_size) OVER () * 1.5e0 AS budget FROM s),
g AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
f AS (SELECT *, (budget - used) * w >= cap * open AS is_full FROM g),
t AS (SELECT source, source_size, budget, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE (budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * w / sum(w) FILTER (NOT is_full) OVER () END AS target FROM f),
q AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS queued
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, copy, (queued + source_size * copy) / target AS finish FROM q, (VALUES (0), (1)) v(copy) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, copy, h, doc_id, size) AS so_far FROM c),
n AS (SELECT doc_id, source, h, count(*) AS copies FROM o WHERE so_far <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.source IS NOT DISTINCT FROM n.source""")
def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold within their error budgets."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.main_text(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every document."""
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), pii.all_spans().alias("spans")
    )


@query("op11_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes in every order, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_hamming_dedup")
def op13_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return hamming_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    def grown(state: str, cost: str, audit: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{audit}', 'r': {state}.r || {line}}} END"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    both = "chr(10) || 'user:' || chr(10) || 'assistant:'"
    kept = lambda state, initial: f"CASE WHEN i = '{initial}' AND NOT gone THEN {grown(state, 'late', 'K', 'chr(10) || role || chr(58) || text')} END"
    renamed = lambda state, role: f"CASE WHEN NOT gone THEN {grown(state, '2 + late', 'R', role + ' || text')} END"
    gone = lambda state: grown(state, "3", "D")
    return rf"""
WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
h AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
crc AS (
  SELECT h.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(s)), lambda k: CAST(ascii(s[k + 1]) AS BIGINT))),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM h, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM faulty),
step(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'r': ''}}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)),
         CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) FROM rows_
  UNION ALL
  SELECT conv_id, pos, {gone('p0')}, {least(gone('p1'), kept('p0', 's'))},
         {least(gone('p2'), *[f(p, x) for p in ('p0', 'p1', 'p3') for f, x in ((kept, 'u'), (renamed, user))])},
         {least(gone('p3'), kept('p2', 'a'), renamed('p2', assistant))}
  FROM (SELECT r.*, s0 AS p0, s1 AS p1, {least('s2', *[grown(x, '2', 'I', user) for x in ('s0', 's1', 's3')])} AS p2,
               {least('s3', grown('s2', '2', 'I', assistant), *[grown(x, '4', 'II', both) for x in ('s0', 's1')])} AS p3
        FROM step JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.pos = step.pos + 1)),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
best AS (
  SELECT sums.*, {least('s0', grown('s1', '4', 'II', both), grown('s2', '2', 'I', assistant), 's3')} AS b
  FROM sums JOIN step ON step.conv_id IS NOT DISTINCT FROM sums.conv_id AND step.pos = sums.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    convs = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(convs), convs)
