"""Small hand-made inputs with exact expected results."""

import pytest
from pyspark.sql import functions as F

from coord.functions import status as S
from coord.functions import text as X
from coord.operators import corpus, extract, graph, history, lint, ops, people, planning, search, tasks
from coord.sources import files

ALPHA = "# Alpha\n\n**Status:** Approved\n\n## Dependencies\n\n- beta\n\n## Outstanding Questions\n\n- Question 1\n- Question 2\n"
BETA = "# Beta\n\n**Status:** Draft\n\n## Outstanding Questions\n\nNone at this time.\n"
GAMMA = "# Gamma\n\n**Status:** Implemented\n\n## Dependencies\n\n- alpha\n\n## Outstanding Questions\n\n- Question 1\n"
CHILD = "# Alpha Child\n\n**Status:** Draft\n\n## Outstanding Questions\n\nNone at this time.\n"


def readme(feature):
    return f"spec/features/{feature}/README.md"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(readme("alpha"), ALPHA), (readme("beta"), BETA), (readme("gamma"), GAMMA), (readme("alpha/child"), CHILD)]
    return spark.createDataFrame(rows, "path string, text string").cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- corpus ----


def test_features_and_fields(docs):
    assert rows(corpus.features_of(docs)) == [
        ("alpha", "Approved"), ("alpha/child", "Draft"), ("beta", "Draft"), ("gamma", "Implemented"),
    ]
    oq = dict(corpus.open_question_counts(extract.sections(docs)).collect())
    assert oq == {"alpha": 2, "beta": 0, "gamma": 1, "alpha/child": 0}
    feats = corpus.features_of(docs).withColumnRenamed("id", "slug")
    with pytest.raises(ValueError, match="unknown field"):
        tasks.select_fields(feats, ["nope"], ["status"])
    assert tasks.select_fields(feats, ["status"], ["status", "oq"]).columns == ["slug", "status"]


def test_select_fields_joins_only_what_is_asked(docs):
    feats = corpus.features_of(docs)
    counts = corpus.open_question_counts(extract.sections(docs)).withColumnRenamed("feature", "id")
    enrich = {"oq": lambda df: df.join(counts, "id", "left")}
    plain = tasks.select_fields(feats, ["status"], ["status", "oq"], ["id"], enrich)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    full = tasks.select_fields(feats, ["oq", "status"], ["status", "oq"], ["id"], enrich)
    assert rows(full)[0] == ("alpha", 2, "Approved")


def test_feature_list(spark, docs):
    prop = spark.createDataFrame([("spec/features/alpha/proposals/p1/README.md", "# P\n")], docs.schema)
    got = corpus.feature_list(docs.unionByName(prop), ["oq", "deps", "refs", "children", "proposals", "status"])
    assert rows(got)[0] == ("alpha", 2, ["beta"], 1, 1, 1, "Approved") and len(rows(got)) == 4
    lean = corpus.feature_list(docs, ["status"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in lean and "Window" not in lean
    with pytest.raises(ValueError, match="unknown field"):
        corpus.feature_list(docs, ["size"])


def test_edges_closure_and_tree(spark, docs):
    edges = extract.dependency_edges(docs)
    assert rows(edges) == [("alpha", "beta"), ("gamma", "alpha")]
    gamma = spark.createDataFrame([("gamma",)], "root string")
    assert rows(graph.paths(edges, gamma).select("node", "depth", "cycle")) == [("alpha", 1, False), ("beta", 2, False)]
    beta = spark.createDataFrame([("beta",)], "root string")
    assert rows(graph.transitive_refs(edges, beta).select("node", "depth")) == [("alpha", 1), ("gamma", 2)]
    tree = graph.tree_lines(graph.focus_tree(corpus.features_of(docs)))
    assert [r["line"] for r in tree.collect()] == ["alpha", "  child", "beta", "gamma"]
    up = graph.focus_tree(corpus.features_of(docs), "alpha/child", "up")
    assert rows(up.select("id", "focus")) == [("alpha", False), ("alpha/child", True)]


def test_cycle_is_marked_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")], "src string, dst string")
    a = spark.createDataFrame([("a",)], "root string")
    tree = graph.paths(e, a)
    assert rows(tree.select("node", "depth", "cycle")) == [("a", 2, True), ("b", 1, False), ("c", 2, False)]
    assert rows(graph.simple_cycles(tree)) == [(["a", "b"],)]
    assert rows(graph.find_cycles(e)) == [("a", "b", "a"), ("b", "a", "a"), ("d", "d", "d")]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "node string")
    assert rows(graph.dependency_waves(nodes, e)) == [("a", None), ("b", None), ("c", 0), ("x", 0)]


def test_deep_chain_and_inverse(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    deps, refs = graph.transitive_deps(e), graph.transitive_refs(e)
    assert deps.count() == 30 * 31 // 2 and deps.agg(F.max("depth")).first()[0] == 30
    swapped = refs.select(F.col("node").alias("root"), F.col("root").alias("node"), "depth")
    assert rows(deps) == rows(swapped)


def test_sections_ignore_fences(spark):
    text = "# T\n```\n# no\n- no\n```\n## A\n- x\n1. y\n### B\n- z\n## C\nNone at this time."
    got = extract.sections(spark.createDataFrame([("d", text), ("e", "one line")], "path string, text string"))
    cols = ["title", "level", "start_line", "end_line", "parent_title", "items", "range_items", "range_nones"]
    assert rows(got.select(*cols)) == [
        ("A", 2, 6, 10, "T", 2, 3, 0), ("B", 3, 9, 10, "A", 1, 1, 0), ("C", 2, 11, 12, "T", 0, 0, 1), ("T", 1, 1, 12, None, 0, 3, 1),
    ]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert extract.sections(none).count() == 0
    assert lint.violations(lint.Corpus(none), severity="info").count() == 0
    assert search.search_specs(none, "x").count() == 0
    summary = lint.violation_summary(lint.violations(lint.Corpus(none)))
    assert rows(summary) == [(None, None, 0, True)]


# ---- search ----


def test_search_scopes_tiers_and_context(spark, docs):
    more = docs.unionByName(
        spark.createDataFrame([("spec/plans/p1/README.md", "# Plan\n\n**Features:** alpha, beta\n\nquestion about alpha\n")], docs.schema)
    )
    got = search.search_specs(more, "question", context=5)
    assert set(rows(got.select("path", "line", "tier", "type"))) == {
        (readme("alpha"), 9, 1, "feature"), (readme("alpha"), 11, 2, "feature"), (readme("alpha"), 12, 2, "feature"),
        (readme("alpha/child"), 5, 1, "feature"), (readme("beta"), 5, 1, "feature"),
        (readme("gamma"), 11, 2, "feature"), (readme("gamma"), 9, 1, "feature"), ("spec/plans/p1/README.md", 5, 2, "plan"),
    }
    last = got.filter("path LIKE '%alpha/README.md' AND line = 12").select(search.context_text().alias("c")).first()["c"]
    assert last.split("\n") == ["7: - beta", "8: ", "9: ## Outstanding Questions", "10: ", "11: - Question 1", "12: - Question 2"]
    assert search.search_specs(more, "question", section="oq", status="Approved").count() == 3
    assert search.search_specs(more, "question alpha", section="outstanding").count() == 0
    both = search.search_specs(more, "alpha beta")
    assert (readme("alpha"), 7, 3) in rows(both.select("path", "line", "tier"))
    assert search.search_specs(more, "Question 2", phrase=True).count() == 1
    with pytest.raises(ValueError):
        search.search_specs(more, "x", type="nope")
    edges, plans = extract.dependency_edges(more), extract.plan_features(more)
    summary = {r["feature"]: r for r in search.search_with_refs(got, edges, plans).collect()}
    assert (summary["alpha"]["deps"], summary["alpha"]["reverse_deps"], summary["alpha"]["plans"]) == (1, 1, 1)
    assert ("beta", "reverse_dep", "alpha") in rows(search.related(got, edges, plans))


# ---- lint ----


def test_lint_rules(spark):
    text = {
        "spec/features/README.md": "# Features\n",
        readme("a"): "# A\n\n## Contents\n\n- [b](b/)\n- [zz](zz/README.md)\n\n#### Deep\n\n## Dependencies\n\n- ghost\n\n## Outstanding Questions\n\n",
        readme("a/b"): "# B\n\nSee [a](../README.md#contents), [x](../../q/README.md), [y](#nope) and [z](../B c/).\n\n## Outstanding Questions\n\nNone at this time.\n",
        readme("a/c"): "# C\n",
        "spec/other/sub/note.md": "# N\n",
        "spec/.github/workflows/x.md": "# W\n",
    }
    docs = spark.createDataFrame(list(text.items()), "path string, text string")
    src = spark.createDataFrame([("m.go", "package m\n"), ("n.go", "// Features implemented: a\n")], "path string, text string")
    c = lint.Corpus(docs, src, keep=True)
    got = {(r["rule"], r["file"], r["message"]) for r in lint.violations(c, severity="warning").collect()}
    assert {(r, f) for r, f, _ in got if r == "readme-exists"} == {
        ("readme-exists", "spec/other"), ("readme-exists", "spec/other/sub"), ("readme-exists", "spec/.github/workflows"),
    }
    assert {f for r, f, _ in got if r == "oq-section"} == {readme("a/c")}
    assert {f for r, f, _ in got if r == "oq-not-empty"} == {readme("a")}
    assert {m for r, _, m in got if r == "index-entries"} == {"child not listed: a/c", "listed child does not exist: a/zz"}
    assert {m for r, _, m in got if r == "heading-levels"} == {"heading level jumps from 2 to 4"}
    assert {m for r, _, m in got if r == "feature-ref-syntax"} == {"malformed feature reference: ../B c/"}
    assert {m for r, _, m in got if r == "internal-links"} == {
        "link target not found: zz/README.md", "link target not found: ../../q/README.md", "anchor not found: #nope",
        "link target not found: ../B c/",
    }
    assert {m for r, _, m in got if r == "forward-refs"} == {
        "unknown feature: ghost", "unknown feature: a/zz", "unknown feature: q", "unknown feature: a/B c",  # the last three behind links
    }
    assert {f for r, f, _ in got if r == "code-annotations"} == {"m.go"}
    linked = spark.createDataFrame([
        (readme("a"), "# A\n\n[p](../../plans/p/README.md), [r](../../plans/r/), [b](b/README.md)\n\n## Dependencies\n\n- [b](../b/README.md)\n"), ("spec/plans/p/README.md", "# P\n\n**Features:** a, c\n\nAfter [q](../q/README.md).\n"),
    ], "path string, text string")
    refs = lint.violations(lint.Corpus(linked, keep=True), rules=["forward-refs"], severity="warning")
    assert {(r["file"], r["line"], r["message"]) for r in refs.collect()} == {
        (readme("a"), 3, "unknown plan: r"), (readme("a"), 3, "unknown feature: a/b"), (readme("a"), 0, "unknown feature: b"),
        ("spec/plans/p/README.md", 0, "unknown feature: c"), ("spec/plans/p/README.md", 5, "unknown plan: q"),
    }
    only = lint.violations(lint.Corpus(docs), rules=["oq-section"])
    assert only.count() == 1
    assert not lint.violations(lint.Corpus(docs), ignore=["oq-section"]).filter("rule = 'oq-section'").count()
    for bad in ({"rules": ["x"]}, {"severity": "fatal"}, {"rules": ["oq-section"], "ignore": ["oq-section"]}):
        with pytest.raises(ValueError):
            lint.violations(lint.Corpus(docs), **bad)


# ---- boards and task documents ----

BOARD = (
    "# Tasks\n\n| Task | Status | Depends on | Branch | Agent | Requester | Time |\n|---|---|---|---|---|---|---|\n"
    "| [a](a/) | 📋 `planning` | — | — | — | — | — |\n"
    "| [b](b/) | ❌ `failed` | a | `br-1` | GPT-5 | @bob | 2026-01-01 10:00 (4m32s) |\n"
    "| [c](c/) | 🟡 `blocked` | a, b | — | — | @carol | — |\n"
    "| d | 🔵 `unknown_status` | — | — | — | — | — |\n| e | no backticks | — | — | — | — | — |\n| f | ✅&nbsp;`complete` | — |\n"
)


def test_board_round_trip(spark):
    got = files.ingest_boards(spark.createDataFrame([("t/README.md", BOARD)], "path string, text string"))
    assert rows(got.select("ordinal", "slug", "status", "depends_on", "branch", "error")) == [
        (0, "a", "planning", [], None, None), (1, "b", "failed", ["a"], "br-1", None), (2, "c", "blocked", ["a", "b"], None, None),
        (3, "d", None, [], None, "unknown status unknown_status"), (4, "e", None, [], None, "status without backticks"),
        (5, "f", "completed", [], None, "expected 7 cells, got 3"),
    ]
    assert got.filter("slug = 'b'").first()["duration_s"] == 272
    good = got.filter("error IS NULL").withColumn("section", F.when(S.is_terminal(F.col("status")), "recently_finished").otherwise("active"))
    lines = files.render_boards(good)
    text = "\n".join(r["line"] for r in lines.orderBy("section_no", "ordinal").collect())
    assert "| [c](c/) | 🟡 `blocked` | a, b | — | — | @carol | — |" in text and "### Recently Finished" in text
    again = files.ingest_boards(spark.createDataFrame([("t/README.md", text)], "path string, text string"))
    keep = ["slug", "status", "depends_on", "branch", "agent", "requester", "time"]
    assert rows(again.select(*keep)) == rows(good.select(*keep))


@pytest.mark.parametrize(
    "status,emoji",
    [("planning", "📋"), ("queued", "⏳"), ("claimed", "🔒"), ("in_progress", "🔵"), ("completed", "✅"), ("failed", "❌"), ("blocked", "🟡"), ("aborted", "⛔")],
)
def test_status_signs(spark, status, emoji):
    row = spark.range(1).select(S.emoji(F.lit(status)), S.canonical_status(F.lit(status.upper()))).first()
    assert tuple(row) == (emoji, status)


def test_task_documents(spark):
    full = "# Implement API endpoints\n\nFirst paragraph.\n\nSecond.\n\n## Dependencies\n\n- setup-db\n- define-schema\n\n## Summary\n\nSome summary text\n"
    none = "# My Task\n\nSome description.\n\n## Dependencies\n\nNone\n\n## Summary\n\nNone\n"
    bad = [none.replace("# My Task", "No title"), none.replace("## Dependencies", "## Other"), none.replace("## Summary", "## Other")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([full, none, *bad])], "path string, text string")
    got = rows(files.ingest_task_docs(df))
    assert got[0] == ("0", "Implement API endpoints", "First paragraph.\n\nSecond.", ["setup-db", "define-schema"], "Some summary text", None)
    assert got[1] == ("1", "My Task", "Some description.", [], "", None)
    assert [g[5] for g in got[2:]] == ["missing title", "missing Dependencies section", "missing Summary section"]


def test_rebuild_board_and_duplicates(spark):
    docs = spark.createDataFrame([("a", []), ("b", ["a"])], "slug string, depends_on array<string>")
    board = spark.createDataFrame([("a", "completed", ["z"], "br"), ("gone", "queued", [], None)], "slug string, status string, depends_on array<string>, branch string")
    assert rows(tasks.rebuild_board(docs, board)) == [("a", "completed", ["z"], "br"), ("b", "planning", ["a"], None)]
    assert rows(tasks.rebuild_board(docs, board.filter("false"))) == [("a", "planning", [], None), ("b", "planning", ["a"], None)]
    dup = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "slug string, ordinal int")
    assert rows(tasks.unique_slugs(dup)) == [("a", 1, False), ("a", 5, True), ("b", 2, False)]


def test_files_and_sinks(spark, tmp_path):
    for f, t in {"alpha": ALPHA, "alpha/child": CHILD}.items():
        p = tmp_path / "spec/features" / f
        p.mkdir(parents=True, exist_ok=True)
        (p / "README.md").write_text(t)
    (tmp_path / "a.go").write_text("// spec:feature/alpha\n")
    docs = files.scan_spec_corpus(spark, str(tmp_path))
    assert rows(files.discover_features(docs)) == [("alpha",), ("alpha/child",)]
    assert rows(docs)[0] == (readme("alpha"), ALPHA)
    assert rows(files.scan_source_tree(spark, str(tmp_path), "*.go")) == [("a.go", "// spec:feature/alpha\n")]
    with pytest.raises(ValueError):
        files.scan_source_tree(spark, str(tmp_path), "[bad")
    (tmp_path / "events.json").write_text('{"type":"status_change","task_id":"t","seq":1,"from":"queued","to":"claimed","at":"2024-01-15T14:00:00Z","by":"a","data":{"k":1}}\n')
    ev = files.read_event_log(spark, str(tmp_path / "events.json"))
    assert ev.selectExpr("type", "to", "variant_get(data, '$.k', 'int') k").first() == ("status_change", "claimed", 1)
    chat = tmp_path / "chats/c1"
    chat.mkdir(parents=True)
    (chat / "history.jsonl").write_text('{"role":"user","content":"hi","timestamp":"2024-01-15T14:00:00Z"}\n')
    assert rows(files.read_chat_history(spark, str(tmp_path / "chats")).select("chat_id", "role", "content")) == [("c1", "user", "hi")]
    t = spark.createDataFrame([("a", "queued", ["x", "y"]), ("b", "failed", [])], "slug string, status string, depends_on array<string>")
    for fmt in ("csv", "json", "md"):
        files.write_task_list(t, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == files.CSV_HEADER
    md = [r[0] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert "| a | queued |  |  |  |  |" in md and "| Path | Status | Title | Run | Model | Updated |" in md
    board = files.ingest_boards(spark.createDataFrame([("t", BOARD)], "path string, text string")).filter("error IS NULL")
    files.write_boards(files.render_boards(board.withColumn("section", F.lit("active"))), str(tmp_path / "boards"))
    assert spark.read.text(str(tmp_path / "boards")).count() == 7


# ---- references ----


def test_source_refs(spark):
    data = {
        "file1.go": "// spec:feature/cli/code/deps\n// spec:plan/v2\n// spec:plan/v2\n", "file2.py": "# https://spec.example/doc/api\n",
        "file3.go": "// just a comment\nx := \"spec:feature/no\"\n", "file4.go": "// spec:feature/x@github.com/acme/repo\n",
    }
    src = spark.createDataFrame(list(data.items()), "path string, text string")
    assert rows(extract.source_refs(src)) == [
        ("file1.go", "feature", "spec/features/cli/code/deps", None), ("file1.go", "plan", "spec/plans/v2", None),
        ("file2.py", "doc", "docs/api", None), ("file4.go", "feature", "spec/features/x", "github.com/acme/repo"),
    ]
    assert extract.source_refs(src, kind="plan").count() == 1
    with pytest.raises(ValueError):
        extract.source_refs(src, kind="nope")
    feats = spark.createDataFrame([("cli/code/deps",), ("lonely",)], "id string")
    assert set(rows(corpus.code_spec_trace(extract.source_refs(src), feats))) == {
        (None, "lonely", "unreferenced"), ("file1.go", "cli/code/deps", "ok"), ("file4.go", "x@github.com/acme/repo", "external"),
    }


@pytest.mark.parametrize(
    "raw,want",
    [
        ("github.com/org/repo", ("github.com", "org", "repo")), ("https://github.com/org/repo", ("github.com", "org", "repo")),
        ("https://github.com/org/repo.git", ("github.com", "org", "repo")), ("git@github.com:org/repo.git", ("github.com", "org", "repo")),
        (" https://github.com/org/repo/ ", ("github.com", "org", "repo")), ("", (None, None, None)), ("org/repo", (None, None, None)),
        ("https://github.com/a/b/c", (None, None, None)), ("git@github.com", (None, None, None)), ("https://github.com/org", (None, None, None)),
    ],
)
def test_repo_ref(spark, raw, want):
    assert tuple(spark.range(1).select(X.repo_ref(F.lit(raw)).alias("r")).first()["r"]) == want


@pytest.mark.parametrize("raw,want", [("5m", 300), ("4m32s", 272), ("1h", 3600), ("2d1s", 172801), ("x", None), ("", None), ("35m", 2100)])
def test_duration(spark, raw, want):
    assert spark.range(1).select(X.duration_seconds(F.lit(raw))).first()[0] == want


def test_sync_policy_and_paths(spark):
    r = spark.range(1).select(
        X.sync_policy(F.lit("on_interval=5m")).alias("a"), X.sync_policy(F.lit("manual")).alias("b"),
        X.normal_path(F.lit("a/b/../c/./d")).alias("p"), X.normal_path(F.lit("../x")).alias("q"), X.heading_slug(F.lit("What's New? (v2)")).alias("h"),
    ).first()
    assert tuple(r["a"]) == ("on_interval", 300) and tuple(r["b"]) == ("manual", None)
    assert (r["p"], r["q"], r["h"]) == ("a/c/d", None, "whats-new-v2")


def test_task_refs(spark):
    t = spark.createDataFrame([("task-1/sub-1",), ("task-1/sub-2",), ("top",)], "path string")
    refs = spark.createDataFrame(
        [("task-1/sub-2", "sub-1"), ("task-2/x", "task-1/sub-1"), ("top", "nope"), ("top", "https://git.example/o/r/t"), ("top", "top")], "path string, ref string"
    )
    got = {(r["path"], r["ref"]): (r["kind"], r["target"], r["resolved"]) for r in tasks.resolve_task_refs(refs, t).collect()}
    assert got["task-1/sub-2", "sub-1"] == ("sibling", "task-1/sub-1", True)
    assert got["task-2/x", "task-1/sub-1"] == ("path", "task-1/sub-1", True)
    assert got["top", "nope"] == ("sibling", "nope", False)
    assert got["top", "https://git.example/o/r/t"][0::2] == ("external", None)


# ---- tasks ----


def test_transitions_and_final_row(spark):
    seq = ["create", "enqueue", "claim", "start", "block", "unblock", "request_abort", "complete", "fail"]
    data = [("t", i, f"2024-01-01 00:00:{i:02d}", c, "r1", "ag", "why" if c == "block" else None, "done" if c == "complete" else None) for i, c in enumerate(seq)]
    data += [("ghost", 0, "2024-01-01 00:00:00", "claim", "r", "ag", None, None)]
    df = spark.createDataFrame(data, "slug string, seq int, ts string, cmd string, run string, by_agent string, reason string, summary string")
    folded = history.fold(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), history.CREATED_TASKS)
    assert dict(rows(folded.filter("slug = 't'").select("cmd", "outcome")))["fail"] == "invalid_transition"
    assert rows(folded.filter("slug = 'ghost'").select("outcome", "to_status")) == [("not_found", "absent")]
    row = history.task_states(folded, "absent").filter("slug = 't'").first()
    assert (row["status"], row["branch"], row["agent"], row["reason"], row["summary"], row["abort_requested"]) == ("completed", "agent/r1", "ag", None, "done", True)


def test_exactly_one_claim_wins(spark):
    t = spark.createDataFrame([("q", "queued"), ("d", "completed"), ("w", "queued"), ("dep", "queued")], "slug string, status string")
    d = spark.createDataFrame([("w", "dep")], "slug string, dep string")
    reqs = spark.createDataFrame([("q", 1, i) for i in range(500)] + [("d", 1, 1), ("w", 1, 1), ("no", 1, 1)], "slug string, ts int, seq int")
    got = history.arbitrate_claims(reqs, t, d)
    assert rows(got.groupBy("slug", "outcome").count()) == [
        ("d", "invalid_transition", 1), ("no", "not_found", 1), ("q", "conflict", 499), ("q", "ok", 1), ("w", "invalid_transition", 1),
    ]
    assert got.filter("outcome = 'ok'").first()["seq"] == 0
    assert history.arbitrate_claims(reqs, t, d, enforce_deps=False).filter("slug = 'w' AND outcome = 'ok'").count() == 1


def test_plan_progress(spark):
    pt = spark.createDataFrame([("p", 1, "t1"), ("p", 2, "t2"), ("p", 3, "t3"), ("p", 4, "none")], "plan string, plan_task int, task string")
    t = spark.createDataFrame(
        [("t1", "completed"), ("t2", "in_progress"), ("t2a", "completed"), ("t2b", "queued"), ("t3", "queued"), ("tx", "in_progress")], "slug string, status string"
    )
    sub = spark.createDataFrame([("t2a", "t2"), ("t2b", "t2")], "slug string, parent string")
    got = rows(tasks.plan_progress(pt, t, sub).select("plan_task", "task", "status", "unplanned"))
    assert got == [
        (1, None, "completed", False), (2, None, "in_progress", False), (3, None, "queued", False), (4, None, "not_started", False),
        (None, "tx", "in_progress", True),
    ]


def test_plan_progress_counts_sub_tasks_at_every_depth(spark):
    pt = spark.createDataFrame([("p", 1, "a"), ("p", 2, "z")], "plan string, plan_task int, task string")
    t = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "completed"), ("d", "failed"), ("z", "completed"), ("u", "queued")], "slug string, status string")
    sub = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("b", "c"), ("u", None)], "slug string, parent string")
    got = rows(tasks.plan_progress(pt, t, sub).select("plan_task", "task", "status", "done", "linked"))
    assert got == [(1, None, "failed", 3, 4), (2, None, "completed", 1, 1), (None, "u", "queued", 0, 1)]


def test_paging_covers_everything(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    seen, cursor = [], None
    while True:
        page = tasks.page_after(df, "k", cursor, 20).collect()
        seen += [r["k"] for r in page]
        if not page[0]["has_more"]:
            break
        cursor = page[0]["next_cursor"]
    assert sorted(seen) == list(range(45))
    with pytest.raises(ValueError):
        tasks.page_after(df, "k", None, 101)


def test_board_retention(spark):
    t = spark.createDataFrame(
        [("b", f"t{i}", "completed" if i else "queued", f"2024-01-{i + 1:02d} 00:00:00") for i in range(15)], "board string, slug string, status string, u string"
    ).withColumn("updated_at", F.col("u").cast("timestamp_ntz"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    count = lambda df: dict(df.groupBy("section").count().collect())
    assert count(history.split_board(t, now)) == {"active": 1, "recently_finished": 10}
    assert count(history.split_board(t, now, limit=None, hours=48)) == {"active": 1, "recently_finished": 2}
    assert count(history.split_board(t, now, limit=1, hours=48)) == {"active": 1, "recently_finished": 1}


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("d", 4)], "k string, v int")
    assert rows(corpus.snapshot_diff(a, b, ["k"])) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert corpus.snapshot_diff(a, a, ["k"]).count() == 0


# ---- people ----


def test_roles(spark):
    feats = spark.createDataFrame([("cli",), ("cli/task",), ("cli/task/claim",), ("api/auth/permissions",), ("api/auth",)], "id string")
    ov = spark.createDataFrame(
        [("", "r", "add", "agent-x:model=opus"), ("", "r", "add", "alex@github"), ("cli", "r", "add", "bob@github"), ("cli", "r", "remove", "agent-x"),
         ("api/auth", "r", "add", "carol"), ("api/auth/permissions", "r", "remove", "agent-x"), ("api/auth/permissions", "r", "add", "dana"),
         ("api/auth/permissions", "r", "remove", "nobody")],
        "scope string, role string, op string, stakeholder string",
    )
    got = people.resolve_roles(feats, ov)
    who = lambda f: {r["stakeholder"] for r in got.filter(F.col("feature") == f).collect()}
    assert who("cli/task/claim") == {"alex@github", "bob@github"}
    assert who("api/auth/permissions") == {"alex@github", "carol", "dana"}
    gates = spark.createDataFrame([("g", "cli", "r"), ("g", "cli", "r")], "gate string, feature string, role string")
    assert people.combine_role_sets(gates, got).count() == 2


@pytest.mark.parametrize(
    "policy,min_n,votes,want",
    [
        ("min", 2, [("a", "jwt"), ("b", "jwt")], ("jwt", 2)), ("any", None, [("a", "x")], ("x", 1)), ("min", 2, [("a", "jwt"), ("b", "opaque")], ("mixed", 2)),
        ("all", None, [("a", "x"), ("b", "x")], ("pending", None)), ("all", None, [("a", "x"), ("b", "x"), ("c", "x")], ("x", 3)),
        ("majority", None, [("a", "x"), ("b", "x")], ("x", 2)), ("min", 4, [("a", "x")], ("invalid", None)), ("any", None, [], ("pending", None)),
        ("min", 2, [("a", "x"), ("a:tz=UTC", "y")], ("pending", None)), ("min", 2, [("a", "x"), ("z", "x")], ("pending", None)),
        ("min", 2, [("a", "x"), ("b", "custom")], ("mixed", 2)), ("any", None, [("a", "custom")], ("mixed", 1)),
    ],
)
def test_decision_policies(spark, policy, min_n, votes, want):
    d = spark.createDataFrame([("d", policy, min_n)], "decision string, policy string, min_n int")
    a = spark.createDataFrame([("d", p) for p in ("a", "a:tz=UTC", "b", "c:model=m")], "decision string, stakeholder string")
    v = spark.createDataFrame([("d", w, r, i + 1, i) for i, (w, r) in enumerate(votes)], "decision string, stakeholder string, response string, ts int, seq int")
    got = people.tally_decisions(d, a, v).first()
    assert (got["outcome"], got["resolved_at"]) == want and got["assigned"] == 3


def test_micro_tasks_models_questions(spark):
    t = spark.createDataFrame([("t1", "m1", "p1"), ("t2", "m2", "p1")], "task string, module string, project string")
    c = spark.createDataFrame(
        [("global", "", "pre", "g"), ("module", "m1", "pre", "m"), ("task", "t1", "pre", "x"), ("task", "t1", "pre", "y"), ("project", "p1", "post", "p")],
        "level string, scope string, phase string, name string",
    )
    assert rows(people.effective_micro_tasks(t, c).select("task", "phase", "name")) == [
        ("t1", "post", "p"), ("t1", "pre", "x"), ("t1", "pre", "y"), ("t2", "post", "p"), ("t2", "pre", "g"),
    ]
    q = spark.createDataFrame([(1, "open", "a"), (2, "linked", "a"), (3, "resolved", "a"), (4, "open", None), (5, "linked", "b")], "id int, status string, linked_task string")
    s = spark.createDataFrame([("a", "completed"), ("b", "queued")], "slug string, status string")
    assert [r["id"] for r in people.resolvable_questions(q, s).orderBy("id").collect()] == [1, 2]


# ---- plans and operations ----


def test_roadmaps_and_estimates(spark):
    p = spark.createDataFrame(
        [("r1", "approved", False), ("r1", "in_review", False), ("r2", "approved", False), ("r3", "draft", True), ("r4", "draft", False), ("r5", "approved", True)],
        "roadmap string, status string, active boolean",
    )
    sup = spark.createDataFrame([("r5",)], "roadmap string")
    assert rows(planning.roadmap_status(p, sup).select("roadmap", "status")) == [
        ("r1", "in_review"), ("r2", "approved"), ("r3", "in_progress"), ("r4", "draft"), ("r5", "superseded"),
    ]
    plans = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", None)], "plan string, effort string")
    steps = spark.createDataFrame([("a", i) for i in range(12)] + [("b", 1)], "plan string, step int")
    assert rows(planning.plan_estimate_check(plans, steps).select("plan", "inferred", "mismatch")) == [("a", "XL", True), ("b", "S", False), ("c", "S", False)]


def test_containers(spark):
    c = spark.createDataFrame(
        [(1, "paused", "2024-01-01 00:00:00", 0), (2, "stopped", None, 0), (3, "paused", "2023-01-01 00:00:00", 0), (4, "paused", "2022-01-01 00:00:00", 1), (5, "running", "2024-01-30 23:00:00", 0)],
        "project_id int, container_status string, i string, active_sessions int",
    ).withColumn("idle_since", F.col("i").cast("timestamp_ntz"))
    assert [r["project_id"] for r in ops.eviction_candidates(c).collect()] == [3, 1, 2]
    assert [r["project_id"] for r in ops.eviction_candidates(c, 1).collect()] == [3]
    act = dict(rows(ops.idle_and_retention(c, F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).select("project_id", "action")))
    assert act == {1: "stop", 2: "keep", 3: "stop", 4: "stop", 5: "pause"}


def test_spans_with_cycle_and_orphan(spark):
    s = spark.createDataFrame([("t", 1, None), ("t", 2, 1), ("t", 3, 2), ("t", 4, 99), ("t", 5, 6), ("t", 6, 5)], "trace_id string, span_id int, parent_id int")
    assert rows(ops.span_depths(s)) == [("t", 1, False, 0), ("t", 2, False, 1), ("t", 3, False, 2), ("t", 4, True, 0), ("t", 5, False, None), ("t", 6, False, None)]


def test_ac_coverage(spark):
    s = spark.createDataFrame([("s1", "f", "*"), ("s1", "f", "a"), ("s2", "f", "a"), ("s2", "f", "zz"), ("s3", "g", "*")], "scenario string, feature string, ac string")
    c = spark.createDataFrame([("f", "a"), ("f", "b"), ("h", "q")], "feature string, ac string")
    assert rows(corpus.ac_coverage(s, c)) == [("f", "a", 2, "covered"), ("f", "b", 1, "covered"), ("f", "zz", 1, "unknown"), ("h", "q", 0, "uncovered")]


def test_guarded_updates(spark):
    cur = spark.createDataFrame([("a", "queued", 5)], "slug string, status string, updated_at int")
    up = spark.createDataFrame(
        [("a", 1, 1, "claimed", None), ("a", 2, 2, "queued", 5), ("a", 3, 3, "queued", None), ("a", 4, 4, None, None), ("a", 5, 5, None, 4), ("z", 1, 1, None, None)],
        "slug string, ts int, seq int, expected_status string, expected_updated_at int",
    )
    got = history.guard_updates(up, cur).select("slug", "seq", "outcome")
    assert rows(got) == [
        ("a", 1, "conflict"), ("a", 2, "ok"), ("a", 3, "conflict"), ("a", 4, "ok"), ("a", 5, "conflict"), ("z", 1, "not_found"),
    ]


def test_options(spark):
    req = spark.createDataFrame([("e", float(i)) for i in range(1001)], "endpoint string, latency double")
    approx, exact = (ops.latency_percentiles(req, ["endpoint"], exact=e).first() for e in (False, True))
    assert tuple(exact)[1:] == (1001, 500.0, 950.0, 990.0) and abs(approx["p99"] - exact["p99"]) <= 1
    plans = spark.createDataFrame([("a", "S")], "plan string, effort string")
    steps, depth = spark.createDataFrame([("a", 1)], "plan string, step int"), spark.createDataFrame([("a", 9)], "plan string, depth int")
    assert planning.plan_estimate_check(plans, steps, depth).first()["inferred"] == "M"
    q = spark.createDataFrame(
        [(1, "d", "resolved", "2024-01-30 00:00:00"), (2, "d", "resolved", "2024-01-01 00:00:00"), (3, "d", "open", None)], "id int, doc string, status string, r string"
    ).withColumn("resolved_at", F.col("r").cast("timestamp_ntz"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    assert [r["id"] for r in people.recently_resolved(q, now, limit=None, days=7).collect()] == [1]
    assert sorted(r["id"] for r in people.recently_resolved(q, now, limit=3).collect()) == [1, 2]


def test_snapshot_diff_sees_values_moving_between_columns(spark):
    from coord.operators.corpus import snapshot_diff

    schema = "id int, reason string, summary string"
    old, new = spark.createDataFrame([(1, "x", None), (2, "y", None)], schema), spark.createDataFrame([(1, None, "x"), (2, "y", None)], schema)
    assert [tuple(r) for r in snapshot_diff(old, new, ["id"]).collect()] == [(1, "changed")]


def test_bad_policies_are_invalid(spark):
    from coord.operators.people import tally_decisions

    decisions = spark.createDataFrame([("a", "min", None), ("b", "min", 0), ("c", "bogus", None), ("d", None, None)], "decision string, policy string, min_n int")
    assigned = spark.createDataFrame([(d, "ann@x") for d in "abcd"], "decision string, stakeholder string")
    responses = spark.createDataFrame([(d, "ann@x", "yes", i, i) for i, d in enumerate("abcd")], "decision string, stakeholder string, response string, ts int, seq int")
    got = {r.decision: r.outcome for r in tally_decisions(decisions, assigned, responses).collect()}
    assert got == {"a": "invalid", "b": "invalid", "c": "invalid", "d": "yes"}


def test_long_chain_and_null_keyed_quantiles(spark):
    from coord.operators import graph
    from coord.operators.ordered import exact_quantiles

    chain = spark.createDataFrame([(i, i + 1) for i in range(24)], "src int, dst int")
    got = graph.reach(chain, spark.createDataFrame([(0,)], "root int"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(i, i) for i in range(1, 25)]
    values = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", 5.0)], "g string, v double")
    assert {r.g: (r.samples, r.p50) for r in exact_quantiles(values, ["g"], "v", {"p50": 0.5}).collect()} == {None: (2, 2.0), "k": (1, 5.0)}


def test_paths_with_plus_signs_and_slugs_with_umlauts(spark, tmp_path):
    from pyspark.sql import functions as F

    from coord.functions.text import heading_slug
    from coord.sources.files import scan_spec_corpus

    (tmp_path / "a.b" / "x+y z").mkdir(parents=True)
    (tmp_path / "a.b" / "x+y z" / "README.md").write_text("# T\n")
    assert [r.path for r in scan_spec_corpus(spark, str(tmp_path / "a.b")).collect()] == ["x+y z/README.md"]
    assert spark.range(1).select(heading_slug(F.lit("Größe & Maß"))).first()[0] == "größe--maß"


def test_fences_close_with_their_own_sign(spark):
    text = "\n".join([
        "# A", "````", "```", "# inner", "```", "````", "~~~ text", "```", "# also inner", "~~~", "# B", "``` x ``` # C", "## C",
        "```", "~~~", "# no", "``` not closed", "# neither",
    ])
    docs = spark.createDataFrame([("p", text), ("q", "~~~\n# in"), ("r", "# out\n```\n```\n# out 2")], "path string, text string")
    got = extract.sections(docs).orderBy("path", "start_line").collect()
    assert [(r["path"], r["title"]) for r in got] == [("p", "A"), ("p", "B"), ("p", "C"), ("r", "out"), ("r", "out 2")]


def test_feature_info(spark):
    text = {
        readme("a"): "# A\n\n**Status:** Stable\n\n## Contents\n\n- [b](b/README.md)\n\n## Dependencies\n\n- c\n- d\n\n### Notes\n\ntext\n",
        readme("a/b"): "# B\n", readme("a/c"): "# C\n", readme("a/b/deep"): "# Deep\n", readme("c"): "# C\n\n## Dependencies\n\n- a\n",
    }
    docs = spark.createDataFrame(list(text.items()), "path string, text string")
    plans = spark.createDataFrame([("spec/plans/p/README.md", "# P\n\n**Features:** a\n")], "path string, text string")
    asked = spark.createDataFrame([("a",), ("a/b",), ("none",)], "id string")
    got = {r.id: r for r in corpus.feature_info(docs, asked, plans).collect()}
    assert set(got) == {"a", "a/b"}
    a = got["a"]
    assert (a.status, a.deps, a.refs, a.plans) == ("Stable", ["c", "d"], ["c"], ["p"])
    assert [tuple(c) for c in a.children] == [("a/b", True), ("a/c", False)]
    assert [(x.title, x.start, x.end, x.parent, x["items"]) for x in a.sections] == [("Contents", 5, 8, 1, 1), ("Dependencies", 9, 16, 1, 2), ("Notes", 14, 16, 9, None)]
    assert [tuple(c) for c in got["a/b"].children] == [("a/b/deep", False)] and got["a/b"].sections == []


def test_task_context_asked(spark):
    t = spark.createDataFrame([("a", "queued", None), ("b", "completed", None), ("c", "queued", None), ("d", "queued", None)], "slug string, status string, parent string")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "zz")], "slug string, dep string")
    plan_tasks = spark.createDataFrame([("p", "a")], "plan string, task string")
    feats = spark.createDataFrame([("f", "Stable")], "id string, status string")
    links = spark.createDataFrame([("p", "g"), ("p", "f")], "plan string, feature string")
    asked = spark.createDataFrame([("a",), ("d",)], "slug string")
    got = tasks.task_context(t, deps, plan_tasks, feats, asked, links).select("slug", "deps", "all_deps", "all_deps_completed", "plan", "feature", "feature_status")
    assert rows(got) == [("a", 2, 4, 1, "p", "f", "Stable"), ("d", 0, 0, 0, None, None, None)]
