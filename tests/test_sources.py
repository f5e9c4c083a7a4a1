"""Path globs, open payloads and streamed logs."""

import json

import pytest
from pyspark.sql import functions as F

from coord.operators import people, skew
from coord.session import cut_lineage
from coord.sources import files
from coord.streaming.io import run_available


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in ("pkg/a.go", "pkg/cli/b.go", "pkg/cli/deep/c.go", "pkg/cli/b.md", "other/d.go", "other/x1.go", "other/x2.go", "top.go", "a+b/e f.go"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    return root


GLOBS = {
    "**/*": None, "pkg/**/*.go": {"pkg/a.go", "pkg/cli/b.go", "pkg/cli/deep/c.go"}, "*.md": {"pkg/cli/b.md"}, "pkg/*.go": {"pkg/a.go"}, "pkg/*/*.go": {"pkg/cli/b.go"},
    "{pkg/cli,other}/*.go": {"pkg/cli/b.go", "other/d.go", "other/x1.go", "other/x2.go"}, "other/x[1-1].go": {"other/x1.go"}, "other/[!x]*.go": {"other/d.go"}, "pkg/**": {"pkg/a.go", "pkg/cli/b.go", "pkg/cli/deep/c.go", "pkg/cli/b.md"},
    "top.go": {"top.go"}, "pkg/a.go": {"pkg/a.go"}, "none/**/*.go": set(), "{a,b}.go": {"pkg/a.go", "pkg/cli/b.go"}, "?/*.go": set(), "a+b/e *.go": {"a+b/e f.go"}, "**/cli/*.{go,md}": {"pkg/cli/b.go", "pkg/cli/b.md"},
}


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(spark, tree, glob):
    got = {r.path: r.text for r in files.scan_source_tree(spark, str(tree), glob).collect()}
    want = GLOBS[glob] if GLOBS[glob] is not None else {str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file()}
    assert got == {name: f"text of {name}" for name in want}


def test_sibling_folders_are_not_listed(spark, tree):
    plan = files.scan_source_tree(spark, str(tree), "pkg/**/*.go").inputFiles()
    assert plan and all("/pkg/" in f for f in plan)


@pytest.mark.parametrize("glob", ["[a", "{a", "a}", "{a,{b}"])
def test_bad_globs(spark, tree, glob):
    with pytest.raises(ValueError, match="glob"):
        files.scan_source_tree(spark, str(tree), glob)


def test_event_log_as_table_and_stream(spark, tmp_path):
    lines = [{"type": "t", "task_id": "a", "seq": k, "at": f"2024-01-01T00:0{k}:00Z", "data": d} for k, d in enumerate([{"n": 1, "deep": {"x": [1, 2]}}, {"n": "one"}, None])]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "events.jsonl").write_text("\n".join(map(json.dumps, lines)))
    for stream in (False, True):
        log = files.read_event_log(spark, str(tmp_path / "log"), stream)
        got = files.payload_values(log, {"n": "$.n int", "last": "$.deep.x[1] int"}).select("seq", "ts", "n", "last")
        got = run_available(got, "log") if stream else got
        assert [(x.seq, x.n, x.last) for x in got.orderBy("seq").collect()] == [(0, 1, 2), (1, None, None), (2, None, None)]
    found = files.payload_schemas(files.read_event_log(spark, str(tmp_path / "log"))).first()
    assert (found.events, found.parsed) == (3, 2) and "deep: OBJECT<x: ARRAY<BIGINT>>" in found.schema
    text = spark.createDataFrame([("t", '{"n": 5}'), ("t", "{broken"), ("t", None)], "type string, data string")
    assert rows(files.payload_values(text, {"n": "$.n int"}).select("n")) == [(5,), (None,), (None,)]


def test_chat_history_as_stream(spark, tmp_path):
    (tmp_path / "chats" / "c1").mkdir(parents=True)
    (tmp_path / "chats" / "c1" / "history.jsonl").write_text('{"role": "user", "content": "hi", "timestamp": "2024-01-01T00:00:00Z"}\n')
    got = run_available(files.read_chat_history(spark, str(tmp_path / "chats"), stream=True), "chats")
    assert rows(got.select("chat_id", "role", "content")) == [("c1", "user", "hi")]


def test_hot_scopes_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    left = cut_lineage(spark.range(20_000).select(F.when(F.col("id") % 4 > 0, "").otherwise(F.col("id").cast("string")).alias("scope"), "id"))
    right = spark.createDataFrame([("", "a"), ("", "b"), ("0", "c"), ("4", "d"), ("x", "e")], "scope string, name string")
    got = skew.spread_join(left, right, ["scope"])
    assert rows(got.select("id", "name")) == rows(left.join(right, "scope").select("id", "name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = skew.spread_join(left, right, ["scope"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 20_000
    features = spark.createDataFrame([("a",), ("a/b",)], "id string")
    over = spark.createDataFrame([("", "r", "add", "p@x"), ("a", "r", "remove", "p@x"), ("a/b", "r", "add", "q@x")], "scope string, role string, op string, stakeholder string")
    assert rows(people.resolve_roles(features, over)) == [("a/b", "r", "q@x")]


def test_tasks_of_a_spread_join_follow_the_rows_it_makes(spark, monkeypatch):
    """Salts stay apart under adaptive execution, which would coalesce them by the few bytes they read."""
    monkeypatch.setattr(skew, "SMALL", 0)
    left = cut_lineage(spark.range(20_000).select(F.lit("").alias("scope"), "id"))
    right = cut_lineage(spark.range(30).select(F.lit("").alias("scope"), F.col("id").alias("other")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = skew.spread_join(left, right, ["scope"]).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most[1] == 600_000 and most[0] <= 100_000


def test_names_of_micro_tasks_are_joined_as_lists(spark, monkeypatch):
    """The join makes a row per list of names, not one per name; repeated and null names are listed all the same."""
    monkeypatch.setattr(skew, "SMALL", 0)
    targets = spark.createDataFrame([(f"t{k}", f"m{k % 2}", "p0") for k in range(40)] + [(None, "m0", "p0")], "task string, module string, project string")
    names = [f"n{k}" for k in range(2_500)] + ["n1", None, None]
    configs = [("module", "m0", "pre", n) for n in names] + [("global", "", "pre", "g"), ("task", "t2", "pre", None), ("other", "m0", "pre", "x"), ("module", None, "pre", "x"), ("module", "m0", None, "x")]
    c = spark.createDataFrame(configs, "level string, scope string, phase string, name string")
    got = people.effective_micro_tasks(targets, c)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
    even = [t for t in [*(f"t{k}" for k in range(0, 40, 2)), None] if t != "t2"]
    want = [(t, "pre", "module", n) for t in even for n in names] + [(f"t{k}", "pre", "global", "g") for k in range(1, 40, 2)] + [("t2", "pre", "task", None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    lists = skew.blocks(c, ["level", "scope", "phase"], "name", 100).where("level = 'module'").collect()
    assert len(lists) >= 20 and max(r["_size"] for r in lists) < 200
    assert sorted((n for r in lists for n in r["name"]), key=repr) == sorted(names, key=repr)
