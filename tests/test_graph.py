"""Graph operators on long, cyclic and random graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from coord.operators import graph, ops, skew, tasks
from coord.session import cut_lineage


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def groups_of(edges):
    """{node: least node of its strongly connected component} of nodes on cycles."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen
    far = {a: reached(a) for a in out}
    return {a: min(b for b in far[a] if a in far.get(b, ())) for a in far if a in far[a]}


def waves_of(nodes, edges):
    deps = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}
    waves, last = {}, None
    while last != len(waves):
        last = len(waves)
        waves |= {n: 1 + max((waves[d] for d in deps[n]), default=-1) for n in nodes if n not in waves and all(d in waves for d in deps[n])}
    return {n: waves.get(n) for n in nodes}


def edges_of(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


@pytest.mark.parametrize("seed", [3])
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range((30, 45, 60, 90)[seed])]
    pairs += [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(106, 200), (200, 201), (201, 103), (201, 300), (300, 301), (7, 100), (400, 400), (401, 400)]
    want = groups_of(pairs)
    assert dict(rows(graph.strong_components(edges_of(spark, pairs)))) == want
    cyclic = sorted({(a, b, want[a]) for a, b in pairs if a in want and want.get(b) == want[a]}, key=repr)
    assert rows(graph.find_cycles(edges_of(spark, pairs))) == cyclic


def test_long_ring_with_tails(spark):
    n = 10_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tails = spark.range(n, 2 * n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst")).filter("src > 10000")
    chord = edges_of(spark, [(5000, 20_000), (20_000, 20_001), (20_001, 12), (10_000, 3)])
    got = graph.strong_components(ring.unionByName(tails).unionByName(chord)).agg(F.count("*"), F.min("group"), F.max("group"), F.max("node")).first()
    assert tuple(got) == (n + 2, 0, 0, 20_001)
    assert graph.strong_components(ring.filter("src > 0")).count() == 0
    assert graph.find_cycles(edges_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [2])
def test_waves_of_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = set(range(60))
    pairs = [(a, r.randrange(a)) for a in range(1, 60) for _ in range(r.randrange(3))] + [(5, 99), (98, 5)]
    if seed:
        pairs += [(3, 50), (50, 3), (55, 50)]
    table = spark.createDataFrame([(n,) for n in nodes], "node long")
    assert dict(rows(graph.dependency_waves(table, edges_of(spark, pairs)))) == waves_of(nodes, pairs)


def test_waves_of_a_long_chain(spark):
    n = 300
    chain = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    ladder = chain.unionByName(edges_of(spark, [(k, k - 7) for k in range(290, 300)]))  # a few nodes of two dependencies
    got = graph.dependency_waves(spark.range(n).select(F.col("id").alias("node")), ladder)
    assert got.filter("node = wave").count() == n


def test_deep_trace_and_wide_trace(spark):
    deep = spark.range(1_000).select(F.lit("deep").alias("trace_id"), F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    wide = spark.range(5_000).select(F.lit("wide").alias("trace_id"), F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.lit(0)).alias("parent_id"))
    got = ops.span_depths(deep.unionByName(wide))
    assert got.filter("trace_id = 'deep' AND depth = span_id").count() == 1_000
    assert got.filter("trace_id = 'wide' AND depth = least(span_id, 1)").count() == 5_000


def test_climb(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 9), (10, 9), (20, 21), (21, 22), (22, 20), (23, 22)], "node int, up int")
    got = {x.node: (x.top, x.dist) if x.top is not None else x.low for x in graph.climb(links).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3)}
    assert {k: got[k] for k in (9, 10, 20, 21, 22, 23)} == {9: 9, 10: 9, 20: 20, 21: 20, 22: 20, 23: 20}


def test_sub_tasks_at_every_depth(spark):
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", None)], "slug string, parent string")
    roots = spark.createDataFrame([("a",), ("c",), ("x",)], "root string")
    want = [("a", "b"), ("a", "c"), ("a", "d"), ("c", "d"), ("x", "y")]
    assert rows(tasks.descendants(tree, roots)) == want
    diamond = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d")], "slug string, parent string")
    assert rows(tasks.descendants(diamond, roots.limit(1))) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")]


def test_hot_keys_are_looked_up_in_place(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 0)
    many = cut_lineage(spark.range(5_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("a"), F.lit("k").alias("b"), "id"))
    found = spark.createDataFrame([(0, "k", "zero"), (7, "k", "seven")], "a long, b string, what string")
    want = rows(many.join(found, ["a", "b"], "left").select("id", "what"))
    assert rows(skew.hot_join(many, found, ["a", "b"]).select("id", "what")) == want


def test_known_pairs_are_not_read_every_round(spark, monkeypatch):
    n, read = 24, []
    real = graph._union
    monkeypatch.setattr(graph, "_union", lambda parts: read.append(len(parts)) or real(parts))
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(k, k + 2) for k in range(n - 1)], "src int, dst int")
    got = {(x.root, x.node): x.depth for x in graph.reach(chain).collect()}
    assert got == {(a, b): (b - a + 1) // 2 for a in range(n) for b in range(a + 1, n + 1)}
    ring = spark.createDataFrame([(k, (k + 1) % n) for k in range(n)] + [(0, 0)], "src int, dst int")
    got = [tuple(x) for x in graph.reach(ring, spark.createDataFrame([(0,), (5,)], "root int")).collect()]
    assert sorted(got) == sorted([(0, k, k or 1) for k in range(n)] + [(5, k, (k - 5) % n or n) for k in range(n)])
    assert len(read) <= 20


def test_few_pairs_on_cycles_do_not_keep_the_rounds_going(spark, monkeypatch):
    """However many pairs are known, a cycle or a longer way ends once the depth has doubled, and so does a null root's."""
    tables = []
    real = graph.cut_lineage
    def counted(df):
        tables.append(df)
        assert len(tables) <= 16, "rounds go on"
        return real(df)
    monkeypatch.setattr(graph, "cut_lineage", counted)
    far = spark.range(2_000).select((F.col("id") + 1_000).alias("src"), (F.col("id") + 5_000).alias("dst"))
    odd = [(0, 0), (1, 2), (2, 3), (3, 1), (None, 1), (7, None), (2, None)] + [(a, b) for a in range(20, 25) for b in range(a + 1, 25)]
    got = graph.reach(far.unionByName(spark.createDataFrame(odd, "src long, dst long")))
    want = [(0, 0, 1), (None, 1, 1), (None, 2, 2), (None, 3, 3), (None, None, 3), (7, None, 1)] + [(a, b, 1) for a in range(20, 25) for b in range(a + 1, 25)]
    want += [(a, b, (b - a) % 3 or 3) for a in (1, 2, 3) for b in (1, 2, 3)] + [(1, None, 2), (2, None, 1), (3, None, 3)]
    assert rows(got) == sorted(want + [(k + 1_000, k + 5_000, 1) for k in range(2_000)], key=repr)


def test_edges_of_paths_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "int")
    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "src int, dst int").select(count("src").alias("src"), "dst")
    got = graph.paths(chain, spark.createDataFrame([(0,)], "root int"))
    assert sorted((x.node, x.depth) for x in got.collect()) == [(k, k) for k in range(1, 7)]
    assert seen.value <= 12
