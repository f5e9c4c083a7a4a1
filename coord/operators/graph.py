"""Dependency graphs and path hierarchies.

Edges are ``(src, dst)`` tables. The loops run one job per round on the frontier only, test emptiness on
the driver and cut lineage with reliable checkpoints, so a lost executor costs one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.functions import text as X
from coord.operators import ordered as O
from coord.operators.skew import hot_join
from coord.session import stored as cut_lineage  # tables: a checkpoint keeps the old plan's size estimate, which multiplies in a loop


TABLES = 16  # so many tables of found pairs are read together before they are merged


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reach(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): every node reachable from each root, with its smallest number of steps.

    ``roots`` has ``root``; without it every source is one. A root reaches itself only through a cycle.
    Each round follows the pairs of the round before. Pairs known from earlier rounds are dropped once those followed
    since the last time are as many as all before, or the depth has more than doubled: so what is followed twice is less than what
    is known, rounds end at twice the depth of the last new pair or one later, whatever goes round in cycles or comes again
    on longer ways, and all known pairs are shuffled a logarithmic number of times, not every round. The
    least depth of a pair is taken at the end. Known pairs lie in a few tables, merged when they become many.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    first = e.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    if roots is not None:
        first = first.join(roots.select("root").distinct(), "root", "left_semi")
    frontier = cut_lineage(first.withColumn("depth", F.lit(1)))
    step = e.withColumnRenamed("src", "node")
    found, sizes, depth = [frontier], [frontier.count()], 1
    same = F.col("root") == F.col("_root")
    if roots is None and not frontier.filter("root IS NULL").isEmpty():
        same = F.col("root").eqNullSafe(F.col("_root"))  # only where needed, as its join shuffles the new pairs again
    unchecked, checked, again = 0, 1, False
    while sizes[-1]:
        depth += 1
        nxt = frontier.join(step, "node").select("root", F.col("dst").alias("node")).distinct()
        if 2 * unchecked >= sum(sizes) or depth > 2 * checked:
            known = _union(found).select(F.col("root").alias("_root"), F.col("node").alias("_node"))
            nxt, unchecked, checked = nxt.join(known, same & (F.col("node") == F.col("_node")), "left_anti"), 0, depth
        else:
            again = True
        frontier = cut_lineage(nxt.withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            break
        unchecked += size
        found.append(frontier)
        sizes.append(size)
        while len(found) > TABLES and sizes[-2] <= 2 * sizes[-1]:
            found[-2:] = [cut_lineage(_union(found[-2:]))]
            sizes[-2:] = [sum(sizes[-2:])]
    pairs = _union(found)
    return pairs.groupBy("root", "node").agg(F.min("depth").alias("depth")) if again else pairs


def transitive_deps(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    return reach(edges, roots)


def transitive_refs(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Everything that depends on each root, directly or not."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)


def paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth, path, cycle): the dependency tree below each root, one row per path.

    A node already on its own path is emitted once with ``cycle`` true and not followed. The number of
    paths can grow exponentially with depth, so this is for chosen roots; ``reach`` serves whole graphs.
    """
    e = cut_lineage(edges.select(F.col("src").alias("node"), "dst").distinct())
    kind = edges.schema["src"].dataType
    frontier = roots.select("root").distinct().select(
        "root", F.col("root").cast(kind).alias("node"), F.array(F.col("root").cast(kind)).alias("path")
    )
    found: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        grown = frontier.join(e, "node").select(
            "root", F.col("dst").alias("node"), F.lit(depth).alias("depth"),
            F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("cycle"),
        )
        grown = cut_lineage(grown)
        if grown.isEmpty():
            break
        found.append(grown)
        frontier = grown.filter(~F.col("cycle")).select("root", "node", "path")
    return _union(found) if found else grown


def simple_cycles(tree: DataFrame) -> DataFrame:
    """Distinct cycles met in a dependency tree, rotated to start at their smallest node."""
    last = F.element_at("path", -1)
    loop = F.slice("path", F.array_position("path", last).cast("int"), F.size("path"))
    loop = F.slice(loop, 1, F.size(loop) - 1)
    at = F.array_position(loop, F.array_min(loop)).cast("int")
    turned = F.concat(F.slice(loop, at, F.size(loop)), F.slice(loop, 1, at - 1))
    return tree.filter("cycle").select(turned.alias("cycle")).distinct()


def climb(links: DataFrame) -> DataFrame:
    """(node, top, dist, low) for links (node, up): the end of the way up, its length, and the least node on it.

    ``up`` is null on tops and else another node of the table. A node whose way never ends has a null top; on a
    cycle its ``low`` is then the least node of the cycle. Ways are doubled: after k rounds every node knows the
    2^k-th above it, so the rounds are logarithmic in the depth. A round reads all nodes and writes those whose
    way is still open; nodes above which many others stand are looked up without gathering these.
    """
    up = F.col("up")
    start = links.select("node", F.coalesce(up, F.col("node")).alias("at"), up.isNotNull().cast("long").alias("dist"), F.col("node").alias("low"), up.isNotNull().alias("open"))
    start = cut_lineage(start)
    shut, waiting, n, span = [start.filter(~F.col("open"))], start.filter("open"), start.count(), 1
    left = waiting.count()
    while left and span <= n:
        above = _union([*shut, waiting]).select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("dist").alias("_dist"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        moved = hot_join(waiting, above, ["at"], n=left).select(
            "node", F.col("_at").alias("at"), (F.col("dist") + F.col("_dist")).alias("dist"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"),
        )
        moved = cut_lineage(moved)
        shut.append(moved.filter(~F.col("open")))
        waiting = moved.filter("open")
        left, span = waiting.count(), span * 2
    ended = _union(shut).select("node", F.col("at").alias("top"), "dist", "low")
    return ended.unionByName(waiting.select("node", F.lit(None).cast(links.schema["node"].dataType).alias("top"), "dist", "low"))


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out."""
    e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def _straightened(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without nodes of one edge in and one out, (node, head, tail) of these, (node, label) of rings made of them)."""
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.first("src").alias("before"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.first("dst").alias("after"))
    thin = (F.col("ins") == 1) & (F.col("outs") == 1)
    nodes = cut_lineage(ins.join(outs, "node", "full").select("node", F.coalesce(thin, F.lit(False)).alias("thin"), "before", "after"))
    inner = nodes.filter("thin").select("node")
    if inner.isEmpty():
        return e, inner, inner
    way = lambda side: climb(nodes.select("node", F.when(F.col("thin"), F.col(side)).alias("up")))
    ahead = cut_lineage(way("after").join(inner, "node", "left_semi"))
    rings = ahead.filter("top IS NULL").select("node", F.col("low").alias("label"))
    back = way("before").select("node", F.col("top").alias("head"))
    chains = cut_lineage(ahead.filter("top IS NOT NULL").select("node", F.col("top").alias("tail")).join(back, "node").select("node", "head", "tail"))
    gone = lambda c: inner.withColumnRenamed("node", c)
    kept = e.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst")
    return cut_lineage(kept.unionByName(chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()), chains, rings


def _spread(labels: DataFrame, e: DataFrame) -> DataFrame:
    """(node, label): the least label of the nodes from which a node is reached, and its own."""
    labels = news = cut_lineage(labels)
    while True:
        sent = news.select(F.col("node").alias("src"), "label").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        news = cut_lineage(sent.join(labels, "node").filter("new < label").select("node", F.col("new").alias("label")))
        if news.isEmpty():
            return labels
        fresh = news.withColumnRenamed("label", "new")
        labels = cut_lineage(labels.join(fresh, "node", "left").select("node", F.coalesce("new", "label").alias("label")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, group) of every node on a cycle: the least node of its strongly connected component.

    Edges that cannot lie on a cycle are trimmed, and nodes with one edge in and one out are taken out of their
    ways (by doubling, so a ring or tail of n nodes takes log n rounds); such a node is in a component if both
    ends of its way are. In what is left the least label spreads along the edges; a component's least node keeps
    its own, and the nodes of that label from which it is reached are its component. One label per node, no
    pairs. Rounds of the spreading are as many as what is left is deep.
    """
    e = edges.select("src", "dst").distinct()
    loops = [e.filter("src = dst").select(F.col("src").alias("node"))]
    e = cut_lineage(e.filter("src <> dst"))
    levels: list[DataFrame] = []
    found: list[DataFrame] = []
    n = e.count()
    while n:
        before = n
        e, chains, rings = _straightened(cut_lineage(_trimmed(e)))
        if "head" in chains.columns:
            levels.append(chains)
            found.append(rings)
            loops.append(e.filter("src = dst").select(F.col("src").alias("node")))
            e = cut_lineage(e.filter("src <> dst"))
        n = e.count()
        if n < before:
            continue
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), e)
        of = lambda side: colour.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        inside = cut_lineage(e.join(of("src"), "src").join(of("dst"), "dst").filter("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")))
        reached = news = cut_lineage(colour.filter("node = label"))
        while not news.isEmpty():
            back = news.select(F.col("node").alias("dst")).join(inside, "dst").select(F.col("src").alias("node"), "label").distinct()
            news = cut_lineage(back.join(reached, "node", "left_anti"))
            reached = cut_lineage(reached.unionByName(news))
        big = reached.groupBy("label").count().filter("count > 1").select("label")
        found.append(cut_lineage(reached.join(big, "label", "left_semi").select("node", "label")))
        done = reached.select("node")
        e = inside.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = cut_lineage(e.select("src", "dst"))
        n = e.count()
    known = _union(found) if found else loops[0].select("node", F.col("node").alias("label"))
    alone = _union(loops).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("label"))
    known = cut_lineage(known.unionByName(alone) if found else alone.unionByName(known).distinct())
    for chains in reversed(levels):
        of = lambda side: known.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        ends = chains.join(of("head"), "head").join(of("tail"), "tail").filter("head_label = tail_label")
        known = cut_lineage(known.unionByName(ends.select("node", F.col("head_label").alias("label"))))
    least = known.groupBy("label").agg(F.min("node").alias("group"))
    return hot_join(known, least, ["label"]).select("node", "group")


def find_cycles(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle, with the smallest node of their cycle group."""
    groups = cut_lineage(strong_components(edges))
    of = lambda side: groups.select(F.col("node").alias(side), F.col("group").alias(f"{side}_group"))
    inside = edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").filter("src_group = dst_group")
    return inside.select("src", "dst", F.col("src_group").alias("cycle_group"))


def dependency_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, wave): 0 without dependencies, else one more than the latest of them; null on and behind cycles.

    Dependencies on unknown nodes are ignored. A node with one dependency stands one wave above it, so ways of
    such nodes are climbed by doubling. Nodes with several count down: each round, the nodes settled in the round
    before send their wave along the edges to them, and those that have heard from all are settled. What was sent
    lies in a few tables, merged as they grow, so the rows written in all are about nodes plus edges.
    """
    all_nodes = cut_lineage(nodes.select("node").distinct())
    named = lambda c: all_nodes.withColumnRenamed("node", c)
    e = cut_lineage(edges.select("src", "dst").distinct().join(named("dst"), "dst", "left_semi").join(named("src"), "src", "left_semi").select("src", "dst"))
    needs = cut_lineage(all_nodes.join(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need"), F.first("dst").alias("one")), "node", "left"))
    ways = cut_lineage(climb(needs.select("node", F.when(F.col("need") == 1, F.col("one")).alias("up"))).select("node", "top", "dist"))
    many = needs.filter("need > 1").select(F.col("node").alias("src"), "need")
    tops = ways.select(F.col("node").alias("dst"), "top", "dist")
    sends = cut_lineage(e.join(many.select("src"), "src", "left_semi").join(tops, "dst").select("src", "top", (F.col("dist") + 1).alias("more")))
    settled = [cut_lineage(needs.filter("need IS NULL").select("node", F.lit(0).cast("long").alias("wave")))]
    heard: list[DataFrame] = []
    sizes: list[int] = []
    while not sends.isEmpty():
        now = settled[-1].select(F.col("node").alias("top"), "wave").join(sends, "top")
        now = cut_lineage(now.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("wave") + F.col("more")).alias("wave")))
        size = now.count()
        if not size:
            break
        heard.append(now)
        sizes.append(size)
        while len(heard) > 1 and sizes[-2] <= 2 * sizes[-1]:
            heard[-2:] = [cut_lineage(_union(heard[-2:]).groupBy("src").agg(F.sum("n").alias("n"), F.max("wave").alias("wave")))]
            sizes[-2:] = [sum(sizes[-2:])]
        so_far = _union([h.join(now.select("src"), "src", "left_semi") for h in heard]).groupBy("src").agg(F.sum("n").alias("n"), F.max("wave").alias("wave"))
        settled.append(cut_lineage(so_far.join(many, "src").filter("n = need").select(F.col("src").alias("node"), "wave")))
    waves = _union(settled).withColumnRenamed("node", "top")
    return hot_join(ways, waves, ["top"]).select("node", (F.col("wave") + F.col("dist")).cast("int").alias("wave"))


def impact(
    edges: DataFrame, plans: DataFrame | None = None, tasks: DataFrame | None = None, roots: DataFrame | None = None
) -> DataFrame:
    """Blast radius per feature: features that depend on it, and plans and tasks linked to it or to those.

    ``plans`` and ``tasks`` are (feature, id) links. Counts come from the transitive references by
    map-side aggregation.
    """
    refs = transitive_refs(edges, roots).select(F.col("root").alias("feature"), F.col("node").alias("ref"))
    refs = cut_lineage(refs.filter(F.col("ref") != F.col("feature")))
    out = cut_lineage(refs.groupBy("feature").agg(F.count(F.lit(1)).alias("refs")))
    reached = refs.unionByName(out.select("feature", F.col("feature").alias("ref")))
    for name, links in (("plans", plans), ("tasks", tasks)):
        if links is None:
            continue
        hit = reached.join(links.select(F.col("feature").alias("ref"), "id").distinct(), "ref")
        out = out.join(hit.groupBy("feature").agg(F.countDistinct("id").alias(name)), "feature", "left").withColumn(
            name, F.coalesce(name, F.lit(0))
        )
    return out


def focus_tree(features: DataFrame, target: str | None = None, direction: str | None = None) -> DataFrame:
    """(id, depth, focus, sort_key) in pre-order with siblings in alphabetical order.

    Without a target the whole tree; with one its ancestors (``up``), its subtree (``down``) or, by
    default, both. Paths carry the hierarchy, so no recursion is needed.
    """
    if direction not in (None, "up", "down"):
        raise ValueError("direction is up or down")
    i = F.col("id")
    out = features.select("id").distinct()
    if target is not None:
        target = target.strip("/")
        above = F.lit(target).startswith(F.concat(i, F.lit("/"))) | (i == target)
        below = X.in_subtree(i, target)
        out = out.filter({"up": above, "down": below, None: above | below}[direction])
    focus = (i == F.lit(target)) if target is not None else F.lit(False)
    return out.select("id", X.depth(i).alias("depth"), focus.alias("focus"), F.split(i, "/").alias("sort_key"))


def tree_lines(tree: DataFrame) -> DataFrame:
    """Indented lines of a tree with their ``place`` in reading order."""
    name = F.element_at("sort_key", -1)
    placed = O.over_order(tree.withColumn("_all", F.lit(0)), ["_all"], ["sort_key"], O.rank("place"))
    return placed.select(
        "id", "place", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("focus"), "* ").otherwise(""), name).alias("line")
    )


def rollup_parent_status(tasks: DataFrame, path: str = "path", status: str = "status") -> DataFrame:
    """Status of every inner path from the leaves below it: done when all are, else in progress or queued.

    Each leaf adds to its own ancestors map-side, so a root with millions of tasks is no hot group.
    """
    s = F.col(status)
    up = tasks.select(F.explode(F.slice(X.prefixes(F.col(path)), 1, F.size(F.split(path, "/")) - 1)).alias("parent"), s.alias("s"))
    counts = up.groupBy("parent").agg(F.count_if(F.col("s") == "completed").alias("done"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col("s").isin("planning", "queued")).alias("_begun"))
    return counts.select("parent", "done", "total", derived_status().alias("status"))


def derived_status() -> Column:
    return (
        F.when(F.col("done") == F.col("total"), "completed").when(F.col("_begun") > 0, "in_progress").otherwise("queued")
    )
