"""Task tables: listing, paging, dependencies, boards, plan progress, timelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.functions.status import is_terminal
from coord.functions.text import parent_path
from coord.operators import ordered as O
from coord.operators.graph import reach
from coord.schemas import TASK_FIELDS
from coord.session import cut_lineage


def list_tasks(tasks: DataFrame, order: str | None = "ordinal", **equals: str | None) -> DataFrame:
    """Rows matching every given equality (status, parent, project, agent); filters reach the scan."""
    for column, value in equals.items():
        if value is not None:
            tasks = tasks.filter(F.col(column) == F.lit(value))
    return tasks.orderBy(order) if order else tasks


def select_fields(
    df: DataFrame,
    fields: Sequence[str],
    known: Sequence[str] = TASK_FIELDS,
    key: Sequence[str] = ("slug",),
    enrich: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Project named fields after checking the names, before any job runs.

    ``enrich`` holds, per field that is not stored, a function that joins it in; joins of fields nobody
    asked for never enter the plan.
    """
    unknown = [f for f in fields if f not in known]
    if unknown:
        raise ValueError(f"unknown field(s): {', '.join(unknown)}; known: {', '.join(known)}")
    for f in fields:
        if f not in df.columns:
            if not enrich or f not in enrich:
                raise ValueError(f"field {f} is not available on this table")
            df = enrich[f](df)
    return df.select(*key, *[f for f in fields if f not in key])


def page_after(df: DataFrame, key: str, cursor=None, limit: int = 20) -> DataFrame:
    """Keyset page: ``limit`` rows after ``cursor`` with ``next_cursor`` and ``has_more`` on each row.

    Only ``limit`` + 1 rows leave the tasks (top-k), so the page costs the same at any depth.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = df if cursor is None else df.filter(F.col(key) > F.lit(cursor))
    window = rows.orderBy(key).limit(limit + 1)
    numbered = O.top_per_key(window.withColumn("_one", F.lit(1)), ["_one"], [F.col(key)], limit + 1, "_n")
    edge = numbered.groupBy("_one").agg(
        F.max(F.when(F.col("_n") == limit, F.col(key))).alias("_last"), (F.count(F.lit(1)) > limit).alias("has_more")
    )
    page = numbered.filter(F.col("_n") <= limit).join(F.broadcast(edge), "_one")
    return page.withColumn("next_cursor", F.when(F.col("has_more"), F.col("_last"))).drop("_one", "_n", "_last")


def rebuild_board(docs: DataFrame, board: DataFrame) -> DataFrame:
    """Board rows for every task document: an existing row wins whole, a new document becomes ``planning``.

    Rows whose document is gone are dropped. ``docs`` has ``slug, depends_on``; output in slug order.
    """
    cols = [c for c in board.columns if c != "slug"]
    old = board.select("slug", F.struct(*cols).alias("_row"))
    blank = F.struct(
        *[
            (
                F.lit("planning") if c == "status"
                else F.col("depends_on") if c == "depends_on"
                else F.lit(None).cast(board.schema[c].dataType)
            ).alias(c)
            for c in cols
        ]
    )
    merged = docs.select("slug", "depends_on").join(old, "slug", "left")
    return merged.select("slug", F.coalesce("_row", blank).alias("_row")).select("slug", "_row.*")


def unique_slugs(rows: DataFrame, keys: Sequence[str] = ("slug",), ordinal: str = "ordinal") -> DataFrame:
    """Mark repeated slugs: the lowest position is kept, ``duplicate`` is true on the others."""
    first = rows.groupBy(*keys).agg(F.min(ordinal).alias("_first"))
    return rows.join(first, list(keys)).withColumn("duplicate", F.col(ordinal) > F.col("_first")).drop("_first")


def unmet_dependencies(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(slug, dep, dep_status) for dependencies that are not completed; a missing one has a null status."""
    state = tasks.select(F.col("slug").alias("dep"), F.col("status").alias("dep_status"))
    joined = deps.select("slug", F.col("dep").cast("string").alias("dep")).join(state, "dep", "left")
    return joined.filter(~F.col("dep_status").eqNullSafe("completed")).select("slug", "dep", "dep_status")


def unmet_counts(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    return unmet_dependencies(tasks, deps).groupBy("slug").agg(F.count(F.lit(1)).alias("unmet"))


def ready_tasks(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Queued tasks with the number of unmet dependencies; ready when there is none."""
    queued = tasks.filter(F.col("status") == "queued").select("slug")
    unmet = F.coalesce("unmet", F.lit(0)).cast("long")
    return queued.join(unmet_counts(tasks, deps), "slug", "left").select(
        "slug", unmet.alias("unmet"), (unmet == 0).alias("ready")
    )


def resolve_task_refs(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Resolve dependency references (``path, ref``) and match them to task paths (``path``).

    A bare slug names a sibling, a reference with ``/`` starts at the tasks root, a URL is external.
    """
    ref = F.trim("ref")
    kind = F.when(ref.rlike("^[a-z][a-z0-9+.-]*://"), "external").when(ref.contains("/"), "path").otherwise("sibling")
    base = parent_path(F.col("path"))
    target = (
        F.when(kind == "external", ref)
        .when(kind == "path", F.regexp_replace(ref, "/+$", ""))
        .otherwise(F.when(base == "", ref).otherwise(F.concat_ws("/", base, ref)))
    )
    known = tasks.select(F.col("path").alias("target")).distinct().withColumn("_hit", F.lit(True))
    out = refs.withColumns({"kind": kind, "target": target}).join(known, "target", "left")
    resolved = F.when(F.col("kind") == "external", F.lit(None)).otherwise(F.coalesce("_hit", F.lit(False)))
    return out.select("path", "ref", "kind", "target", resolved.alias("resolved"))


def _derived(counts: dict[str, str]) -> Column:
    """Status of a plan task from counts over its execution tasks and their sub-tasks."""
    c = {k: F.coalesce(F.col(v), F.lit(0)) for k, v in counts.items()}
    return (
        F.when(c["all"] == 0, "not_started")
        .when(c["completed"] == c["all"], "completed")
        .when(c["failed"] > 0, "failed")
        .when(c["blocked"] > 0, "blocked")
        .when((c["running"] > 0) | (c["completed"] > 0), "in_progress")
        .otherwise("queued")
    )


def descendants(subtasks: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every sub-task (``slug, parent``) below each root, at every depth.

    With one parent each the sub-tasks are a forest: a level is the children of the level above, no node comes
    twice, and only a root on a cycle of parents could come back, to itself. Other tables go through ``reach``.
    """
    e = cut_lineage(subtasks.filter("parent IS NOT NULL").select("slug", "parent").distinct())
    if not e.groupBy("slug").count().filter("count > 1").isEmpty():
        return reach(e.select(F.col("parent").alias("src"), F.col("slug").alias("dst")), roots).select("root", "node")
    found = []
    level = roots.select("root", F.col("root").alias("parent")).distinct()
    while True:
        level = cut_lineage(level.join(e, "parent").filter("slug <> root").select("root", F.col("slug").alias("node")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, [*found, level])
        found.append(level)
        level = level.select("root", F.col("node").alias("parent"))


def plan_progress(plan_tasks: DataFrame, tasks: DataFrame, subtasks: DataFrame | None = None) -> DataFrame:
    """Derived status per (plan, plan_task) from linked execution tasks and their sub-tasks at every depth.

    Execution tasks in no plan come out with a null plan and ``unplanned`` true. ``subtasks`` has
    ``slug, parent``. Ruling where the design is silent: failed beats blocked beats in_progress.
    """
    live = tasks.select("slug", "status")
    links = plan_tasks.select("plan", "plan_task", F.col("task").alias("slug")).distinct()
    if subtasks is not None:
        below = descendants(subtasks, links.select(F.col("slug").alias("root")))
        below = links.join(below.select(F.col("root").alias("slug"), F.col("node").alias("_sub")), "slug")
        links = links.unionByName(below.select("plan", "plan_task", F.col("_sub").alias("slug"))).distinct()
    planned = links.join(live, "slug", "left")
    s = F.col("status")
    counts = planned.groupBy("plan", "plan_task").agg(
        F.count("status").alias("linked"),
        F.count_if(s == "completed").alias("done"),
        F.count_if(s.isin("failed", "aborted")).alias("n_failed"),
        F.count_if(s == "blocked").alias("n_blocked"),
        F.count_if(s.isin("in_progress", "claimed")).alias("n_running"),
    )
    derived = _derived(
        {"all": "linked", "completed": "done", "failed": "n_failed", "blocked": "n_blocked", "running": "n_running"}
    )
    rows = counts.select(
        "plan", "plan_task", F.lit(None).cast("string").alias("task"), derived.alias("status"),
        "done", "linked", F.lit(False).alias("unplanned"),
    )
    extra = live.join(links, "slug", "left_anti").select(
        F.lit(None).cast(links.schema["plan"].dataType).alias("plan"),
        F.lit(None).cast(links.schema["plan_task"].dataType).alias("plan_task"), F.col("slug").alias("task"), "status",
        (s == "completed").cast("long").alias("done"), F.lit(1).cast("long").alias("linked"),
        F.lit(True).alias("unplanned"),
    )
    return rows.unionByName(extra)


def state_as_of(changes: DataFrame, at: Column) -> DataFrame:
    """Status of every task at one moment: the latest change not after it (map-side maximum)."""
    past = changes.filter(F.col("ts") <= at)
    return past.groupBy("slug").agg(
        F.max_by("to_status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("since")
    )


def states_as_of(
    changes: DataFrame, asked: DataFrame, chunks: int | None = None
) -> DataFrame:
    """Status for each asked (``slug, ts``): as-of join by merging both tables in time order.

    Changes and questions are united and the last known status carried forward, so the cost is one sort
    and never a product of the two sides. A change at exactly the asked time counts.
    """
    moves = changes.select("slug", "ts", F.lit(0).alias("_side"), F.col("seq").cast("long").alias("_seq"), "to_status")
    marks = asked.select("slug", "ts").distinct().select(
        "slug", "ts", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"),
        F.lit(None).cast("string").alias("to_status"),
    )
    filled = O.over_order(
        moves.unionByName(marks), ["slug"], ["ts", "_side", "_seq"],
        O.last_known("status", F.col("to_status")), chunks=chunks,
    )
    return filled.filter(F.col("_side") == 1).select("slug", "ts", "status")


def task_timeline(changes: DataFrame, logs: DataFrame) -> DataFrame:
    """Status changes and progress log entries of each task in one table, in time order."""
    moved = changes.withColumn("type", F.lit("status_change"))
    noted = logs.withColumn("type", F.lit("log"))
    return moved.unionByName(noted, allowMissingColumns=True).orderBy("slug", "ts", "seq")


def task_context(
    tasks: DataFrame, deps: DataFrame, plan_tasks: DataFrame | None = None, features: DataFrame | None = None,
    asked: DataFrame | None = None, plan_features: DataFrame | None = None,
) -> DataFrame:
    """One row per task: its parent's status, sibling and dependency tallies, plan and feature.

    ``asked`` (``slug``) names the tasks one wants; they also get ``all_deps`` and ``all_deps_completed``, what they
    depend on at every depth. The feature is the task's own column or, with ``plan_features`` (``plan, feature``),
    the first one that its plan references; a task without a plan has neither.

    Siblings are tallied per parent and not listed on every row: a parent with millions of sub-tasks would
    otherwise emit all pairs. ``siblings_of`` lists them for the tasks one asks about.
    """
    per_parent = tasks.filter("parent IS NOT NULL").groupBy("parent").agg(
        F.count(F.lit(1)).alias("_kids"), F.count_if(F.col("status") == "completed").alias("_kids_done")
    )
    parents = tasks.select(F.col("slug").alias("parent"), F.col("status").alias("parent_status"))
    state = tasks.select(F.col("slug").alias("dep"), F.col("status").alias("_ds"))
    dep_counts = (
        deps.select("slug", F.col("dep").cast("string").alias("dep")).join(state, "dep", "left").groupBy("slug").agg(
            F.count(F.lit(1)).alias("deps"), F.count_if(F.col("_ds").eqNullSafe("completed")).alias("deps_completed")
        )
    )
    out = (
        tasks.join(per_parent, "parent", "left")
        .join(parents, "parent", "left")
        .join(dep_counts, "slug", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    if asked is not None:
        out = out.join(asked.select("slug").distinct(), "slug", "left_semi")
    done_self = F.when(F.col("status") == "completed", 1).otherwise(0)
    cols = [
        "slug", "status", "parent", "parent_status",
        F.when(F.col("_kids").isNull(), 0).otherwise(F.col("_kids") - 1).cast("long").alias("siblings"),
        F.when(F.col("_kids").isNull(), 0).otherwise(F.col("_kids_done") - done_self).cast("long").alias("siblings_completed"),
        zero("deps").alias("deps"), zero("deps_completed").alias("deps_completed"),
    ]
    if plan_tasks is not None:
        first = plan_tasks.groupBy(F.col("task").alias("slug")).agg(F.min("plan").alias("plan"))
        out = out.join(first, "slug", "left")
        cols.append("plan")
    if plan_features is not None:
        out = out.join(plan_features.groupBy("plan").agg(F.min("feature").alias("feature")), "plan", "left")
    if asked is not None:
        far = reach(deps.select(F.col("slug").alias("src"), F.col("dep").cast("string").alias("dst")), asked.select(F.col("slug").alias("root")))
        far = far.select(F.col("root").alias("slug"), F.col("node").alias("dep")).join(state, "dep", "left").groupBy("slug").agg(
            F.count(F.lit(1)).alias("all_deps"), F.count_if(F.col("_ds").eqNullSafe("completed")).alias("all_deps_completed")
        )
        out = out.join(far, "slug", "left")
        cols += [zero("all_deps").alias("all_deps"), zero("all_deps_completed").alias("all_deps_completed")]
    if features is not None:
        feats = features.select(F.col("id").alias("feature"), F.col("status").alias("feature_status"))
        out = out.join(feats, "feature", "left")
        cols += ["feature", "feature_status"]
    return out.select(*cols)


def siblings_of(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """(slug, sibling, sibling_status) for the asked tasks (``slug``)."""
    mine = tasks.join(asked.select("slug").distinct(), "slug", "left_semi").select("slug", "parent")
    other = tasks.select("parent", F.col("slug").alias("sibling"), F.col("status").alias("sibling_status"))
    return mine.join(other, "parent").filter(F.col("slug") != F.col("sibling")).drop("parent")
