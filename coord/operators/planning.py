"""Plans, roadmaps, proposals: derived status, estimates, digests, what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.functions.status import effort_rank, impact_rank, lookup
from coord.operators import ordered as O

# How close a feature status is to stable.
FEATURE_CLOSENESS = {
    "Conceptual": 1, "Draft": 1, "In Review": 2, "Approved": 3, "In Progress": 4, "Implemented": 5, "Stable": 6,
}


def roadmap_status(plans: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """Status per roadmap from its plans (``roadmap, status, active``; active = a linked task in progress).

    Ruling on overlap: superseded, then in_progress, draft, approved, in_review.
    """
    s = F.col("status")
    agg = plans.groupBy("roadmap").agg(
        F.bool_or("active").alias("_active"), F.bool_or(s == "draft").alias("_draft"),
        F.bool_and(s == "approved").alias("_approved"), F.count(F.lit(1)).alias("plans"),
    )
    derived = F.when(F.col("_active"), "in_progress").when(F.col("_draft"), "draft").when(F.col("_approved"), "approved").otherwise("in_review")
    if superseded is not None:
        agg = agg.join(superseded.select("roadmap", F.lit(True).alias("_sup")).distinct(), "roadmap", "left")
        derived = F.when(F.col("_sup"), "superseded").otherwise(derived)
    return agg.select("roadmap", "plans", derived.alias("status"))


def inferred_effort(steps: Column) -> Column:
    """Ruling for the overlapping bands: up to 3 steps S, up to 6 M, up to 10 L, else XL."""
    return F.when(steps <= 3, "S").when(steps <= 6, "M").when(steps <= 10, "L").otherwise("XL")


def plan_estimate_check(plans: DataFrame, steps: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Declared effort against the one inferred from step count (``steps``: plan, step).

    With ``depths`` (plan, depth), a dependency depth above 3 raises the band by one.
    """
    n = steps.groupBy("plan").agg(F.count(F.lit(1)).alias("steps"))
    out = plans.select("plan", "effort").join(n, "plan", "left").withColumn("steps", F.coalesce("steps", F.lit(0)).cast("long"))
    rank = effort_rank(inferred_effort(F.col("steps")))
    if depths is not None:
        out = out.join(depths, "plan", "left")
        rank = F.least(F.lit(4), rank + F.when(F.col("depth") > 3, 1).otherwise(0))
    inferred = lookup(rank, {1: "S", 2: "M", 3: "L", 4: "XL"})
    return out.select(
        "plan", "effort", "steps", inferred.alias("inferred"),
        F.coalesce(F.col("effort") != inferred, F.lit(False)).alias("mismatch"),
    )


def summary_digest(items: DataFrame, root: str = "root", status: str = "status") -> DataFrame:
    """Counts by status and root, by each alone, and in total (nulls mark the totals)."""
    return items.cube(root, status).agg(F.count(F.lit(1)).alias("n"))


def latest_n(rows: DataFrame, keys: list[str], created: str, tie: str, n: int = 3) -> DataFrame:
    """Newest ``n`` rows per key, numbered from oldest to newest in ``position``."""
    top = O.top_per_key(rows, keys, [F.col(created).desc(), F.col(tie).desc()], n)
    kept = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return top.withColumn("position", (kept - F.col("rank") + 1).cast("int")).drop("rank")


def whats_next(plans: DataFrame, deps: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """Rank the open plans whose dependencies are all completed.

    ``plans``: ``plan, roadmap, state (open, in_progress, completed), completed_at, effort, impact,
    feature_status`` (and ``inferred_effort``, ``inferred_impact`` for the missing ones). Order: impact
    down, effort up, newly unblocked, roadmap momentum, feature closeness, name.
    """
    have = set(plans.columns)
    pick = lambda c: F.coalesce(F.col(c), F.col("inferred_" + c)) if "inferred_" + c in have else F.col(c)
    done = plans.filter("state = 'completed'").select(F.col("plan").alias("dep"), F.col("completed_at").alias("_done_at"))
    dep_state = deps.select("plan", "dep").distinct().join(done, "dep", "left").groupBy("plan").agg(
        F.count_if(F.col("_done_at").isNull()).alias("_open"), F.max("_done_at").alias("_last")
    )
    momentum = plans.groupBy("roadmap").agg(F.bool_or(F.col("state") == "in_progress").alias("momentum"))
    cand = (
        plans.filter("state = 'open'")
        .join(dep_state, "plan", "left")
        .filter("coalesce(_open, 0) = 0")
        .join(momentum, "roadmap")
        .withColumns(
            {
                "impact_rank": F.coalesce(impact_rank(pick("impact")), F.lit(0)),
                "effort_rank": F.coalesce(effort_rank(pick("effort")), F.lit(9)),
                "newly_unblocked": F.coalesce(F.col("_last") >= since, F.lit(False)),
                "closeness": F.coalesce(lookup(F.col("feature_status"), FEATURE_CLOSENESS), F.lit(0)),
            }
        )
        .select("plan", "roadmap", "impact_rank", "effort_rank", "newly_unblocked", "momentum", "closeness")
    )
    out = cand.orderBy(
        F.col("impact_rank").desc(), "effort_rank", F.col("newly_unblocked").desc(), F.col("momentum").desc(),
        F.col("closeness").desc(), "plan",
    )
    return out.limit(limit) if limit is not None else out


def completed_since(plans: DataFrame, since: Column) -> DataFrame:
    return plans.filter("state = 'completed'").filter(F.col("completed_at") >= since).select("plan", "completed_at")


def in_progress(plans: DataFrame, plan_progress: DataFrame) -> DataFrame:
    """Plans under way with steps done and in total (``plan_progress`` rows per plan task)."""
    n = plan_progress.filter("plan IS NOT NULL").groupBy("plan").agg(
        F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status").isin("blocked", "failed")).alias("blockers"),
    )
    return plans.filter("state = 'in_progress'").select("plan").join(n, "plan", "left").na.fill(0)
