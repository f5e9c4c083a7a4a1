"""Search over a specification corpus."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coord.functions import text as X
from coord.operators import ordered as O
from coord.operators.corpus import classify_documents, document_type, feature_refs, features_of
from coord.operators.extract import enclosing, marked_lines

TYPES = ("feature", "plan", "proposal", "other")


def search_specs(
    docs: DataFrame,
    query: str,
    phrase: bool = False,
    feature: str | None = None,
    section: str | None = None,
    status: str | None = None,
    type: str | None = None,  # noqa: A002
    context: int = 2,
    classes: DataFrame | None = None,
) -> DataFrame:
    """Matching lines with section, feature, status, type, context and relevance tier.

    Terms are matched without regard to case; all must occur in the file (in the named sections when
    ``section`` is given), then every line with at least one is a match. Tier 1: a heading holding the whole
    query; 2: a line holding it contiguously; 3: the rest. The document test runs on the whole text before
    any line is split off, so files without a match cost one scan and no shuffle. Type and subtree are decided
    from the path; the status is joined to the matching lines and never to whole texts.
    """
    if type is not None and type not in TYPES:
        raise ValueError(f"unknown type {type}; known: {', '.join(TYPES)}")
    whole = " ".join(query.lower().split()) if not phrase else query.lower()
    terms = [whole] if phrase else whole.split()
    if not terms:
        raise ValueError("empty query")
    found = docs
    if feature is not None:
        found = found.filter(X.in_subtree(F.col("path"), X.FEATURES_ROOT + feature.strip("/")))
    if classes is None:
        classes = classify_documents(docs.select("path"), features_of(docs))
    if type is not None:
        found = found.filter(document_type(F.col("path")) == type)
    low = F.lower("text")
    found = found.filter(reduce(and_, [low.contains(t) for t in terms]))

    line = F.lower("line_text")
    has = [line.contains(t) for t in terms]
    rows = marked_lines(found, extra=reduce(or_, has), context=context, levels=section is not None).filter("is_extra")
    if section is not None:
        want = section.lower()
        fits = lambda h: F.lower(h).contains(want) | (X.initials(h) == want)
        rows = rows.filter(F.exists(enclosing(), fits))
        if len(terms) > 1:
            per_file = Window.partitionBy("path")
            rows = rows.withColumns({f"_t{i}": F.max(h).over(per_file) for i, h in enumerate(has)})
            rows = rows.filter(" AND ".join(f"_t{i}" for i in range(len(terms))))
    contiguous = line.contains(whole)
    all_here = reduce(and_, has)
    tier = F.when(F.col("is_heading") & all_here, 1).when(contiguous, 2).otherwise(3)
    matches = rows.select(
        "path", "line", tier.alias("tier"), F.col("line_text").alias("text"), "context",
        F.col("section")["title"].alias("section"),
    )
    placed = matches.join(classes, "path", "left")
    if status is not None:
        placed = placed.filter(F.col("status") == status)
    return placed.select(
        "path", "line", "tier", "text", "context", "section", "feature", "status", "type"
    )


def ranked(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches with their ``rank`` by relevance, then path, then line; with ``limit`` the first ones."""
    order = ["tier", "path", "line"]
    if limit is not None:
        return O.top_per_key(matches.orderBy(*order).limit(limit), [], [F.col(c) for c in order], limit)
    return O.over_order(matches.withColumn("_all", F.lit(0)), ["_all"], order, O.rank("rank")).drop("_all")


def context_text(column: str = "context"):
    """Context lines as ``n: text`` joined by newlines."""
    return F.array_join(F.transform(column, lambda c: F.concat(c["line"].cast("string"), F.lit(": "), c["text"])), "\n")


def search_with_refs(matches: DataFrame, edges: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Matches per feature with the number of dependencies, reverse dependencies and plans of the feature.

    Relations are counted once per feature, not per match. ``related`` gives them as rows.
    """
    per = matches.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("path").alias("files"), F.min("tier").alias("best_tier")
    )
    deps = edges.distinct().groupBy(F.col("src").alias("feature")).agg(F.count(F.lit(1)).alias("deps"))
    refs = feature_refs(edges).groupBy("feature").agg(F.count(F.lit(1)).alias("reverse_deps"))
    out = per.join(deps, "feature", "left").join(refs, "feature", "left")
    if plans is not None:
        out = out.join(plans.groupBy("feature").agg(F.countDistinct("plan").alias("plans")), "feature", "left")
    else:
        out = out.withColumn("plans", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("feature", "matches", "files", "best_tier", zero("deps"), zero("reverse_deps"), zero("plans"))


def related(matches: DataFrame, edges: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(feature, relation, other) for every feature with a match: dep, reverse_dep or plan."""
    hit = matches.filter("feature IS NOT NULL").select("feature").distinct()
    rows = edges.select(F.col("src").alias("feature"), F.lit("dep").alias("relation"), F.col("dst").alias("other"))
    rows = rows.unionByName(
        edges.select(F.col("dst").alias("feature"), F.lit("reverse_dep").alias("relation"), F.col("src").alias("other"))
    )
    if plans is not None:
        rows = rows.unionByName(plans.select("feature", F.lit("plan").alias("relation"), F.col("plan").alias("other")))
    return rows.distinct().join(hit, "feature", "left_semi")
