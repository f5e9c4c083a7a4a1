"""Relations over a specification corpus: classification, references, indexes, traces, coverage, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.functions import text as X
from coord.operators.extract import dependency_edges, feature_id, has_link, links, marked_lines, plan_features, sections
from coord.session import cut_lineage


def normative_only(docs: DataFrame, include_proposals: bool = False) -> DataFrame:
    """Drop documents below a ``proposals`` directory unless asked for."""
    return docs if include_proposals else docs.filter(~F.col("path").rlike("(^|/)proposals/"))


def subtree(df: DataFrame, root: str, column: str = "id") -> DataFrame:
    return df.filter(X.in_subtree(F.col(column), root))


def features_of(docs: DataFrame) -> DataFrame:
    """(id, status) of every feature README."""
    return docs.select(
        feature_id(F.col("path")).alias("id"), X.metadata_value(F.col("text"), "Status").alias("status")
    ).filter("id IS NOT NULL")


def document_type(path: Column) -> Column:
    """feature, plan, proposal or other, from the path alone."""
    return (
        F.when(path.rlike(r"^spec/features/(.+/)?proposals/"), "proposal")
        .when(path.startswith(X.FEATURES_ROOT), "feature")
        .when(path.startswith(X.PLANS_ROOT), "plan")
        .otherwise("other")
    )


def classify_documents(paths: DataFrame, features: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Type, owning feature and its status per document path.

    The owner is the nearest directory upwards that is a feature; candidates per document are its own
    ancestors only, a handful of rows each. A plan document belongs to the feature that its plan references:
    ``plans`` (``plan, feature``) tells which; of several existing ones the first by name.
    """
    p = F.col("path")
    kind = document_type(p)
    docs = paths.select("path").distinct()
    folder = F.regexp_extract(p, r"^spec/features/(.+)/[^/]*$", 1)
    ancestors = docs.filter(folder != "").select("path", F.explode_outer(X.prefixes(folder)).alias("id"))
    owner = (
        ancestors.join(features.select("id", "status"), "id")
        .groupBy("path")
        .agg(F.max_by(F.struct("id", "status"), X.depth(F.col("id"))).alias("o"))
    )
    if plans is not None:
        of_plan = plans.join(features.select(F.col("id").alias("feature"), "status"), "feature")
        of_plan = of_plan.groupBy("plan").agg(F.min(F.struct(F.col("feature").alias("id"), "status")).alias("o"))
        at = docs.where(kind == "plan").select("path", F.explode_outer(X.prefixes(F.regexp_extract(p, r"^spec/plans/(.+)/[^/]*$", 1))).alias("plan"))
        named = at.join(of_plan, "plan").groupBy("path").agg(F.max_by("o", X.depth(F.col("plan"))).alias("o"))
        owner = owner.unionByName(named)
    return docs.join(owner, "path", "left").select(
        "path", kind.alias("type"), F.col("o.id").alias("feature"), F.col("o.status").alias("status")
    )


def dangling_dependencies(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Edges whose target is no feature."""
    return edges.join(features.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def feature_refs(edges: DataFrame) -> DataFrame:
    """Who depends on whom, as rows (feature, ref): the reversed edges, each once."""
    return edges.select(F.col("dst").alias("feature"), F.col("src").alias("ref")).distinct()


def ref_counts(edges: DataFrame) -> DataFrame:
    return feature_refs(edges).groupBy("feature").agg(
        F.count(F.lit(1)).alias("refs"), F.min("ref").alias("first_ref"), F.max("ref").alias("last_ref")
    )


def children_on_disk(features: DataFrame) -> DataFrame:
    """(parent, child) for features directly below another one."""
    return features.select(X.parent_path(F.col("id")).alias("parent"), F.col("id").alias("child")).filter("parent <> ''")


def reconcile_index(on_disk: DataFrame, listed: DataFrame) -> DataFrame:
    """Compare children present with children listed, both (parent, child).

    ``state`` is ok, missing (present, not listed) or orphaned (listed, not present).
    """
    a = on_disk.select("parent", "child").distinct().withColumn("_disk", F.lit(True))
    b = listed.select("parent", "child").distinct().withColumn("_listed", F.lit(True))
    state = F.when(F.col("_disk") & F.col("_listed"), "ok").when(F.col("_disk"), "missing").otherwise("orphaned")
    return a.join(b, ["parent", "child"], "full").select(
        "parent", "child", F.coalesce("_listed", F.lit(False)).alias("in_readme"), state.alias("state")
    )


def code_spec_trace(refs: DataFrame, features: DataFrame) -> DataFrame:
    """Source references against features: ``ok``, ``unresolved``, ``external`` (other repository) or
    ``unreferenced`` (a feature no file names; null file)."""
    r = refs.filter("type = 'feature'").select(
        "file", "repo", F.regexp_replace("target", "^spec/features/", "").alias("feature")
    ).distinct()
    own, other = r.filter("repo IS NULL"), r.filter("repo IS NOT NULL")
    f = features.select(F.col("id").alias("feature")).distinct().withColumn("_f", F.lit(True))
    used = own.drop("repo").join(f, "feature", "left")
    resolved = used.select("file", "feature", F.when(F.col("_f"), "ok").otherwise("unresolved").alias("state"))
    unused = f.join(own, "feature", "left_anti").select(
        F.lit(None).cast("string").alias("file"), "feature", F.lit("unreferenced").alias("state")
    )
    foreign = other.select("file", F.concat_ws("@", "feature", "repo").alias("feature"), F.lit("external").alias("state"))
    return resolved.unionByName(unused).unionByName(foreign)


def ac_coverage(scenarios: DataFrame, criteria: DataFrame) -> DataFrame:
    """Test scenarios (scenario, feature, ac) against acceptance criteria (feature, ac); ``*`` names all.

    Output per criterion: number of scenarios covering it; unknown criteria that scenarios name follow
    with ``state`` unknown. A wildcard is counted once per feature and added, so it is never expanded into
    scenario x criterion pairs.
    """
    s = scenarios.select("scenario", "feature", "ac").distinct()
    wild = s.filter("ac = '*'").groupBy("feature").agg(F.count(F.lit(1)).alias("_wild"))
    both = s.filter("ac <> '*'").join(
        s.filter("ac = '*'").select("scenario", "feature"), ["scenario", "feature"], "left_anti"
    )
    named = both.groupBy("feature", "ac").agg(F.count(F.lit(1)).alias("_named"))
    known = criteria.select("feature", "ac").distinct().withColumn("_k", F.lit(True))
    total = F.coalesce("_named", F.lit(0)) + F.when(F.col("_k"), F.coalesce("_wild", F.lit(0))).otherwise(0)
    state = F.when(F.col("_k").isNull(), "unknown").when(total > 0, "covered").otherwise("uncovered")
    extra = s.filter("ac <> '*'").groupBy("feature", "ac").agg(F.count(F.lit(1)).alias("_any"))
    return (
        known.join(named, ["feature", "ac"], "full")
        .join(extra, ["feature", "ac"], "full")
        .join(wild, "feature", "left")
        .withColumn("_named", F.when(F.col("_k").isNull(), F.col("_any")).otherwise(F.col("_named")))
        .select("feature", "ac", total.cast("long").alias("scenarios"), state.alias("state"))
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two snapshots; unchanged rows are left out.

    Rows are compared by all shared columns through a 64-bit hash pair, so only keys and hashes travel. The
    hashes pass over nulls, so which columns are null is hashed with them.
    """
    keys = list(keys)
    cols = [c for c in old.columns if c in new.columns and c not in keys]
    nulls = [F.col(c).isNull() for c in cols]
    digest = F.struct(F.xxhash64(*cols, *nulls), F.hash(*cols, *nulls)) if cols else F.struct(F.lit(0))
    a = old.select(*keys, digest.alias("_a"))
    b = new.select(*keys, digest.alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    )
    return a.join(b, keys, "full").select(*keys, change.alias("change")).filter("change IS NOT NULL")


def open_question_counts(sections: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Open questions per feature: list items under its Outstanding Questions heading.

    With ``docs`` (``path``) features whose README has no heading at all count 0; without it they are missing.
    """
    if docs is not None:
        bare = docs.select("path").join(sections.select("path").distinct(), "path", "left_anti")
        sections = sections.unionByName(bare, allowMissingColumns=True)
    return (
        sections.withColumn("feature", feature_id(F.col("path")))
        .filter("feature IS NOT NULL")
        .groupBy("feature")
        .agg(F.coalesce(F.sum(F.when(F.col("title") == "Outstanding Questions", F.col("range_items"))), F.lit(0)).cast("long").alias("oq"))
    )


def subtree_sums(values: DataFrame, column: str, key: str = "feature") -> DataFrame:
    """Sum of a per-feature number over every subtree, and over everything (null key).

    Each row is added to its own ancestors before the shuffle (map-side sums), so a root holding a third
    of the corpus costs one partial row per task.
    """
    up = values.select(F.explode_outer(X.prefixes(F.col(key))).alias(key), column)
    each = up.groupBy(key).agg(F.sum(column).alias(column))
    total = values.agg(F.lit(None).cast("string").alias(key), F.sum(column).alias(column))
    return each.unionByName(total)


def proposals_of(docs: DataFrame) -> DataFrame:
    """(feature, proposal) from documents below a feature's ``proposals`` directory."""
    p = F.col("path")
    feature = F.regexp_extract(p, r"^spec/features/(.+?)/proposals/([^/]+)/README\.md$", 1)
    name = F.regexp_extract(p, r"^spec/features/(.+?)/proposals/([^/]+)/README\.md$", 2)
    return docs.filter(feature != "").select(feature.alias("feature"), name.alias("proposal"))


def feature_list(
    docs: DataFrame, fields: Sequence[str] = (), edges: DataFrame | None = None, sections: DataFrame | None = None,
    plans: DataFrame | None = None,
) -> DataFrame:
    """Features with the requested fields (status, oq, deps, refs, children, plans, proposals).

    Only requested fields enter the plan. ``deps`` is the sorted list from the feature's own document; the
    others that point at a feature from elsewhere are counts, because a popular feature may have any number
    of them (``feature_refs``, ``children_on_disk``, ``proposals_of`` give them as rows).
    """
    from coord.operators import extract as E
    from coord.operators.tasks import select_fields
    from coord.schemas import FEATURE_FIELDS

    def joined(counts: DataFrame, field: str):
        return lambda df: df.join(counts.withColumnRenamed("feature", "id"), "id", "left").withColumn(
            field, F.coalesce(field, F.lit(0)).cast("long")
        )

    def edge_table() -> DataFrame:
        return edges if edges is not None else E.dependency_edges(docs)

    n = lambda name: F.count(F.lit(1)).alias(name)

    def deps(df: DataFrame) -> DataFrame:
        own = edge_table().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
        return df.join(own, "id", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))

    enrich = {
        "oq": lambda df: joined(open_question_counts(sections if sections is not None else E.sections(docs)), "oq")(df),
        "deps": deps,
        "refs": lambda df: joined(feature_refs(edge_table()).groupBy("feature").agg(n("refs")), "refs")(df),
        "children": lambda df: joined(
            children_on_disk(features_of(docs)).groupBy(F.col("parent").alias("feature")).agg(n("children")), "children"
        )(df),
        "plans": lambda df: joined(
            (plans if plans is not None else E.plan_features(docs)).groupBy("feature").agg(n("plans")), "plans"
        )(df),
        "proposals": lambda df: joined(proposals_of(docs).groupBy("feature").agg(n("proposals")), "proposals")(df),
    }
    return select_fields(features_of(docs), list(fields), FEATURE_FIELDS, ["id"], enrich)


def feature_info(docs: DataFrame, asked: DataFrame, plan_docs: DataFrame | None = None) -> DataFrame:
    """One row per asked feature (``id``): status, deps, refs, children, plans and sections.

    ``children`` are the features one level below, with ``in_readme`` whether the Contents section names them;
    ``sections`` are the headings under the title with their lines, parent and, where they are lists, items. Only
    the documents of the asked features and of their children are parsed for sections and children; references
    are looked up in the edges of all features.
    """
    want = asked.select("id").distinct()
    ids = docs.withColumn("id", feature_id(F.col("path"))).filter("id IS NOT NULL")
    own = ids.join(want, "id", "left_semi")
    marks = cut_lineage(marked_lines(own.select("path", "text"), extra=has_link()))
    listed = lambda name, col: F.array_sort(F.collect_set(col)).alias(name)
    edges = cut_lineage(dependency_edges(docs))
    deps = edges.join(want, edges["src"] == want["id"], "left_semi").groupBy(F.col("src").alias("id")).agg(listed("deps", "dst"))
    refs = edges.join(want, edges["dst"] == want["id"], "left_semi").groupBy(F.col("dst").alias("id")).agg(listed("refs", "src"))
    below = ids.select(X.parent_path(F.col("id")).alias("id"), F.col("id").alias("child")).join(want, "id", "left_semi")
    named = links(own, marks).filter("section = 'Contents' AND kind = 'internal'").select(
        feature_id(F.col("path")).alias("id"), F.regexp_extract("target", r"^(?:\./)?([^/]+)/?(?:README\.md)?$", 1).alias("name")
    ).distinct().withColumn("_in", F.lit(True))
    kids = below.withColumn("name", F.element_at(F.split("child", "/"), -1)).join(named, ["id", "name"], "left")
    kids = kids.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("child").alias("path"), F.coalesce("_in", F.lit(False)).alias("in_readme")))).alias("children"))
    heads = sections(own, marks).filter("level > 1").select(feature_id(F.col("path")).alias("id"), F.struct(
        F.col("start_line").alias("start"), F.col("end_line").alias("end"), "title", "level", F.col("parent_line").alias("parent"), F.when(F.col("range_items") > 0, F.col("range_items")).alias("items"),
    ).alias("s"))
    toc = heads.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    out = own.select("id", X.metadata_value(F.col("text"), "Status").alias("status"))
    parts = [(deps, "deps"), (refs, "refs"), (kids, "children"), (toc, "sections")]
    if plan_docs is not None:
        linked = plan_features(plan_docs).withColumnRenamed("feature", "id").join(want, "id", "left_semi")
        parts.append((linked.groupBy("id").agg(listed("plans", "plan")), "plans"))
    for df, name in parts:
        out = out.join(df, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    return out
