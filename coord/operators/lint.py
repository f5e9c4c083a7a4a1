"""Lint rules over a specification corpus; each rule is a function from a corpus to violations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.functions import text as X
from coord.operators import extract as E
from coord.operators.corpus import children_on_disk, features_of, reconcile_index
from coord.session import cut_lineage

SEVERITIES = ["error", "warning", "info"]
OQ = "Outstanding Questions"


class Corpus:
    """Documents ``(path, text)``, optionally source files, and the tables read out of them, each once.

    With ``keep`` an extracted table is written to the shared checkpoint folder when a rule first asks for
    it, so several rules share one parse of the texts.
    """

    def __init__(self, docs: DataFrame, sources: DataFrame | None = None, root: str = "spec", keep: bool = False):
        self.docs, self.sources, self.root, self.keep = docs, sources, root, keep

    def _held(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.keep else df

    @cached_property
    def paths(self) -> DataFrame:
        return self.docs.select("path")

    @cached_property
    def marks(self) -> DataFrame | None:
        """Headings, items and lines with links: the one parse that sections, links and edges are read out of."""
        return cut_lineage(E.marked_lines(self.docs, extra=E.has_link())) if self.keep else None

    @cached_property
    def sections(self) -> DataFrame:
        return self._held(E.sections(self.docs, self.marks))

    @cached_property
    def links(self) -> DataFrame:
        return self._held(E.links(self.docs, self.marks))

    @cached_property
    def features(self) -> DataFrame:
        return self._held(features_of(self.docs))

    @cached_property
    def edges(self) -> DataFrame:
        return self._held(E.dependency_edges(self.docs, self.marks))

    @cached_property
    def plan_features(self) -> DataFrame:
        return self._held(E.plan_features(self.docs))

    def readmes(self) -> DataFrame:
        """Feature and plan READMEs."""
        return self.paths.filter(F.col("path").rlike(r"^spec/(features|plans)/.+/README\.md$"))


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    check: Callable[[Corpus], DataFrame]


RULES: dict[str, Rule] = {}


def register_rule(name: str, severity: str, check: Callable[[Corpus], DataFrame], rules: dict[str, Rule] = RULES) -> Rule:
    """Add a rule: ``check`` returns (file, line, message)."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    if name in rules:
        raise ValueError(f"rule {name} exists")
    rules[name] = Rule(name, severity, check)
    return rules[name]


def rule(name: str, severity: str):
    def wrap(fn):
        register_rule(name, severity, fn)
        return fn

    return wrap


def violations(
    corpus: Corpus,
    rules: list[str] | None = None,
    ignore: list[str] | None = None,
    severity: str = "error",
    known: dict[str, Rule] = RULES,
) -> DataFrame:
    """All violations at or above ``severity`` as (file, line, severity, rule, message)."""
    if rules and ignore:
        raise ValueError("rules and ignore exclude each other")
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    unknown = [r for r in [*(rules or []), *(ignore or [])] if r not in known]
    if unknown:
        raise ValueError(f"unknown rule(s): {', '.join(unknown)}")
    shown = SEVERITIES[: SEVERITIES.index(severity) + 1]
    chosen = [
        r for r in known.values()
        if r.severity in shown and (not rules or r.name in rules) and r.name not in (ignore or [])
    ]
    parts = [
        r.check(corpus).select(
            "file", F.col("line").cast("int").alias("line"), F.lit(r.severity).alias("severity"),
            F.lit(r.name).alias("rule"), "message",
        )
        for r in chosen
    ]
    if not parts:
        return corpus.docs.sparkSession.createDataFrame([], "file string, line int, severity string, rule string, message string")
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame) -> DataFrame:
    return found.orderBy("file", "line")


def violation_summary(found: DataFrame) -> DataFrame:
    """Counts per (severity, rule), per severity and in total; ``passed`` is true when nothing was found.

    The rules run once; the sums are made from one count per rule.
    """
    counts = cut_lineage(found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("violations")))
    none = F.lit(None).cast("string")
    per = counts.groupBy("severity").agg(F.sum("violations").alias("violations")).select("severity", none.alias("rule"), "violations")
    total = counts.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations")).select(none.alias("severity"), none.alias("rule"), "violations")
    return counts.unionByName(per).unionByName(total).withColumn("passed", F.col("violations") == 0)


@rule("readme-exists", "error")
def readme_exists(c: Corpus) -> DataFrame:
    """Every directory below the root holds a README.md; a ``.github`` directory itself is exempt."""
    folder = X.parent_path(F.col("path"))
    dirs = (
        c.paths.filter(F.col("path").startswith(c.root + "/"))
        .select(F.explode_outer(X.prefixes(folder)).alias("file"))
        .filter((F.col("file") != c.root) & ~F.col("file").rlike(r"(^|/)\.github$"))
        .distinct()
    )
    have = c.paths.filter(F.col("path").endswith("/README.md")).select(X.parent_path(F.col("path")).alias("file"))
    return dirs.join(have, "file", "left_anti").select("file", F.lit(0).alias("line"), F.lit("missing README.md").alias("message"))


def _oq(c: Corpus) -> DataFrame:
    return c.sections.filter((F.col("level") == 2) & (F.col("title") == OQ))


@rule("oq-section", "error")
def oq_section(c: Corpus) -> DataFrame:
    return c.readmes().join(_oq(c).select("path"), "path", "left_anti").select(
        F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("missing section " + OQ).alias("message")
    )


@rule("oq-not-empty", "warning")
def oq_not_empty(c: Corpus) -> DataFrame:
    blank = _oq(c).filter("range_items = 0 AND range_nones = 0")
    return blank.join(c.readmes(), "path", "left_semi").select(
        F.col("path").alias("file"), F.col("start_line").alias("line"), F.lit("empty section " + OQ).alias("message")
    )


def listed_children(c: Corpus) -> DataFrame:
    """(parent, child, line, path) named by links of a feature README's Contents section."""
    hit = c.links.filter("section IN ('Contents', 'Index') AND kind = 'internal'")
    parent = E.feature_id(F.col("path"))
    name = F.regexp_extract("target", r"^(?:\./)?([^/]+)(?:/|/README\.md)?$", 1)
    return (
        hit.select("path", "line", parent.alias("parent"), name.alias("n"))
        .filter("parent IS NOT NULL AND n <> '' AND n NOT LIKE '%.%'")
        .groupBy("path", "parent", F.concat_ws("/", "parent", "n").alias("child"))
        .agg(F.min("line").alias("line"))
    )


@rule("index-entries", "error")
def index_entries(c: Corpus) -> DataFrame:
    """READMEs with a Contents section list every child directory and no others."""
    indexed = (
        c.sections.filter("title IN ('Contents', 'Index')")
        .select("path", E.feature_id(F.col("path")).alias("parent"), "start_line")
        .filter("parent IS NOT NULL")
        .groupBy("path", "parent").agg(F.min("start_line").alias("start_line"))
    )
    listed = listed_children(c)
    on_disk = children_on_disk(c.features).join(indexed.select("parent"), "parent", "left_semi")
    gaps = reconcile_index(on_disk, listed).filter("state <> 'ok'")
    lines = listed.select("parent", "child", "line")
    return (
        gaps.join(indexed, "parent").join(lines, ["parent", "child"], "left").select(
            F.col("path").alias("file"), F.coalesce("line", "start_line").alias("line"),
            F.when(F.col("state") == "missing", F.concat(F.lit("child not listed: "), "child"))
            .otherwise(F.concat(F.lit("listed child does not exist: "), "child")).alias("message"),
        )
    )


@rule("heading-levels", "warning")
def heading_levels(c: Corpus) -> DataFrame:
    w = Window.partitionBy("path").orderBy("start_line")
    jump = c.sections.select("path", "start_line", "level", F.lag("level").over(w).alias("prev"))
    return jump.filter("level > prev + 1").select(
        F.col("path").alias("file"), F.col("start_line").alias("line"),
        F.format_string("heading level jumps from %d to %d", "prev", "level").alias("message"),
    )


@rule("feature-ref-syntax", "error")
def feature_ref_syntax(c: Corpus) -> DataFrame:
    """Links towards features (``spec/features/...`` or relative ones) use a well-formed path."""
    target = F.col("target")
    towards = target.startswith(X.FEATURES_ROOT) | target.startswith("../") | target.startswith("./")
    well = target.rlike(r"^(\./|(\.\./)+)?[A-Za-z0-9_-][A-Za-z0-9._-]*(/[A-Za-z0-9_-][A-Za-z0-9._-]*)*/?$") | target.rlike(r"^(\.\./)*\.\./?$")
    return c.links.filter((F.col("kind") == "internal") & towards & ~well).select(
        F.col("path").alias("file"), "line", F.concat(F.lit("malformed feature reference: "), target).alias("message")
    )


def resolved_links(c: Corpus) -> DataFrame:
    """Internal and anchor links with the document they point to (``doc``; null when above the root)."""
    t = F.col("target")
    base = X.parent_path(F.col("path"))
    joined = F.when(t.startswith("spec/") | t.startswith("docs/"), t).when(t.startswith("/"), t).otherwise(F.concat_ws("/", base, t))
    at = X.normal_path(joined)
    last = F.element_at(F.split(at, "/"), -1)
    doc = F.when(last.contains("."), at).otherwise(F.concat_ws("/", at, F.lit("README.md")))
    return c.links.filter("kind <> 'external'").withColumn(
        "doc", F.when(F.col("kind") == "anchor", F.col("path")).when(at.isNotNull(), doc)
    )


def heading_anchors(c: Corpus) -> DataFrame:
    """(doc, anchor) of every heading; repeated ones get ``-1``, ``-2``, ... as on the usual hosts."""
    slug = X.heading_slug(F.col("title"))
    w = Window.partitionBy("path", "slug").orderBy("start_line")
    n = c.sections.select("path", "start_line", slug.alias("slug")).withColumn("n", F.row_number().over(w) - 1)
    return n.select(
        F.col("path").alias("doc"), F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")).alias("anchor")
    ).distinct()


@rule("internal-links", "error")
def internal_links(c: Corpus) -> DataFrame:
    """Targets of README and markdown links exist, and so do the headings their anchors name."""
    links_ = resolved_links(c).filter("doc IS NULL OR doc LIKE '%.md'").withColumn("anchor", F.lower("anchor"))
    docs = c.paths.select(F.col("path").alias("doc")).withColumn("_doc", F.lit(True))
    anchors = heading_anchors(c).withColumn("_anchor", F.lit(True))
    checked = links_.join(docs, "doc", "left").join(anchors, ["doc", "anchor"], "left")
    message = (
        F.when(F.col("_doc").isNull(), F.concat(F.lit("link target not found: "), "target"))
        .when(F.col("anchor").isNotNull() & F.col("_anchor").isNull(), F.concat(F.lit("anchor not found: #"), "anchor"))
    )
    return checked.select(F.col("path").alias("file"), "line", message.alias("message")).filter("message IS NOT NULL")


@rule("forward-refs", "warning")
def forward_refs(c: Corpus) -> DataFrame:
    """Features and plans that do not exist (yet): in dependencies, in the features of plans, and behind links of READMEs.

    Links of a ``Dependencies`` section are named by their labels, so they are the dependencies.
    """
    known = c.features.select(F.lit("feature").alias("kind"), F.col("id").alias("dst"))
    plan = F.regexp_extract("path", r"^spec/plans/(.+)/README\.md$", 1)
    known = known.unionByName(c.paths.select(F.lit("plan").alias("kind"), plan.alias("dst")).filter("dst <> ''")).distinct()
    at = lambda root, name: F.concat(F.lit(root), name, F.lit("/README.md")).alias("file")
    feature, top = F.lit("feature").alias("kind"), F.lit(0).alias("line")
    deps = c.edges.select(at(X.FEATURES_ROOT, "src"), top, feature, "dst")
    plans = c.plan_features.select(at(X.PLANS_ROOT, "plan"), top, feature, F.col("feature").alias("dst"))
    to = lambda g: F.regexp_extract("doc", r"^spec/(feature|plan)s/(.+)/README\.md$", g)
    linked = resolved_links(c).filter("kind = 'internal' AND NOT (section <=> 'Dependencies')").join(c.readmes(), "path", "left_semi")
    linked = linked.select(F.col("path").alias("file"), "line", to(1).alias("kind"), to(2).alias("dst")).filter("dst <> ''").distinct()
    refs = deps.unionByName(plans).unionByName(linked)
    return refs.join(known, ["kind", "dst"], "left_anti").select("file", "line", F.concat(F.lit("unknown "), "kind", F.lit(": "), "dst").alias("message"))


ANNOTATION = r"(?m)^\s*(//|#|--|/\*|\*)\s*Features (implemented|depended on):"


@rule("code-annotations", "warning")
def code_annotations(c: Corpus) -> DataFrame:
    """Source files without a ``Features implemented:`` or ``Features depended on:`` comment."""
    if c.sources is None:
        return c.docs.filter(F.lit(False)).select(F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("").alias("message"))
    return c.sources.filter(~F.col("text").rlike(ANNOTATION)).select(
        F.col("path").alias("file"), F.lit(0).alias("line"), F.lit("no feature annotations").alias("message")
    )
