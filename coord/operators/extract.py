"""Tables read out of markdown and source text: lines, sections, metadata, edges, links, references.

Documents arrive as ``(path, text)``. Everything that can be decided from one line is decided before any
shuffle; only the few marked lines (headings, fences, list items, hits) are sorted per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.functions import text as X

HEADING = r"^#{1,6}[ \t]+\S"
FENCE = r"^ {0,3}(```|~~~)"
ITEM = r"^([-*+]|\d+[.)])[ \t]+\S"
NONE_LINE = "None at this time."
MARK = r"^(?:#{1,6}[ \t]+\S| {0,3}(?:```|~~~)|(?:[-*+]|\d+[.)])[ \t]+\S| *None at this time\. *$)"
LINK = r"\[([^\]]*)\]\(([^)]*)\)|<a\s[^>]*href=\"([^\"]*)\""


def line_array(text: Column) -> Column:
    """Lines of a text without the empty piece after a final newline."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    whole = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.split(whole, "\n")


def fence_lines(text: Column, line_list: Column) -> Column:
    """Places (from 0) of the lines that open or close fenced code.

    A fence is closed by the same sign, at least as long and with nothing after it; other fence lines inside are
    code. One of backticks opens only without a backtick behind it. An open fence runs to the end.
    """
    found = F.filter(
        F.transform(
            line_list,
            lambda x, i: F.struct(
                i.alias("at"), F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})", 1).alias("sign"),
                x.rlike(r"^ {0,3}(`{3,}|~{3,})[ \t]*$").alias("bare"), x.rlike(r"^ {0,3}(`{3,}[^`]*|~{3,}.*)$").alias("opens"),
            ),
        ),
        lambda f: f["sign"] != "",
    )

    def step(acc: Column, f: Column) -> Column:
        counts = F.when(acc["sign"] == "", f["opens"]).otherwise(f["bare"] & f["sign"].startswith(acc["sign"]))
        sign = F.when(acc["sign"] == "", f["sign"]).otherwise("")
        return F.when(counts, F.struct(sign.alias("sign"), F.concat(acc["at"], F.array(f["at"])).alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("sign"), F.array().cast("array<int>").alias("at"))
    some = text.contains("```") | text.contains("~~~")
    return F.when(some, F.aggregate(found, start, step)["at"]).otherwise(F.array().cast("array<int>"))


def has_link() -> Column:
    """Whether a marked line may hold a link."""
    return F.col("line_text").contains("](") | F.col("line_text").contains("href=")


def marked_lines(
    docs: DataFrame, extra: Column | None = None, context: int | None = None, levels: bool = False
) -> DataFrame:
    """Headings, list items and ``extra`` lines (a condition on column ``line_text``) of every document.

    Adds ``in_code`` and ``section``, the (line, title) of the latest heading up to the line; with ``levels``
    also the latest heading of each level (``h1`` .. ``h6``). With
    ``context`` each extra line carries the lines around it, cut at the ends of the file.

    Arrays are exploded with the ``outer`` form: for the plain form Spark adds a filter on the array's size, which
    would split every text twice.
    """
    arr = docs.filter("text IS NOT NULL").select("path", "text", line_array(F.col("text")).alias("_ls"))
    arr = arr.select("path", "_ls", fence_lines(F.col("text"), F.col("_ls")).alias("_fences"))
    rows = arr.select("path", F.size("_ls").alias("n_lines"), "_ls", "_fences", F.posexplode_outer("_ls").alias("_i", "line_text"))
    t, i = F.col("line_text"), F.col("_i")
    want = F.coalesce(extra, F.lit(False)) if extra is not None else F.lit(False)
    around = []
    if context is not None:
        start = F.greatest(i + 1 - context, F.lit(1))
        near = F.slice("_ls", start, F.least(i, F.lit(context)) + 1 + context)
        near = F.transform(near, lambda x, k: F.struct((start + k).alias("line"), x.alias("text")))
        around = [F.when(want, near).alias("context")]
    rows = rows.filter(t.rlike(MARK) | want).select(
        "path", "n_lines", (i + 1).alias("line"), "line_text",
        (t.rlike(FENCE) & F.array_contains("_fences", i)).alias("_fence"), t.rlike(FENCE).alias("_like"),
        t.rlike(HEADING).alias("_head"), t.rlike(ITEM).alias("_item"), (F.trim(t) == NONE_LINE).alias("_none"),
        want.alias("is_extra"), *around,
    )
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.coalesce(F.sum(F.col("_fence").cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("in_code", (fences % 2 == 1) | F.col("_fence"))
    prose = ~F.col("in_code")
    is_heading = F.col("_head") & prose
    level = F.when(is_heading, F.length(F.regexp_extract("line_text", "^(#{1,6})", 1)))
    title = F.when(is_heading, F.trim(F.regexp_extract("line_text", r"^#{1,6}[ \t]+(.*)$", 1)))
    rows = rows.filter("NOT _fence AND (NOT _like OR is_extra)").withColumns(
        {
            "level": level, "title": title, "is_heading": is_heading,
            "is_item": F.col("_item") & prose, "is_none": F.col("_none") & prose,
        }
    ).drop("_fence", "_like", "_head", "_item", "_none")
    latest = lambda cond: F.last(F.when(cond, F.struct("line", "title")), ignorenulls=True).over(upto)
    heads = {"section": latest(F.col("is_heading"))}
    if levels:
        heads |= {f"h{k}": latest(F.col("level") == k) for k in range(1, 7)}
    return rows.withColumns(heads)


def enclosing() -> Column:
    """Array of the titles of the headings that enclose a marked line, outermost first.

    A heading of level k is still open when no heading of a smaller level came after it.
    """
    open_heads = []
    for k in range(1, 7):
        h = F.col(f"h{k}")
        later = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{j}")["line"], F.lit(0)) for j in range(1, k)])
        open_heads.append(F.when(h["line"] > later, h["title"]))
    return F.array_compact(F.array(*open_heads))


def sections(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Headings with their line range, parent heading and list items; fenced code is ignored.

    A section ends before the next heading of the same or a higher level. ``items`` counts unindented
    list items of the section's own body, ``range_items`` those of the whole range. ``marks`` may give the marked
    lines of the documents, here and below, where several tables are read out of one parse.
    """
    marks = marked_lines(docs) if marks is None else marks
    asc = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("path")
    n = lambda c: F.col(c).cast("int")
    heads = (
        marks.withColumns(
            {
                "_items": F.sum(n("is_item")).over(asc), "_nones": F.sum(n("is_none")).over(asc),
                "_all_items": F.sum(n("is_item")).over(whole), "_all_nones": F.sum(n("is_none")).over(whole),
            }
        )
        .filter("is_heading")
        .drop("section")
    )
    at = Window.partitionBy("path").orderBy("line")
    after = Window.partitionBy("path").orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("line", "_items", "_nones")
    nexts = {f"_n{k}": F.last(F.when(F.col("level") <= k, here), ignorenulls=True).over(after) for k in range(1, 7)}
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    up = {
        f"_p{k}": F.last(F.when(F.col("level") < k, F.struct("line", "title")), ignorenulls=True).over(before)
        for k in range(2, 7)
    }
    heads = heads.withColumns({"_next_items": F.lead("_items").over(at), **up}).withColumns(nexts)
    own = lambda prefix, first: F.coalesce(*[F.when(F.col("level") == k, F.col(f"{prefix}{k}")) for k in range(first, 7)])
    heads = heads.withColumns({"_next": own("_n", 1), "_parent": own("_p", 2)})
    return heads.select(
        "path", "level", "title", F.col("line").alias("start_line"),
        F.coalesce(F.col("_next")["line"] - 1, F.col("n_lines")).cast("int").alias("end_line"),
        F.col("_parent")["line"].alias("parent_line"), F.col("_parent")["title"].alias("parent_title"),
        (F.coalesce("_next_items", "_all_items") - F.col("_items")).alias("items"),
        (F.coalesce(F.col("_next")["_items"], F.col("_all_items")) - F.col("_items")).alias("range_items"),
        (F.coalesce(F.col("_next")["_nones"], F.col("_all_nones")) - F.col("_nones")).alias("range_nones"),
    )


def metadata(docs: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Title (first level-1 heading, else the directory name) and ``**Key:** value`` header fields."""
    keys = keys or {
        "status": "Status", "effort": "Effort", "impact": "Impact", "author": "Author",
        "created": "Created", "features": "Features",
    }
    heading = F.trim(F.regexp_extract("text", r"(?m)^[ \t]*#[ \t]+([^\r\n]*)", 1))
    fallback = F.element_at(F.split(X.parent_path(F.col("path")), "/"), -1)
    return docs.select(
        "path", F.when(heading != "", heading).otherwise(fallback).alias("title"),
        *[X.metadata_value(F.col("text"), k).alias(n) for n, k in keys.items()],
    )


def links(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Markdown and HTML links outside code: (path, line, section, label, target, anchor, kind).

    Kind is ``anchor`` (same document), ``external`` (has a scheme) or ``internal``.
    """
    marks = marked_lines(docs, extra=has_link()) if marks is None else marks
    rows = marks.filter(has_link()).filter("NOT in_code")
    sect = F.col("section")["title"]
    t = F.col("line_text")
    found = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(LINK), F.lit(1)).alias("label"),
        F.regexp_extract_all(t, F.lit(LINK), F.lit(2)).alias("md"),
        F.regexp_extract_all(t, F.lit(LINK), F.lit(3)).alias("html"),
    )
    ex = rows.select("path", "line", sect.alias("section"), F.explode_outer(found).alias("l")).filter("l IS NOT NULL")
    raw = F.trim(F.when(F.col("l")["html"] != "", F.col("l")["html"]).otherwise(F.col("l")["md"]))
    raw = F.regexp_replace(raw, r"\s+\"[^\"]*\"$", "")
    target = F.split_part(raw, F.lit("#"), F.lit(1))
    anchor = F.split_part(raw, F.lit("#"), F.lit(2))
    kind = (
        F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | raw.startswith("//"), "external")
        .when(target == "", "anchor")
        .otherwise("internal")
    )
    external = raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | raw.startswith("//")
    return ex.select(
        "path", "line", "section", F.col("l")["label"].alias("label"),
        F.when(external, raw).otherwise(target).alias("target"),
        F.when(external | (anchor == ""), F.lit(None)).otherwise(anchor).alias("anchor"), kind.alias("kind"),
    )


def feature_id(path: Column) -> Column:
    """Id of the feature a README belongs to; null for other documents."""
    got = F.regexp_extract(path, r"^spec/features/(.+)/README\.md$", 1)
    return F.when((got != "") & ~got.rlike("(^|/)proposals(/|$)"), got)


def dependency_edges(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(src, dst) from list items under a ``Dependencies`` heading; links count by their label."""
    rows = (marked_lines(docs) if marks is None else marks).filter("is_item")
    sect = F.col("section")["title"]
    body = F.trim(F.regexp_replace("line_text", r"^([-*+]|\d+[.)])[ \t]+", ""))
    label = F.regexp_extract(body, r"^\[([^\]]*)\]", 1)
    dst = F.regexp_extract(F.regexp_replace(F.when(label != "", label).otherwise(body), "`", ""), r"^(\S+)", 1)
    return (
        rows.select(feature_id(F.col("path")).alias("src"), sect.alias("s"), dst.alias("dst"))
        .filter("src IS NOT NULL AND s = 'Dependencies' AND lower(dst) <> 'none' AND dst <> ''")
        .select("src", "dst")
        .distinct()
    )


def plan_features(docs: DataFrame) -> DataFrame:
    """(plan, feature) from the ``**Features:**`` header of plan documents."""
    plan = F.regexp_extract("path", r"^spec/plans/(.+)/README\.md$", 1)
    listed = F.explode(F.split(X.metadata_value(F.col("text"), "Features"), ","))
    return (
        docs.filter(plan != "")
        .select(plan.alias("plan"), listed.alias("f"))
        .select("plan", F.regexp_replace(F.trim(F.regexp_replace("f", r"^\s*\[([^\]]*)\].*$", "$1")), "`", "").alias("feature"))
        .filter("feature <> ''")
        .distinct()
    )


# Reference type -> folder it stands for.
REF_ROOTS = {"feature": "spec/features/", "plan": "spec/plans/", "doc": "docs/"}
COMMENT = r"^\s*(//|#|--|/\*|\*|;|%|<!--)"


def source_refs(
    files: DataFrame, scheme: str = "spec", site: str = "https://spec.example/", kind: str | None = None
) -> DataFrame:
    """References in comment lines: (file, type, target, repo), each once per file.

    ``<scheme>:feature/x`` and the long ``<site>feature/x`` stand for ``spec/features/x``; an ``@host/org/repo``
    suffix names another repository and is kept.
    """
    if kind is not None and kind not in REF_ROOTS:
        raise ValueError(f"unknown type {kind}; known: {', '.join(REF_ROOTS)}")
    start = "|".join(p.replace(".", r"\.") for p in (scheme + ":", site))
    pattern = rf"(?:{start})((?:feature|plan|doc)/[A-Za-z0-9._/-]+(?:@[A-Za-z0-9.-]+/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+)?)"
    hits = (
        files.filter(F.col("text").contains(scheme + ":") | F.col("text").contains(site))
        .select("path", F.explode_outer(line_array(F.col("text"))).alias("t"))
        .filter((F.col("t").contains(scheme + ":") | F.col("t").contains(site)) & F.col("t").rlike(COMMENT))
        .select("path", F.explode_outer(F.regexp_extract_all("t", F.lit(pattern), F.lit(1))).alias("r"))
        .filter("r IS NOT NULL")
    )
    head = F.split_part("r", F.lit("@"), F.lit(1))
    kind_col = F.split_part(head, F.lit("/"), F.lit(1))
    rest = F.regexp_replace(F.regexp_extract(head, "^[a-z]+/(.*)$", 1), r"[./]+$", "")
    root = F.when(kind_col == "feature", REF_ROOTS["feature"]).when(kind_col == "plan", REF_ROOTS["plan"]).otherwise(REF_ROOTS["doc"])
    repo = F.split_part("r", F.lit("@"), F.lit(2))
    out = hits.select(
        F.col("path").alias("file"), kind_col.alias("type"), F.concat(root, rest).alias("target"),
        F.when(repo != "", repo).alias("repo"),
    )
    if kind is not None:
        out = out.filter(F.col("type") == kind)
    return out.distinct()


def stakeholders(refs: DataFrame, column: str = "ref", keys: tuple[str, ...] = ()) -> DataFrame:
    """Parsed stakeholder references, one row per identity (and per ``keys``)."""
    return (
        refs.select(*keys, X.stakeholder(F.col(column)).alias("s"))
        .select(*keys, "s.identity", "s.id", "s.platform", "s.is_agent")
        .filter("id <> ''")
        .distinct()
    )


def link_census(refs: DataFrame, column: str = "raw", source: str = "source") -> DataFrame:
    """Repository references normalised and counted per source; invalid ones are kept as they are."""
    parsed = refs.select(F.col(source), F.col(column).alias("_raw"), X.repo_ref(F.col(column)).alias("r"))
    valid = F.col("r.hosting").isNotNull()
    name = F.when(valid, F.concat_ws("/", "r.hosting", "r.org", "r.repo")).otherwise(F.trim("_raw"))
    return parsed.groupBy(F.col(source), name.alias("target"), valid.alias("valid")).agg(F.count(F.lit(1)).alias("links"))
