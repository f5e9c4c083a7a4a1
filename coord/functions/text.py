"""Paths, durations, references and markdown lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES_ROOT = "spec/features/"
PLANS_ROOT = "spec/plans/"


def parent_path(path: Column) -> Column:
    """Everything before the last ``/``; empty for a root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    """0 for a root, one more per ``/``."""
    return F.size(F.split(path, "/")) - 1


def prefixes(path: Column, sep: str = "/") -> Column:
    """All ancestors of a path and the path itself, shortest first."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def in_subtree(path: Column, root: str) -> Column:
    """Equal to ``root`` or below it."""
    root = root.strip("/")
    return (path == root) | path.startswith(root + "/")


def duration_seconds(raw: Column) -> Column:
    """Seconds of a duration such as ``4m32s``, ``5m``, ``1h``; null when it is not one."""
    text = F.lower(F.trim(raw))
    unit = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}(?![a-z])", 1).try_cast("long"), F.lit(0))
    valid = text.rlike(r"^(\d+d)?(\d+h)?(\d+m)?(\d+s)?$") & (text != "")
    return F.when(valid, unit("d") * 86400 + unit("h") * 3600 + unit("m") * 60 + unit("s"))


def sync_policy(raw: Column) -> Column:
    """Struct (policy, interval_s) of ``manual``, ``on_commit``, ``on_interval=5m`` and the like."""
    kind = F.split_part(raw, F.lit("="), F.lit(1))
    spec = F.split_part(raw, F.lit("="), F.lit(2))
    return F.struct(kind.alias("policy"), F.when(kind == "on_interval", duration_seconds(spec)).alias("interval_s"))


def repo_ref(raw: Column) -> Column:
    """Struct (hosting, org, repo) of a short path, https or ssh reference; nulls when it is invalid."""
    text = F.trim(raw)
    ssh = F.regexp_extract(text, r"^git@([^:]+):([^/]+)/([^/]+?)/?$", 0) != ""
    url = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)/([^/]+)/([^/]+?)/?$", 0) != ""
    short = ~text.startswith("git@") & ~text.contains("://") & text.rlike(r"^[^/]+/[^/]+/[^/]+$")

    def part(i: int) -> Column:
        got = (
            F.when(ssh, F.regexp_extract(text, r"^git@([^:]+):([^/]+)/([^/]+?)/?$", i))
            .when(url, F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)/([^/]+)/([^/]+?)/?$", i))
            .when(short, F.split_part(text, F.lit("/"), F.lit(i)))
        )
        return F.regexp_replace(got, r"\.git$", "") if i == 3 else got

    whole = (part(1) != "") & (part(2) != "") & (part(3) != "")
    return F.struct(*[F.when(whole, part(i)).alias(n) for i, n in ((1, "hosting"), (2, "org"), (3, "repo"))])


def stakeholder(raw: Column) -> Column:
    """Struct (id, platform, params, is_agent, identity) of ``id[@platform][:key=value,...]``.

    ``identity`` is id and platform without parameters: the same person on two platforms is two people,
    the same reference with and without parameters is one.
    """
    text = F.trim(raw)
    head = F.split_part(text, F.lit(":"), F.lit(1))
    tail = F.regexp_extract(text, "^[^:]*:(.*)$", 1)
    platform = F.when(head.contains("@"), F.split_part(head, F.lit("@"), F.lit(2)))
    return F.struct(
        F.split_part(head, F.lit("@"), F.lit(1)).alias("id"),
        platform.alias("platform"),
        F.when(tail != "", F.str_to_map(tail, F.lit(","), F.lit("="))).alias("params"),
        platform.isNull().alias("is_agent"),
        head.alias("identity"),
    )


def heading_slug(title: Column) -> Column:
    """Anchor of a heading: lower case, punctuation dropped, letters of all scripts kept, blanks to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N} _-]", ""), " ", "-")


def initials(title: Column) -> Column:
    """First letters of the words, lower-cased (``Outstanding Questions`` gives ``oq``)."""
    return F.lower(F.array_join(F.transform(F.split(F.trim(title), r"\s+"), lambda w: F.substring(w, 1, 1)), ""))


def metadata_value(text: Column, key: str) -> Column:
    """Value of a ``**Key:** value`` header line; null when absent or blank."""
    got = F.trim(F.regexp_extract(text, rf"(?m)^\*\*{key}:\*\*[ \t]*([^\r\n]*)", 1))
    return F.when(got != "", got)


def normal_path(path: Column) -> Column:
    """Path without ``.``, ``..`` and empty parts; null when it climbs above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")

    def step(acc: Column, p: Column) -> Column:
        popped = F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1) != up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(up)))
        return F.when(p == up, popped).otherwise(F.concat(acc, F.array(p)))

    flat = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(flat, ".."), F.array_join(flat, "/"))
