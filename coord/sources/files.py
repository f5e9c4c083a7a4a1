"""Reading corpora and logs, writing task lists and boards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coord.functions.status import canonical_status, emoji
from coord.functions.text import duration_seconds
from coord.operators.extract import line_array
from coord.schemas import CHAT_MESSAGE, EVENT


def _read_texts(spark: SparkSession, root: str, at: str, name: str, deep: bool) -> DataFrame:
    """(path, text) of files below ``root`` listed at ``at`` (a folder, or a pattern of files); paths relative to ``root``."""
    reader = spark.read.option("pathGlobFilter", name)
    files = (reader.option("recursiveFileLookup", "true") if deep else reader).text(at, wholetext=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    # percent codes only: a plus sign in a path is a plus sign
    full = F.url_decode(F.replace(plain(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B")))
    below = F.substring(full, F.length(plain(F.lit(top))) + 2, F.length(full))
    return files.select(below.alias("path"), F.col("value").alias("text"))


def _whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return _read_texts(spark, root.rstrip("/"), root.rstrip("/"), glob, True)


def glob_alternatives(pattern: str) -> list[str]:
    """The patterns that braces stand for; a pattern without a slash names files at any depth."""
    depth = 0
    for k, c in enumerate(pattern):
        depth += (c == "{") - (c == "}")
        if depth < 0:
            break
    if depth or pattern.count("[") != pattern.count("]") or not pattern:
        raise ValueError(f"invalid glob {pattern!r}")
    at = pattern.find("{")
    if at < 0:
        return [pattern if "/" in pattern else f"**/{pattern}"]
    end, depth, cuts = at, 0, [at]
    for end in range(at, len(pattern)):
        c = pattern[end]
        depth += (c == "{") - (c == "}")
        if depth == 1 and c == "," or not depth:
            cuts.append(end)
        if not depth:
            break
    parts = [pattern[a + 1:b] for a, b in zip(cuts, cuts[1:])]
    return list(dict.fromkeys(x for part in parts for x in glob_alternatives(pattern[:at] + part + pattern[end + 1:])))


def glob_regex(pattern: str) -> str:
    """Regular expression of a pattern without braces: ``**`` any folders, ``*`` and ``?`` within a name, ``[a-z]`` and ``[!a]``."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] in "*?":
            out, k = out + ("[^/]*" if pattern[k] == "*" else "[^/]"), k + 1
        elif pattern[k] == "[":
            end = pattern.index("]", k + 2)
            inside = pattern[k + 1:end].replace("\\", "\\\\")
            out, k = out + "[" + ("^/" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return f"^{out}$"


def scan_spec_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every markdown file below ``root``; paths relative to it."""
    return _whole_files(spark, root, "*.md")


def discover_features(docs: DataFrame, features_root: str = "spec/features/") -> DataFrame:
    """Feature ids: every directory that holds a README.md, relative to the features directory."""
    got = F.regexp_extract("path", rf"^{features_root}(.+)/README\.md$", 1)
    return docs.filter(got != "").select(got.alias("id"))


def scan_source_tree(spark: SparkSession, root: str, glob: str = "**/*") -> DataFrame:
    """(path, text) of the files below ``root`` whose relative path fits the glob, each once.

    ``**`` stands for any folders, ``{a,b}`` for alternatives, ``[a-z]`` for classes; a glob without a slash
    names files at any depth. Only folders that can hold a match are listed: from the leading part without
    wildcards down, and no deeper than the pattern goes unless it has ``**``.
    """
    root, found = root.rstrip("/"), []
    for pattern in glob_alternatives(glob.strip("/")):
        parts = pattern.split("/")
        fixed = next((k for k, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts) - 1)
        base, deep, name = "/".join([root, *parts[:fixed]]), "**" in pattern, parts[-1]
        try:
            if deep:
                rows = _read_texts(spark, root, base, name if "**" not in name else "*", True)
            else:
                rows = _read_texts(spark, root, "/".join([root, *(x.replace("[!", "[^") for x in parts)]), "*", False)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(rows.filter(F.col("path").rlike(glob_regex(pattern))))
    if not found:
        return spark.createDataFrame([], "path string, text string")
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).dropDuplicates(["path"])


def read_event_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-line events with the common envelope; the payload stays open as VARIANT."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(path).withColumnRenamed("at", "ts")


def payload_values(events: DataFrame, fields: dict[str, str], payload: str = "data") -> DataFrame:
    """The events with fields of their open payload as columns: ``fields`` maps a name to ``path type`` (``$.a.b int``).

    The payload is VARIANT, or JSON text (broken text is null). A missing field, or one of another type, is null.
    """
    value = F.col(payload)
    if isinstance(events.schema[payload].dataType, T.StringType):
        value = F.try_parse_json(value)
    picked = {name: F.try_variant_get(value, *spec.rsplit(" ", 1)) for name, spec in fields.items()}
    return events.withColumns(picked)


def payload_schemas(events: DataFrame, by: str = "type", payload: str = "data") -> DataFrame:
    """(by, events, parsed, schema): what the payloads of each kind of event hold, merged map-side over all of them."""
    value = F.col(payload)
    if isinstance(events.schema[payload].dataType, T.StringType):
        value = F.try_parse_json(value)
    rows = events.select(by, value.alias("_v"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("_v").isNotNull() & ~F.is_variant_null("_v")).alias("parsed"), F.schema_of_variant_agg("_v").alias("schema"))


def read_chat_history(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``<chat id>/history.jsonl`` files; the chat id is the directory name."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(CHAT_MESSAGE).option("recursiveFileLookup", "true").option("pathGlobFilter", "history.jsonl").json(path)
    return rows.withColumn("chat_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/history\.jsonl$", 1))


def ingest_boards(docs: DataFrame) -> DataFrame:
    """Rows of markdown status boards, one per table line; ``error`` is set on rows to quarantine.

    The position is the row's place among the data rows of its document, found inside the document's own
    record, so nothing is shuffled.
    """

    def cells(row: Column) -> Column:
        clean = F.replace(F.replace(row, F.lit("&nbsp;"), F.lit(" ")), F.lit("<br>"), F.lit(" "))
        inner = F.split(F.regexp_replace(clean, r"^\||\|$", ""), r"(?<!\\)\|")
        return F.transform(inner, lambda c: F.when(~F.trim(c).isin("—", "-", ""), F.trim(c)))

    is_row = lambda t: t.startswith("|") & ~t.rlike(r"^\|[-:| ]+$") & ~t.rlike(r"^\|\s*Task\s*\|")
    found = F.filter(F.transform(line_array(F.col("text")), lambda t: F.trim(t)), is_row)
    rows = docs.select(
        F.col("path").alias("board"), F.posexplode_outer(F.transform(found, cells)).alias("ordinal", "c")
    ).filter("c IS NOT NULL")
    cell = lambda i: F.get("c", F.lit(i))
    label = F.regexp_extract(cell(0), r"^\[([^\]]*)\]", 1)
    named = F.regexp_extract(F.coalesce(cell(1), F.lit("")), "`([^`]+)`", 1)
    status = canonical_status(named)
    deps = F.filter(F.transform(F.split(cell(2), ","), lambda d: F.trim(d)), lambda d: d != "")
    when = F.regexp_extract(F.coalesce(cell(6), F.lit("")), r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1)
    took = F.regexp_extract(F.coalesce(cell(6), F.lit("")), r"\(([^)]*)\)", 1)
    error = (
        F.when(F.size("c") != 7, F.concat(F.lit("expected 7 cells, got "), F.size("c").cast("string")))
        .when(cell(0).isNull(), "missing task")
        .when(named == "", "status without backticks")
        .when(status.isNull(), F.concat(F.lit("unknown status "), named))
    )
    return rows.select(
        "board", "ordinal", F.when(label != "", label).otherwise(cell(0)).alias("slug"), status.alias("status"),
        F.coalesce(deps, F.array().cast("array<string>")).alias("depends_on"),
        F.replace(cell(3), F.lit("`"), F.lit("")).alias("branch"), cell(4).alias("agent"), cell(5).alias("requester"),
        cell(6).alias("time"), F.try_to_timestamp(F.when(when != "", when), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("started_at"),
        duration_seconds(took).alias("duration_s"), error.alias("error"),
    )


def ingest_task_docs(docs: DataFrame) -> DataFrame:
    """Task documents as (path, title, description, depends_on, summary, error); whole texts, no shuffle."""
    t = F.col("text")
    title = F.trim(F.regexp_extract(t, r"(?m)^#[ \t]+([^\r\n]+)", 1))
    body = lambda name: F.trim(F.regexp_extract(t, rf"(?ms)^##[ \t]+{name}[ \t]*\r?$\n(.*?)(?=^##[ \t]|\z)", 1))
    has = lambda name: t.rlike(rf"(?m)^##[ \t]+{name}[ \t]*\r?$")
    trim_lines = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    description = trim_lines(F.regexp_extract(t, r"(?ms)^#[ \t]+[^\r\n]+\r?$\n?(.*?)(?=^##[ \t]|\z)", 1))
    deps = trim_lines(body("Dependencies"))
    items = F.transform(F.regexp_extract_all(deps, F.lit(r"(?m)^[-*][ \t]+([^\r\n]+)"), F.lit(1)), lambda d: F.trim(d))
    summary = trim_lines(body("Summary"))
    error = (
        F.when(title == "", "missing title")
        .when(~has("Dependencies"), "missing Dependencies section")
        .when(~has("Summary"), "missing Summary section")
    )
    return docs.select(
        "path", F.when(title != "", title).alias("title"), description.alias("description"),
        F.when(F.lower(deps) == "none", F.array().cast("array<string>")).otherwise(items).alias("depends_on"),
        F.when(F.lower(summary) == "none", "").otherwise(summary).alias("summary"), error.alias("error"),
    )


# Column order of the two list formats.
CSV_HEADER = ["path", "status", "title", "run", "model", "requester", "depends_on", "claimed_at", "updated_at"]
MD_HEADER = ["Path", "Status", "Title", "Run", "Model", "Updated"]


def task_list_rows(tasks: DataFrame) -> DataFrame:
    """Task rows as text in the fixed column order; missing columns and values become empty."""
    have = set(tasks.columns)
    stamp = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def out(name: str) -> Column:
        source = "slug" if name == "path" and "path" not in have else name
        if source not in have:
            return F.lit("")
        kind = tasks.schema[source].dataType.simpleString()
        if kind.startswith("timestamp"):
            got = stamp(source)
        elif kind.startswith("array"):
            got = F.array_join(source, ",")
        else:
            got = F.col(source).cast("string")
        return F.coalesce(got, F.lit(""))

    return tasks.select(*[out(n).alias(n) for n in CSV_HEADER])


def markdown_lines(tasks: DataFrame) -> DataFrame:
    """One table line per task (column ``line``)."""
    cols = ["path", "status", "title", "run", "model", "updated_at"]
    return task_list_rows(tasks).select("path", F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |")).alias("line"))


def write_task_list(tasks: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Write csv (with header), json or a markdown table; each task writes its own part file."""
    if fmt == "csv":
        task_list_rows(tasks).write.mode(mode).option("header", "true").csv(path)
    elif fmt == "json":
        task_list_rows(tasks).write.mode(mode).json(path)
    elif fmt == "md":
        head = tasks.sparkSession.createDataFrame(
            [(0, "", "| " + " | ".join(MD_HEADER) + " |"), (1, "", "|" + "---|" * len(MD_HEADER))], "o int, path string, line string"
        )
        body = markdown_lines(tasks).select(F.lit(2).alias("o"), "path", "line")
        head.unionByName(body).orderBy("o", "path").select("line").write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def render_boards(rows: DataFrame) -> DataFrame:
    """Markdown of status boards as ordered lines (board, section_no, ordinal, line).

    ``rows`` has ``board, section, ordinal`` and the board cells. Lines stay rows, so a board with any
    number of tasks is rendered in parallel; ``write_boards`` stores them in order.
    """
    dash = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("—"))
    code = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), "—").otherwise(F.concat(F.lit("`"), F.col(c), F.lit("`")))
    deps = F.array_join("depends_on", ", ")
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            F.concat(F.lit("["), F.col("slug"), F.lit("]("), F.col("slug"), F.lit("/)")),
            F.concat(emoji(F.col("status")), F.lit(" `"), F.col("status"), F.lit("`")),
            F.when(F.coalesce(deps, F.lit("")) == "", "—").otherwise(deps),
            code("branch"), dash("agent"), dash("requester"), dash("time"),
        ),
        F.lit(" |"),
    )
    no = F.when(F.col("section") == "active", 0).otherwise(1)
    body = rows.select("board", no.alias("section_no"), F.col("ordinal").cast("long").alias("ordinal"), line.alias("line"))
    table = ["| Task | Status | Depends on | Branch | Agent | Requester | Time |", "|---|---|---|---|---|---|---|"]
    heads = {0: ["# Tasks", "", *table], 1: ["", "### Recently Finished", "", *table]}
    present = body.select("board", "section_no").distinct()
    always = present.select("board", F.lit(0).alias("section_no"))
    shown = present.unionByName(always).distinct()
    lead = F.when(
        F.col("section_no") == 0, F.array(*[F.lit(x) for x in heads[0]])
    ).otherwise(F.array(*[F.lit(x) for x in heads[1]]))
    top = shown.select("board", "section_no", F.posexplode(lead).alias("i", "line")).select(
        "board", "section_no", (F.col("i") - 10).cast("long").alias("ordinal"), "line"
    )
    return body.unionByName(top)


def write_boards(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Store rendered boards, one folder per board, lines in order within and across its part files."""
    lines.repartitionByRange("board", "section_no", "ordinal").sortWithinPartitions(
        "board", "section_no", "ordinal"
    ).select("board", "line").write.mode(mode).partitionBy("board").text(path)
