"""Positional inverted index of a specification corpus, kept as tables in shared storage."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coord.functions import text as X
from coord.operators.corpus import classify_documents, document_type
from coord.operators.extract import HEADING, dependency_edges, feature_id, fence_lines, line_array
from coord.operators.search import TYPES
from coord.session import checkpoint_dir

WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
VERSION = 2  # of the tables
RUN = 1_000_000  # so many places of words are gathered and sorted at once
FEW = 1_000  # so many words or paths are named to the scan, which then skips files and row groups; more are joined


def _headings(lines: Column, fences: Column) -> Column:
    """(line, level, title) of every heading outside fenced code."""
    marked = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("t"), (F.size(F.filter(fences, lambda f: f <= i)) % 2 == 0).alias("prose")))
    heads = F.filter(marked, lambda m: m["prose"] & m["t"].rlike(HEADING))
    return F.transform(heads, lambda m: F.struct(
        m["line"].alias("line"), F.length(F.regexp_extract(m["t"], "^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_extract(m["t"], r"^#{1,6}[ \t]+(.*)$", 1)).alias("title")
    ))


def _open_at(heads: Column, line: Column) -> Column:
    """Headings that enclose a line, outermost first."""
    none = F.filter(heads, lambda h: F.lit(False))
    upto = F.filter(heads, lambda h: h["line"] <= line)
    return F.aggregate(upto, none, lambda acc, h: F.concat(F.filter(acc, lambda a: a["level"] < h["level"]), F.array(h)))


def _named(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows with one of the wanted values: named to the scan if they are few, joined otherwise."""
    few = [r[0] for r in wanted.limit(FEW + 1).collect()]
    return rows.where(F.col(column).isin(few)) if len(few) <= FEW else rows.join(wanted, column, "left_semi")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their words as runs of ``path, word, line, pos``: one row per document and word, sorted by word."""
    def run(lines: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(lines).combine_chunks()
        words = t["words"].combine_chunks()
        of, ends = pc.list_parent_indices(words), np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], ends])[:-1]
        pos = np.arange(len(of)) - starts[of.to_numpy()]
        places = pa.table({"path": t["path"].take(of), "word": pc.list_flatten(words), "line": t["line"].take(of), "pos": pa.array(pos, pa.int32())})
        lists = places.group_by(["path", "word"], use_threads=False).aggregate([("line", "list"), ("pos", "list")]).sort_by([("word", "ascending"), ("path", "ascending")])
        yield from lists.select(["path", "word", "line_list", "pos_list"]).rename_columns(["path", "word", "line", "pos"]).to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("words").flatten())
        if n >= RUN:
            yield from run(held)
            held, n = [], 0
    if n:
        yield from run(held)


class SearchIndex:
    """Index in ``folder``: segments of documents, each with a vocabulary, postings, and texts sorted by path.

    Postings hold one row per document and word with the lists of its lines and places. They are written where the
    texts are read, in runs sorted by word, of which a scan reads the pages of the words it asks for; no place of a
    word is shuffled.

    A segment holds the documents that were new or changed when it was made; its ``dead`` names those of earlier
    segments that it replaces or that are gone. ``merge`` writes all live documents as one segment. A segment
    counts once the manifest names it, so one left half written is passed over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        try:
            named = spark.read.schema("seg int, base boolean").parquet(f"{folder}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            named = []
        base = max((r["seg"] for r in named if r["base"]), default=0)
        self.segments = sorted({r["seg"] for r in named if r["seg"] >= base})

    def _read(self, part: str) -> DataFrame:
        """A part of all segments, without documents replaced since."""
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/seg={s}/{part}").withColumn("seg", F.lit(s)) for s in self.segments])
        if len(self.segments) == 1 or part == "vocabulary":
            return rows.drop("seg")
        dead = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/seg={s}/dead").withColumn("by", F.lit(s)) for s in self.segments[1:]])
        dead = dead.groupBy("path").agg(F.max("by").alias("by"))
        return rows.join(dead, "path", "left").where("by IS NULL OR seg >= by").drop("seg", "by")

    def update(self, docs: DataFrame) -> None:
        """Take over the documents (``path, text``) as they are now; only new and changed ones are indexed."""
        fresh = docs.where("text IS NOT NULL").select("path", "text", F.sha2("text", 256).alias("hash"))
        if not self.segments:
            return self._write(0, True, fresh, None)
        live = self._read("texts").select("path", F.col("hash").alias("old"))
        moved = fresh.select("path", "hash").join(live, "path", "full").where("NOT (hash <=> old)")
        if not moved.isEmpty():
            changed = fresh.join(moved.where("hash IS NOT NULL").select("path"), "path", "left_semi")
            self._write(self.segments[-1] + 1, False, changed, moved.where("old IS NOT NULL").select("path"))

    def merge(self) -> None:
        """All live documents in one new segment."""
        self._write(self.segments[-1] + 1, True, self._read("texts").select("path", F.array_join("ls", "\n").alias("text"), "hash"), None)

    def _write(self, seg: int, base: bool, docs: DataFrame, gone: DataFrame | None) -> None:
        at = f"{self.folder}/seg={seg}"
        placed = docs.select("path", "hash", "text").repartitionByRange("path").sortWithinPartitions("path")
        rows = placed.select("path", "hash", "text", line_array(F.col("text")).alias("ls"), X.metadata_value(F.col("text"), "Status").alias("status"))
        rows = rows.withColumn("heads", _headings(F.col("ls"), fence_lines(F.col("text"), F.col("ls")))).drop("text")
        rows.write.mode("overwrite").parquet(f"{at}/texts")
        texts = self.spark.read.parquet(f"{at}/texts")
        lines = texts.select("path", F.posexplode("ls").alias("line", "t")).select("path", (F.col("line") + 1).alias("line"), F.regexp_extract_all(F.lower("t"), F.lit(f"({WORD})")).alias("words"))
        postings = lines.where("size(words) > 0").mapInArrow(_gathered, "path string, word string, line array<int>, pos array<int>")
        postings.write.mode("overwrite").parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/postings").groupBy("word").agg(F.sum(F.size("line")).alias("count")).write.mode("overwrite").parquet(f"{at}/vocabulary")
        edges = dependency_edges(docs.select("path", "text"))
        edges.select(F.concat(F.lit(X.FEATURES_ROOT), "src", F.lit("/README.md")).alias("path"), "src", "dst").write.mode("overwrite").parquet(f"{at}/edges")
        (texts.select("path").where(F.lit(False)) if gone is None else gone).write.mode("overwrite").parquet(f"{at}/dead")
        self.spark.createDataFrame([(seg, base)], "seg int, base boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.segments = [seg] if base else [*self.segments, seg]

    def sizes(self) -> DataFrame:
        """(documents, lines, words, places) of the live documents."""
        texts = self._read("texts").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("ls")), F.lit(0)).alias("lines"))
        places = self._read("postings").agg(F.countDistinct("word").alias("words"), F.coalesce(F.sum(F.size("line")), F.lit(0)).alias("places"))
        return texts.join(places, F.lit(True))

    def features(self) -> DataFrame:
        """(id, status) of every feature, without reading a text."""
        return self._read("texts").select(feature_id(F.col("path")).alias("id"), "status").where("id IS NOT NULL")

    def edges(self) -> DataFrame:
        """(src, dst) dependencies of features."""
        return self._read("edges").select("src", "dst")

    def _places(self, number: int, term: str) -> DataFrame:
        """(path, line, term) of lines that may hold a term: words around it at its ends, its own words between, in a row."""
        pieces = _WORD.findall(term)
        if not pieces:  # nothing but signs
            at = self._read("texts").select("path", F.posexplode("ls").alias("line", "t")).where(F.lower("t").contains(term))
            return at.select("path", (F.col("line") + 1).alias("line"), F.lit(number).alias("term"))
        alone, word = len(pieces) == 1, F.col("word")
        found = []
        for k, piece in enumerate(pieces):
            fits = word.contains(piece) if alone else word.endswith(piece) if k == 0 else word.startswith(piece) if k == len(pieces) - 1 else word == piece
            rows = _named(self._read("postings"), "word", self._read("vocabulary").where(fits).select("word").distinct())
            if alone:
                return rows.select("path", F.explode(F.array_distinct("line")).alias("line"), F.lit(number).alias("term")).distinct()
            each = rows.select("path", F.explode(F.arrays_zip("line", "pos")).alias("p"))
            found.append(each.select("path", "p.line", (F.col("p.pos") - k).alias("pos"), F.lit(k).alias("k")))
        rows = reduce(DataFrame.unionByName, found).groupBy("path", "line", "pos").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(pieces))
        return rows.select("path", "line", F.lit(number).alias("term")).distinct()

    def search(
        self, query: str, phrase: bool = False, feature: str | None = None, section: str | None = None, status: str | None = None,
        type: str | None = None, context: int = 2, plans: DataFrame | None = None,  # noqa: A002
    ) -> DataFrame:
        """Matching lines as ``search.search_specs`` gives them.

        A term matches anywhere in a line, also within words: the vocabulary tells which words hold it. Only the
        postings of these and the texts of documents that hold all terms are read; a term of several words must
        stand in a row, and is compared with the line at the end. Status and owner are looked up for matched
        documents only; ``plans`` (``plan, feature``) gives plan documents an owner.
        """
        if type is not None and type not in TYPES:
            raise ValueError(f"unknown type {type}; known: {', '.join(TYPES)}")
        whole = query.lower() if phrase else " ".join(query.lower().split())
        terms = [whole] if phrase else whole.split()
        if not terms:
            raise ValueError("empty query")
        places = reduce(DataFrame.unionByName, [self._places(k, t) for k, t in enumerate(terms)])
        if feature is not None:
            places = places.where(X.in_subtree(F.col("path"), X.FEATURES_ROOT + feature.strip("/")))
        if type is not None:
            places = places.where(document_type(F.col("path")) == type)
        hit = places.groupBy("path").agg(F.collect_set("line").alias("at"), F.countDistinct("term").alias("n")).where(F.col("n") == len(terms))
        hit = hit.select("path", F.array_sort("at").alias("at"))
        few = [r[0] for r in hit.select("path").limit(FEW + 1).collect()]
        texts = self._read("texts")
        texts = (texts.where(F.col("path").isin(few)) if len(few) <= FEW else texts).join(hit, "path")

        low = lambda m: F.lower(m["text"])
        line = lambda n: F.struct(n.alias("line"), F.element_at("ls", n).alias("text"), _open_at(F.col("heads"), n).alias("open"))
        found = F.filter(F.transform("at", line), lambda m: reduce(or_, [low(m).contains(t) for t in terms]))
        if section is not None:
            want = section.lower()
            found = F.filter(found, lambda m: F.exists(m["open"], lambda h: F.lower(h["title"]).contains(want) | (X.initials(h["title"]) == want)))
        rows = texts.select("path", "ls", "heads", found.alias("found"))
        rows = rows.where(_all(terms, low))
        rows = rows.select("path", "ls", "heads", F.explode("found").alias("m"))
        start = F.greatest(F.col("m.line") - context, F.lit(1))
        near = F.slice("ls", start, F.least(F.col("m.line") - 1, F.lit(context)) + 1 + context)
        text = F.lower("m.text")
        heading = F.exists("heads", lambda h: h["line"] == F.col("m.line"))
        all_here = reduce(and_, [text.contains(t) for t in terms])
        matches = rows.select(
            "path", F.col("m.line").alias("line"), F.when(heading & all_here, 1).when(text.contains(whole), 2).otherwise(3).alias("tier"), F.col("m.text").alias("text"),
            F.transform(near, lambda x, k: F.struct((start + k).alias("line"), x.alias("text"))).alias("context"),
            _section().alias("section"),
        )
        placed = matches.join(classify_documents(hit.select("path"), self.features(), plans), "path", "left")
        if status is not None:
            placed = placed.where(F.col("status") == status)
        return placed.select("path", "line", "tier", "text", "context", "section", "feature", "status", "type")


def _all(terms: list[str], low) -> Column:
    """Whether every term stands in one of the lines found."""
    has = lambda t: F.exists("found", lambda m: low(m).contains(t))
    return reduce(and_, [has(t) for t in terms])


def _section() -> Column:
    """Title of the latest heading up to the line."""
    heads = F.filter("heads", lambda h: h["line"] <= F.col("m.line"))
    return F.try_element_at(heads, F.lit(-1))["title"]


def index_of(docs: DataFrame, name: str) -> SearchIndex:
    """The index of a table of documents, in the shared checkpoint folder.

    It is named after the files the table is read from, their times and sizes, so it is made once and made anew
    when the files change. A table that is read from no files gets an index of its own.
    """
    spark, files = docs.sparkSession, docs.inputFiles()
    key = uuid.uuid4().hex
    if files:
        seen = spark.read.format("binaryFile").load(files).select("path", F.col("modificationTime").cast("string"), "length")
        key = hashlib.sha256("|".join(sorted(map(str, map(tuple, seen.collect())))).encode()).hexdigest()[:24]
    index = SearchIndex(spark, f"{checkpoint_dir(spark).rstrip('/').rpartition('/')[0]}/search-{VERSION}-{name}-{key}")
    if not index.segments:
        index.update(docs)
    return index
