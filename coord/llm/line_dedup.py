"""Dropping lines that many documents share, with levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coord.llm.common import BLANKS, cut_lineage, lower_ascii, run_folder, text_of, union_all

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 2
KEY = ["k1", "k2"]
HOT_SHARE = 1_000
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of a key, in two numbers."""
    return F.struct(F.xxhash64(F.lit(1), key).alias("k1"), F.xxhash64(F.lit(2), key).alias("k2"))


class LineRuns:
    """Sorted runs of (k1, k2, docs, top) in a shared folder, in levels; ``top`` is the largest document.

    A batch is merge-joined with the runs: keys that no run has (the anti join) enter with their own counts,
    keys that some run has enter with counts brought up to date, and the batch's run is the newest. When a
    level holds more than ``fanout`` runs, they are merged into one run of the next level, newest entry of a
    key kept. So a key is rewritten a logarithmic number of times. Documents of one batch must not come again
    in a later one. Runs are range-sorted files, so a lost executor costs a reread, no recount.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or run_folder(spark, "line-runs"), fanout
        self.levels: list[list[tuple[int, str]]] = []
        self.written = 0

    def _write(self, run: DataFrame) -> tuple[int, str]:
        self.written += 1
        path = f"{self.folder}/run-{self.written}"
        run.select(*KEY, "docs", "top").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        return self.written, path

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame:
        parts = [self.spark.read.schema("k1 long, k2 long, docs long, top long").parquet(path).withColumn("age", F.lit(n)) for n, path in runs]
        return union_all(parts).groupBy(*KEY).agg(F.max_by(F.struct("docs", "top"), "age").alias("e")).select(*KEY, "e.docs", "e.top")

    def all(self) -> DataFrame | None:
        """Newest entry of every key."""
        runs = [r for level in self.levels for r in level]
        return self._read(runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """Take in one batch of (k1, k2, docs, top), one row per key."""
        known = self.all()
        if known is not None:
            a, b = batch.alias("a"), known.alias("b")
            batch = a.join(b, KEY, "left").select(
                *KEY, (F.col("a.docs") + F.coalesce("b.docs", F.lit(0))).alias("docs"), F.greatest("a.top", F.coalesce("b.top", "a.top")).alias("top")
            )
        self._put(0, self._write(batch))

    def _put(self, level: int, run: tuple[int, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) > self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._read(runs)))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(id, drop): hashes of the line keys that each document loses; only documents that lose some.

    Documents come in ``batches`` ranges of their ids, as they would arrive one after the other.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    lines = docs.select(ident.alias("id"), F.explode(F.split(text_of(), "\n", -1)).alias("line")).where(F.length("line") >= min_chars)
    keyed = lines.select("id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select("id", key_hash(F.col("key")).alias("k"))
    cuts = docs.select(ident.alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum([F.when(F.col("id") > int(c), 1).otherwise(0) for c in cuts], F.lit(0))
    folder = run_folder(spark, "lines")
    keyed.select("id", "k.k1", "k.k2", batch.alias("batch")).distinct().write.partitionBy("batch").parquet(folder)
    schema = "id long, k1 long, k2 long, batch int"
    runs = LineRuns(spark)
    for b in range(batches):
        part = spark.read.schema(schema).parquet(folder).where(F.col("batch") == b)
        runs.add(part.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("id").alias("top")))
    many = cut_lineage(runs.all().where(F.col("docs") >= min_docs))
    found = spark.read.schema(schema).parquet(folder).drop("batch")
    # lines of more than a thousandth of the rows are fewer than a thousand: they meet their documents by broadcast
    hot = F.col("docs") * HOT_SHARE > found.count()
    seen = found.join(F.broadcast(many.where(hot)), KEY, "left")
    near = seen.where("docs IS NOT NULL")
    far = seen.where("docs IS NULL").select("id", *KEY).join(many.where(~hot), KEY)
    losing = near.unionByName(far).where(F.col("id") < F.col("top"))
    return losing.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("drop"))


def among(key: Column, keys: Column) -> Column:
    """Whether a key stands in a sorted list, by halving."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        before = F.element_at(keys, middle + 1) < key
        done = at["low"] >= at["high"]
        low = F.when(done | ~before, at["low"]).otherwise(middle + 1)
        return F.struct(low.alias("low"), F.when(done | before, at["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), (F.size(keys) - 1).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(keys))).cast("int"))
    return F.element_at(keys, F.aggregate(rounds, start, halve, lambda at: at["low"] + 1)) == key


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """(row, n_lines, n_dropped, kept): every document's row as a struct and its text without shared lines.

    Texts are split at line breaks; a null or empty text is one empty line. A key is a line without blanks at
    its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more found in ``min_docs`` documents or
    more lose all their lines but those in the largest doc_id holding it. Rows of one doc_id, and all rows
    without one, count as one document, rows without one as the smallest. Lines again in the same document
    stay or go together. The texts move once, to meet the sorted hashes their document loses; each line is looked
    up there by halving, so very long texts cost little more than their length. An empty table gives no rows. Columns of any name pass through in ``row``.
    """
    drops = shared_lines(docs, **how)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.split(text_of(), "\n", -1).alias("lines"))
    met = rows.join(drops, "id", "left")
    long = lambda line: F.length(line) >= how.get("min_chars", MIN_CHARS)
    keyed = F.transform("lines", lambda line: F.struct(line.alias("line"), F.when(long(line), key_hash(line_key(line))).alias("key")))
    stay = F.filter(keyed, lambda x: x["key"].isNull() | ~among(x["key"], F.col("drop")))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda x: x["line"]))
    met = met.select("row", "lines", kept.alias("left"))
    return met.select(
        "row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join("left", "\n").alias("kept"),
    )


def rewritten(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns, texts without shared lines; ``n_chars``, where it is, follows the text.

    Documents that lose no line keep their row as it was, a null text included.
    """
    out = dedup_lines(docs, **how)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    cell = lambda c: F.when(changed, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]
    return out.select(*[cell(c).alias(c) for c in docs.columns])
