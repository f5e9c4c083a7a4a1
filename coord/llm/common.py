"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coord.streaming.io import run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"  # \x20 \x09-\x0D

__all__ = ["BLANKS", "components", "cut_lineage", "fold_of", "hot_join", "lower_ascii", "run_folder", "smallest_hashes", "table", "text_of", "union_all"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    Unlike a checkpoint, the new plan keeps nothing of the old one, so loops stay as cheap as their first round.
    """
    path = run_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def smallest_hashes(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label from distinct (doc_id, label): those with the smallest hashes of their ids.

    The number of rows of a label tells below which hash about ``per_label`` of them lie (with six standard
    deviations to spare), so the task that ranks a label reads about that many, however many there are. One
    number per label reaches the driver.
    """
    rows = cut_lineage(rows.select("doc_id", label))
    enough = per_label + 6 * per_label**0.5 + 20
    below = []
    for r in rows.groupBy(label).count().collect():
        top = int(2**64 * enough / r["count"]) - 2**63
        below += [F.lit(r[label]), F.lit(min(top, 2**63 - 1))]
    if not below:
        return rows
    h = F.xxhash64("doc_id")
    near = rows.where(h <= F.element_at(F.create_map(*below), F.col(label)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= per_label).drop("_rank")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node reachable from it.

    Rounds of contraction: every node joins the first of its neighbours and itself in an order that is the order
    of the nodes in the first round (which settles stars around their smallest node) and one of fresh hashes
    later (which halves chains and trees, in a logarithmic number of rounds). Edges between the merged nodes
    are mapped and made distinct. Minima are combined before the shuffle, so a hub costs one row per task. Each
    round writes two tables to the shared checkpoint folder. An edge list without rows gives no rows.
    """
    left = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v"))
        both = left.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        order = F.struct(F.xxhash64(F.lit(len(maps)), "v"), "v") if maps else F.col("v")
        maps.append(cut_lineage(both.groupBy("u").agg(F.min_by("v", order).alias("p"))))
        to = maps[-1]
        left = cut_lineage(
            left.where("u <> v").join(to, "u").select("v", F.col("p").alias("pu")).join(to.withColumnsRenamed({"u": "v"}), "v")
            .select(F.least("pu", "p").alias("u"), F.greatest("pu", "p").alias("v")).where("u <> v").distinct()
        )
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = maps[0].select(F.col("u").alias("node"), F.col("p").alias("at"))
    for to in maps[1:]:
        state = state.join(to.withColumnsRenamed({"u": "at"}), "at", "left").select("node", F.coalesce("p", "at").alias("at"))
    state = cut_lineage(state)
    low = state.groupBy("at").agg(F.min("node").alias("root"))
    return state.join(low, "at").select("node", "root")


def hot_join(rows: DataFrame, found: DataFrame, key: str, share: int = 1_000) -> DataFrame:
    """Left join of stored ``rows`` to ``found``, which has at most one row per ``key``, with hot keys split.

    Keys that hold more than one in ``share`` of the rows are fewer than ``share``, whatever the data: what was
    found for them is broadcast and their rows stay where they are. All other keys are joined by a shuffle in
    which none is large. Null keys match nothing and are not shuffled.
    """
    n = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * share > n).select(key)
    near = hot.join(found, key, "left").withColumn("_hot", F.lit(True))
    seen = rows.join(F.broadcast(near), key, "left")
    here = F.col("_hot").isNotNull() | F.col(key).isNull()
    far = seen.where(~here).select(*rows.columns).join(found, key, "left")
    return seen.where(here).drop("_hot").unionByName(far)
