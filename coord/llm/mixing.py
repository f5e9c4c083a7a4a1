"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.llm.common import BLANKS, cut_lineage, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
ROWS_PER_BUCKET = 10_000


def size_of(text: str = "text") -> Column:
    """Number of runs of characters other than blanks; 0 for null."""
    trimmed = F.btrim(text_of(text), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target words of each source from (source, source_size): shares by weight, none above ``repeats`` sizes.

    Weights repeat along the sources in code-point order, null last. What a source cannot take is shared again
    by weight among the others until none is above its bound: with the sources in order of bound by weight,
    a source is at its bound exactly if the level left for it and all later ones reaches it. One row per
    source, so the windows here span as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.select("source", "source_size", w.alias("_w"), (F.col("source_size") * repeats).alias("_cap"))
    levels = ranked.select(
        "*", (F.sum("source_size").over(everything) * F.lit(float(share))).alias("_budget"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_used"), F.sum("_w").over(after).alias("_open"),
    ).withColumn("_full", (F.col("_budget") - F.col("_used")) * F.col("_w") >= F.col("_cap") * F.col("_open"))
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0))
    weight_left = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything)
    return levels.select(
        "source", "source_size", "_budget",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_budget") - spent) * F.col("_w") / weight_left).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for every document.

    The documents of a source are shuffled by a hash of their id and queued ``repeats`` times over. The virtual
    finish time of a copy is the words queued up to its end divided by the source's target; the copies of all
    sources are put in one order of finish times and taken until the total budget is reached, so all sources
    are served at the rate of their targets.

    A hot source is cut into buckets of the shuffle hash: running sums are taken inside a bucket and start from
    the sum of the buckets before. The global order is cut into equal spans of finish time, which hold about
    equal numbers of words; only the span in which the budget ends is sorted, and only the last copy taken
    is passed on. Texts are read once and not shuffled.

    Null text and blank text: size 0, nothing taken. A null source is a source of its own. Repeated rows have
    the same place in the queue and share its fate. An empty table gives no rows. Other columns are ignored.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = cut_lineage(docs.select("doc_id", "source", size_of().alias("size")).select("*", h.alias("h")))
    buckets = rows.count() // rows_per_bucket + 1
    keyed = rows.select(
        "*", F.coalesce("source", F.lit("")).alias("skey"), F.col("source").isNull().alias("snull"),
        F.least(F.floor(F.col("h") / F.lit(float(16**15)) * buckets), F.lit(buckets - 1)).alias("bucket"),
    )
    sums = cut_lineage(keyed.groupBy("skey", "snull", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    aims = cut_lineage(aims.select(F.coalesce("source", F.lit("")).alias("skey"), F.col("source").isNull().alias("snull"), "source_size", "target", "_budget"))
    first = aims.select("_budget").first()
    budget = first[0] if first else 0.0
    ahead = Window.partitionBy("skey", "snull").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    info = sums.select("skey", "snull", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")).join(aims.drop("_budget"), ["skey", "snull"])
    inside = Window.partitionBy("skey", "snull", "bucket").orderBy("h", "doc_id", "size")
    queued = keyed.join(info, ["skey", "snull", "bucket"]).withColumn("queued", F.col("ahead") + F.sum("size").over(inside))

    def place(copy: int) -> Column:
        finish = (F.col("queued") + F.col("source_size") * copy) / F.when(F.col("target") > 0, F.col("target"))
        return F.struct(
            F.coalesce(finish, F.lit(float("inf"))).alias("finish"), F.col("snull"), F.col("skey"), F.lit(copy).alias("copy"), F.col("h"),
            F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("size"),
        )

    queued = cut_lineage(queued.select("doc_id", "source", "size", "source_size", "target", "snull", "skey", "h", "queued"))
    copies = queued.where("size > 0").select(F.explode(F.array(*[place(c) for c in range(repeats)])).alias("at"))
    spans = repeats * buckets
    copies = copies.select("at", F.least(F.floor(F.col("at.finish") * buckets), F.lit(4 * spans)).alias("span"))
    loads = copies.groupBy("span").agg(F.sum("at.size").alias("words"))
    running = loads.select("span", F.sum("words").over(Window.orderBy("span")).alias("upto"), "words")
    last = running.where(F.col("upto") > budget).orderBy("span").first()
    if last is None:
        taken_by = [F.lit(1)] * repeats
    else:
        so_far = F.sum("at.size").over(Window.partitionBy("span").orderBy("at")) + (last["upto"] - last["words"])
        cut = copies.where(F.col("span") == last["span"]).select("at", so_far.alias("so_far")).where(F.col("so_far") <= budget).agg(F.max("at").alias("at")).first()[0]
        if cut is None:  # not even the first copy of the span fits: all of the spans before, nothing of this one
            inside_budget = lambda c: F.floor(place(c)["finish"] * buckets) < last["span"]
        else:
            end = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in copies.schema["at"].dataType.fields])
            inside_budget = lambda c: place(c) <= end
        taken_by = [F.when(inside_budget(c), 1).otherwise(0) for c in range(repeats)]
    count = F.when(F.col("size") > 0, sum(taken_by[1:], taken_by[0])).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * count).cast("long").alias("taken"), count.cast("int").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents in the mix with all their columns and ``mix_copies``, how often each is taken."""
    picked = mix(docs, **how).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_n")).agg(F.max("copies").alias("_copies"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"), size_of().alias("_n"))
    a, b = packed.alias("a"), picked.alias("b")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & F.col("a._src").eqNullSafe(F.col("b._src")) & (F.col("a._n") == F.col("b._n"))
    return a.join(b, same).select("a.row.*", F.col("b._copies").alias("mix_copies"))
