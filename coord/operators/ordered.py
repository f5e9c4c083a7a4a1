"""Ordered per-key computations that stay balanced when one key holds a large share of the rows.

A window over ``PARTITION BY key ORDER BY ts`` sends every row of a key to one task. Here the rows are first
dealt by range over (keys, order) into partitions of about equal size and stored with their partition number,
so a key with many rows lies in several partitions, in order. Each part of a key is processed on its own; what
it needs from the parts before (or the one after) comes from per-part summaries. Only a key that crosses a
border between partitions has summaries, so there are at most two per partition. The plan is the same for
every size, and nulls, NaN, infinities and strings are placed by the order the engine sorts them in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.session import stored


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of two lists of columns; true for empty ones."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_chunk``, split keys): 0 for a key that lies in one partition, else 1 and more in order.

    The rows are stored, because another evaluation could draw other borders. ``chunks`` sets the number of
    range partitions (the session's shuffle partitions, merged when small, without it). A border splits at
    most one key, so the split keys are fewer than the partitions, whatever the data: they may be broadcast.
    """
    keys = list(keys)
    by = [*keys, *[o for o in order if o not in keys]]
    dealt = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    rows = stored(dealt.withColumn("_part", F.spark_partition_id().cast("long")))
    key = F.struct(*keys)
    ends = rows.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ends = ends.select("_part", F.explode(F.array("lo", "hi")).alias("key"))
    split = ends.groupBy("key").agg(F.countDistinct("_part").alias("n")).filter("n > 1").select("key.*")
    names = [f"_k{i}" for i in range(len(keys))]
    marks = split.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(True).alias("_split"))
    marked = rows.join(F.broadcast(marks), same_keys(keys, names), "left").withColumn(
        "_chunk", F.when(F.col("_split"), F.col("_part") + 1).otherwise(F.lit(0).cast("long"))
    )
    return marked.drop(*names, "_split", "_part"), split


@dataclass(frozen=True)
class Spec:
    kind: str
    name: str
    expr: Column | None = None


def lag(name: str, expr: Column) -> Spec:
    """Value of ``expr`` on the row before."""
    return Spec("lag", name, expr)


def lead(name: str, expr: Column) -> Spec:
    """Value of ``expr`` on the row after."""
    return Spec("lead", name, expr)


def rank(name: str) -> Spec:
    """Row number, from 1."""
    return Spec("rank", name)


def running_sum(name: str, expr: Column) -> Spec:
    """Sum of ``expr`` up to and including the row."""
    return Spec("sum", name, expr)


def last_known(name: str, expr: Column) -> Spec:
    """Latest non-null ``expr`` up to and including the row."""
    return Spec("last", name, expr)


def over_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *specs: Spec,
    chunks: int | None = None,
) -> DataFrame:
    """Add one column per spec, computed per key in ascending ``order`` (a total order per key).

    The input is evaluated once (and sampled for the borders), stored in the shared checkpoint folder, and
    the result is computed from there. Null keys are a key like others.
    """
    keys, order = list(keys), list(order)
    kept = df.columns
    inputs = {f"_x{i}": s.expr for i, s in enumerate(specs) if s.expr is not None}
    cut, _ = in_chunks(df.withColumns(inputs), keys, order, chunks)
    part = [*keys, "_chunk"]
    here = Window.partitionBy(*part).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    local: dict[str, Column] = {}
    summary: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    carried: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for i, spec in enumerate(specs):
        x, loc, car = F.col(f"_x{i}"), f"_l{i}", f"_c{i}"
        if spec.kind == "lag":
            local[loc] = F.lag(F.struct(x)).over(here)
            summary.append(F.max_by(F.struct(x), at).alias(f"_s{i}"))
            carried[car] = F.lag(f"_s{i}").over(parts)
            final[spec.name] = F.coalesce(F.col(loc), F.col(car))[f"_x{i}"]
        elif spec.kind == "lead":
            local[loc] = F.lead(F.struct(x)).over(here)
            summary.append(F.min_by(F.struct(x), at).alias(f"_s{i}"))
            carried[car] = F.lead(f"_s{i}").over(parts)
            final[spec.name] = F.coalesce(F.col(loc), F.col(car))[f"_x{i}"]
        elif spec.kind == "rank":
            local[loc] = F.row_number().over(here)
            carried[car] = F.sum("_rows").over(earlier)
            final[spec.name] = (F.col(loc) + F.coalesce(F.col(car), F.lit(0))).cast("long")
        elif spec.kind == "sum":
            local[loc] = F.sum(x).over(so_far)
            summary.append(F.sum(x).alias(f"_s{i}"))
            carried[car] = F.sum(f"_s{i}").over(earlier)
            final[spec.name] = F.when(F.col(loc).isNull(), F.col(car)).otherwise(
                F.col(loc) + F.coalesce(F.col(car), F.lit(0))
            )
        elif spec.kind == "last":
            local[loc] = F.last(x, ignorenulls=True).over(so_far)
            summary.append(F.max_by(x, F.when(x.isNotNull(), at)).alias(f"_s{i}"))
            carried[car] = F.last(f"_s{i}", ignorenulls=True).over(earlier)
            final[spec.name] = F.coalesce(F.col(loc), F.col(car))
        else:
            raise ValueError(f"unknown spec {spec.kind}")

    summaries = cut.filter("_chunk > 0").groupBy(*part).agg(*summary)
    names = [f"_k{i}" for i in range(len(part))]
    carry = summaries.withColumns(carried).select(*[F.col(c).alias(n) for c, n in zip(part, names)], *carried)
    # one row per split key and partition, at most two per partition
    return (
        cut.withColumns(local)
        .join(F.broadcast(carry), same_keys(part, names), "left")
        .select(*kept, *[c.alias(n) for n, c in final.items()])
    )


def trailing_count(
    df: DataFrame, keys: Sequence[str], ts: str, interval: str, name: str = "trailing",
    chunks: int | None = None,
) -> DataFrame:
    """Rows of the key in ``[ts - interval, ts]``, one output row per (key, ts).

    Each distinct time enters once and leaves once, so the count is a running sum and never a range join.
    """
    keys = list(keys)
    enter = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_d"))
    leave = enter.select(
        *keys, (F.col(ts) + F.expr(f"INTERVAL {interval}")).alias(ts), (-F.col("_d")).alias("_d"), F.lit(1).alias("_k")
    )
    moves = enter.withColumn("_k", F.lit(0)).unionByName(leave)
    summed = over_order(moves, keys, [ts, "_k"], running_sum(name, F.col("_d")), chunks=chunks)
    return summed.filter(F.col("_k") == 0).select(*keys, ts, F.col("_d").alias("n_at"), name)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float],
    chunks: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key from value counts, without holding a group in memory.

    Values are counted first (map-side), ranked by a running sum, and the two order statistics around each
    target rank are picked by aggregation.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    cum = over_order(counts, keys, [value], running_sum("_cum", F.col("_m")), chunks=chunks)
    totals = counts.groupBy(*keys).agg(F.sum("_m").alias("samples"))
    # null keys are groups like others
    same = same_keys([f"a.{k}" for k in keys], [f"b.{k}" for k in keys])
    ranked = cum.alias("a").join(totals.alias("b"), same).select("a.*", "b.samples")
    aggs = []
    for name, q in fractions.items():
        target = F.lit(q) * (F.col("samples") - 1)
        for side, rank_ in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            hit = (F.col("_cum") > rank_) & (F.col("_cum") - F.col("_m") <= rank_)
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    got = ranked.groupBy(*keys, "samples").agg(*aggs)
    outs = []
    for name, q in fractions.items():
        target = F.lit(q) * (F.col("samples") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return got.select(*keys, "samples", *outs)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    A row-number filter of this form gets a map-side group limit in Spark, so each task sends at most
    ``n`` rows of a key over the network, however large the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)
