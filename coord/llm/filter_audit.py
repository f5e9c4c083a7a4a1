"""Interaction of document filters, from sorted posting lists of failing ids."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.llm.common import BLANKS, UPPER, cut_lineage, hot_join, text_of

FILTERS = "ABCDE"
RANGE_BITS = 16  # a list is kept per range of 2^16 ids, so none is longer
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2  # the latter two in percent
SIGNS = "#$%&*|"
GOOD, TOXIC = "good", "toxic"
RUN = 64  # probes placed together before each gallops on


def text_failures() -> dict[str, Column]:
    """Whether a text fails each filter that needs no other text."""
    words = F.filter(F.split(text_of(), f"[{BLANKS}]+"), lambda w: w != "")
    size = F.length(text_of())
    capitals = size - F.length(F.translate(text_of(), UPPER, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * capitals > MAX_CAPITALS * size,
        "D": F.length(F.translate(text_of(), SIGNS, "")) < size,
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, part, A..E, good, toxic) per document, stored; ``id`` numbers the rows.

    The texts are read once. A text fails E if a smaller doc_id has the same text (compared by md5): the smallest
    id of every repeated text is counted before it meets the documents, and texts or ids that hold many rows
    meet theirs by broadcast. Rows without an id neither fail E nor make others fail, and have no labels. Of
    several labels of an id, one suffices.
    """
    rows = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text_of().cast("binary"))).alias("th"), *[c.alias(k) for k, c in text_failures().items()],
    ))
    firsts = rows.groupBy("th").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("top > low").drop("top")
    rows = cut_lineage(hot_join(rows, firsts, "th").withColumn("E", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))).drop("th", "low"))
    marked = F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias(GOOD), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias(TOXIC)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*marked).where(f"{GOOD} or {TOXIC}")
    return cut_lineage(hot_join(rows, known, "doc_id").fillna(False, [GOOD, TOXIC]).drop("doc_id"))


def postings(failed: DataFrame) -> DataFrame:
    """(part, range, list, ids): sorted ids of each part that fail a filter, or that fail any and are labelled good or toxic."""
    some = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in FILTERS]))
    own = failed.withColumn("some", some).where(F.size("some") > 0)
    more = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in (GOOD, TOXIC)]))
    rows = own.select("part", F.shiftright("id", RANGE_BITS).alias("range"), F.explode(F.concat("some", more)).alias("list"), "id")
    return rows.groupBy("part", "range", "list").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def gallop(ids: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Place of each sorted probe among the sorted ids: the first that is not smaller.

    Every run of probes starts from the place of its first one; from there each probe doubles its step until
    it passes the sought place and halves the last step.
    """
    n = len(ids)
    low = np.repeat(np.searchsorted(ids, probes[::RUN]), RUN)[:len(probes)]
    smaller = lambda at, which: (at < n) & (ids[np.minimum(at, n - 1)] < probes[which])
    if not n:
        return low
    high, live, step = low.copy(), np.arange(len(probes)), 1
    live = live[smaller(low, live)]
    while len(live):  # ids[low] < probe
        ahead = low[live] + step
        on = smaller(ahead, live)
        high[live[~on]] = np.minimum(ahead[~on], n)
        low[live[on]] = ahead[on]
        live, step = live[on], step * 2
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) // 2
        on = smaller(middle, live)
        low[live[on]] = middle[on] + 1
        high[live[~on]] = middle[~on]
        live = live[low[live] < high[live]]
    return high


def common(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each id stands in the other list; the shorter list probes the longer one."""
    out = np.zeros(len(ids), bool)
    if not len(ids) or not len(other):
        return out
    if len(ids) <= len(other):
        at = gallop(other, ids)
        return (at < len(other)) & (other[np.minimum(at, len(other) - 1)] == ids)
    at = gallop(ids, other)
    hit = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == other)
    out[at[hit]] = True
    return out


def removals(lists: dict[str, np.ndarray], filters: str = FILTERS) -> Iterator[tuple[int, int, int, int, int]]:
    """(filters before, filter, removed, of them good, toxic) for every filter and every set of others applied before it.

    The ids that a filter removes after others are its list less theirs: one list after another is merged away
    from what is left, so the difference to a union never needs the union.
    """
    none = np.empty(0, np.int64)
    good, toxic = lists.get(GOOD, none), lists.get(TOXIC, none)
    for f, name in enumerate(filters):
        left = {0: lists.get(name, none)}
        for before in range(1 << len(filters)):
            if before >> f & 1:
                continue
            if before:
                last = before.bit_length() - 1
                ids = left[before ^ 1 << last]
                left[before] = ids[~common(ids, lists.get(filters[last], none))]
            ids = left[before]
            yield before, f, len(ids), int(common(ids, good).sum()), int(common(ids, toxic).sum())


def counted(lists: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, key, removed, good, toxic): sizes for every filter after every set of others, summed over the ranges of ids.

    ``key`` is the set of the filters before, as bits, times 8, plus the number of the filter.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            rows = held + list(zip(pdf["part"], pdf["range"], pdf["list"], pdf["ids"]))
            at = max((k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2]), default=0)  # the last block may go on
            held = rows[at:]
            yield from made(rows[:at])
        yield from made(held)

    def made(rows: list) -> Iterator[pd.DataFrame]:
        out = []
        for (part, _), own in itertools.groupby(rows, lambda r: r[:2]):
            sizes = removals({r[2]: np.asarray(r[3], np.int64) for r in own}, filters)
            out += [(part, b * 8 + f, *n) for b, f, *n in sizes if n[0]]
        yield pd.DataFrame(out, columns=["part", "key", "removed", "good", "toxic"])

    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, else few bytes would be one task
    blocks = lists.repartition(tasks, "part", "range").sortWithinPartitions("part", "range")
    sizes = blocks.mapInPandas(run, "part string, key int, removed long, good long, toxic long")
    return sizes.groupBy("part", "key").agg(F.sum("removed").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _steps(filters: str) -> list[dict]:
    """One entry per order and step: the key of the step, the keys up to it, its filter alone, after all others, and its share of all orders."""
    n, every, out = len(filters), (1 << len(filters)) - 1, []
    weight = lambda b: math.factorial(b.bit_count()) * math.factorial(n - 1 - b.bit_count())
    for order in itertools.permutations(range(n)):
        before, keys = 0, []
        for step, f in enumerate(order, 1):
            keys.append(before * 8 + f)
            shares = [{"key": b * 8 + f, "times": weight(b)} for b in range(every + 1) if not b >> f & 1]
            out.append({
                "filter_order": "".join(filters[k] for k in order), "step": step, "key": keys[-1], "so_far": list(keys),
                "alone": f, "last": (every ^ 1 << f) * 8 + f, "shares": shares,
            })
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    Each part (source, empty for null) keeps, per filter and range of row numbers, the sorted list of rows that
    fail it. What a filter removes after others is a difference of such lists, merged by galloping within a
    range and summed over the ranges; no list is longer than a range, however large a part is. Eighty sizes per
    part give all 120 orders.

    Null, empty and wordless texts fail A, and C and D never; null is the same text as empty. Of equal texts all
    but those with the smallest doc_id fail E. Rows with one id are documents of their own. Texts of any length
    are rows like others. An empty table gives no rows. Other columns are ignored.
    """
    failed = failures(docs, labels)
    value = F.struct("removed", "good", "toxic")
    sizes = counted(postings(failed)).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", value))).alias("sizes"))
    totals = failed.groupBy("part").agg(F.count("*").alias("total"))
    shape = "array<struct<filter_order: string, step: int, key: int, so_far: array<int>, alone: int, last: int, shares: array<struct<key: int, times: bigint>>>>"
    steps = F.explode(F.from_json(F.lit(json.dumps(_steps(FILTERS))), shape))
    zero = F.lit(0).cast("long")
    of = lambda key, what: F.coalesce(F.try_element_at("sizes", key)[what], zero)
    rows = totals.join(sizes, "part", "left").withColumn("s", steps)
    removed = of(F.col("s.key"), "removed")
    return rows.select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - F.aggregate("s.so_far", zero, lambda a, k: a + of(k, "removed"))).alias("kept"), removed.alias("removed"),
        (of(F.col("s.alone"), "removed") - removed).alias("redundant"), of(F.col("s.last"), "removed").alias("unique_fails"),
        of(F.col("s.key"), "good").alias("good_lost"), of(F.col("s.key"), "toxic").alias("toxic_lost"),
        F.aggregate("s.shares", zero, lambda a, x: a + x["times"] * of(x["key"], "removed")).alias("shapley"),
    )
