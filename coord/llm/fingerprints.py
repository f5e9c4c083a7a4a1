"""Order-independent document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coord.llm.common import text_of

SEEDS = (11, 23)  # each gives 63 lanes of one bit
PARAGRAPH_END = r"\n+|(?<=[.!?]) "
SLOT, BITS = 21, 20  # three lanes to a number, each modulo 2^20 with a guard bit above
ONES = sum(1 << (SLOT * i) for i in range(3))
LANES = ONES * ((1 << BITS) - 1)
GUARDS = ONES << BITS


def with_fingerprint(df: DataFrame, text: str, name: str, end: str = PARAGRAPH_END) -> DataFrame:
    """Add the fingerprint of a text column: the sum over its paragraphs of wide 0/1 vectors hashed from them.

    Paragraphs are the trimmed, non-empty pieces between line breaks and after the final marks of sentences;
    sentences count because many texts are one line, of which nothing would stay alike. The result is an
    array<bigint>: numbers of three lanes modulo 2^20, then the number of paragraphs. Lane-wise sums of
    fingerprints are fingerprints of joined texts, whatever the order. A null text has no paragraphs.
    """
    pieces, hashes = f"{name}_pieces", [f"{name}_h{s}" for s in SEEDS]
    df = df.withColumn(pieces, F.array_remove(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), end), F.trim), ""))
    df = df.withColumns({h: _hashed(pieces, s) for h, s in zip(hashes, SEEDS)}).drop(pieces)
    numbers = [_lane_sum(h, j) for h in hashes for j in range(SLOT)]
    return df.withColumn(name, F.array(*numbers, F.size(hashes[0]).cast("long"))).drop(*hashes)


def _hashed(pieces: str, seed: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))


def _lane_sum(hashes: str, shift: int) -> Column:
    step = lambda acc, x: (acc + F.shiftright(x, shift).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LANES))
    return F.aggregate(hashes, F.lit(0).cast("long"), step)


def _apart(fp: Column) -> tuple[Column, Column]:
    return F.slice(fp, 1, SLOT * len(SEEDS)), F.element_at(fp, -1)


def insert(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    (x, n), (y, m) = _apart(a), _apart(b)
    return F.concat(F.zip_with(x, y, lambda p, q: (p + q).bitwiseAND(F.lit(LANES))), F.array(n + m))


def delete(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``, which it must hold."""
    (x, n), (y, m) = _apart(a), _apart(b)
    return F.concat(F.zip_with(x, y, lambda p, q: (p + F.lit(GUARDS) - q).bitwiseAND(F.lit(LANES))), F.array(n - m))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 minus the squared distance of the signed lanes over the sum of their squared lengths.

    A lane's sum of +1 and -1 is twice its count of ones less the number of paragraphs; it is taken as the
    nearest to zero of its class modulo 2^20. The value estimates the share of paragraphs in both texts, and
    is 1 for equal fingerprints, also of texts without paragraphs.
    """
    half, lane_mask = 1 << (BITS - 1), (1 << BITS) - 1

    def signed(fp: Column) -> Column:
        numbers, n = _apart(fp)
        lane = lambda x, i: (F.shiftright(x, SLOT * i).bitwiseAND(F.lit(lane_mask)) * 2 - n + half).bitwiseAND(F.lit(lane_mask)) - half
        return F.flatten(F.transform(numbers, lambda x: F.array(*[lane(x, i) for i in range(3)])))

    products = F.transform(F.arrays_zip(signed(a).alias("x"), signed(b).alias("y")), lambda z: F.struct((z["x"] * z["y"]).cast("double").alias("xy"), (z["x"] * z["x"] + z["y"] * z["y"]).cast("double").alias("ss")))
    sums = F.aggregate(
        products, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("ss")),
        lambda acc, z: F.struct((acc["xy"] + z["xy"]).alias("xy"), (acc["ss"] + z["ss"]).alias("ss")),
        lambda acc: F.when(acc["ss"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * acc["xy"] / acc["ss"]))).otherwise(0.0),
    )
    return F.when(a == b, 1.0).otherwise(sums)


def digest(fp: Column) -> Column:
    """The whole vector as text: numbers in hexadecimal, joined by points."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ".")


def with_next(docs: DataFrame, rows_per_range: int = 5_000) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp) in descending order of doc_id; the last row's next is the first.

    The ids are cut into ranges at approximate quantiles, so rows move once, to the task of their range. The
    first rows of a range are also sent, marked, to the range before it, and the first rows of all to the
    last range; they are found from one maximum per range. Null ids come last. Ties are ordered by text.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    n = docs.count()
    docs = with_fingerprint(docs, "text", "fp")
    pieces = max(1, min(n // rows_per_range, 20_000))
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.2 / pieces))) if pieces > 1 else []
    place = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    located = docs.select("*", _range_of(place, bounds, len(cuts)).alias("range"), place.alias("place"))
    tops = {r["range"]: r["top"] for r in located.groupBy("range").agg(F.max("place").alias("top")).collect()}  # one row per range
    order = sorted(tops, reverse=True)
    heads = [(tops[order[i]], order[i - 1] if i else order[-1], 2 if i == 0 else 1) for i in range(len(order))]
    if not heads:
        return docs.select("doc_id", "text", "fp", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    sent = F.map_from_arrays(F.array(*[F.lit(h[0]) for h in heads]), F.array(*[F.struct(F.lit(h[1]).alias("range"), F.lit(h[2]).alias("mark")) for h in heads]))
    to = F.element_at(sent, F.col("place"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("mark"))
    spread = located.withColumn("to", F.explode(F.when(to.isNull(), F.array(own)).otherwise(F.array(own, to)))).select("doc_id", "text", "fp", "place", "to.range", "to.mark")
    # the first rows of all (mark 2) stand behind everything in the last range
    w = Window.partitionBy("range").orderBy(F.col("mark") == 2, F.desc("place"), "mark", "text")
    ahead = F.lead(F.struct("text", "fp")).over(w)
    return spread.withColumn("ahead", ahead).where("mark = 0").select("doc_id", "text", "fp", F.col("ahead.text").alias("next_text"), F.col("ahead.fp").alias("next_fp"))


def _range_of(place: Column, bounds: Column, n: int) -> Column:
    """Number of bounds at or below the place, by halving: one fold over the step widths, whatever their number."""
    if n == 0:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    onward = lambda at, step: (at + step <= n) & (F.get(bounds, F.least(at + step, F.lit(n)) - 1) <= place)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(onward(at, step), at + step).otherwise(at))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The edited text is the text with its second half (half its code points, rounded down) replaced by as many
    from the start of the next document. Null text counts as empty and has no paragraphs; fingerprints
    without paragraphs equal each other. Equal texts have equal fingerprints in every run. A single document
    is its own next one. Repeated rows follow each other. An empty table gives no rows. Other columns are
    ignored.
    """
    told = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    told = told.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))")).drop("text", "next_text")
    told = with_fingerprint(told.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fp")
    return told.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("fp")).alias("fingerprint"), digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
