"""Jaccard similarity join on word n-grams with Bayesian pruning of candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import components, cut_lineage, text_of

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5  # a pair at the threshold shares no band with probability (1 - 0.8^5)^32 = 3e-6
CHECKS, STEP = 64, 16  # MinHash values for pruning, compared 16 at a time
TOLERANCE = 1e-6
BAND_TILE = 1_000
TEXT_TILE, TEXT_TILE_GRAMS = 256, 1_000_000
NO_ID = -(2**63)
_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sets of hashed word n-grams; hashes of words are remembered up to a bounded number."""

    def __init__(self, n: int = WORDS, remember: int = 500_000):
        self.n, self.remember, self.known = n, remember, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams of lower-case words; a shorter text is one gram, no words none."""
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = min(self.n, len(words))
        size = len(words) - n + 1
        out = np.full(size, n, np.uint64)
        for k in range(n):
            out = _mix(out + h[k:k + size])
        return np.unique(out)


def _hashers(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240131)
    return r.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, count, dtype=np.uint32)


def minhashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of the hash functions a * x + b modulo 2^32 over the upper halves of the grams."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 256):  # bounded memory for long texts
        np.minimum(out, (x[k:k + 256, None] * a + b).min(axis=0), out=out)
    return out.astype(np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, checks: int = CHECKS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): below, the posterior of reaching the threshold is under the tolerance.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1); its mass above t is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, checks + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def promising(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Whether each pair of rows survives the step-wise comparison of its MinHash values."""
    alive, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in bounds:
        matches = matches + (x[alive, at:n] == y[alive, at:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], n
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        up = self.up
        for i, j in pairs:
            while up[i] != i:
                i = up[i]
            while up[j] != j:
                j = up[j]
            if i != j:
                up[max(i, j)] = min(i, j)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by the keys, cut between whole groups, with the number of each row's group."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            held = pdf
            continue
        new = np.ones(len(pdf), bool)
        new[1:] = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield pdf.iloc[:last].reset_index(drop=True), np.cumsum(new[:last])
        held = pdf.iloc[last:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.zeros(len(held), np.int64)


def features(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, th, tid, grams, sig, bands) per document: text hash, hash of the n-gram set, its size, MinHash values, band keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, (a, b) = Grams(n), _hashers(BANDS * BAND_ROWS + CHECKS)
        numbers = np.arange(BANDS, dtype=np.uint64)
        for pdf in batches:
            tids, sizes, sigs, bands = [], [], [], []
            for text in pdf["text"]:
                g = make.of(text)
                sizes.append(len(g))
                if not len(g):
                    tids.append(None), sigs.append(None), bands.append(None)
                    continue
                m = minhashes(g, a, b)
                key = numbers
                for r in range(BAND_ROWS):
                    key = _mix(key + m[r * BANDS:(r + 1) * BANDS])
                tids.append(np.array([_mix(g).sum(), _mix(g ^ _M2).sum()], np.uint64).tobytes())
                sigs.append(_mix(m[-CHECKS:]).astype(np.uint16).tobytes())
                bands.append(key.view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "tid": tids, "grams": sizes, "sig": sigs, "bands": bands})

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"), "text")
    return rows.mapInPandas(run, "id long, th long, tid binary, grams int, sig binary, bands array<long>")


def _tile(size: str, per_tile: str) -> list:
    """Columns p, q of the tile pairs in which a row stands, and its own tile."""
    tiles = F.expr(f"greatest(1, int(ceil({size} / {per_tile})))")
    return [tiles.alias("tiles"), F.pmod(F.xxhash64("tid"), tiles).cast("int").alias("tile")]


def _paired(df: DataFrame) -> DataFrame:
    """A row for every pair of tiles of its group that its own tile is in."""
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return df.withColumn("p", F.least("tile", "other")).withColumn("q", F.greatest("tile", "other")).drop("other", "tiles")


def band_links(texts: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): edges that connect all texts sharing a band key and surviving the pruning.

    Texts of one key are compared within pairs of tiles of about ``BAND_TILE`` rows, so a hot key is many
    groups. Only connection matters here: a pair already connected is not compared.
    """
    bounds = least_matches(threshold, tolerance)
    keyed = texts.select("tid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key").select("key", "tid", *_tile("n", str(BAND_TILE)))
    met = _paired(met.join(texts.select("tid", "sig"), "tid"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in groups(batches, ["key", "p", "q"]):
            codes, names = pd.factorize(pdf["tid"], sort=True)
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), CHECKS)
            tile, across = pdf["tile"].to_numpy(), (pdf["p"] != pdf["q"]).to_numpy()
            forest, roots = Forest(len(names)), np.arange(len(names))
            for d in range(1, len(pdf)):
                i = np.flatnonzero(group[d:] == group[:-d])
                if not len(i):
                    break
                i = i[~across[i] | (tile[i] != tile[i + d])]
                i = i[roots[codes[i]] != roots[codes[i + d]]]
                if len(i):
                    i = i[promising(sig[i], sig[i + d], bounds)]
                    if len(i):
                        forest.join(zip(codes[i], codes[i + d]))
                        roots = forest.roots()
            moved = np.flatnonzero(roots != np.arange(len(names)))
            yield pd.DataFrame({"a": names[moved], "b": names[roots[moved]]})

    spread = met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return spread.mapInPandas(run, "a binary, b binary")


def verified(docs: DataFrame, texts: DataFrame, grouped: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(tid, mate, links, text_links) per text and pair of tiles: exact links to the other texts of its group.

    ``mate``, the smallest text reachable there, connects the linked texts of a tile pair. Counts of a text add up over its tile pairs. The group's
    texts are read again and compared as n-gram sets, in tiles of about ``TEXT_TILE`` texts or
    ``TEXT_TILE_GRAMS`` n-grams.
    """
    bounds = least_matches(threshold, tolerance)
    members = grouped.join(texts.select("tid", "id", "th", "copies", "grams", "sig"), "tid")
    sizes = members.groupBy("root").agg(F.greatest(F.count("*") / TEXT_TILE, F.sum("grams") / TEXT_TILE_GRAMS).alias("load"))
    placed = members.join(sizes, "root").select("root", "tid", "id", "th", "copies", "sig", *_tile("load", "1"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"), "text")
    met = _paired(placed.join(rows, ["id", "th"]).drop("id", "th"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Grams(n)
        for pdf, group in groups(batches, ["root", "p", "q"]):
            for _, own in pdf.groupby(group, sort=False):
                yield _links(own.drop_duplicates("tid"), make, bounds, threshold)

    spread = met.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return spread.mapInPandas(run, "tid binary, mate binary, links long, text_links long")


def _links(own: pd.DataFrame, make: Grams, bounds: list[tuple[int, int]], threshold: float) -> pd.DataFrame:
    """Links within one pair of tiles (or one tile), counted without listing pairs."""
    own, size = own.sort_values("tid"), len(own)
    grams = [make.of(t) for t in own["text"]]
    lengths = np.array([len(g) for g in grams])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    names, flat = np.unique(np.concatenate(grams), return_inverse=True)
    sig = np.frombuffer(b"".join(own["sig"]), np.uint16).reshape(size, CHECKS)
    tile, across = own["tile"].to_numpy(), own["p"].iloc[0] != own["q"].iloc[0]
    copies, tids = own["copies"].to_numpy(), own["tid"].to_numpy()
    links, text_links, forest = np.zeros(size, np.int64), np.zeros(size, np.int64), Forest(size)
    mark = np.zeros(len(names), bool)
    for i in range(size - 1):
        j = np.arange(i + 1, size)
        if across:
            j = j[tile[j] != tile[i]]
        j = j[np.minimum(lengths[j], lengths[i]) >= threshold * np.maximum(lengths[j], lengths[i])]
        j = j[promising(np.broadcast_to(sig[i], (len(j), CHECKS)), sig[j], bounds)]
        if not len(j):
            continue
        mark[flat[starts[i]:starts[i] + lengths[i]]] = True
        both = np.array([np.count_nonzero(mark[flat[starts[k]:starts[k] + lengths[k]]]) for k in j])
        mark[flat[starts[i]:starts[i] + lengths[i]]] = False
        j = j[both >= threshold * (lengths[i] + lengths[j] - both) - 1e-9]
        links[i] += copies[j].sum()
        text_links[i] += len(j)
        links[j] += copies[i]
        text_links[j] += 1
        forest.join((i, k) for k in j)
    return pd.DataFrame({"tid": tids, "mate": tids[forest.roots()], "links": links, "text_links": text_links})


def classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, th, class) for every document; th and class are internal hashes.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams (lower-case words of
    letters, digits and underscores) is at least the threshold. ``n_links`` counts the linked documents,
    ``n_text_links`` the linked different n-gram sets, ``class_id`` is the smallest doc_id reachable by links.

    Documents with one n-gram set are one text from the start, so thousands of copies cost one comparison.
    Texts that agree in a band of MinHash values are candidates; further values are compared in steps, and a
    pair is dropped once the posterior probability of reaching the threshold is under ``tolerance``. The
    surviving pairs connect groups of texts, within which links are verified exactly and counted in place:
    no pair is ever a row. Within a group of m different but near texts the comparisons grow with m squared,
    spread over pairs of tiles. A link at the threshold is missed with a probability of about 3e-6 (bands)
    plus the tolerance, and exactness is up to 64-bit hashes of n-grams.

    A text under ``n`` words is one n-gram. Null, empty and wordless texts have no links and are classes of
    their own. Rows alike in everything are copies of each other. Rows without an id have class_id null
    unless linked to one with an id. An empty table gives no rows. Other columns are ignored.
    """
    found = cut_lineage(features(docs, n))
    filled = found.where("tid is not null")
    first = F.min_by(F.struct("id", "th", "grams"), F.struct(F.col("id") == NO_ID, "id", "th"))
    texts = filled.groupBy("tid").agg(first.alias("f"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    texts = cut_lineage(texts.select("tid", "f.id", "f.th", "f.grams", "copies", "sig", "bands"))
    grouped = components(band_links(texts, threshold, tolerance)).select(F.col("node").alias("tid"), "root")
    exact = cut_lineage(verified(docs, texts, grouped, n, threshold, tolerance))
    counts = exact.groupBy("tid").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    linked = components(exact.select("tid", "mate"), "tid", "mate").select(F.col("node").alias("tid"), F.col("root").alias("class"))
    named = texts.select("tid", F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "copies").join(counts, "tid", "left").join(linked, "tid", "left")
    named = named.withColumn("class", F.coalesce("class", "tid"))
    heads = named.groupBy("class").agg(F.min("id").alias("class_id"))
    info = named.join(heads, "class").select(
        "tid", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    zero = F.lit(0).cast("long")
    return found.select("id", "th", "tid").join(info, "tid", "left").select(
        own.alias("doc_id"), F.when(F.col("tid").isNull(), own).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"), "th", "class",
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One document of each class with all its columns: the one with the smallest id, of rows alike in id and text one."""
    found = classes(docs, **how).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    lone = F.col("class").isNull() | (F.col("n_links") == 0)
    heads = found.where(~lone).groupBy("class").agg(F.min(F.struct(F.col("id") == NO_ID, "id", "th")).alias("h")).select("h.id", "h.th")
    keep = heads.unionByName(found.where(lone).select("id", "th").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"))
    return rows.join(keep, ["id", "th"]).dropDuplicates(["id", "th"]).select("row.*")
