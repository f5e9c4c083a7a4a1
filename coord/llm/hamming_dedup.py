"""Near-duplicates by a multi-index Hamming join of MinHash signatures."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.llm.common import BLANKS, LOWER, UPPER, components, cut_lineage, hot_join, text_of
from coord.llm.ngram_join import Forest, groups
from coord.operators.ordered import top_per_key

WORDS = 3
PERCENT = 85
BITS = 16  # kept of every MinHash value
CHUNKS, PER_CHUNK, ERRORS = 8, 4, 1
SIGNATURE = CHUNKS * PER_CHUNK
DISTANCE = CHUNKS * (ERRORS + 1) - 1  # 15 of 32 values: farther pairs may have two errors or more in every chunk
TILE, TILE_SHINGLES = 256, 1_000_000
HUBS = 8
NO_ID = -(2**63)
_LOW = str.maketrans(UPPER, LOWER)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed word shingles; hashes of words are remembered up to a bounded number."""

    def __init__(self, n: int = WORDS, remember: int = 500_000):
        self.n, self.remember, self.known = n, remember, {}
        self.blank = str.maketrans({c: " " for c in BLANKS})

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no words none."""
        words = [w for w in (text or "").translate(_LOW).translate(self.blank).split(" ") if w]
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out + h[k:k + len(out)])
        return np.unique(out)


def hash_functions(count: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of hash functions modulo 2^32."""
    r = np.random.default_rng(20250307)
    return r.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, count, dtype=np.uint32)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The last ``BITS`` bits (mixed) of the least value of each hash function over the shingles."""
    a, b = functions
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 256):  # bounded memory for long texts
        np.minimum(out, (x[k:k + 256, None] * a + b).min(axis=0), out=out)
    return _mix(out.astype(np.uint64)).astype(np.uint16)


def index_keys(sigs: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """One key per row of signatures, chunk and set of ``errors`` values left out of it.

    Two signatures that differ in fewer than ``chunks * (errors + 1)`` values have a chunk with at most
    ``errors`` differences, so they agree in the key that leaves these values out.
    """
    out = []
    for c, part in enumerate(np.split(sigs.astype(np.uint64), chunks, axis=1)):
        for wrong in itertools.combinations(range(part.shape[1]), errors):
            key = np.full(len(sigs), c + 1, np.uint64)
            for i in range(part.shape[1]):
                key = _mix(key * np.uint64(31) + (np.uint64(1 << BITS) if i in wrong else part[:, i]))
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def distances(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Number of values in which rows of signatures differ."""
    return (sig != other).sum(axis=1)


def features(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, th, tid, shingles, sig, keys) per document: text hash, 128-bit hash of the shingle set, its size, signature, index keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, functions, none = Shingles(n), hash_functions(), np.zeros(SIGNATURE, np.uint16)
        for pdf in batches:
            if pdf.empty:
                continue
            tids, sizes, sigs = [], [], []
            for text in pdf["text"]:
                g = make.of(text)
                sizes.append(len(g))
                sigs.append(signature(g, functions) if len(g) else none)
                tids.append(np.array([_mix(g).sum(), _mix(g ^ _M2).sum()], np.uint64).tobytes() if len(g) else None)
            keys = index_keys(np.stack(sigs))
            yield pd.DataFrame({
                "id": pdf["id"], "th": pdf["th"], "tid": tids, "shingles": sizes,
                "sig": [x.tobytes() if size else None for x, size in zip(sigs, sizes)], "keys": [x if size else None for x, size in zip(keys, sizes)],
            })

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"), "text")
    return rows.mapInPandas(run, "id long, th long, tid binary, shingles long, sig binary, keys array<long>")


def _tiles(load: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(load).cast("int"))


def _tile(name: str, tiles: Column) -> Column:
    """The tile of a text among so many."""
    return F.pmod(F.xxhash64("tid", F.lit(name)), tiles).cast("int").alias(name)


def _every(tiles: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))


def _met(hosts: DataFrame, guests: DataFrame, group: str) -> DataFrame:
    """Every guest with every host of its group: rows of blocks (group, tile, guest_tile), each of bounded size.

    Both are stored and have the group's number of ``tiles``; a host stands in one tile, a guest in all, so few guests
    cost little. Guests of many tiles of their own meet the hosts tile by tile.
    """
    sizes = guests.groupBy(group).agg(_tiles(F.sum("load")).alias("guest_tiles"))
    here = hot_join(hosts.drop("load"), sizes, group).where("guest_tiles is not null").withColumn("tile", _tile("tile", F.col("tiles"))).withColumn("guest_tile", _every("guest_tiles"))
    come = hot_join(guests.drop("load"), sizes, group).withColumn("guest_tile", _tile("guest_tile", F.col("guest_tiles"))).withColumn("tile", _every("tiles"))
    both = here.withColumn("guest", F.lit(False)).unionByName(come.withColumn("guest", F.lit(True)))
    return both.drop("tiles", "guest_tiles")


def near_signatures(texts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges that connect all texts whose signatures differ in at most ``distance`` values.

    Texts that share an index key meet there. In a key of many texts, all are first compared with a few of them,
    the hubs; those within the distance of the hub that has most of them are connected by it and need no other
    partner among themselves. The rest are guests of the key: they meet all its texts, tile by tile. So a key
    of near copies costs about its size, and only texts unlike each other cost their number times the tiles.
    """
    keyed = texts.select("tid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(keyed.join(shared, "key").join(texts.select("tid", "sig"), "tid").select("key", "tid", "sig", _tiles(F.col("n") / TILE).alias("tiles")))
    few, many = met.where("tiles = 1"), met.where("tiles > 1")
    few = few.select("key", "tid", "sig", F.lit(0).alias("tile"), F.lit(0).alias("guest_tile"), F.lit(None).cast("boolean").alias("guest"))
    hubs = top_per_key(many.select("key", "tid", "sig", "tiles"), ["key"], [F.xxhash64("tid")], HUBS)
    held = hubs.groupBy("key", "tiles").agg(F.collect_list(F.struct("tid", "sig")).alias("hubs")).withColumn("tile", _every("tiles")).drop("tiles")
    apart = lambda sig: F.size(F.filter(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda i: F.substring("sig", i * 2 + 1, F.lit(2)) != F.substring(sig, i * 2 + 1, F.lit(2))))
    close = F.transform(F.filter("hubs", lambda h: apart(h["sig"]) <= distance), lambda h: h["tid"])
    seen = cut_lineage(many.withColumn("tile", _tile("tile", F.col("tiles"))).join(held, ["key", "tile"]).withColumn("close", close).drop("hubs", "tile"))
    votes = seen.select("key", F.explode("close").alias("hub")).groupBy("key", "hub").count()
    best = votes.groupBy("key").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    placed = cut_lineage(hot_join(seen, best, "key"))
    star = placed.where("array_contains(close, hub) and tid <> hub").select(F.col("tid").alias("a"), F.col("hub").alias("b"))
    loads = F.lit(1 / TILE).alias("load")
    guests = placed.where("not array_contains(close, hub)").select("key", "tid", "sig", "tiles", loads)  # each hub is close to itself
    rows = few.unionByName(_met(many.select("key", "tid", "sig", "tiles"), guests, "key"), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in groups(batches, ["key", "tile", "guest_tile"]):
            codes, names = pd.factorize(pdf["tid"], sort=True)
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), SIGNATURE)
            side = pdf["guest"].map({None: 2, False: 0, True: 1}).to_numpy()  # 2: a key of one tile, where all meet all
            forest, roots = Forest(len(names)), np.arange(len(names))
            for d in range(1, len(pdf)):
                i = np.flatnonzero(group[d:] == group[:-d])
                if not len(i):
                    break
                i = i[(side[i] != side[i + d]) | (side[i] == 2)]
                i = i[roots[codes[i]] != roots[codes[i + d]]]
                if len(i):
                    i = i[distances(sig[i], sig[i + d]) <= distance]
                    if len(i):
                        forest.join(zip(codes[i], codes[i + d]))
                        roots = forest.roots()
            moved = np.flatnonzero(roots != np.arange(len(names)))
            yield pd.DataFrame({"a": names[moved], "b": names[roots[moved]]})

    keys = ["key", "tile", "guest_tile"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a binary, b binary")
    return star.unionByName(found)


def _linked(rows: DataFrame, keys: list[str], n: int, percent: int, distance: int) -> DataFrame:
    """(a, b): edges that connect what is linked within each block (keys) of texts; exact, on whole sets of shingles.

    ``guest`` tells which pairs are compared: null with all, else guests with hosts. Texts of one known ``part``, or
    connected before, are not compared again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Shingles(n)
        for pdf, group in groups(batches, keys):
            for _, own in pdf.groupby(group, sort=False):
                yield _block(own, make, percent, distance)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a binary, b binary")


def _block(own: pd.DataFrame, make: Shingles, percent: int, distance: int) -> pd.DataFrame:
    own = own.drop_duplicates(["tid", "guest"]).reset_index(drop=True)
    sets = [make.of(t) for t in own["text"]]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sig = np.frombuffer(b"".join(own["sig"]), np.uint16).reshape(len(own), SIGNATURE)
    side = own["guest"].map({None: 2, False: 0, True: 1}).to_numpy()
    codes, tids = pd.factorize(own["tid"], sort=True)
    forest, mark = Forest(len(tids)), np.zeros(len(names), bool)
    if "part" in own:  # known components: join their texts beforehand
        heads = own.groupby("part").head(1).set_index("part").index
        first = dict(zip(heads, codes[own.groupby("part").head(1).index]))
        forest.join((c, first[p]) for c, p in zip(codes, own["part"]))
    known = forest.roots()
    roots = known.copy()
    for i in np.argsort(-sizes, kind="stable") if (side == 2).all() else np.flatnonzero(side != 0):
        j = np.flatnonzero((side != side[i]) | (side[i] == 2))
        j = j[roots[codes[j]] != roots[codes[i]]]
        j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
        j = j[distances(sig[j], sig[i]) <= distance]
        if not len(j):
            continue
        mark[flat[starts[i]:starts[i] + sizes[i]]] = True
        both = np.array([np.count_nonzero(mark[flat[starts[k]:starts[k] + sizes[k]]]) for k in j])
        mark[flat[starts[i]:starts[i] + sizes[i]]] = False
        j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
        if len(j):
            forest.join((codes[i], codes[k]) for k in j)
            roots = forest.roots()
    moved = np.flatnonzero(roots != known)
    return pd.DataFrame({"a": np.asarray(tids)[moved], "b": np.asarray(tids)[roots[moved]]})


def links(docs: DataFrame, texts: DataFrame, grouped: DataFrame, n: int = WORDS, percent: int = PERCENT, distance: int = DISTANCE) -> DataFrame:
    """(a, b): exact links that connect all linked texts of each group.

    A group of one tile is compared whole. In a larger one every tile is, together with a few hubs of the
    group; what that leaves outside the largest component of the group meets all its texts, tile by tile.
    """
    load = F.greatest(F.lit(1 / TILE), F.col("shingles") / TILE_SHINGLES)
    members = cut_lineage(grouped.join(texts.select("tid", "id", "th", "shingles", "sig"), "tid").withColumn("load", load))
    sizes = members.groupBy("root").agg(_tiles(F.sum("load")).alias("tiles"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_of()).alias("th"), "text")
    rows = rows.groupBy("id", "th").agg(F.first("text").alias("text"))
    placed = cut_lineage(hot_join(members, sizes, "root").join(rows, ["id", "th"]).drop("id", "th", "shingles"))
    alone = F.lit(None).cast("boolean").alias("guest")
    own = placed.select("root", _tile("tile", F.col("tiles")), alone, "tid", "sig", "text")
    large = placed.where("tiles > 1")
    hubs = large.join(top_per_key(large.select("root", "tid"), ["root"], [F.xxhash64("tid")], HUBS).select("root", "tid"), ["root", "tid"], "left_semi")
    hubs = hubs.select("root", _every("tiles").alias("tile"), alone, "tid", "sig", "text")
    first = cut_lineage(_linked(own.unionByName(hubs), ["root", "tile"], n, percent, distance))
    if large.isEmpty():
        return first
    parts = components(first).select(F.col("node").alias("tid"), F.col("root").alias("part"))
    parted = cut_lineage(large.join(parts, "tid", "left").withColumn("part", F.coalesce("part", "tid")))
    main = parted.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    guests = cut_lineage(hot_join(parted, main, "root").where("part <> main").drop("main"))
    return first.unionByName(_linked(_met(parted, guests, "root"), ["root", "tile", "guest_tile"], n, percent, distance))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Two documents are linked if their sets of word shingles (words between blanks, A-Z in lower case) have a
    Jaccard similarity of at least ``percent`` of a hundred; ``component_id`` is the smallest doc_id reachable
    by links, ``kept`` whether the document is that one.

    Documents of one set are one text from the start. A signature keeps 16 bits of each of 32 MinHash values.
    Split in 8 chunks of 4 values, two signatures that differ in at most 15 values have a chunk with at most one
    difference: the index has a key for every chunk and every single value of it left out, so all pairs within
    the distance meet. A pair at a similarity of 0.85 differs in more than 15 of 32 values with a probability of
    4e-6. What meets connects groups of texts, in which links are confirmed on whole sets (of 64-bit hashes).
    Texts already connected are not compared, so groups of copies cost about their size; a group of m texts, g of
    them outside its largest component, costs m * g comparisons, spread over tiles.

    A text under ``n`` words is one shingle. Null, empty and wordless texts have no shingles and no links. Rows
    alike in everything are copies of each other. Rows without an id never name a component; they are kept if
    nothing they are linked with has an id. Texts of any length are compared whole. An empty table gives no rows.
    Other columns are ignored.
    """
    found = cut_lineage(features(docs, n))
    first = F.min_by(F.struct("id", "th", "shingles"), F.struct(F.col("id") == NO_ID, "id", "th"))
    texts = found.where("tid is not null").groupBy("tid").agg(first.alias("f"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    texts = cut_lineage(texts.select("tid", "f.id", "f.th", "f.shingles", "sig", "keys"))
    grouped = cut_lineage(components(near_signatures(texts, distance)).select(F.col("node").alias("tid"), "root"))
    linked = components(links(docs, texts, grouped, n, percent, distance)).select(F.col("node").alias("tid"), "root")
    named = texts.select("tid", F.when(F.col("id") != NO_ID, F.col("id")).alias("id")).join(linked, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    heads = named.groupBy("root").agg(F.min("id").alias("head"))
    out = hot_join(found.select("id", "tid", "shingles"), named.join(heads, "root").select("tid", "head"), "tid")
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.when(F.col("tid").isNull(), own).otherwise(F.col("head"))
    return out.select(own.alias("doc_id"), F.col("shingles").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))
