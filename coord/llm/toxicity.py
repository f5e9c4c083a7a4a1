"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import fold_of, smallest_hashes

FOLDS = 5
SAMPLE_PER_LABEL = 1_200  # labelled documents of each kind that the network is trained on
WINDOW, STRIDE = 32, 16
SEARCHED = -4.0  # around a window of at least this logit, every window is scored
BLOCK_WINDOWS = 8_192
DIM, HIDDEN = 16, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 15, 1 << 14
STEPS, BATCH, RATE = 200, 64, 0.01  # a small sample is gone through more often
CHUNK_WORDS = 30_000
CLEAN_SHARE = 0.65  # weight of all clean documents of the sample together
_WORD = re.compile(r"\w+")


def vocabulary(texts: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Word numbers of each text, and the distinct words."""
    seen = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(texts)))}
    return [np.array([seen[w] for w in t], np.int64) for t in texts], list(seen)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words, slots of their character 3- to 5-grams (with a mark before the first letter), starts and numbers of these."""
    marked = ["^" + w + "$$$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    mul = np.uint64(0x9E3779B97F4A7C15)
    mix = lambda h, c: ((h ^ c) * mul) ^ ((h ^ c) * mul >> np.uint64(29))
    three = mix(mix(mix(np.uint64(3), codes[:-2]), codes[1:-1]), codes[2:])
    four = mix(three[:-1], codes[3:])
    five = mix(four[:-1], codes[4:])
    per_word = sizes - 4  # a gram of each length starts at the mark and at every letter but the last ones
    at = np.repeat(starts, per_word) + np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    grams = np.stack([three[at], four[at], np.append(five, np.uint64(0))[at]], axis=1).ravel()
    per_word = per_word * 3
    whole = np.add.reduceat(mix(codes, np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)), starts)
    word_slot = (mix(whole, np.uint64(7)) >> np.uint64(20)).astype(np.int64) % WORD_SLOTS
    return word_slot, (grams >> np.uint64(20)).astype(np.int64) % CHAR_SLOTS, np.cumsum(per_word) - per_word, per_word


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every ``STRIDE``-th window of word numbers (-1 beyond the end) and the text of each; a text without words has one empty window."""
    parts, owner = [], []
    for k, x in enumerate(ids):
        n = max(1, -(-(len(x) - WINDOW) // STRIDE) + 1)
        padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int64)
        padded[:len(x)] = x
        parts.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        owner.append(np.full(n, k))
    return np.concatenate(parts), np.concatenate(owner)


def between(ids: list[np.ndarray], owner: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all whole windows that overlap the ``near`` ones of ``windows(ids)`` by more than half, without the latter."""
    sizes = np.array([len(x) for x in ids])
    first = np.searchsorted(owner, np.arange(len(ids)))
    at = (np.flatnonzero(near) - first[owner[near]]) * STRIDE
    starts = (at[:, None] + np.arange(1 - STRIDE, STRIDE)).ravel()
    text = np.repeat(owner[near], 2 * STRIDE - 1)
    ok = (starts >= 0) & (starts + WINDOW <= sizes[text]) & (starts % STRIDE != 0)
    both = np.unique(np.stack([text[ok], starts[ok]], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _tanh_gates(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Network:
    """Word and character vectors, a gated recurrent layer in each direction, attention over the words of a window."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.words, self.chars = normal(WORD_SLOTS, DIM, scale=0.1), normal(CHAR_SLOTS, DIM, scale=0.1)
        self.p = {
            "in_f": normal(DIM, 3 * HIDDEN, scale=0.4), "in_b": normal(DIM, 3 * HIDDEN, scale=0.4),
            "bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32),
            "rec_f": normal(HIDDEN, 3 * HIDDEN, scale=0.3), "rec_b": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "off": np.zeros(1, np.float32),
        }

    def vectors(self, feats) -> np.ndarray:
        word_slot, gram_slot, starts, counts = feats
        return self.words[word_slot] + np.add.reduceat(self.chars[gram_slot], starts) / np.sqrt(counts)[:, None].astype(np.float32)

    def _layer(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at every place; x holds the projected inputs of the words, looked up by number."""
        rec, h = self.p["rec_" + side], np.zeros((len(mask), HIDDEN), np.float32)
        out, trace = np.empty((WINDOW, len(mask), HIDDEN), np.float32), []
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            a, u = x[t], h @ rec
            gates = _tanh_gates(a[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(a[:, 2 * HIDDEN:] + reset * u[:, 2 * HIDDEN:])
            nxt = new + update * (h - new)
            nxt = np.where(mask[:, t, None], nxt, h)
            if keep:
                trace.append((t, h, reset, update, new, u[:, 2 * HIDDEN:]))
            h = out[t] = nxt
        return out, trace

    def forward(self, vectors: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logit of every window."""
        mask, safe = ids >= 0, np.maximum(ids, 0).T
        sides = []
        for side in "fb":
            table = vectors @ self.p["in_" + side] + self.p["bias_" + side]
            sides.append(self._layer(table[safe], mask, side, keep))
        h = np.concatenate([sides[0][0], sides[1][0]], axis=2)
        e = np.where(mask.T, h @ self.p["att"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w *= mask.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, h)
        logits = pooled @ self.p["out"] + self.p["off"]
        return logits, (mask, safe, h, w, pooled, [s[1] for s in sides]) if keep else None

    def backward(self, vectors: np.ndarray, cache, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        mask, safe, h, w, pooled, traces = cache
        g = {"out": pooled.T @ dlogit, "off": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        dh = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", h, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, h)
        dh += de[:, :, None] * self.p["att"]
        dvec = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            rec, part = self.p["rec_" + side], dh[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            drec, carry = np.zeros_like(rec), np.zeros((len(mask), HIDDEN), np.float32)
            dx = np.zeros((WINDOW, len(mask), 3 * HIDDEN), np.float32)
            for t, before, reset, update, new, u in reversed(traces[k]):
                d = part[t] + carry
                live = mask[:, t, None]
                dn = d * live
                dnew = dn * (1 - update) * (1 - new * new)
                dupdate = dn * (before - new) * update * (1 - update)
                dreset = dnew * u * reset * (1 - reset)
                du = np.concatenate([dreset, dupdate, dnew * reset], axis=1)
                drec += before.T @ du
                carry = du @ rec.T + dn * update + d * ~live
                dx[t] = np.concatenate([dreset, dupdate, dnew], axis=1)
            dtable = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
            np.add.at(dtable, safe.ravel(), dx.reshape(-1, 3 * HIDDEN))
            g["rec_" + side], g["bias_" + side], g["in_" + side] = drec, dtable.sum(axis=0), vectors.T @ dtable
            dvec += dtable @ self.p["in_" + side].T
        return g, dvec

    def train(self, texts: list[list[str]], toxic: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Each document is as toxic as its most toxic window: only that window is learned from (Adam; Adagrad for the vectors)."""
        r, ids_all, (m, v), step = np.random.default_rng(seed), texts, ({}, {}), 0
        memory = [np.full(len(x), 1e-3, np.float32) for x in (self.words, self.chars)]
        weight = np.where(toxic == 1, (1 - CLEAN_SHARE) / (toxic == 1).sum(), CLEAN_SHARE / (toxic == 0).sum()) * len(toxic)
        for _ in range(-(-steps // -(-len(toxic) // BATCH))):
            order = r.permutation(len(toxic))
            for a in range(0, len(order), BATCH):
                rows = order[a:a + BATCH]
                ids, words = vocabulary([ids_all[i] for i in rows])
                feats = hashed(words or ["?"])
                vectors = self.vectors(feats)
                win, owner = windows(ids)
                logits, _ = self.forward(vectors, win)
                best = np.lexsort((-logits, owner))
                best = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
                logits, cache = self.forward(vectors, win[best], keep=True)
                dlogit = ((_tanh_gates(logits) - toxic[rows]) * weight[rows] / len(rows)).astype(np.float32)
                grads, dvec = self.backward(vectors, cache, dlogit)
                step += 1
                for name, grad in grads.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
                    self.p[name] -= (RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                word_slot, gram_slot, starts, counts = feats
                used = np.flatnonzero(dvec.any(axis=1))  # words of the windows learned from
                dvec, counts = dvec[used], counts[used]
                at = np.repeat(starts[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                spread = np.repeat(dvec / np.sqrt(counts)[:, None].astype(np.float32), counts, axis=0)
                for table, mem, slot, grad in ((self.words, memory[0], word_slot[used], dvec), (self.chars, memory[1], gram_slot[at], spread)):
                    hit, inv = np.unique(slot, return_inverse=True)
                    total = np.zeros((len(hit), DIM), np.float32)
                    np.add.at(total, inv, grad)
                    mem[hit] += (total * total).mean(axis=1)
                    table[hit] -= 0.05 * total / np.sqrt(mem[hit])[:, None]

    def score(self, texts: Iterable[str | None], searched: float = SEARCHED) -> np.ndarray:
        """0 to 1 for each text: the highest of its windows.

        Every ``STRIDE``-th window is scored, then all windows around those of a logit of at least ``searched``.
        Works through the words in chunks of bounded size; a text is split into words when its turn comes.
        """
        out: list[float] = []
        chunk: list[tuple[int, list[str]]] = []

        def flush() -> None:
            ids, words = vocabulary([w for _, w in chunk])
            text = np.array([i for i, _ in chunk])
            vectors = self.vectors(hashed(words or ["?"]))
            win, owner = windows(ids)
            logits = np.concatenate([self.forward(vectors, win[a:a + BLOCK_WINDOWS])[0] for a in range(0, len(win), BLOCK_WINDOWS)])
            best = np.full(len(chunk), -np.inf)
            np.maximum.at(best, owner, logits)
            of, starts = between(ids, owner, logits >= searched)
            base, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
            for a in range(0, len(of), BLOCK_WINDOWS):
                which = of[a:a + BLOCK_WINDOWS]
                more = flat[(base[which] + starts[a:a + BLOCK_WINDOWS])[:, None] + np.arange(WINDOW)]
                np.maximum.at(best, which, self.forward(vectors, more)[0])
            for i, x in zip(text, _tanh_gates(best)):
                out[i] = max(out[i], float(x))
            chunk.clear()

        held = 0
        for i, t in enumerate(texts):
            out.append(0.0)
            w = _WORD.findall((t or "").lower())
            for a in range(0, max(1, len(w) - WINDOW + STRIDE), CHUNK_WORDS):  # pieces overlap, so no window is lost
                chunk.append((i, w[a:a + CHUNK_WORDS + WINDOW]))
                held += len(chunk[-1][1])
                if held >= CHUNK_WORDS:
                    flush()
                    held = 0
        if chunk:
            flush()
        return np.array(out, np.float32)


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, per_label: int = SAMPLE_PER_LABEL) -> Network | None:
    """A network trained on at most ``per_label`` documents of each label, of any length.

    Only documents whose fold is not 0 are used, those with the smallest hashes of their ids. They are chosen
    by id alone, then their whole texts (one for each id) are fetched: at most two times ``per_label`` ids are
    broadcast and as many texts reach the driver. None if a label is missing there.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = docs.where(F.length("text") > 0).select("doc_id", "text")
    chosen = smallest_hashes(some.select("doc_id").distinct().join(known, "doc_id"), "toxic", per_label)
    met = some.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    picked = sorted(met.select("toxic", F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect())
    toxic = np.array([r["toxic"] for r in picked], np.float32)
    if not len(picked) or toxic.min() == toxic.max():
        return None
    net = Network()
    net.train([_WORD.findall(r["text"].lower()) for r in picked], toxic)
    return net


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents' rows as a struct ``row``, with ``score``."""
    spark = docs.sparkSession
    if net is None:
        return docs.select(F.struct("*").alias("row"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts).astype(float))

    return docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    The score of a text is that of its most toxic window of ``WINDOW`` words. Of all overlapping windows, those half
    a window apart are scored first, and then every one around each that is not far below the threshold (a logit of
    ``SEARCHED``, a score of 0.018). Labels are learned from a bounded sample of documents outside fold 0 of the ids.
    Null, empty and wordless texts are scored as one empty window. Repeated rows are scored apart and alike;
    repeated labels count as toxic if one of them does. Without labels of both kinds every score is 0. A null
    id is in the fold of the empty text. An empty table gives no rows. Other columns are ignored.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels, folds, **how))
    return out.select("row.doc_id", (fold_of(F.col("row.doc_id"), folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    return scored(docs, train(docs, labels, **how)).where("score < 0.5").select("row.*")
