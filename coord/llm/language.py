"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import fold_of, smallest_hashes

FOLDS, HELD_OUT = 3, 1
SAMPLE_PER_LANG = 400  # documents per language that its prototype is bundled from
DIM = 512
CHUNK_CHARS = 300_000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


class Space:
    """Random vectors of +1 and -1 for letters; n-grams bind the permuted vectors of their letters."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 8192:  # of a text in all scripts; vectors are made again from their code points
                self.letters.clear()
            seed = xxhash.xxh64_intdigest(code.to_bytes(4, "little"))
            self.letters[code] = np.random.default_rng(seed).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams packed as three times 21 bits: the first letter rolled twice, the second once, multiplied."""
        parts = [(codes >> np.int64(42)), (codes >> np.int64(21)) & 0x1FFFFF, codes & 0x1FFFFF]
        out = None
        for turn, part in zip((2, 1, 0), parts):
            seen, inv = np.unique(part, return_inverse=True)
            vectors = np.stack([np.roll(self.letter(int(c)), turn) for c in seen])[inv]
            out = vectors if out is None else out * vectors
        return out.astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Sum of the trigram vectors of each text (words in lower case, set off by blanks), to unit length; 0 without letters."""
        out = np.zeros((len(texts), self.dim), np.float32)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            words = _OTHER.sub(" ", (text or "").lower()).strip()
            if not words:
                continue
            points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
            for a in range(0, len(codes), CHUNK_CHARS):
                held.append((i, codes[a:a + CHUNK_CHARS]))
                size += len(held[-1][1])
                if size >= CHUNK_CHARS:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        if not held:
            return
        seen, inv = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
        at, groups = 0, []
        for i, codes in held:
            groups.append((i, *np.unique(inv[at:at + len(codes)], return_counts=True)))
            at += len(codes)
        for a in range(0, len(seen), 16_384):  # bounded memory for texts of many scripts
            vectors = self.grams(seen[a:a + 16_384])
            for i, which, counts in groups:
                lo, hi = np.searchsorted(which, (a, a + 16_384))
                if hi > lo:
                    out[i] += counts[lo:hi].astype(np.float32) @ vectors[which[lo:hi] - a]


class Profiles:
    """Language prototypes: mean bundles of a sample, compared after their common mean is taken off."""

    def __init__(self, langs: list[str], means: np.ndarray):
        self.langs, self.centre = langs, means.mean(axis=0)
        apart = means - self.centre
        self.prototypes = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)

    def predict(self, space: Space, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bundles = space.bundles(texts)
        apart = bundles - self.centre
        cosine = apart @ self.prototypes.T / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)
        best = cosine.argmax(axis=1)
        known = bundles.any(axis=1) & np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return langs, np.where(known, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0)


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Profiles | None:
    """Prototypes from at most ``per_lang`` documents per language, outside the held-out fold, of any length.

    The documents with the smallest hashes of their ids are chosen by id alone (rows without an id are not),
    then their texts, one for each id, are fetched; at most ``per_lang`` ids per language are broadcast. The
    tasks bundle the whole texts and only one sum per batch and language comes back. None without any.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    rows = rows.where(F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = smallest_hashes(rows.select("doc_id", "lang").distinct(), "lang", per_lang)
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = Space()
        for pdf in batches:
            vectors = space.bundles(list(pdf["text"]))
            for lang, rows in pdf.groupby("lang").indices.items():
                full = vectors[rows].any(axis=1).sum()
                yield pd.DataFrame({"lang": [lang], "n": [int(full)], "total": [vectors[rows].sum(axis=0)]})

    totals: dict[str, list] = {}
    for r in sample.mapInPandas(bundle, "lang string, n long, total array<float>").collect():
        own = totals.setdefault(r["lang"], [0, np.zeros(DIM)])
        own[0], own[1] = own[0] + r["n"], own[1] + np.array(r["total"])
    langs = sorted(k for k, (n, _) in totals.items() if n)
    return Profiles(langs, np.stack([totals[k][1] / totals[k][0] for k in langs])) if langs else None


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    Letters have random vectors of +1 and -1; the trigrams of the lower-case words (with blanks at their ends)
    bind three of them, permuted by place, by multiplication; a text is the sum of its trigrams. The language
    with the nearest prototype by cosine is predicted; the score is that cosine mapped to 0..1.

    Null, empty and letterless texts are ``und`` with score 0, and so is everything where no text has a
    language. Ties go to the first language in order. Repeated rows are predicted alike. A null id is in the
    fold of the empty text. An empty table gives no rows. Other columns are ignored.
    """
    profiles = learn(docs, **how)
    rows = docs.select("doc_id", "text")
    held_out = (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    if profiles is None:
        return rows.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Space()
        for texts in batches:
            langs, score = shared.value.predict(space, list(texts))
            yield pd.DataFrame({"lang": langs, "score": score})

    return rows.select("doc_id", held_out, predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")
