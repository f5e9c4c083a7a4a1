"""Personal data: patterns, and terms that reveal protected entities by what the corpus says about both."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.llm.common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
UNSEEN = 0.5  # documents in which a term is taken to stand without the entity, beyond those counted
GENERALISE, REMOVE = 0.8, 0.95  # disclosure from which a term is generalised, removed
MAX_TERM = 64  # longer terms are known by their digest
HELD_TERMS, HELD_PLACES = 200_000, 100_000  # terms and places a task holds before it passes them on
#: Characters and patterns of the kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):  # a longer chain of numbers holds one address after the other
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of all kinds, by kind as listed, then start; code points, end exclusive. Linear in the text for each kind."""
    out: list[Span] = []
    for mark, find in (("@", _emails), (".", _ips), ("", _cards), ("+", _phones)):
        if mark in text:
            out += find(text)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(word: str) -> str:
    """The term a word is counted as: in small letters; a long one by its digest, which no word can be."""
    low = word.lower()
    return low if len(low) <= MAX_TERM else "#" + xxhash.xxh128_hexdigest(low.encode("utf-8", "surrogatepass"))


def outside(text: str, spans: list[Span]) -> str:
    """The text with its mentions blanked, so that places stay and no word reaches into a mention."""
    parts, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            parts += [text[at:max(a, at)], " " * (b - max(a, at))]
            at = b
    return "".join(parts) + text[at:]


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, counts of the kinds, entities, places, counted) from one pass over the texts.

    One row for each document: its base spans, the hashes of the entities it mentions and, if there are any, the
    places of all its words outside mentions. Rows whose ``counted`` is not null are no documents: they hold, for
    terms, the number of documents of a task in which they stand outside mentions. Both sides cut words alike.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def counts() -> pd.DataFrame:
            terms = [{"term": t, "n": n} for t, n in held.items()]
            held.clear()
            return pd.DataFrame({"doc_id": pd.Series([None], dtype=object), "th": 0, "base": "", **{f"n_{k}": 0 for k in KINDS}, "entities": [[]], "places": [[]], "counted": [terms]})

        for pdf in batches:
            start, words, out = 0, 0, []
            for at, text in enumerate(pdf["text"], 1):
                text = text or ""
                spans = base_spans(text)
                rest = outside(text, spans) if spans else text
                held.update({term_of(w) for w in set(WORD.findall(rest))})
                entities = list({xxhash.xxh128_digest(f"{k}:{text[a:b].lower()}") for k, a, b in spans})
                places = [{"term": term_of(m[0]), "s": m.start(), "e": m.end()} for m in WORD.finditer(rest)] if spans else []
                out.append((joined(spans), *(sum(s[0] == k for s in spans) for k in KINDS), entities, places))
                words += len(places)
                if words >= HELD_PLACES or at == len(pdf):
                    made = pd.DataFrame(out, columns=["base", *(f"n_{k}" for k in KINDS), "entities", "places"])
                    yield pd.concat([pdf[["doc_id", "th"]].iloc[start:at].reset_index(drop=True), made], axis=1).assign(counted=None)
                    start, words, out = at, 0, []
                if len(held) >= HELD_TERMS:
                    yield counts()
        if held:
            yield counts()

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, th long, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<binary>, places array<struct<term:string,s:int,e:int>>, counted array<struct<term:string,n:long>>")


def pairs_of(found: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, th, entity, term, with_t) for every entity of a document and every term anywhere in it that may disclose ``least``.

    No pair has more documents than its entity, so a term in more than m**least * n**(1 - least) documents, with m
    those of the most frequent entity and n all of them, is below ``least`` with every entity. Such
    terms go before entities and terms are paired; nothing else is left out. ``with_t`` counts the term's documents.
    """
    documents = found.where(F.col("counted").isNull())
    with_t = found.select(F.explode("counted").alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("with_t"))
    if least > 0:
        most = documents.select(F.explode("entities").alias("entity")).groupBy("entity").count().agg(F.max("count")).first()[0] or 0
        with_t = with_t.where(F.col("with_t") + UNSEEN <= most**least * documents.count() ** (1 - least) * (1 + 1e-9))
    own = documents.where(F.size("entities") > 0)
    terms = own.select("doc_id", "th", "entities", F.explode(F.array_distinct(F.col("places.term"))).alias("term"))
    return terms.join(with_t, "term").select("doc_id", "th", F.explode("entities").alias("entity"), "term", "with_t")


def disclosures(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of ``pairs_of``: how much of what identifies an entity its terms give away, from the whole corpus.

    A term t tells log2(p(e | t) / p(e)) bits about an entity e, of the -log2 p(e) bits that single it out;
    disclosure is the quotient, of every pair that shares a document. All counts are of documents (rows, so ids
    play no part), exact, and of words cut by one rule. p(e | t) is estimated low: documents with both, over
    those with t and ``UNSEEN`` more. So a term seen in one document discloses less of its entity than one that
    stands with it again and again, the less the more often the entity is met without it. An entity that
    every document holds has nothing left to disclose.
    """
    documents = found.where(F.col("counted").isNull())
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("with_t").alias("with_t"))
    with_e = documents.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_e"))
    n = F.lit(float(documents.count()))
    told = both.join(with_e.where(F.col("with_e") < n), "entity")
    bits = F.log2(F.col("both") * n / ((F.col("with_t") + UNSEEN) * F.col("with_e")))
    return told.select("entity", "term", (bits / F.log2(n / F.col("with_e"))).alias("disclosure"))


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, th, base, n_email, n_ip, n_card, n_phone, added) for every document.

    ``added`` lists (start, end, action) of all places, anywhere in a document, of the terms whose disclosure of
    an entity that the document mentions reaches a threshold: from ``generalise`` on they are generalised, from
    ``remove`` on removed.

    Every text is read once; what follows runs on the documents with mentions. Pairs of entity and term are
    counted before they are shuffled, and joined on both, so an entity in a third of all documents is split
    like its terms; there are as many as a document has entities times distinct words. Null text is empty: no
    spans. Repeated rows are found apart and alike. An empty table gives no rows. Other columns are ignored.
    """
    @F.pandas_udf("array<struct<s:int,e:int,action:string>>")
    def placed(places: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(places, hits):
            action = {x["term"]: x["action"] for x in found}
            out.append([{"s": x["s"], "e": x["e"], "action": action[x["term"]]} for x in own if x["term"] in action])
        return pd.Series(out)

    found = cut_lineage(mentions(docs))
    pairs = cut_lineage(pairs_of(found, generalise))
    strong = cut_lineage(disclosures(found, pairs).where(F.col("disclosure") >= generalise))
    hit = pairs.select("doc_id", "th", "entity", "term").join(strong, ["entity", "term"]).groupBy("doc_id", "th", "term").agg(F.max("disclosure").alias("d"))
    action = F.when(F.col("d") >= remove, "remove").otherwise("generalise")
    hits = hit.groupBy("doc_id", "th").agg(F.collect_list(F.struct("term", action.alias("action"))).alias("hits"))
    documents = found.where(F.col("counted").isNull()).drop("counted")
    a, b = documents.where(F.size("entities") > 0).alias("a"), hits.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    none = F.array().cast("array<struct<s:int,e:int,action:string>>")
    met = a.join(b, same, "left").select("a.*", F.when(F.col("hits").isNull(), none).otherwise(placed("places", F.coalesce("hits", F.array().cast("array<struct<term:string,action:string>>")))).alias("added"))
    rest = documents.where(F.size("entities") == 0).withColumn("added", none)
    return met.unionByName(rest).drop("entities", "places")


def all_spans() -> Column:
    """All spans of a row of ``find``: the base ones, then the added terms by start."""
    terms = F.array_join(F.transform("added", lambda x: F.concat_ws(":", F.lit(TERM), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(terms != "", terms))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns and ``clean_text``: mentions replaced by their kind, terms generalised or removed."""
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, bases: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for text, base, terms in zip(texts, bases, added):
            cuts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in (base or "").split(",") if s)]
            cuts += [(x["s"], x["e"], "" if x["action"] == "remove" else "[TERM]") for x in (terms if terms is not None else [])]
            parts, at, text = [], 0, text or ""
            for a, b, put in sorted(cuts):
                if a >= at:
                    parts += [text[at:a], put]
                    at = b
                elif b > at:  # overlapping mentions are one
                    at = b
            out.append("".join(parts) + text[at:])
        return pd.Series(out)

    found = find(docs, **how).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "base", "added").dropDuplicates(["_id", "_th"])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    met = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
    return met.select("row.*", rewrite(F.col("row.text"), "base", "added").alias("clean_text"))
