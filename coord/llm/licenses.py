"""Licence scans with a positional index of rare licence words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.llm.common import lower_ascii, text_of

#: Places of these phrases are counted and give these labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Templates of the method: label, wording, and the key phrase that must stand in it word by word.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl", "this work is licensed under the gnu affero general public license version", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by", "this work is licensed under the cc by 4 0 license", "under the cc by 4 0"),
    ("cc0", "this work is marked with cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)
RARE_WORDS = 3
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATOR), "")


def _templates() -> list[tuple[str, list[str], int, list[str], bool]]:
    """(label, words, start of the key phrase, key phrase, whether base)."""
    out = [(label, p.split(), 0, p.split(), True) for label, p in BASE]
    for label, whole, key in TEMPLATES:
        w, k = whole.split(), key.split()
        out.append((label, w, next(i for i in range(len(w)) if w[i:i + len(k)] == k), k, False))
    return out


def document_frequencies(words: DataFrame) -> dict[str, int]:
    """Documents that hold each licence word; at most one entry per word of the templates reaches the driver."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, ws, _, _, _ in _templates() for w in ws})])
    found = words.select(F.explode(F.array_intersect("words", vocabulary)).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}


def scan(docs: DataFrame, rare_words: int = RARE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) per document.

    Inverse document frequencies of the licence words come from all documents. A file's postings are the
    places of its rarest licence words: per template the ``rare_words`` rarest words of its key phrase. A posting at place p of
    the template's word i votes for a start at p - i; the votes of a template's rare words are intersected, so
    a start stays only where all of them stand at their relative places. Then the whole key phrase must be
    there, word by word. ``score`` is the largest share of a verified template's words found at their places
    (0 without any). ``places`` lists (label, start, end, share) of all.

    Only rows that hold a rare word build postings; everything stays within a row, so no copy, file or phrase
    is hot and only counts of the licence words are shuffled.

    Null text is empty: no words, null first and last word, empty labels. Repeated rows are scanned apart.
    An empty table gives no rows. Other columns are ignored.
    """
    words = docs.select("doc_id", words_of(text_of()).alias("words"))
    df, n = document_frequencies(words), docs.count()
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0)))
    plan = []
    for label, whole, at, key, base in _templates():
        rare = sorted(dict.fromkeys(key), key=lambda w: (-idf(w), w))[:rare_words]
        plan.append((label, whole, at, key, base, rare))
    index = sorted({w for *_, rare in plan for w in rare})
    anchors = sorted({rare[0] for *_, rare in plan})
    posted = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(index))
    none = F.array().cast("array<struct<w:string,i:int>>")
    rows = words.withColumn("posted", F.when(F.arrays_overlap("words", _array(anchors)), posted).otherwise(none))
    found = []
    for label, whole, at, key, base, rare in plan:
        votes = []
        for word in rare:  # every place of the word in the key phrase votes
            starts = [_starts(word, at + j) for j, x in enumerate(key) if x == word]
            votes.append(F.array_distinct(F.concat(*starts)))
        both = votes[0]
        for other in votes[1:]:
            both = F.array_intersect(both, other)
        found.append(_verified(both, label, whole, at, key, base))
    rows = rows.withColumn("places", F.when(F.size("posted") > 0, F.concat(*found)).otherwise(F.array().cast("array<struct<label:string,base:boolean,start:int,end:int,share:double>>")))
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"].cast("long"))
    joined = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        joined(F.filter("places", lambda p: p["base"])).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _starts(word: str, offset: int) -> Column:
    """Template starts that the postings of a word vote for."""
    return F.transform(F.filter("posted", lambda p: p["w"] == word), lambda p: p["i"] - offset)


def _verified(starts: Column, label: str, whole: list[str], at: int, key: list[str], base: bool) -> Column:
    """Places whose whole key phrase is in the words."""
    held = F.filter(starts, lambda s: (s + at >= 0) & (F.slice("words", F.greatest(s + at, F.lit(0)) + 1, F.lit(len(key))) == _array(key)))
    return F.transform(held, lambda s: F.struct(
        F.lit(label).alias("label"), F.lit(base).alias("base"), s.alias("start"), (s + len(whole)).alias("end"), _share(s, whole).alias("share"),
    ))


def _share(start: Column, whole: list[str]) -> Column:
    hits = [F.when((start + j >= 0) & (F.get("words", start + j) == w), 1).otherwise(0) for j, w in enumerate(whole)]
    return sum(hits[1:], hits[0]) / F.lit(float(len(whole)))
