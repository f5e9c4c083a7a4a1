"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import union_all

ERROR_RATE = 0.05
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, letters and digits, single blanks between."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in ``errors + 1`` parts of about equal length."""
    n, parts = len(item), errors + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Item:
    """A test item with its error budget and the bit masks of its characters."""

    def __init__(self, key, text: str, rate: float):
        self.key, self.size = key, len(text)
        self.errors = int(self.size * rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.all, self.top = (1 << self.size) - 1, 1 << (self.size - 1)

    def distance(self, text: str, a: int, b: int) -> int:
        """Least edit distance of the item to any part of ``text[a:b]``, by bit-parallel columns (Myers)."""
        plus, minus, score, best, full, top = self.all, 0, self.size, self.size, self.all, self.top
        get = self.masks.get
        for c in text[a:b]:
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                best = min(best, score)
            up, down = up << 1, down << 1
            plus = (down | ~(diagonal | up)) & full
            minus = up & diagonal & full
        return best


def _index(items: list[tuple[object, str]], rate: float) -> tuple[list[Item], ahocorasick.Automaton]:
    made, found = [], {}
    for key, text in items:
        item = Item(key, text, rate)
        for offset, piece in pieces(text, item.errors):
            found.setdefault(piece, []).append((len(made), offset))
        made.append(item)
    automaton = ahocorasick.Automaton()
    for piece, places in found.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return made, automaton


def matches(text: str, made: list[Item], automaton: ahocorasick.Automaton) -> Iterator[tuple[object, int, int]]:
    """(item, edits, size) of the items within their error budget of some part of a normal text."""
    spans: dict[int, list[list[int]]] = {}
    for last, (length, places) in automaton.iter(text):
        for k, offset in places:
            start = last + 1 - length - offset
            a, b = start - made[k].errors, start + made[k].size + made[k].errors
            own = spans.setdefault(k, [])
            if own and a <= own[-1][1] and b >= own[-1][0]:
                own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
            else:
                own.append([a, b])
    for k, own in spans.items():
        item = made[k]
        edits = min(item.distance(text, max(0, a), b) for a, b in own)
        if edits <= item.errors:
            yield item.key, edits, item.size


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, item_chars) for every test item that a document holds within its error budget.

    Texts and items are compared in lower case, as letters and digits with single blanks between. An item of m
    characters may differ by ``error_rate`` of m edits, rounded down. Cut into one piece more than that, an
    item with so few edits has a piece without any; all pieces of a block of items are found in one pass over
    a text, and each neighbourhood of a hit is verified by bit-parallel edit distance. The edits given are the
    least over the document.

    The items are a query set: they are passed to the tasks in blocks of at most ``block_chars`` characters
    (a longer item alone), each block meeting all documents, which are neither shuffled nor collected.

    Null and empty texts and items without letters or digits match nothing. Repeated items or documents match
    apart. Empty tables give no rows. Other columns are ignored.
    """
    schema = [docs.schema["doc_id"], benchmark.schema["item_id"]]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", edits int, item_chars int"
    texts = docs.select("doc_id", "text").where("text is not null")

    def search(block: list[tuple[object, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made, automaton = _index(shared.value, error_rate)
            for pdf in batches:
                rows = []
                for doc_id, text in zip(pdf["doc_id"].astype(object), pdf["text"]):
                    rows += [(None if pd.isna(doc_id) else doc_id, *m) for m in matches(normal(text), made, automaton)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "item_chars"], dtype=object)

        return texts.mapInPandas(run, out)

    parts = [search(block) for block in _blocks(benchmark, block_chars)]
    return union_all(parts) if parts else docs.sparkSession.createDataFrame([], out)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that hold no test item; rows without an id are kept or dropped together."""
    hit = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_id")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"))
    return packed.join(hit, F.col("_doc").eqNullSafe(F.col("_id")), "left_anti").select("row.*")
