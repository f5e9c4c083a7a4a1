"""The search index against a scan of the texts, over several segments."""

import pytest
from pyspark.sql import functions as F

from coord.operators import search
from coord.operators.search_index import SearchIndex, index_of
from coord.streaming.io import run_folder

DOCS = {
    "spec/features/a/README.md": "# Claim protocol\n\n**Status:** Stable\n\n## Dependencies\n\n- b\n\n## Claiming\n\nThe claiming-protocol is re-claimed.\n```\n# claim in code\n```\nEnd of the Claiming Protocol.\n",
    "spec/features/a/sub/README.md": "# Sub\r\n\r\n**Status:** Draft\r\n\r\n### Outstanding Questions\r\n\r\n- Is a claim, protocol or both?\r\n",
    "spec/features/b/README.md": "# B\n\nNothing here. foo_bar baz ** star\n\n## Claims\n\n### Deep\n\nprotocol claims\n\n## Other\n\nclaim",
    "spec/plans/p/README.md": "# Plan\n\n**Features:** b\n\nclaim É protocol\n",
    "docs/readme.md": "",
}
CASES = [
    ("claim", {}), ("claim protocol", {}), ("Claiming Protocol", {"phrase": True}), ("laim", {}), ("claiming-protocol", {"phrase": True}), ("claim, protocol or", {"phrase": True}),
    ("**", {}), ("foo_bar", {}), ("o_b", {}), ("é", {}), ("claim", {"section": "claim"}), ("claim", {"section": "oq"}), ("protocol claims", {"section": "claims"}), ("claim star", {"section": "claims"}),
    ("claim", {"status": "Stable"}), ("claim", {"type": "plan"}), ("claim", {"feature": "a"}), ("claim", {"context": 0}), ("absent", {}), ("the claiming protocol", {"phrase": True}), (" of  the", {"phrase": False}),
]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "path string, text string")


@pytest.fixture(scope="module")
def segments(spark):
    """An index built in steps, and the documents it should hold."""
    index = SearchIndex(spark, run_folder(spark, "index"))
    first = {**DOCS, "spec/features/b/README.md": "# Old claim protocol\n", "spec/features/gone/README.md": "# claim protocol star\n"}
    del first["spec/features/a/sub/README.md"]
    index.update(frame(spark, first))
    index.update(frame(spark, {**first, "spec/features/b/README.md": "# Middle claim\n"}))
    index.update(frame(spark, DOCS))
    assert index.segments == [0, 1, 2]
    index.update(frame(spark, DOCS))
    assert index.segments == [0, 1, 2]
    return index


@pytest.mark.parametrize("query,how", CASES)
def test_index_finds_what_a_scan_finds(spark, segments, query, how):
    want = search.search_specs(frame(spark, DOCS), query, **how)
    assert rows(segments.search(query, **how)) == rows(want.select("path", "line", "tier", "text", "context", "section", "feature", "status", "type"))


def test_reopened_and_merged(spark, segments):
    again = SearchIndex(spark, segments.folder)
    assert again.segments == segments.segments and rows(again.edges()) == ["('a', 'b')"]
    before = rows(again.search("claim"))
    again.merge()
    assert len(SearchIndex(spark, segments.folder).segments) == 1 and rows(SearchIndex(spark, segments.folder).search("claim")) == before
    assert again.sizes().first()["documents"] == len(DOCS)


def test_many_words_and_documents(spark, monkeypatch):
    monkeypatch.setattr("coord.operators.search_index.FEW", 2)
    docs = {f"spec/features/f{k}/README.md": f"# Word{k} word\n" for k in range(9)}
    got = index_of(frame(spark, docs), "many").search("word")
    assert rows(got.select("path", "tier")) == rows(frame(spark, docs).select("path", F.lit(1)))


def test_plan_owner_and_rank(spark, segments):
    plans = spark.createDataFrame([("p", "zz"), ("p", "b"), ("p", "a")], "plan string, feature string")
    got = segments.search("claim", type="plan", plans=plans).first()
    assert (got.feature, got.status) == ("a", "Stable")
    found = search.ranked(segments.search("claim")).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and [(r.tier, r.path, r.line) for r in found] == sorted((r.tier, r.path, r.line) for r in found)
    assert [tuple(r) for r in search.ranked(segments.search("claim"), 2).orderBy("rank").collect()] == [tuple(r) for r in found[:2]]


def test_postings_are_one_row_per_document_and_word(spark, monkeypatch):
    monkeypatch.setattr("coord.operators.search_index.RUN", 3)
    docs = {"a.md": "to be or not to be\n\nTo be.\n", "b.md": "not\n" * 50, "c.md": ""}
    index = SearchIndex(spark, run_folder(spark, "postings"))
    index.update(frame(spark, docs).coalesce(1))
    held = spark.read.parquet(f"{index.folder}/seg=0/postings")
    places = held.select("path", "word", F.explode(F.arrays_zip("line", "pos")).alias("p")).select("path", "word", "p.*")
    want = [("a.md", w, line, k) for line, t in ((1, "to be or not to be"), (3, "to be")) for k, w in enumerate(t.split())] + [("b.md", "not", k, 0) for k in range(1, 51)]
    assert rows(places) == sorted(map(repr, want))
    assert held.count() < len(want)
    assert tuple(index.sizes().first()) == (3, 54, 4, len(want))
