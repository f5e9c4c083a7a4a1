"""Every stage of the pipeline against plain Python over its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from coord.llm import decontam, toxicity
from coord.llm.common import table


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def kept_lines(docs):
    """{doc_id: text} without shared lines, as the line stage should leave it."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    gone = lambda i, line: len(holders.get(key(line), ())) >= 5 and max(holders[key(line)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in docs.items()}


def heads(docs):
    """Smallest id of every group linked by a similarity of 0.8 or more."""
    sets, root = {i: grams(t) for i, t in docs.items()}, {i: i for i in docs}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in docs:
        before = dict(root)
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return set(root.values())


def test_stages_in_order(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert set(columns) <= set(docs.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["toxicity"]
    rejected = {r.doc_id for r in toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert set(after) == set(before) - rejected
    before, after = seen["line_dedup"]
    assert after == kept_lines(before)
    before, after = seen["ngram_jaccard_join"]
    assert set(after) == heads(before)
    before, after = seen["benchmark_decontamination"]
    items = [decontam.normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    dropped = {i for i, t in before.items() if any(x and x in decontam.normal(t) for x in items)}
    assert dropped <= set(before) - set(after)
    made, automaton = decontam._index(list(enumerate(items)), decontam.ERROR_RATE)
    assert set(after) == {i for i, t in before.items() if not list(decontam.matches(decontam.normal(t), made, automaton))}
    before, after = seen["weighted_mix"]
    assert set(after) <= set(before) and all(r.mix_copies in (1, 2) for r in docs.collect())
    size = lambda t: len(t.split())
    taken = sum(size(r.text) * r.mix_copies for r in docs.collect())
    assert abs(taken - 1.5 * sum(map(size, before.values()))) < 2 * max(map(size, before.values()))
