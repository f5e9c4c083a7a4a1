"""Operators against brute force on small tables, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coord.llm import decontam, fingerprints, html_text, language, licenses, line_dedup, mixing, ngram_join, pii, toxicity
from coord.llm.common import components, smallest_hashes

LONG = "  This line is long enough to be counted as shared by all.\t"


def words(r, n, k=400):
    return " ".join(f"w{r.randrange(k)}" for _ in range(n))


def test_components_of_chain_star_and_loop(spark, rows_of):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 9)] + [(200, 200)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(9)}, 200: 200}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_line_dedup(docs_of):
    rows = [(i, f"own {i}\n{LONG}\n{LONG.upper()}") for i in range(5)] + [(None, LONG), (7, None), (8, ""), (3, f"own 3\n{LONG}\n{LONG.upper()}")]
    out = {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs_of(rows)).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect()}
    for i in range(4):
        assert out[(i, rows[i][1])] == (3, 2, f"own {i}")
    assert out[(4, rows[4][1])] == (3, 0, rows[4][1])
    assert out[(None, LONG)] == (1, 1, "")
    assert out[(7, None)] == (1, 0, "") and out[(8, "")] == (1, 0, "")
    new = line_dedup.rewritten(docs_of(rows))
    assert new.columns == docs_of(rows).columns and new.where("doc_id = 7 and text is null").count() == 1
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


@pytest.mark.parametrize("batches", [1, 4])
def test_line_runs_do_not_depend_on_batches(docs_of, rows_of, batches):
    r = random.Random(batches)
    lines = [f"a common line number {k} that is quite long indeed" for k in range(6)]
    docs = docs_of([(i, "\n".join(r.choices(lines, k=3))) for i in range(40)])
    holders = {k: [d.doc_id for d in docs.collect() if k in d.text] for k in lines}
    many = {k for k, v in holders.items() if len(v) >= 5}
    want = sorted((d.doc_id, "\n".join(x for x in d.text.split("\n") if x not in many or max(holders[x]) == d.doc_id)) for d in docs.collect())
    assert rows_of(line_dedup.dedup_lines(docs, batches=batches).select("row.doc_id", "kept")) == sorted(want, key=repr)


def test_mix_meets_targets(docs_of):
    r = random.Random(1)
    docs = docs_of([(i, words(r, r.randrange(1, 30)), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(None, None, "en", "a"), (None, "  ", "en", None)])
    got = mixing.mix(docs, rows_per_bucket=50).collect()
    assert len(got) == 602
    total = sum(x.size for x in got)
    assert abs(sum(x.taken for x in got) - 1.5 * total) < 60
    for s in ("a", "b", "c", None):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) < 60 and own[0].target <= 2 * own[0].source_size + 1e-6
    assert all(x.taken in (0, x.size, 2 * x.size) for x in got)
    key = lambda x: repr(tuple(x))
    assert sorted(got, key=key) == sorted(mixing.mix(docs.repartition(7), rows_per_bucket=7).collect(), key=key)
    assert mixing.mix(docs_of([])).count() == 0
    out = mixing.mixed(docs)
    assert set(docs.columns) < set(out.columns) and out.count() == sum(x.copies > 0 for x in got)


def test_fingerprints_follow_multisets(spark, docs_of):
    a, b = "one two.\nthree four!\nfive", "five\none two. three four!"
    docs = docs_of([(1, a), (2, b), (3, "other"), (4, None), (5, ""), (None, a)])
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint == got[None].fingerprint != got[3].fingerprint and got[4].fingerprint == got[5].fingerprint
    order = [5, 4, 3, 2, 1, None]
    text = {1: a, 2: b, 3: "other", 4: "", 5: "", None: a}
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % 6]]
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    f = fingerprints.with_fingerprint(spark.createDataFrame([("x. y.", "z.", "x. y. z.")], "a string, b string, c string"), "a", "fa")
    for c in "bc":
        f = fingerprints.with_fingerprint(f, c, "f" + c)
    r = f.select((fingerprints.insert(f.fa, f.fb) == f.fc).alias("added"), (fingerprints.delete(f.fc, f.fb) == f.fa).alias("removed"), fingerprints.likeness(f.fa, f.fa).alias("same")).first()
    assert tuple(r) == (True, True, 1.0)
    assert fingerprints.fingerprints(docs_of([])).count() == 0
    assert fingerprints.fingerprints(docs_of([(1, "ab")])).first().near_next == 1.0


def test_next_document_over_many_ranges(docs_of):
    docs = docs_of([(i % 50, f"text {i}") for i in range(120)])
    got = fingerprints.with_next(docs, rows_per_range=7).select("doc_id", "text", "next_text").collect()
    order = sorted(((d.doc_id, d.text) for d in docs.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted((x.doc_id, x.text, x.next_text) for x in got) == sorted((*order[i], order[(i + 1) % 120][1]) for i in range(120))


def test_license_places(docs_of):
    docs = docs_of([(1, "Released Under THE MIT-License, under the mit license"), (2, None), (3, ""), (4, "Apache License, Version 2.0 and CC BY-NC"), (5, "This work is licensed under the GNU General Public License, version 3.")])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 2, 1, 5, "mit")
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert got[4].base_labels == "apache-2,cc-by-nc" and got[4].first_word == 0 and got[4].last_word == 6
    assert got[5].base_labels == "" and got[5].labels == "gpl-3" and got[5].score == 1.0
    assert licenses.scan(docs_of([])).count() == 0


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark, docs_of, rows_of):
    r = random.Random(3)
    items = [(k, words(r, 25)) for k in range(6)] + [(90, "..."), (91, None)]
    docs = []
    for i in range(60):
        t = list(words(r, 60))
        if i % 2:
            own = list(items[i % 6][1])
            for _ in range(r.randrange(0, 9)):
                p = r.randrange(len(own))
                own[p] = r.choice(["", "x", own[p] + "y"])
            t[50:50] = own
        docs.append((i, "".join(t)))
    want = []
    for i, t in docs:
        for k, x in items:
            x, norm = decontam.normal(x), decontam.normal(t)
            if x and brute_distance(x, norm) <= int(len(x) * decontam.ERROR_RATE):
                want.append((i, k, brute_distance(x, norm), len(x)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of([*docs, (None, None), (70, "")])
    assert want and rows_of(decontam.contaminated(frame, bench)) == sorted(want, key=repr)
    assert rows_of(decontam.contaminated(frame, bench, block_chars=200)) == sorted(want, key=repr)
    assert decontam.clean(frame, bench).count() == 62 - len({w[0] for w in want})
    assert decontam.contaminated(docs_of([]), bench).count() == 0 and decontam.contaminated(frame, bench.where("false")).count() == 0


def test_ngram_join_against_all_pairs(docs_of):
    r = random.Random(5)
    texts = []
    for g in range(12):
        base = words(r, 60, 5000).split()
        for _ in range(6):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"n{r.randrange(9999)}"
            texts.append(" ".join(own))
    texts += [texts[0]] * 3 + ["", None, "two words", "Two, words!", words(r, 4000)]
    docs = [(i, t) for i, t in enumerate(texts)]
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(texts))]
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.classes(docs_of(docs)).collect())
    assert got == [(i, root[i], len(near[i])) for i in range(len(texts))]
    kept = sorted(x.doc_id for x in ngram_join.one_of_each(docs_of(docs)).collect())
    assert kept == sorted(set(root))
    assert ngram_join.classes(docs_of([])).count() == 0


def test_ngram_join_over_many_tiles(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "TEXT_TILE", 7)
    monkeypatch.setattr(ngram_join, "BAND_TILE", 5)
    base = [f"w{k}" for k in range(80)]
    docs = [(i, " ".join(f"n{i}" if k == i else w for k, w in enumerate(base))) for i in range(40)]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(76)} for _, t in docs]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.classes(docs_of(docs)).collect())
    assert got == [(i, 0, n) for i, n in enumerate(want)]


def test_rows_without_ids_stay_apart(docs_of):
    docs = docs_of([(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "i j k l m n o p"), (None, "i j k l m n o p"), (5, "q r s t u v")])
    assert sorted(x.text for x in ngram_join.one_of_each(docs).collect()) == ["a b c d e f g h", "i j k l m n o p", "q r s t u v"]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(9)
    bits = ["a", "b.c", "@", "@", ".", "1", "12", "255", "4111 1111 1111 1111", "+4", "(0)", "-", " ", "é", "x@y.z", "1.2.3.4", "300", "+1 234 567 89", "%", "\n"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randrange(1, 25)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_revealing_terms(docs_of, rows_of):
    r = random.Random(2)
    rows = [(i, f"{words(r, 5)} zorblax q{'abcdefghij'[i]} writes to boss@firm.example about {words(r, 5)}") for i in range(8)]
    rows += [(20 + i, f"plain writes to about {words(r, 9)}") for i in range(40)] + [(90, None), (91, ""), (None, "x@y.zz")]
    got = {x.doc_id: x for x in pii.find(docs_of(rows)).collect()}
    assert len(got) == len(rows) and got[90].base == "" and got[None].n_email == 1 and not got[20].added
    for i in range(8):
        terms = {rows[i][1][x.s:x.e]: x.action for x in got[i].added}
        assert terms == {"zorblax": "remove"}
    clean = {x.doc_id: x.clean_text for x in pii.sanitised(docs_of(rows)).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[91] == ""
    assert pii.find(docs_of([])).count() == 0


def test_revealing_terms_anywhere_in_the_document(docs_of):
    far = " ".join(["plain"] * 30)
    rows = [(i, f"zorblax {far} boss@firm.example {far} Zorblax quendri") for i in range(4)]
    rows += [(10, f"once@firm.example {far} hapaxen"), (11, f"spread {far} twice@firm.example"), (None, f"anon@firm.example {far} vexilon")]
    rows += [(100 + i, f"{far} spread") for i in range(60)]
    got = {x.doc_id: x for x in pii.find(docs_of(rows)).collect()}
    marked = {i: [(t[x.s:x.e], x.action) for x in got[i].added] for i, t in rows}
    for i in range(4):  # sixty words away, beside no mention, and at every place
        assert marked[i] == [("zorblax", "remove"), ("Zorblax", "remove"), ("quendri", "remove")]
    assert marked[10] == [("hapaxen", "generalise")] and marked[None] == [("vexilon", "generalise")]  # entities of one document, ids or none
    assert not marked[11] and not any(marked[100 + i] for i in range(60))
    clean = {x.doc_id: x.clean_text for x in pii.sanitised(docs_of(rows)).collect()}
    assert "orblax" not in clean[0] and clean[10] == f"[EMAIL] {far} [TERM]"


def test_disclosure_is_exact(docs_of):
    r = random.Random(8)
    names = ["alpha", "beta", "gamma", "delta", "omega²x", "straße", "longword" * 12]
    rows = [(r.choice([i, None]), " ".join([*r.sample(names, 3), *r.sample([f"p{k}@x.example" for k in "abc"], r.randrange(3))])) for i in range(40)] + [(None, "alpha pa@x.example")] * 2 + [(50, "every")]
    sets = [({m for m in re.findall(r"p\w@x\.example", t)}, set(re.findall(r"[^\W\d_]{2,}", re.sub(r"\S+@\S+", " ", t)))) for _, t in rows]
    want, n = [], len(rows)
    for e in {e for es, _ in sets for e in es}:
        for t in {t for es, ts in sets if e in es for t in ts}:
            both, with_e, with_t = sum(e in es and t in ts for es, ts in sets), sum(e in es for es, _ in sets), sum(t in ts for _, ts in sets)
            want.append(np.log2(both * n / ((with_t + pii.UNSEEN) * with_e)) / np.log2(n / with_e))
    found = pii.mentions(docs_of(rows))
    for least in (0.0, 0.3, 0.8):  # leaving out what cannot reach it leaves all that does
        got = [x.disclosure for x in pii.disclosures(found, pii.pairs_of(found, least)).collect()]
        assert np.allclose(sorted(x for x in got if least == 0 or x >= least), sorted(x for x in want if least == 0 or x >= least))
    assert pii.find(docs_of([(1, "all@x.example word")] * 3)).count() == 3  # an entity of every document


def test_sample_of_smallest_hashes(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("lang"))
    got = {(r["lang"], r["doc_id"]) for r in smallest_hashes(rows, "lang", 60).collect()}
    order = [(r["lang"], r["doc_id"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = {x for lang in ("rare", "often") for x in [o for o in order if o[0] == lang][:60]}
    assert got == want and len(got) == 120
    assert smallest_hashes(rows.where("false"), "lang", 60).count() == 0
    few = {r["doc_id"] for r in smallest_hashes(rows.where("doc_id in (0, 50, 1)"), "lang", 60).collect()}
    assert few == {0, 1, 50}


def test_language_profiles(docs_of):
    r = random.Random(4)
    syl = {"xx": ["ka", "to", "ri"], "yy": ["blu", "gen", "osk"]}
    make = lambda lang: " ".join("".join(r.choices(syl[lang], k=3)) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(500, None, "xx"), (501, "123 !", "yy"), (None, make("xx"), None)]
    got = {x.doc_id: x for x in language.identify(docs_of(rows)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:120] if got[i].held_out]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[None].lang_pred == "xx"
    assert language.identify(docs_of([])).count() == 0
    assert {x.lang_pred for x in language.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}


def test_toxicity_network(spark, docs_of):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        bad = i % 2
        t = words(r, 50, 200).split()
        if bad:
            t[r.randrange(50)] = r.choice(["grunkle", "grunkles", "vexpot"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, bad))
    frame = docs_of([*rows, (900, None), (901, ""), (902, "word " * 20_000 + "vexpot")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(frame, lab).collect()}
    assert np.mean([got[i].predicted == bad for i, _, bad in labels if got[i].held_out]) > 0.9
    assert got[900].score == got[901].score and got[902].predicted == 1 and got[900].predicted == 0
    assert {x.score for x in toxicity.toxicity(frame, lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs_of([]), lab).count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 100):
        win, owner = toxicity.windows([np.arange(n)])
        assert set(win[win >= 0].tolist()) == set(range(n)) and len(owner) == len(win) >= 1


def test_html_blocks_and_labels(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Menu one</a></li></ul></nav><article><h1>Head &amp; line</h1><p>First  para\n of text.<br>More.<p>Second para of text here.</article><div class='comments'><p>Reader says hello there.</p></div><script>var t='</p>';</script><footer>&copy; me</footer>"
    texts = [b.text for b in html_text.blocks(page)]
    assert texts == ["T", "Menu one", "Head & line", "First para of text. More.", "Second para of text here.", "Reader says hello there.", "© me"]
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5), (4, "w", "<!-- only <p>x</p>", 5)], "page_id long, url string, html string, row int")
    got = {x.page_id: x.text for x in html_text.main_text(pages, layouts=200).select("row.page_id", "text").collect()}
    assert got == {1: "Head & line\nFirst para of text. More.\nSecond para of text here.", 2: "", 3: "", 4: ""}
    assert html_text.main_text(pages.where("false"), layouts=20).count() == 0


def test_html_elements_that_close_themselves():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    for own in ("<svg/>", "<svg />", '<svg class="i"/>', "<SVG class='a>b' viewBox=\"0 0 1 1\" />", "<svg hidden/>", "<!-->", "<!--->", "<!---->", "<!-- a > b -->", "<svg class='i'><path d='M0'/><text>No</text></svg>", "<svg width=5/>No</svg>", "<script/>No</script>", "<!--x->No-->"):
        assert texts(f"<article>{own}<p>Whole article here.</p><p>More{own} text.</p></article>") == ["Whole article here.", "More text."], own


def test_line_dedup_of_a_document_of_100_000_lines(docs_of):
    lines = [f"a line that several documents share, number {k}" for k in range(100_000)]
    docs = docs_of([(i, "\n".join(lines[:100_000 if i < 2 else 10_000])) for i in range(5)])
    got = {x.doc_id: (x.n_lines, x.n_dropped) for x in line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped").collect()}
    assert got == {0: (100_000, 10_000), 1: (100_000, 10_000), 2: (10_000, 10_000), 3: (10_000, 10_000), 4: (10_000, 0)}
