"""Models against plain loops, and labels, languages and layouts that stand only in long texts."""

import random
import re
from html.parser import HTMLParser

import numpy as np
import xxhash

from coord.llm import html_text, language, toxicity


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(net, vectors, window):
    """One window through both layers and the attention, word by word."""
    words = [vectors[i].astype(float) for i in window if i >= 0]
    sides = []
    for side, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        h, states = np.zeros(toxicity.HIDDEN), {}
        for t in order:
            a, u = words[t] @ net.p["in_" + side] + net.p["bias_" + side], h @ net.p["rec_" + side]
            n = toxicity.HIDDEN
            reset, update = sigmoid(a[:n] + u[:n]), sigmoid(a[n:2 * n] + u[n:2 * n])
            h = update * h + (1 - update) * np.tanh(a[2 * n:] + reset * u[2 * n:])
            states[t] = h
        sides.append(states)
    both = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(words))]
    e = np.array([x @ net.p["att"] for x in both])
    w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return sum(x * k for x, k in zip(both, w)) @ net.p["out"] + net.p["off"][0]


def small_net():
    net, r = toxicity.Network(), random.Random(4)
    texts = [[f"w{r.randrange(30)}" for _ in range(n)] for n in (3, 32, 40)]
    ids, words = toxicity.vocabulary(texts)
    return net, net.vectors(toxicity.hashed(words)), toxicity.windows(ids)[0]


def test_recurrent_layers_and_attention():
    net, vectors, win = small_net()
    got, _ = net.forward(vectors, win)
    assert np.allclose(got, [plain_logit(net, vectors, w) for w in win], atol=1e-4)


def test_gradients():
    net, vectors, win = small_net()
    _, cache = net.forward(vectors, win, keep=True)
    grads, dvec = net.backward(vectors, cache, np.ones(len(win), np.float32))
    for name, at in (("in_f", (1, 2)), ("rec_f", (3, 17)), ("rec_b", (0, 5)), ("att", (4,)), ("out", (2,)), ("bias_b", (20,)), ("in_b", (5, 9))):
        before, sums = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = before + step
            sums.append(sum(plain_logit(net, vectors, w) for w in win))
        net.p[name][at] = before
        assert abs(grads[name][at] - (sums[0] - sums[1]) / 2e-2) < 2e-3 + 0.02 * abs(grads[name][at])
    moved = vectors.copy()
    moved[0, 3] += 1e-2
    assert abs(dvec[0, 3] - (sum(plain_logit(net, moved, w) - plain_logit(net, vectors, w) for w in win)) / 1e-2) < 5e-3


def test_all_windows_are_scored():
    net, r = toxicity.Network(seed=3), random.Random(9)
    for table in (net.words, net.chars):
        table *= 20  # scores that differ
    texts = [" ".join(f"t{r.randrange(200)}" for _ in range(n)) for n in (0, 5, 31, 32, 33, 50, 200)]
    for text, got in zip(texts, net.score(texts, searched=-np.inf)):
        ids, words = toxicity.vocabulary([text.split()])
        x = ids[0]
        wins = [x[k:k + 32] for k in range(max(1, len(x) - 31))] + [x[k:] for k in range(0, max(1, len(x) - 31 + 15), 16) if len(x) - k < 32]
        vectors = net.vectors(toxicity.hashed(words or ["?"]))
        best = max(float(net.forward(vectors, np.pad(w, (0, 32 - len(w)), constant_values=-1)[None])[0][0]) for w in wins)
        assert abs(got - sigmoid(best)) < 1e-4


def test_toxic_documents_that_are_all_long(spark, docs_of):
    r = random.Random(2)
    prose = lambda n: " ".join(f"word{r.randrange(300)}" for _ in range(n))
    rows = [(i, prose(2_500) + " vile slur hateful scum " * 3 + prose(100) if i % 4 == 0 else prose(60)) for i in range(160)]
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    held = [x for x in got if x.held_out]
    assert held and sum(x.predicted == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.9


def test_language_that_stands_only_in_long_texts(docs_of):
    r = random.Random(3)
    words = {"xx": ["kraz", "obruk", "zolt", "vraka"], "en": ["the", "house", "and", "river"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(3_000 if lang == "xx" else 30)), lang) for i in range(60) for lang in ("xx" if i % 3 == 0 else "en",)]
    got = {x.doc_id: x.lang_pred for x in language.identify(docs_of([*rows, (900, "zolt kraz vraka obruk", None), (901, "the river", None)])).collect()}
    assert got[900] == "xx" and got[901] == "en" and all(got[i] == lang for i, _, lang in rows)


def test_hypervectors_by_hand():
    space = language.Space(64)
    letter = lambda c: np.random.default_rng(xxhash.xxh64_intdigest(ord(c).to_bytes(4, "little"))).integers(0, 2, 64, dtype=np.int8) * 2 - 1
    text = " ab c "
    want = sum(np.roll(letter(text[k]), 2) * np.roll(letter(text[k + 1]), 1) * letter(text[k + 2]) for k in range(len(text) - 2)).astype(float)
    assert np.allclose(space.bundles(["Ab, 7 c!"])[0], want / np.linalg.norm(want), atol=1e-6)


class Texts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def test_blocks_hold_the_text_that_a_parser_finds():
    r = random.Random(8)
    values = ['"quo>ted"', "'sin\">gle'", "it's", 'a"b', "x/y/", "/p?a=1&b=2", '""', "pla-in", '"two words"', "a='b'"]
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for _ in range(400):
        page = []
        for _ in range(r.randrange(1, 12)):
            tag = r.choice(["p", "div", "span", "a", "li", "h2", "b", "td"])
            attrs = "".join(f" {r.choice(['class', 'data-x', 'HREF', 'hidden', 'title'])}{r.choice([' = ', '=', '= '])}{r.choice(values)}" if r.random() < 0.7 else " checked" for _ in range(r.randrange(4)))
            page.append(f"<{tag}{attrs}>text {r.randrange(99)} &amp; &#233;</{tag}>" if r.random() < 0.8 else r.choice(["<!-- <p>no</p> -->", f"<script{attrs}>var a = '<p>no</p>';</script>", "<!doctype html>", "<br>", "plain 1 < 2 "]))
        parser = Texts()
        parser.feed("".join(page))
        parser.close()
        assert squeeze("".join(b.text for b in html_text.blocks("".join(page)))) == squeeze("".join(parser.out)), page


def test_no_markup_after_odd_quotes():
    cases = {"<p data-x=it's>The first…</p>": ["The first…"], '<p title="a>b">x</p>': ["x"], "<p>a<p title='>b": ["a"], "<article><svg class=\"i\"/><p>Whole.</p></article>": ["Whole."], "<p a=b/>t</p>": ["t"]}
    for page, want in cases.items():
        assert [b.text for b in html_text.blocks(page)] == want


def test_layout_that_stands_only_on_long_pages(spark):
    r = random.Random(5)
    para = lambda n: "<p>" + " ".join(f"word{r.randrange(200)}" for _ in range(n)) + ".</p>"
    rows = [(i, "u", f"<nav><a href=x>menu</a></nav><article>{''.join(para(60) for _ in range(120))}</article><footer>foot note</footer>") for i in range(12)]
    df = spark.createDataFrame([*rows, (None, "u", None)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_text.main_text(df).select("row.page_id", "text").collect()}
    for i, _, h in rows:
        assert got[i] == "\n".join(re.findall("<p>(.*?)</p>", h))
    assert got[None] == ""
