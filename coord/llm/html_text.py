"""Main text of web pages: a recurrent labeller of text blocks, in numpy."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coord.llm.common import smallest_hashes

SAMPLE_PAGES = 150  # pages whose blocks give words and layouts to learn from
LAYOUTS = 450  # invented pages to learn from
PATH_DIM, WORD_DIM, EXTRA = 96, 24, 6
HIDDEN = 16
EPOCHS, BATCH, RATE = 12, 16, 0.01
CHUNK_BLOCKS = 4_000
CHUNK_CHARS = 4_000_000

#: Elements that begin and end blocks, elements whose content is no text, elements without content.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = "script|style|noscript|template|svg|textarea|iframe"
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Inside a tag: blanks, slashes, and attributes. Only a value that begins with a quote is quoted; others hold quotes and slashes.
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)"
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_CLOSED_SVG = rf"<svg(?=[\s/>])(?:\s++|/(?!>)|{_ATTRIBUTE})*+/>"  # its start tag closes it
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:-->|\Z))|{_CLOSED_SVG}|<({SKIPPED})(?=[\s/>])(?:[\s/]++|{_ATTRIBUTE})*+(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S | re.I,
)
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>][^\s>]*$")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z0-9]+")


class Block:
    """A run of text without a block boundary inside: its text, the names on the path to it, its share of link text."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; references decoded, white space turned into single blanks, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements that matter: block elements
    text: list[tuple[str, bool]] = []
    links, at, page = 0, 0, page or ""

    def close() -> None:
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
            if whole:
                linked = sum(len(t) for t, a in text if a) / max(1, sum(len(t) for t, _ in text))
                path = tuple(n for name, names in stack for n in (name, *names))
                out.append(Block(whole, path, linked))
            text.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append((page[at:m.start()], links > 0))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if m[2] else 1
        elif name == "br":
            text.append((" ", False))
        elif name in BLOCKS:
            close()
            if m[2]:
                open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if open_at is not None:
                    del stack[open_at:]
            else:
                if stack and stack[-1][0] == "p":  # a block ends a paragraph
                    stack.pop()
                if stack and name == stack[-1][0] and name in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    stack.pop()
                if name not in EMPTY and not (m[4].endswith("/") and not _OPEN_VALUE.search(m[4])):
                    names = tuple(w for found in _NAMES.findall(m[4]) for w in _PARTS.findall("".join(found).lower()))
                    stack.append((name, names))
    if at < len(page):
        text.append((page[at:], links > 0))
    close()
    return out


def _slot(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % dim, 1.0 if h & 0x10000 else -1.0


class Vectors:
    """Hashed vectors of tag paths and words; slots are remembered up to a bounded number."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 10_000:
                self.paths.clear()
            v = np.zeros(PATH_DIM, np.float32)
            for depth, name in enumerate(reversed(path)):
                i, s = _slot("t:" + name, PATH_DIM)
                v[i] += s * (1.0 if depth < 8 else 0.5)
            self.paths[path] = v
        return self.paths[path]

    def of(self, block: Block) -> np.ndarray:
        v = np.zeros(PATH_DIM + WORD_DIM + EXTRA, np.float32)
        v[:PATH_DIM] = self.path(block.path)
        words = block.text.lower().split(" ")
        hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
        signs = np.where(hashes & 0x10000, 1.0, -1.0)
        v[PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(hashes % WORD_DIM, signs, WORD_DIM) / len(words) ** 0.5 * 0.3
        t = block.text
        v[-EXTRA:] = (np.log1p(len(words)) / 4, block.linked, t[-1] in ".!?\"'", t[:1].isupper(), sum(c in "|»·©" for c in t) > 0, len(t) < 30)
        return v


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM over the blocks of a page; a block's logit sees the whole page."""

    def __init__(self, seed: int = 5):
        r, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + EXTRA
        self.p = {}
        for side in "fb":
            self.p["in_" + side] = r.normal(0, 0.2, (d, 4 * HIDDEN)).astype(np.float32)
            self.p["rec_" + side] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["bias_" + side] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["out"], self.p["off"] = r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: places, pages, features; mask: places, pages. Logits of all places."""
        states, traces = [], []
        for side in "fb":
            pre = x @ self.p["in_" + side] + self.p["bias_" + side]
            h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
            out, trace = np.zeros((*mask.shape, HIDDEN), np.float32), []
            for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
                a = pre[t] + h @ self.p["rec_" + side]
                i, f, o = (_sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
                n = np.tanh(a[:, 3 * HIDDEN:])
                live = mask[t][:, None]
                c2 = np.where(live, f * c + i * n, c)
                tc = np.tanh(c2)
                h2 = np.where(live, o * tc, h)
                if keep:
                    trace.append((t, h, c, i, f, o, n, tc, live))
                h, c, out[t] = h2, c2, h2
            states.append(out)
            traces.append(trace)
        both = np.concatenate(states, axis=2)
        return both @ self.p["out"] + self.p["off"], (both, traces) if keep else None

    def gradients(self, x: np.ndarray, mask: np.ndarray, cache, d: np.ndarray) -> dict[str, np.ndarray]:
        both, traces = cache
        g = {"out": both.reshape(-1, 2 * HIDDEN).T @ d.ravel(), "off": np.array([d.sum()], np.float32)}
        for k, side in enumerate("fb"):
            dh_out = d[:, :, None] * self.p["out"][k * HIDDEN:(k + 1) * HIDDEN]
            rec, da_all = self.p["rec_" + side], np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh, dc, drec = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros_like(rec)
            for t, h, c, i, f, o, n, tc, live in reversed(traces[k]):
                dh = dh + dh_out[t]
                here, dcc = dh * live, dc * live + dh * live * o * (1 - tc * tc)
                da = np.concatenate([dcc * n * i * (1 - i), dcc * c * f * (1 - f), here * tc * o * (1 - o), dcc * i * (1 - n * n)], axis=1)
                drec += h.T @ da
                da_all[t] = da
                dc = dcc * f + dc * ~live
                dh = da @ rec.T + dh * ~live
            g["rec_" + side], g["bias_" + side] = drec, da_all.sum(axis=(0, 1))
            g["in_" + side] = x.reshape(-1, x.shape[2]).T @ da_all.reshape(-1, 4 * HIDDEN)
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> None:
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            order = order[np.argsort([len(pages[i][1]) // 8 for i in order], kind="stable")]  # batches of about one length, in random order
            for a in r.permutation(np.arange(0, len(order), BATCH)):
                own = [pages[i] for i in order[a:a + BATCH]]
                x, mask = padded([p[0] for p in own])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(own):
                    y[:len(labels), k] = labels
                logits, cache = self.forward(x, mask, keep=True)
                d = ((_sigmoid(logits) - y) * mask / mask.sum()).astype(np.float32)
                step += 1
                for name, grad in self.gradients(x, mask, cache, d).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
                    self.p[name] -= (RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def main(self, pages: list[list[Block]], vectors: Vectors) -> list[list[bool]]:
        """Whether each block of each page is main text; pages of about one length run together."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            size = max(1, CHUNK_BLOCKS // len(pages[order[at]]))
            own = order[at:at + size]
            while len(own) > 1 and len(own) * len(pages[own[-1]]) > 2 * CHUNK_BLOCKS:
                own = own[:len(own) // 2]
            x, mask = padded([np.stack([vectors.of(b) for b in pages[i]]) for i in own])
            logits, _ = self.forward(x, mask)
            for k, i in enumerate(own):
                out[i] = (logits[:len(pages[i]), k] > 0).tolist()
            at += len(own)
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32), np.zeros((longest, len(rows)), bool)
    for k, r in enumerate(rows):
        x[:len(r), k], mask[:len(r), k] = r, True
    return x, mask


#: Names of page parts that layouts are invented from; the first list holds the article, the others what stands around it.
ARTICLES = ("article", "main", "div class='content'", "div id='main'", "div class='article-body'", "section class='post'", "div class='entry-content'", "div id='content'", "div role='main'", "div class='story text'")
AROUND = {
    "menu": ("nav", "div class='menu'", "ul class='navigation'", "div id='nav'", "div class='breadcrumb'", "div role='navigation'", "menu"),
    "head": ("header", "div class='header'", "div id='top'", "div class='masthead banner'"),
    "foot": ("footer", "div class='footer'", "div id='bottom'", "div class='copyright'", "div class='legal'"),
    "side": ("aside", "div class='sidebar'", "div id='sidebar'", "div class='related'", "div class='widget'", "section class='recommended'", "div class='share social'"),
    "note": ("div class='notice'", "div class='cookie'", "div class='banner'", "div class='alert'", "div role='alert'", "div class='popup newsletter'", "div class='consent'"),
    "ad": ("div class='ad'", "div class='ads'", "div class='advert'", "div class='sponsored'", "div id='promo'", "aside class='ad'", "div class='advertisement'"),
    "form": ("form", "div class='subscribe'", "form class='search'", "div class='login'", "fieldset"),
    "talk": ("section class='comments'", "div class='comment'", "div id='comments'", "ul class='comments'", "div class='discussion replies'", "ol class='comment-list'"),
}


def layout(r: np.random.Generator, words: np.ndarray) -> tuple[str, set[str]]:
    """An invented page and the texts of its main blocks, all texts different."""
    main, count = set(), [0]

    def prose(short: bool = False) -> str:
        count[0] += 1
        n = int(r.integers(1, 8)) if short else int(np.exp(r.uniform(0, 5)))
        own = [str(w) for w in r.choice(words, n)]
        return f"{' '.join(own).capitalize()}{'' if short else r.choice(['.', '.', '.', '!', ''])} {count[0]}{'' if short else '.'}"

    def wrap(tag: str, inside: str) -> str:
        return f"<{tag}>{inside}</{tag.split(' ')[0]}>"

    def part(kind: str) -> str:
        tag, n = str(r.choice(AROUND[kind])), int(r.integers(1, 7))
        style = r.integers(0, 3)
        if kind in ("menu", "foot", "side") and style == 0 or kind == "menu" and style == 1:
            inside = "<ul>" + "".join(f"<li><a href='#'>{prose(True)}</a></li>" for _ in range(n)) + "</ul>"
        elif kind == "form":
            inside = f"<label>{prose(True)}</label><input name='q'><button>{prose(True)}</button>"
        elif style == 1:
            inside = prose(bool(r.integers(0, 2)))
        else:
            inside = "".join(wrap("p", prose(bool(r.integers(0, 2)))) for _ in range(n))
        return wrap(tag, inside)

    def body() -> str:
        out = []
        for k in range(int(r.integers(1, 12))):
            own = prose(k == 0 and bool(r.integers(0, 2)))
            main.add(own)
            tag = "h1" if k == 0 else str(r.choice(["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "li", "pre"]))
            inside = f"<ul>{wrap('li', own)}</ul>" if tag == "li" else f"<p><b>{own}<br>" if r.random() < 0.1 else wrap(tag, own)
            out.append(inside)
            if r.random() < 0.08:
                out.append(part(str(r.choice(["ad", "side", "note", "form"]))))
        if r.random() < 0.2:
            out.append(part("talk"))
        return wrap(str(r.choice(ARTICLES)), "".join(out))

    before = [part(str(k)) for k in r.choice(["menu", "head", "note", "ad", "side", "form"], int(r.integers(0, 5)))]
    after = [part(str(k)) for k in r.choice(["talk", "side", "ad", "foot", "note", "form", "menu"], int(r.integers(0, 5)))]
    inside = "".join([*before, body(), *after])
    inside = wrap(str(r.choice(["div class='page'", "div id='wrapper'", "div class='container'"])), inside) if r.random() < 0.5 else inside
    return f"<html><head><title>{prose(True)}</title></head><body>{inside}</body></html>", main


_OUTSIDE = frozenset("nav header footer aside form button title head ad ads comments comment menu sidebar".split())


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = 17) -> Labeller:
    """A labeller trained on at most ``sample`` pages of the table, of any length, and on invented layouts.

    The pages with the smallest hashes of their ids are chosen by id alone (rows without an id are not); one
    whole page of each id reaches the driver. Blocks of a page with an ``article`` or ``main`` element are main
    text if they are inside it and not inside an element made for something else; pages without one only give
    words. Layouts put such words under many names of page parts.
    """
    ids = pages.where("page_id IS NOT NULL AND html <> ''").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("all")).distinct()
    chosen = smallest_hashes(ids, "all", sample).select(F.col("doc_id").alias("page_id"))
    met = pages.where("html <> ''").select("page_id", "html").join(F.broadcast(chosen), "page_id")
    picked = sorted(met.groupBy("page_id").agg(F.min("html").alias("html")).select(F.xxhash64("page_id").alias("h"), "page_id", "html").collect())
    vectors, rows, words = Vectors(), [], []
    for r in picked:
        own = blocks(r["html"])
        words += [w for b in own[:20] for w in b.text.split(" ")[:30]]
        if any({"article", "main"} & set(b.path) for b in own):
            labels = [bool({"article", "main"} & set(b.path)) and not _OUTSIDE & set(b.path) for b in own]
            rows.append((np.stack([vectors.of(b) for b in own]), np.array(labels, np.float32)))
    r, words = np.random.default_rng(seed), np.array(words or ["text", "word", "page", "more", "news"])
    for _ in range(layouts):
        page, main = layout(r, words)
        own = blocks(page)
        rows.append((np.stack([vectors.of(b) for b in own]), np.array([b.text in main for b in own], np.float32)))
    made = Labeller()
    made.train(rows)
    return made


def pieces(htmls: Iterable[str | None], chars: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """The pages in lists of about so many characters."""
    held, size = [], 0
    for h in htmls:
        held.append(h)
        size += len(h or "")
        if size >= chars:
            yield held
            held, size = [], 0
    yield held


def main_text(pages: DataFrame, **how) -> DataFrame:
    """(row, text): every page's row as a struct and its main text, block by block, joined by line breaks.

    A page is cut into blocks at the boundaries of block elements; scripts, styles, comments and markup are no
    text. A bidirectional LSTM reads a vector per block (hashed names on the tag path, hashed words, a few
    figures) and labels each one in view of the whole page; blocks labelled main stay, whole and in order.

    Null, empty and textless pages give an empty text. Unclosed and broken tags end where a browser would end
    them for the cases met here (paragraphs, list items, table cells, end of page). Repeated rows are read
    apart and alike. An empty table gives no rows. Columns of any name pass through in ``row``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, **how))

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors()
        for htmls in batches:
            out: list[str] = []
            for part in pieces(htmls):
                parsed = [blocks(h) for h in part]
                kept = shared.value.main(parsed, vectors)
                out += ["\n".join(b.text for b, k in zip(p, ks) if k) for p, ks in zip(parsed, kept)]
            yield pd.Series(out, dtype=object)

    return pages.select(F.struct("*").alias("row"), extract(F.col("html")).alias("text"))
