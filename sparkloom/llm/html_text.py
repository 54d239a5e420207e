"""Operator 9: main text of web pages by boosted trees over DOM nodes.

Each block-level node gets the odds that it is (or holds) main text given that its
parent does, from features of its subtree, attributes, depth and siblings. Decoding is
hierarchical, from the page down: below a node that isn't kept nothing is, so an ancestor
and a descendant never contradict each other. The text of the kept nodes is the result.

No table tells what the main text of a page is, so the trees are trained on pages that
training_page() makes: invented words in many layouts, with a known answer. The model
depends on nothing but the parameters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import tidy, whole_texts
from .dom import Page, features


class _Maker:
    """Makes one labelled page. Nodes are (tag, attributes, label, children); children are
    nodes or texts."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.parts = ["".join(self.r.choice(list("bcdfghlmnprstvwz")) + self.r.choice(list("aeiouéäó")) for _ in range(1)) for _ in range(40)]

    def odds(self, p: float) -> bool:
        return self.r.random() < p

    def pick(self, *xs):
        return xs[self.r.integers(len(xs))]

    def word(self) -> str:
        return "".join(self.parts[i] for i in self.r.integers(0, 40, self.r.integers(1, 5)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.integers(lo, hi + 1)))

    def sentence(self, lo: int = 1, hi: int = 18) -> str:
        s = self.words(lo, hi).capitalize()
        return (s.replace(" ", ", ", 1) if self.odds(0.3) else s) + self.pick(".", ".", ".", "!", "?")

    def prose(self, lo: int, hi: int) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.integers(lo, hi + 1)))
        return s.replace(" ", " | ") if self.odds(0.05) else s

    def links(self, lo: int, hi: int, label: int = 0, short: bool = True):
        return [("li", "", label, [("a", ' href="/x"', label, [self.words(1, 3 if short else 9)])]) for _ in range(self.r.integers(lo, hi + 1))]

    def attribute(self, *names: str) -> str:
        name = self.pick(*names)
        if self.odds(0.15):
            name += self.pick("-1", "-wrap", "-inner", "Box", "_area", " clearfix")
        return f' {self.pick("class", "class", "id")}="{name}"'

    def menu(self):
        inner = [("ul", "", 0, self.links(3, 12))] if self.odds(0.8) else [("a", ' href="/"', 0, [self.words(1, 2) + " "]) for _ in range(6)]
        return ("nav", "" if self.odds(0.6) else self.attribute("menu", "nav"), 0, inner) if self.odds(0.6) else ("div", self.attribute("menu", "nav", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs"), 0, inner)

    def head(self):
        inner = [(self.pick("div", "p", "h1"), self.pick("", ' class="logo"'), 0, [self.words(1, 4)])]
        if self.odds(0.5):
            inner.append(self.menu())
        if self.odds(0.3):
            inner.append(self.form())
        return ("header", "", 0, inner) if self.odds(0.6) else ("div", self.attribute("header", "masthead", "top", "site-header"), 0, inner)

    def foot(self):
        inner = [self.pick("&copy; ", "") + self.word() + " &middot; " + self.prose(1, 3)] if self.odds(0.6) else [("p", "", 0, [self.prose(1, 3)]), ("ul", "", 0, self.links(2, 8))]
        return ("footer", "", 0, inner) if self.odds(0.65) else ("div", self.attribute("footer", "bottom", "copyright", "site-footer"), 0, inner)

    def side(self):
        inner = []
        for _ in range(self.r.integers(1, 4)):
            inner.append(("h3", "", 0, [self.words(1, 3)]))
            inner.append(("ul", "", 0, self.links(3, 9, 0, False)) if self.odds(0.7) else ("p", "", 0, [self.prose(1, 4)]))
        return ("aside", "" if self.odds(0.5) else self.attribute("sidebar", "widget"), 0, inner) if self.odds(0.55) else ("div", self.attribute("sidebar", "side", "widget", "right", "rail", "related"), 0, inner)

    def advert(self):
        text = self.prose(1, 3) if self.odds(0.85) else self.prose(3, 8)
        inner = [text] if self.odds(0.6) else [("p", "", 0, [text])]
        return (self.pick("div", "div", "div", "aside", "section"), self.attribute("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-banner"), 0, inner)

    def notice(self):
        inner = [("p", "", 0, [self.prose(1, 4)]), ("button", "", 0, [self.word()])]
        return (self.pick("div", "div", "section", "dialog"), self.attribute("cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "modal", "alert", "overlay"), 0, inner[: self.r.integers(1, 3)])

    def form(self):
        return ("form", self.pick("", ' class="search"', ' class="newsletter"', ' id="login"'), 0, [("p" if self.odds(0.3) else "label", "", 0, [self.words(1, 8)]), ("button", "", 0, [self.word()])])

    def comments(self):
        one = lambda: (self.pick("div", "li", "article"), self.attribute("comment", "reply"), 0, [("div", self.pick("", ' class="author"'), 0, [self.words(1, 3)]), ("p", "", 0, [self.prose(1, 6)])])
        return (self.pick("section", "div", "ul"), self.attribute("comments", "comments", "discussion", "responses reply", "reviews"), 0, [("h2", "", 0, [self.words(1, 2)]), *[one() for _ in range(self.r.integers(1, 7))]])

    def social(self):
        return (self.pick("div", "ul", "p"), self.attribute("share", "social", "tags", "related", "newsletter", "meta"), 0, self.links(2, 5) if self.odds(0.7) else [self.words(2, 8)])

    def body_block(self):
        kind = self.r.random()
        if kind < 0.78:
            text = self.sentence(1, 4) if self.odds(0.2) else self.prose(1, 8)
            return ("p", "", 1, [("b", "", 1, [text + "<br>"])] if self.odds(0.1) else [text])
        if kind < 0.86:
            return (self.pick("h2", "h3", "h4"), "", 1, [self.words(1, 7).capitalize()])
        if kind < 0.91:
            return (self.pick("ul", "ol"), "", 1, [("li", "", 1, [self.prose(1, 2)]) for _ in range(self.r.integers(2, 7))])
        if kind < 0.94:
            return ("blockquote", "", 1, [("p", "", 1, [self.prose(1, 4)])] if self.odds(0.6) else [self.prose(1, 4)])
        if kind < 0.96:
            return ("pre", "", 1, [self.words(3, 30)])
        if kind < 0.98:
            return ("figure", "", 1, ["<img src=x>", ("figcaption", "", 1, [self.sentence()])])
        return ("table", "", 1, [("tr", "", 1, [("td", "", 1, [self.words(1, 4)]) for _ in range(3)]) for _ in range(self.r.integers(2, 6))])

    def article(self):
        blocks = [self.body_block() for _ in range(int(self.r.choice([1, 2, 4, 7, 12, 25, 60], p=[0.08, 0.12, 0.2, 0.25, 0.2, 0.1, 0.05])))]
        if self.odds(0.1):  # hardly any text
            blocks = [("p", "", 1, [("b", "", 1, [self.sentence(1, 5) + "<br>"])] if self.odds(0.4) else [self.sentence(1, 5)])]
        if self.odds(0.75):
            title = ("h1", "", 1, [self.words(1, 12).capitalize()])
            blocks.insert(0, ("header", "", 1, [title]) if self.odds(0.08) else title)
        for extra, p in ((self.advert, 0.25), (self.social, 0.25), (self.form, 0.08), (self.side, 0.06)):
            if self.odds(p):
                blocks.insert(int(self.r.integers(1, len(blocks) + 1)), extra())
        if self.odds(0.12):
            blocks.append(self.comments())
        kind = self.r.random()
        if kind < 0.45:
            return ("article", "" if self.odds(0.7) else self.attribute("post", "article", "entry"), 1, blocks)
        if kind < 0.85:
            return (self.pick("div", "div", "section", "td"), self.attribute("content", "post", "article", "entry", "story", "main", "text", "article-body", "post-content"), 1, blocks)
        return ("div", "", 1, blocks)

    def page(self):
        core = self.article()
        for _ in range(self.r.integers(0, 3)):
            core = (self.pick("main", "div", "div", "section"), self.pick("", "", self.attribute("main", "content", "container", "wrapper", "page")), 1, [core])
        before = [f() for f, p in ((self.notice, 0.25), (self.head, 0.45), (self.menu, 0.7), (self.advert, 0.45), (self.form, 0.08), (self.side, 0.12)) if self.odds(p)]
        after = [f() for f, p in ((self.advert, 0.2), (self.side, 0.35), (self.comments, 0.35), (self.social, 0.15), (self.form, 0.15), (self.notice, 0.1), (self.foot, 0.85)) if self.odds(p)]
        if self.odds(0.15):
            after.insert(0, core)
            core, before, after = before[0] if before else after[0], before[1:], after if before else after[1:]
        if self.odds(0.25) and after:
            core = ("div", self.pick("", ' class="row"', ' class="wrapper"'), 1, [core, after.pop(0)])
        return [*before, core, *after]

    def written(self, node) -> str:
        if isinstance(node, str):
            return node
        tag, attributes, label, children = node
        inner = "".join(map(self.written, children))
        end = "" if tag in ("p", "li", "b") and self.odds(0.08) else f"</{tag}>"
        return f'<{tag}{attributes} data-k="{label}">{inner}{end}'


def training_page(seed: int) -> str:
    m = _Maker(seed)
    text = '<html><head><title>t</title></head><body data-k="1">' + "".join(map(m.written, m.page())) + "</body></html>"
    return text if m.odds(0.9) else text[: int(len(text) * m.r.uniform(0.6, 1))].rsplit("<", 1)[0]


@lru_cache(4)
def model(pages: int = 900, trees: int = 50, depth: int = 4) -> boosting.Trees:
    """The trees trained on the pages of seeds 0 to pages - 1."""
    xs, ys = [], []
    for seed in range(pages):
        page = Page(training_page(seed))
        label, parent = np.array(page.label), np.maximum(page.parent, 0)
        asked = (label[parent] == 1) & (np.array(page.tag) != 0)
        xs.append(features(page, page.texts())[asked])
        ys.append(label[asked])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees, depth)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """From the page down: a node is kept if its parent is and, given that, it is likelier
    kept than not. html and body are always kept."""
    likely, out = (odds > 0).tolist(), [True] * len(page.tag)
    for i in range(1, len(out)):
        out[i] = out[page.parent[i]] and (likely[i] or page.tag[i] == 0)
    return out


def main_texts(htmls: list[str | None], trees: boosting.Trees) -> list[str]:
    """The main text of each page: kept blocks in page order, an empty line between them."""
    pages = [Page(h) for h in htmls]
    texts = [p.texts() for p in pages]
    odds = trees.log_odds(np.concatenate([features(p, t) for p, t in zip(pages, texts, strict=True)])) if pages else np.zeros(0)
    out, at = [], 0
    for page, blocks in zip(pages, texts, strict=True):
        kept = decode(page, odds[at : at + len(page.tag)])
        at += len(page.tag)
        out.append("\n\n".join(s for node, s in blocks if kept[node]))
    return out


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, batch_pages: int = 64, **options) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages (page_id, url,
    html). Null or textless html gives an empty text. Repeated rows are pages of their own."""
    shared = pages.sparkSession.sparkContext.broadcast(model(**options))

    def extract(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_pages):
                b = batch.slice(lo, batch_pages)
                texts = main_texts(b.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return whole_texts(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(extract), "page_id long, url string, text string, n_chars long")
