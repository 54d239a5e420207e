"""A forgiving HTML reader for main-text extraction, and the features of its nodes.

Nodes are block-level elements, in page order, each with a parent and the last of its
subtree; inline elements only count as links. Text is gathered in blocks: a run of text
without a block-level tag within.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np

#: Block-level tags, by the class that the features use.
TAGS = {
    "html": 0, "body": 0, "main": 1, "article": 2, "section": 3, "div": 4, "center": 4, "p": 5, "pre": 5, "blockquote": 5, "address": 6,
    "h1": 7, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "hgroup": 8, "header": 9, "nav": 10, "menu": 10, "footer": 11, "aside": 12,
    "form": 13, "fieldset": 13, "legend": 13, "label": 13, "button": 13, "select": 13, "textarea": 13, "option": 13, "dialog": 14, "ul": 15, "ol": 15, "dl": 15, "dir": 15,
    "li": 16, "dt": 16, "dd": 16, "table": 17, "tbody": 17, "thead": 17, "tfoot": 17, "tr": 18, "td": 19, "th": 19, "caption": 20,
    "figure": 21, "figcaption": 20, "details": 4, "summary": 6,
}
N_TAGS = 22
#: Words in class, id and role, by what they speak for.
ATTRIBUTES = [
    ("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"),
    ("header", "masthead", "top", "topbar", "logo", "brand", "branding", "hero"),
    ("footer", "bottom", "copyright", "colophon", "legal", "contentinfo", "foot"),
    ("sidebar", "side", "aside", "rail", "widget", "complementary", "right", "left", "column"),
    ("ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner", "dfp"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "warning", "message", "dialog", "toast"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "feedback", "reviews"),
    ("share", "social", "related", "recommended", "tags", "more", "popular", "trending", "newsletter", "subscribe", "meta", "byline", "author"),
    ("form", "search", "login", "signup", "signin", "register", "input", "field"),
    ("article", "content", "post", "entry", "story", "main", "text", "body", "page", "single", "copy", "prose"),
]
_GROUP = {w: 1 << k for k, group in enumerate(ATTRIBUTES) for w in group}
_BAD_TAG = {"nav": 1, "menu": 1, "footer": 2, "aside": 4, "form": 8, "header": 16, "article": 32, "main": 32, "dialog": 64}
_RAW = "script|style|title"
#: Left out with all they hold if they are closed; else only the tag is.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "svg", "math", "iframe")}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<({_RAW})\b[^>]*>(?:.*?</\1\s*>|.*)|<(/?)([a-z][a-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|<[a-z][^>]*\Z|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-k)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select"}


def _split_camel(s: str) -> list[str]:
    return _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", s).lower())


class Page:
    """Parallel lists over nodes; node 0 is the page itself."""

    def __init__(self, text: str | None):
        self.tag, self.parent, self.depth, self.last = [0], [-1], [0], [0]
        self.bits, self.above, self.label = [0], [0], [1]
        self.blocks: list[tuple[int, list[str], list[int]]] = []  # node, pieces, letters within links
        self._read(text or "")

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        block: tuple[int, list[str], list[int]] | None = None
        link_at = 0  # depth of the stack where an open link began; 0: none

        def close(upto: int) -> None:
            nonlocal link_at
            end = len(self.tag) - 1
            while len(stack) > upto:
                self.last[stack.pop()[1]] = end
            if link_at > len(stack):
                link_at = 0

        shown = 0  # where the last hidden element ends
        unclosed: set[str] = set()
        for m in _TOKEN.finditer(text):
            if m.start() < shown:
                continue
            piece = m.group(5)
            if piece is not None:
                if block is None:
                    if piece.isspace():
                        continue
                    block = (stack[-1][1], [], [0])
                    self.blocks.append(block)
                block[1].append(piece)
                if link_at:
                    block[2][0] += len(piece)
                continue
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if name in _HIDDEN and not m.group(2) and name not in unclosed:
                if end := _HIDDEN[name].search(text, m.end()):
                    shown = end.end()
                else:
                    unclosed.add(name)
                continue
            if name == "br":
                if block is not None:
                    block[1].append(" ")
                continue
            if name == "a":
                link_at = 0 if m.group(2) else len(stack)
                continue
            kind = TAGS.get(name)
            if name == "hr":
                block = None
            if kind is None:
                if name in ("head", "link", "meta", "base"):
                    block = None
                continue
            block = None
            if m.group(2):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                continue
            if name in ("html", "body") and any(t == name for t, _ in stack):
                continue
            # a block ends an open paragraph; an item ends the item before it
            ends = _CLOSES.get(name)
            for k in range(len(stack) - 1, 0, -1):
                if ends and stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in ("h1", "h2", "h3", "h4", "h5", "h6", "label", "button"):
                    break
            parent, bits, label, own = stack[-1][1], 0, 0, m.group(4)
            if own and "=" in own:
                for key, a, b, c in _ATTRIBUTE.findall(own):
                    if key.lower() == "data-k":
                        label = int((a or b or c) == "1")
                    else:
                        for w in _split_camel(a or b or c):
                            bits |= _GROUP.get(w, 0)
            at = len(self.tag)
            self.tag.append(kind)
            self.parent.append(parent)
            self.depth.append(len(stack))
            self.last.append(at)
            self.bits.append(bits)
            self.above.append(self.above[parent] | _BAD_TAG.get(name, 0) | bits << 8)
            self.label.append(label)
            stack.append((name, at))
        close(0)
        self.last[0] = len(self.tag) - 1

    def texts(self) -> list[tuple[int, str]]:
        """Node and text of each block that isn't blank."""
        out = []
        for node, pieces, _ in self.blocks:
            s = " ".join(entities.unescape("".join(pieces)).split())
            if s:
                out.append((node, s))
        return out


def features(page: Page, texts: list[tuple[int, str]]) -> np.ndarray:
    """A row for each node: subtree density, attribute words, depth, siblings."""
    n = len(page.tag)
    tag, parent, depth, last = (np.array(x) for x in (page.tag, page.parent, page.depth, page.last))
    bits, above = np.array(page.bits), np.array(page.above)
    own = np.zeros((n, 6))  # letters, letters in links, words, stops, commas, blocks
    for node, s in texts:
        row = own[node]
        row[0] += len(s)
        row[2] += s.count(" ") + 1
        row[3] += s.count(".") + s.count("!") + s.count("?")
        row[4] += s.count(",")
        row[5] += 1
    for node, _, inside in page.blocks:
        own[node, 1] += inside[0]
    onehot = np.zeros((n, N_TAGS))
    onehot[np.arange(n), tag] = 1
    both = np.hstack([own, onehot[:, [5, 16, 15, 13]], np.ones((n, 1))])  # paragraphs, items, lists, form parts, all
    run = np.vstack([np.zeros((1, both.shape[1])), np.cumsum(both, 0)])
    sub = run[last + 1] - run[np.arange(n)]
    p = np.maximum(parent, 0)
    total = np.maximum(sub[0], 1)
    siblings = np.bincount(p[1:], minlength=n)
    index = np.zeros(n)
    seen: dict[int, int] = {}
    for i, q in enumerate(page.parent):
        index[i] = seen[q] = seen.get(q, -1) + 1
    same = np.zeros(n)
    keys, inverse, counts = np.unique(p * 64 + tag, return_inverse=True, return_counts=True)
    same[:] = counts[inverse]
    mean_sibling = np.bincount(p[1:], weights=sub[1:, 0], minlength=n)[p] / np.maximum(siblings[p], 1)
    letters = np.maximum(sub[:, 0], 1)
    start = run[np.arange(n), 0] / total[0]
    columns = [
        np.log1p(sub[:, 0]), np.log1p(own[:, 0]), np.minimum(sub[:, 1] / letters, 1), np.log1p(sub[:, 2]), sub[:, 3] / letters * 100, sub[:, 4] / letters * 100,
        letters / sub[:, 10], np.log1p(sub[:, 10]), sub[:, 6], sub[:, 7], sub[:, 8], sub[:, 9], depth, start, start + sub[:, 0] / total[0], sub[:, 0] / total[0],
        siblings[p], index, same, sub[:, 0] / np.maximum(sub[p, 0], 1), np.log1p(mean_sibling), np.log1p(sub[p, 0]), np.minimum(sub[p, 1] / np.maximum(sub[p, 0], 1), 1),
    ]
    flags = [(bits >> k) & 1 for k in range(len(ATTRIBUTES))]
    up = above[p]
    flags += [(up >> k) & 1 for k in [*range(7), *range(8, 8 + len(ATTRIBUTES))]]
    return np.column_stack([*columns, *flags, onehot, onehot[p]]).astype(np.float32)
