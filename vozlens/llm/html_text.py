"""HTML extraction: gradient-boosted trees over the features of DOM nodes, decoded along the tree.

A page is parsed leniently (implied end tags, void elements, raw script text) into
block nodes.  Each node gets features of its subtree (text and link density, counts,
punctuation), its attribute tokens, depth, siblings and ancestors, and the trees give
the probability that it belongs to the article.  Decoding picks, over the whole tree,
the likeliest labelling in which everything under a dropped node is dropped, so no
choice contradicts one above or below it.

The trees are fitted on the driver to pages that ``training_pages`` makes by rule, a
fixed number of them, the same everywhere; no page of the input takes part in the fit.

Defined results: null or empty html and pages without an article give an empty text;
a page of bare text is one block; unclosed and stray tags end where the next block
begins; a head ends where something begins that can't stand in it; an even choice (log
odds of 0) keeps a node; repeated rows give the same text; an empty table gives an empty
table; columns other than page_id, url and html are ignored; a page of any length is read
whole, in time and memory in proportion to it.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Silent elements that end by an end tag only.
PAIRED = re.compile(r"<(/?)(svg|math|canvas|object|audio|video|select|optgroup|option|datalist|button|applet|map)(?=[\s/>])", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr picture source map area".split())
#: Never text of a page, whatever their place.
SILENT = frozenset("head title script style noscript template iframe svg math canvas object embed audio video select option optgroup datalist textarea button meta link base applet map".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("title script style meta link base noscript template".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOP = frozenset("ul ol dl table body html".split())
KINDS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "pre", "figure", "body", "other")
_KIND = {"p": "p", "li": "li", "ul": "list", "ol": "list", "dl": "list", "dd": "li", "dt": "li", "menu": "nav", "div": "div", "section": "section", "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "pre", "figure": "figure", "figcaption": "figure", "body": "body", "html": "body"} | {f"h{i}": "h" for i in range(1, 7)}
NEGATIVE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup sidebar side aside widget rail related recommended recommendations more nav navbar navigation menu breadcrumb breadcrumbs toc header masthead topbar toolbar footer foot bottom copyright comment comments commentlist disqus reply replies respond discussion share sharing social login search form pagination pager tags meta complementary contentinfo".split())
POSITIVE = frozenset("article articlebody content main post entry body story text page blog".split())


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    good: int = 0
    bad: int = 0
    texts: int = 0  # characters of own text
    links: int = 0  # of them in links
    stops: int = 0
    commas: int = 0
    tags: int = 0
    children: list = field(default_factory=list)


def _attributes(raw: str) -> tuple[int, int]:
    good = bad = 0
    for m in ATTRIBUTE.finditer(raw):
        for token in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            good += token in POSITIVE
            bad += token in NEGATIVE
    if HIDDEN.search(raw):
        bad += 2
    return good, bad


class _Open:
    """The open elements of a page, with what keeps every step short: where each name is open, which are blocks, which lack an end tag."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, bool]] = [("", 0, False)]  # name, node, without an end tag
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.loose: list[int] = []
        self.silent = self.links = 0

    def push(self, tag: str, node: int, loose: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag not in INLINE:
            self.blocks.append(len(self.items))
        if loose:
            self.loose.append(len(self.items))
        self.items.append((tag, node, loose))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def cut(self, size: int) -> bool:
        """Closes all but the first ``size`` elements; tells whether a block of text was among them."""
        ended = False
        while len(self.items) > size:
            tag, _, loose = self.items.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                ended |= not self.silent
            if loose:
                self.loose.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        return ended

    def last(self, tags) -> int:
        """Where the innermost of the named elements is; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def _unclosed(page: str) -> set[int]:
    """Where start tags of silent elements stand that no end tag of their own follows before the next of the same name."""
    out: set[int] = set()
    open_: dict[str, int] = {}
    for m in PAIRED.finditer(page):
        tag = m[2].lower()
        if m[1]:
            open_.pop(tag, None)
            continue
        if tag in open_:
            out.add(open_[tag])
        open_[tag] = m.start()
    return out.union(open_.values())


def parse(page: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Block nodes (the first is the root) and the text blocks in page order, as (node, pieces).

    Time is in proportion to the page, however its tags are nested or left open.  As in
    browsers a head ends at the first thing that can't stand in it, and foreign content or a
    control without an end tag of its own ends where a block begins.
    """
    nodes = [Node("body", -1, 0)]
    open_ = _Open()
    blocks: list[tuple[int, list[str]]] = []
    current: list[str] | None = None
    at, end, last = 0, len(page), page.rfind(">")
    unclosed = _unclosed(page)

    def say(text: str) -> None:
        nonlocal current
        if not text:
            return
        if open_.items[-1][0] == "head" and not text.isspace():
            open_.cut(len(open_.items) - 1)
            current = None
        if open_.silent:
            return
        text = html.unescape(text) if "&" in text else text
        home = open_.items[-1][1]
        node = nodes[home]
        if current is None:
            if text.isspace():
                return
            current = []
            blocks.append((home, current))
        current.append(text)
        n = len(text)
        node.texts += n
        if open_.links:
            node.links += n
        node.stops += text.count(".") + text.count("!") + text.count("?")
        node.commas += text.count(",")

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            open_tag = UNENDED.search(page, at)  # a tag that the page's end cuts off is no text
            say(page[at : open_tag.start() if open_tag else end])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[4]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = open_.last((tag,))
            if k and (tag not in INLINE or k > open_.blocks[-1]):  # an inline end tag closes nothing outside its block
                if open_.cut(k):
                    current = None
            continue
        if open_.items[-1][0] == "head" and tag not in IN_HEAD:
            open_.cut(len(open_.items) - 1)
            current = None
        if tag == "br":
            if current is not None:
                current.append(" ")
            continue
        block = tag not in INLINE
        if block:
            if open_.loose and tag in _KIND:
                open_.cut(open_.loose[0])
            if not open_.silent and tag not in SILENT:  # silent elements stand within a line
                if open_.items[open_.blocks[-1]][0] == "p":
                    open_.cut(open_.blocks[-1])
                if tag in SAME and (k := open_.last(SAME[tag])) > open_.last(STOP):
                    open_.cut(k)
                current = None
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", close.end()) if close else -1
            at = stop + 1 if stop >= 0 else end
            continue
        home = open_.items[-1][1]
        nodes[home].tags += 1
        if block and not open_.silent and tag not in SILENT and tag != "html" and not (tag == "body" and home == 0):
            good, bad = _attributes(m[3] or "")
            nodes.append(Node(tag, home, nodes[home].depth + 1, good, bad))
            nodes[home].children.append(len(nodes) - 1)
            home = len(nodes) - 1
        open_.push(tag, home, tag in SILENT and tag != "head" and m.start() in unclosed)
    return nodes, blocks


#: Nodes whose features are held at once.
CHUNK = 4_096


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node."""
    return _stacked(*_columns(nodes))


def _stacked(columns: list[np.ndarray], code: np.ndarray, above: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
    """The features of some nodes: columns, and the kinds of the node and its parent as indicators."""
    code, above = code[rows], above[rows]
    one = np.zeros((len(code), 2 * len(KINDS)))
    one[np.arange(len(code)), code] = 1
    one[np.arange(len(code)), len(KINDS) + above] = 1
    return np.column_stack([*(c[rows] for c in columns), one])


def _columns(nodes: list[Node]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The numbers of all nodes, and the kinds of each and of its parent."""
    n = len(nodes)
    own = np.array([(v.texts, v.links, v.stops, v.commas, v.tags, 1) for v in nodes], dtype=float)
    sub = own.copy()
    kinds = [_KIND.get(v.tag, "other") for v in nodes]
    code = np.array([KINDS.index(k) for k in kinds])
    paragraphs = (code == KINDS.index("p")).astype(float)
    items = (code == KINDS.index("li")).astype(float)
    heads = (code == KINDS.index("h")).astype(float)
    good = np.array([v.good for v in nodes], dtype=float)
    bad = np.array([v.bad for v in nodes], dtype=float)
    deep = np.column_stack([paragraphs, items, heads, np.minimum(good, 1), np.minimum(bad, 1)])
    for i in range(n - 1, 0, -1):  # children come after their parents
        sub[nodes[i].parent] += sub[i]
        deep[nodes[i].parent] += deep[i]
    above = np.zeros((n, 8))  # article or main, nav, header, footer, aside, form, good tokens, bad tokens
    place = np.zeros((n, 4))
    flag = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 5}
    for i in range(1, n):
        p = nodes[i].parent
        above[i] = above[p]
        if (k := flag.get(kinds[p])) is not None:
            above[i, k] = 1
        above[i, 6] += min(good[p], 1)
        above[i, 7] += min(bad[p], 1)
    for p in range(n):
        c = nodes[p].children
        for k, i in enumerate(c):
            place[i] = k, len(c), k / len(c), sum(nodes[j].tag == nodes[i].tag for j in (c[max(0, k - 3) : k + 4]))
    total = max(sub[0, 0], 1)
    parent = np.array([max(v.parent, 0) for v in nodes])
    size = np.maximum(sub[:, 0], 1)
    rows = [
        np.log1p(sub[:, 0]), np.log1p(own[:, 0]), sub[:, 1] / size, sub[:, 0] / (sub[:, 4] + 1), sub[:, 0] / sub[:, 5], sub[:, 2] / size * 100, sub[:, 3] / size * 100,
        np.log1p(sub[:, 4]), sub[:, 0] / total, sub[:, 0] / size[parent], deep[:, 0], deep[:, 1], deep[:, 2], deep[:, 3], deep[:, 4], good, bad,
        np.array([v.depth for v in nodes], dtype=float), *place.T, *above.T,
    ]
    return rows, code, code[parent]


class Boosted:
    """Binary gradient boosting with depth-limited trees over quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        n, d = x.shape
        self.start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        z = np.full(n, self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            where = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                base, count = 2**level - 1, 2**level
                local = where - base
                best = np.zeros(count)
                bin_at = np.full(count, -1)
                for f in range(d):
                    key = local * self.bins + binned[:, f]
                    gs = np.bincount(key, g, count * self.bins).reshape(count, -1).cumsum(1)
                    hs = np.bincount(key, h, count * self.bins).reshape(count, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[:, len(edges[f]) :] = 0
                    k = gain.argmax(1)
                    v = gain[np.arange(count), k]
                    better = v > best + 1e-9
                    best[better], bin_at[better] = v[better], k[better]
                    feature[base : base + count][better] = f
                for s in range(count):
                    if bin_at[s] >= 0:
                        cut[base + s] = edges[feature[base + s]][bin_at[s]]
                where = 2 * where + 1 + (x[np.arange(n), feature[where]] > cut[where])
            leaf = where - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            z += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            where = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                where = 2 * where + 1 + (x[rows, feature[where]] > cut[where])
            z += value[where - (2**self.depth - 1)]
        return z


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the likeliest labelling with nothing kept under a dropped node; the root stays."""
    n = len(nodes)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    gone = drop.copy()  # the whole subtree dropped
    best = keep.copy()  # this node kept, each child as is best for it
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        gone[p] += gone[i]
        best[p] += max(best[i], gone[i])
    out = np.zeros(n, dtype=bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[nodes[i].parent] and best[i] >= gone[i]
    return out


def texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    parts = [_columns(nodes) for nodes, _ in parsed]
    odds = [np.concatenate([model.predict(_stacked(*part, slice(a, a + CHUNK))) for a in range(0, len(part[1]), CHUNK)]) for part in parts if len(part[1]) > CHUNK]
    few = [part for part in parts if len(part[1]) <= CHUNK]  # small pages go through the trees together
    together = model.predict(np.concatenate([_stacked(*part) for part in few])) if few else np.zeros(0)
    out, at = [], 0
    for (nodes, blocks), part in zip(parsed, parts, strict=True):
        if len(part[1]) > CHUNK:
            own = odds.pop(0)
        else:
            own, at = together[at : at + len(nodes)], at + len(nodes)
        keep = decode(nodes, own)
        lines = (" ".join("".join(pieces).split()) for node, pieces in blocks if keep[node])
        out.append("\n".join(line for line in lines if line))
    return out


def training_pages(n: int = 260, seed: int = 20260918) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages by rule, each with the openings of its block elements in order and whether they are the article's."""
    rng = random.Random(seed)
    syllables = "th er in on an re ti es ha or nt ed he le ou la que de ado ción ung ver sch ä é ment pa bo ga".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return " ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))).capitalize() + "."

    def prose(k: int) -> str:
        style = rng.random()
        text = " ".join(sentence() for _ in range(k))
        if style < 0.06:
            return " ".join(w + rng.choice(("***", "###", "&amp;", "%%%")) for w in text.split())
        return text.upper() if style < 0.09 else text

    pages = []
    for _ in range(n):
        marks: list[tuple[str, bool]] = []

        def el(tag: str, main: bool, inner, attributes: str = "", close: bool = True) -> str:
            marks.append((tag, main))
            body = inner() if callable(inner) else inner
            return f"<{tag}{' ' + attributes if attributes else ''}>{body}" + (f"</{tag}>" if close else "")

        def links(k: int) -> str:
            return "".join(el("li", False, f'<a href="/{word()}">{word()}</a>') for _ in range(k))

        def menu() -> str:
            kind = rng.random()
            if kind < 0.5:
                return el("nav", False, lambda: el("ul", False, lambda: links(rng.randint(3, 9))))
            return el("div", False, lambda: el("ul", False, lambda: links(rng.randint(3, 9))), rng.choice(('class="menu"', 'id="navbar"', 'class="breadcrumbs"', 'role="navigation" class="nav main-nav"')))

        def ad() -> str:
            return el("div", False, lambda: prose(rng.randint(1, 2)) if rng.random() < 0.6 else el("p", False, prose(rng.randint(1, 3))), rng.choice(('class="ad"', 'class="advert"', 'class="sponsored-box"', 'id="banner"', 'class="promo"')))

        def notice() -> str:
            return el("div", False, lambda: el("p", False, prose(rng.randint(1, 3))) if rng.random() < 0.5 else prose(rng.randint(1, 3)), rng.choice(('class="cookie-notice"', 'id="consent"', 'class="notice"', 'class="alert"', 'role="alert" class="gdpr"', 'class="newsletter"')))

        def side() -> str:
            inner = lambda: el("h3", False, sentence(1, 3)) + el("ul", False, lambda: links(rng.randint(2, 6))) + (el("p", False, prose(rng.randint(1, 3))) if rng.random() < 0.5 else "")
            return el("aside", False, inner) if rng.random() < 0.5 else el("div", False, inner, rng.choice(('class="sidebar"', 'id="side"', 'class="widget"', 'class="related"')))

        def form() -> str:
            return el("form", False, lambda: rng.choice(("", "<label>" + sentence(1, 4) + "</label>")) + '<input name="q">' + (el("p", False, sentence(3, 9)) if rng.random() < 0.6 else ""), rng.choice(("", 'class="search"', 'id="subscribe"', 'action="/login"')))

        def comments() -> str:
            one = lambda: el(rng.choice(("div", "li")), False, lambda: el("p", False, prose(rng.randint(1, 4))), rng.choice(("", 'class="comment"', 'class="reply"')))
            tag = rng.choice(("section", "div", "ol"))
            return el(tag, False, lambda: (el("h3", False, sentence(1, 3)) if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6))), rng.choice(('class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus"')))

        def share() -> str:
            return el("div", False, "".join(f'<a href="#">{word()}</a> ' for _ in range(rng.randint(2, 5))), rng.choice(('class="share"', 'class="social"', 'class="tags"')))

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.1:
                return el("p", True, f"<b>{prose(rng.randint(1, 2))}<br>", close=False)
            text = prose(rng.randint(1, 7)) if kind < 0.85 else sentence(1, 5)
            if kind > 0.7:
                text += f' <a href="/{word()}">{word()}</a> {sentence()}'
            return el("p", True, text, close=rng.random() < 0.9)

        def part() -> str:
            kind = rng.random()
            if kind < 0.74:
                return paragraph()
            if kind < 0.82:
                return el(rng.choice(("h2", "h3")), True, sentence(1, 6))
            if kind < 0.88:
                return el(rng.choice(("ul", "ol")), True, lambda: "".join(el("li", True, sentence(2, 14)) for _ in range(rng.randint(2, 6))))
            if kind < 0.92:
                return el("blockquote", True, lambda: el("p", True, prose(rng.randint(1, 3))) if rng.random() < 0.6 else prose(2))
            if kind < 0.95:
                return el("table", True, lambda: "".join(el("tr", True, lambda: "".join(el("td", True, word()) for _ in range(3))) for _ in range(rng.randint(2, 4))))
            if kind < 0.97:
                return el("pre", True, prose(1))
            return el("figure", True, lambda: '<img src="x.png">' + el("figcaption", True, sentence(2, 8)))

        def article() -> str:
            def inner() -> str:
                out = el("h1", True, sentence(2, 12)) if rng.random() < 0.9 else ""
                for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
                    out += part()
                    if rng.random() < 0.05:
                        out += rng.choice((ad, share, side, form, notice))()
                if rng.random() < 0.15:
                    out += rng.choice((comments, share))()
                return out

            kind = rng.random()
            if kind < 0.6:
                return el("article", True, inner, rng.choice(("", 'class="post"')))
            if kind < 0.75:
                return el("main", True, lambda: el("article", True, inner) if rng.random() < 0.5 else inner())
            if kind < 0.95:
                return el("div", True, inner, rng.choice(('class="content"', 'id="main"', 'class="entry-content"', 'class="post body"', "", 'class="x1"')))
            return inner()

        def top() -> str:
            return el("header", False, lambda: (el("h1", False, sentence(1, 4)) if rng.random() < 0.3 else "") + (el("p", False, sentence(2, 7)) if rng.random() < 0.5 else "") + (menu() if rng.random() < 0.5 else f'<a href="/">{word()}</a>'), rng.choice(("", 'class="masthead"')))

        def foot() -> str:
            text = lambda: f"&copy; {word()}.example &middot; {prose(rng.randint(1, 2))}" if rng.random() < 0.6 else el("p", False, prose(1)) + el("ul", False, lambda: links(3))
            return el("footer", False, text) if rng.random() < 0.75 else el("div", False, text, rng.choice(('class="footer"', 'id="footer"', 'class="copyright"')))

        bare = rng.random() < 0.06
        body = ""
        if not bare:
            for piece, chance in ((notice, 0.25), (top, 0.4), (menu, 0.7), (ad, 0.5), (form, 0.15), (side, 0.2)):
                if rng.random() < chance:
                    body += piece()
        if rng.random() < 0.15:
            body += el("div", True, article, rng.choice(('class="wrapper"', 'id="page"', "")))
        else:
            body += article()
        if not bare:
            for piece, chance in ((comments, 0.3), (side, 0.3), (ad, 0.2), (form, 0.15), (notice, 0.12), (foot, 0.8)):
                if rng.random() < chance:
                    body += piece()
        pages.append((f'<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><script>var t="</p>";</script></head><body>{body}</body></html>', marks))
    return pages


_model: list[Boosted] = []


def trained() -> Boosted:
    """The trees, fitted once in a driver's life."""
    if not _model:
        xs, ys = [], []
        for page, marks in training_pages():
            nodes, _ = parse(page)
            assert [v.tag for v in nodes[1:]] == [t for t, _ in marks], "the made page didn't parse as it was made"
            xs.append(features(nodes)[1:])
            ys.append(np.array([float(m) for _, m in marks]))
        _model.append(Boosted().fit(np.concatenate(xs), np.concatenate(ys)))
    return _model[0]


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; one narrow pass."""
    small_batches(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "html"):
                for a in range(0, batch.num_rows, 32):
                    part = batch.slice(a, 32)
                    found = texts(part.column(2).to_pylist(), model)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every page."""
    return extract(table(spark, sf_dir, "pages"))
