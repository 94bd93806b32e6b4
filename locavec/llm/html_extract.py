"""Main text of web pages: gradient-boosted trees over the features of DOM nodes, then hierarchical decoding.

A page is parsed into block nodes; inline markup belongs to its block. Each node is described by its tag, the tokens of its class, id and
role and of its ancestors', its depth, the density of text, links and punctuation in its subtree, and its
siblings. Boosted trees give the log odds that a node holds main text if its parent does. The decoder takes the likeliest
labelling of the whole tree in which every kept node's parent is kept, so that no kept block lies in a dropped one.
The trees are trained on pages that ``training_page`` makes from a seed: layouts of known content.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their closing tag, and never text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Elements inside a line that are nodes of their own: the block around them goes on after them.
EMBEDDED = frozenset("button select svg math object canvas audio video noscript template".split())
#: Elements whose unknown inner elements are no nodes, and which a block ends.
FOREIGN = frozenset(("svg", "math", "select"))
TAGS = ("body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "nav", "header", "footer", "aside",
        "form", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "fieldset", "address", "details",
        "button", "select", "svg", "math", "object", "canvas", "audio", "video", "noscript", "template")
#: Tokens of class, id and role that get a feature of their own.
TOKENS = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs",
          "sidebar", "side", "aside", "complementary", "widget", "related", "recommended", "footer", "contentinfo", "copyright", "header", "masthead", "top", "cookie", "cookies",
          "notice", "alert", "consent", "gdpr", "newsletter", "subscribe", "signup", "popup", "modal", "comment", "comments", "reply", "discussion", "share", "social",
          "form", "login", "search", "article", "content", "main", "post", "entry", "body", "story")
_BIT = {t: i for i, t in enumerate(TOKENS)}
_TAG = {t: i for i, t in enumerate(TAGS)}
_MARKUP = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*+>?|/?[a-zA-Z][^>]*+(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "button": ("button",), "select": ("select",)}
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "button": ("td", "th", "table", "object", "template"), "select": ("td", "th", "table", "object", "template")}
_masks: dict[str, int] = {}


def _mask(attributes: str) -> int:
    """Bits of the known tokens in class, id and role."""
    if attributes not in _masks:
        if len(_masks) > 100_000:
            _masks.clear()
        m = 0
        for found in _ATTRIBUTE.findall(attributes):
            words = re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found))
            for t in re.split(r"[^a-z]+", words.lower()):
                if t in _BIT:
                    m |= 1 << _BIT[t]
        _masks[attributes] = m
    return _masks[attributes]


class Page:
    """Nodes in page order and the text segments between their boundaries.

    ``runs`` has for each segment the number of its block, the same before and after an embedded element, and whether white space is before it.
    """

    __slots__ = ("tag", "parent", "depth", "own", "above", "end", "segments", "runs", "links", "marked")

    def __init__(self, text: str):
        self.tag, self.parent, self.depth, self.own, self.above, self.end = ["body"], [-1], [0], [0], [0], [0]
        self.segments: list[tuple[int, str]] = []
        self.runs: list[tuple[int, bool]] = []
        self.links, self.marked = [0], [False]
        self._parse(text)

    def _parse(self, text: str) -> None:
        stack, parts, linked, run, gap = [0], [], 0, 0, False
        at, n = 0, len(text)

        def flush(block=True):
            nonlocal run, gap
            if parts:
                raw = html.unescape("".join(parts))
                s = " ".join(raw.split())
                if s:
                    self.segments.append((stack[-1], s))
                    self.runs.append((run, gap or raw[0].isspace()))
                    gap = raw[-1].isspace()
                else:
                    gap = True
                parts.clear()
            run += block

        def close(k):  # all open nodes from stack position k on
            flush(not all(self.tag[i] in EMBEDDED for i in stack[k:]))
            for i in stack[k:]:
                self.end[i] = len(self.tag)
            del stack[k:]

        while at < n:
            m = _MARKUP.search(text, at)
            stop = m.start() if m else n
            if stop > at:
                parts.append(text[at:stop])
                if linked:
                    self.links[stack[-1]] += stop - at
            if not m:
                break
            at = m.end()
            if m.group() == "<!--":
                e = text.find("-->", at)
                at = n if e < 0 else e + 3
                continue
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            foreign = self.tag[stack[-1]] in FOREIGN
            if m.group(1):
                if name == "a":
                    linked = 0
                elif name not in INLINE and name not in ("body", "html"):
                    if name in EMBEDDED and name != "math":
                        parts.append(" ")
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            close(k)
                            if name in EMBEDDED and name != "math":
                                parts.append(" ")
                            break
                continue
            if name in INLINE:
                if name == "a":
                    linked = 1
                elif name == "br":
                    parts.append(" ")
                continue
            if name in RAW:
                parts.append(" ")
                if not (foreign and m.group(3).endswith("/")):
                    at = self._raw_end(text, name, at)
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in ("html", "head", "body"):  # head ends by itself: what it may hold has no text
                if name == "body":
                    self.own[0] |= _mask(m.group(3))
                continue
            inside = name in EMBEDDED
            if foreign and (name not in _TAG or m.group(3).endswith("/")) or name in ("option", "optgroup"):
                if self.tag[stack[-1]] != "math":
                    parts.append(" ")
                continue
            if name in ("svg", "math") and m.group(3).endswith("/"):
                parts.append(" ")
                continue
            if not inside:
                flush()
                linked = 0
                while self.tag[stack[-1]] in FOREIGN:
                    close(len(stack) - 1)
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t == "p":
                        close(k)
                    if t not in EMBEDDED or t in ("object", "template"):
                        break
            if name in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in _CLOSES[name]:
                        close(k)
                        break
                    if t in _SCOPE[name]:
                        break
            if inside:
                if name != "math":
                    parts.append(" ")
                flush(False)
            up, i = stack[-1], len(self.tag)
            self.tag.append(name)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1)
            self.own.append(_mask(m.group(3)))
            self.above.append(self.above[up] | self.own[up])
            self.end.append(i + 1)
            self.links.append(0)
            self.marked.append("data-main" in m.group(3))
            stack.append(i)
        close(0)

    @staticmethod
    def _raw_end(text: str, name: str, at: int) -> int:
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
        return m.end() if m else len(text)


WIDTH = len(TAGS) + 2 * len(TOKENS) + len(TAGS) + 19


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages."""
    size = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(size) - size, size)
    n = int(size.sum())
    tag = np.array([_TAG.get(t, -1) for p in pages for t in p.tag])
    parent = np.array([q for p in pages for q in p.parent]) + base
    root = np.arange(n) == base
    parent[root] = base[root]
    end = np.array([e for p in pages for e in p.end]) + base
    depth = np.array([d for p in pages for d in p.depth], np.float32)
    own = np.array([m for p in pages for m in p.own], np.int64)
    above = np.array([m for p in pages for m in p.above], np.int64)
    links = np.array([x for p in pages for x in p.links], np.float64)
    chars, marks, parts = np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.cumsum(size) - size
    for f, p in zip(first, pages):
        for i, s in p.segments:
            chars[f + i] += len(s)
            marks[f + i] += s.count(",") + s.count(".") + s.count("!") + s.count("?")
            parts[f + i] += 1
    at = np.arange(n)

    def under(x):
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[end] - c[at]

    t_chars, t_links, t_marks, t_parts, t_nodes = under(chars), np.minimum(under(links), under(chars)), under(marks), under(parts), (end - at).astype(float)
    total = t_chars[base]
    children = np.bincount(parent[~root], minlength=n).astype(float)
    # place among the siblings: nodes are in page order, so a stable sort by parent keeps it
    order = np.argsort(parent + root * 0.0, kind="stable")
    order = order[~root[order]]
    place = np.zeros(n)
    start = np.concatenate([[0], np.flatnonzero(np.diff(parent[order])) + 1]) if len(order) else np.zeros(0, int)
    place[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) if len(order) else 0
    sib_chars = np.bincount(parent[~root], t_chars[~root], n)[parent] / np.maximum(children[parent], 1)
    alike = np.bincount(parent[~root], tag[~root] == tag[parent][~root], n)[parent]
    before = np.full(n, -1.0)
    if len(order):
        prev = order[:-1][parent[order[1:]] == parent[order[:-1]]]
        nxt = order[1:][parent[order[1:]] == parent[order[:-1]]]
        before[nxt] = t_chars[prev]
    log = np.log1p
    numbers = np.stack([
        depth, log(t_chars), log(chars), t_chars / np.maximum(total, 1), t_links / np.maximum(t_chars, 1), 1000 * t_nodes / np.maximum(t_chars, 1),
        100 * t_marks / np.maximum(t_chars, 1), t_chars / np.maximum(t_parts, 1), log(t_parts), log(t_nodes), children, place, place / np.maximum(children[parent] - 1, 1),
        children[parent], log(sib_chars), t_chars / np.maximum(sib_chars, 1), alike, log(np.maximum(before, 0)), (at - base) / np.maximum(size.repeat(size), 1),
    ], axis=1)
    out = np.zeros((n, WIDTH), np.float32)
    k = len(TAGS)
    ok = tag >= 0
    out[at[ok], tag[ok]] = 1
    bits = np.arange(len(TOKENS))
    out[:, k:k + len(TOKENS)] = (own[:, None] >> bits) & 1
    out[:, k + len(TOKENS):k + 2 * len(TOKENS)] = (above[:, None] >> bits) & 1
    k += 2 * len(TOKENS)
    up = tag[parent]
    ok = (up >= 0) & ~root
    out[at[ok], k + up[ok]] = 1
    out[:, k + len(TAGS):] = numbers
    return out


class Trees:
    """Gradient-boosted regression trees of fixed depth for the logistic loss, on feature histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 100, depth: int = 4, rate: float = 0.2, bins: int = 24,
                 ridge: float = 1.0, columns: int = 80, seed: int = 5):
        self.depth, width = depth, x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        self.start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        score = np.full(len(y), self.start)
        self.feature = np.zeros((trees, 2 ** depth - 1), np.int64)
        self.limit = np.full((trees, 2 ** depth - 1), np.inf, np.float32)
        self.leaf = np.zeros((trees, 2 ** depth))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            some = np.sort(rng.choice(width, min(columns, width), replace=False))  # the features this tree may use
            place = (binned[:, some] + np.arange(len(some)) * bins).astype(np.int32)
            for d in range(depth):
                for k in range(2 ** d):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 20:
                        continue
                    flat, m = place[rows].T.ravel(), len(some)
                    gs = np.bincount(flat, np.tile(g[rows], m), m * bins).reshape(m, bins).cumsum(1)
                    hs = np.bincount(flat, np.tile(h[rows], m), m * bins).reshape(m, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[some[j]]):
                        self.feature[t, 2 ** d - 1 + k], self.limit[t, 2 ** d - 1 + k] = some[j], edges[some[j]][b]
                at = 2 ** d - 1 + node
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, at]] > self.limit[t, at])
            self.leaf[t] = rate * np.bincount(node, g, 2 ** depth) / (np.bincount(node, h, 2 ** depth) + ridge)
            score = score + self.leaf[t][node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = 2 ** d - 1 + node
                node = 2 * node + (x[rows, f[at]] > limit[at])
            out += leaf[node]
        return out


def decode(page: Page, odds: np.ndarray) -> str:
    """Text of the likeliest labelling in which every kept node's parent is kept; the root is always kept.

    ``odds`` are the log odds that a node is kept if its parent is. A dropped node settles its whole subtree; a kept one is
    worth its own log probability and the best of each child.
    """
    n = len(page.tag)
    o = np.clip(odds, -12, 12)
    yes, no = (-np.log1p(np.exp(-o))).tolist(), (-np.log1p(np.exp(o))).tolist()
    for i in range(n - 1, 0, -1):
        yes[page.parent[i]] += max(yes[i], no[i])
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and yes[i] > no[i]
    out, last, left = [], -1, False
    for (i, s), (run, gap) in zip(page.segments, page.runs):
        if not keep[i]:
            left = True
            continue
        if out:
            out.append("\n\n" if run != last else " " if gap or left else "")
        out.append(s)
        last, left = run, False
    return "".join(out)


# ---------------------------------------------------------------- training pages


def training_page(rng: np.random.Generator) -> str:
    """A page of a random layout; blocks of the article carry the attribute data-main."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p

    letters = rng.integers(0, 14, 400 * 9)
    pool = ["".join("etaoinshrdluéü"[c] for c in letters[9 * i:9 * i + 2 + letters[9 * i] % 8]) for i in range(400)]

    def words(n):
        return [pool[i] for i in rng.integers(0, len(pool), n)]

    def sentence(least=3, most=18):
        w = words(int(rng.integers(least, most)))
        w = [x + "," if chance(0.08) else x for x in w]
        return " ".join(w).capitalize() + pick(".", ".", ".", "!", "?")

    odd = pick("", "", "", "", "!!", "***", " |", "shout")
    brief = chance(0.3)  # pages of few and short blocks

    def prose(least=1, most=6):
        t = " ".join(sentence() for _ in range(int(rng.integers(least, 2 if brief else most))))
        if odd and chance(0.5):
            t = t.upper() if odd == "shout" else (odd + " ").join(t.split(" "))
        return t

    def inline(t):
        w = t.split(" ")
        for _ in range(int(rng.integers(0, 3))):
            i = int(rng.integers(len(w)))
            w[i] = pick('<a href="/x">{}</a>', "<b>{}</b>", "<i>{}</i>", "<em>{}</em>", "<br>{}").format(w[i])
        return " ".join(w)

    def links(n):
        return [f'<a href="/{i}">{" ".join(words(int(rng.integers(1, 4))))}</a>' for i in range(n)]

    def named(tags, tokens, body):
        tag, t = pick(*tags), pick(*tokens)
        t = pick("{}", "{}", "{}", "site-{}", "{}-box", "{}_1", "js {}", "{} wide", "page-{}").format(t)
        return f'<{tag} {pick("class", "class", "id")}="{t}">{body}</{tag}>'

    def listing(n):
        a = links(n)
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in a) + "</ul>", " ".join(a), "<p>" + " | ".join(a) + "</p>", "".join(f"<div>{x}</div>" for x in a))

    def menu():
        b = listing(int(rng.integers(3, 9)))
        return pick(f"<nav>{b}</nav>", f'<nav class="menu">{b}</nav>', named(("div", "ul"), ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs"), b), f'<div role="navigation">{b}</div>')

    def header():
        b = pick("", f"<h1>{' '.join(words(2))}</h1>", f"<p>{' '.join(words(3))}</p>", f"<div>{sentence(2, 7)}</div>") + pick("", menu(), listing(4))
        return pick(f"<header>{b or sentence()}</header>", named(("div",), ("header", "masthead", "top", "banner"), b or sentence()), f'<div role="banner">{b or sentence()}</div>')

    def footer():
        b = pick(f"&copy; {prose(1, 3)}", f"<p>&copy; {' '.join(words(3))} &middot; {prose(1, 2)}</p>", listing(4), f"<div>{prose(1, 4)}</div>{listing(3)}", f"<p>{prose(1, 3)}</p>")
        return pick(f"<footer>{b}</footer>", f'<footer class="footer">{b}</footer>', named(("div",), ("footer", "copyright"), b), f'<div role="contentinfo">{b}</div>')

    def advert():
        return named(("div", "div", "aside", "section", "p"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"), pick(prose(1, 4), f"<p>{prose(1, 4)}</p>", f'<a href="/y">{sentence()}</a>'))

    def sidebar():
        b = "".join(pick(f"<h3>{sentence(2, 5)}</h3>{listing(4)}", f"<p>{prose(1, 4)}</p>", f"<div class=\"widget\">{prose(1, 3)}</div>") for _ in range(int(rng.integers(1, 4))))
        return pick(f"<aside>{b}</aside>", named(("div", "aside", "section"), ("sidebar", "side", "aside", "widget", "related", "recommended"), b), f'<div role="complementary">{b}</div>')

    def notice():
        b = pick(prose(1, 3), f"<p>{prose(1, 3)}</p><button>ok</button>", f"<p>{sentence()} <a href='/c'>{words(1)[0]}</a></p>")
        return pick(named(("div", "section", "p", "aside"), ("cookie", "cookies", "notice", "alert", "consent", "gdpr", "popup", "modal", "cookie-notice", "cookie-banner"), b), f'<div role="alert">{b}</div>')

    def form():
        b = f"<p>{prose(1, 3)}</p><label>{' '.join(words(2))}</label><input name=q>" + pick("", "<button>go</button>", f"<div>{sentence()}</div>")
        return pick(f"<form>{b}</form>", f'<form class="newsletter">{b}</form>', named(("div", "section"), ("newsletter", "subscribe", "signup", "login", "search", "form"), pick(b, f"<form>{b}</form>")))

    def comments():
        item = lambda: pick(f"<p>{prose(1, 5)}</p>", f"<b>{words(1)[0]}</b><p>{prose(1, 4)}</p>", prose(1, 4))
        n, head = int(rng.integers(1, 6)), pick("", f"<h2>{sentence(1, 4)}</h2>", f"<h3>{sentence(1, 4)}</h3>")
        b = pick("<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", "<ol>" + "".join(f'<li class="comment">{item()}</li>' for _ in range(n)) + "</ol>",
                 "".join(f'<div class="comment">{item()}</div>' for _ in range(n)), "".join(f"<article class=\"comment\">{item()}</article>" for _ in range(n)),
                 "".join(f"<p>{prose(1, 4)}</p>" for _ in range(n)), "".join(f"<div>{item()}</div>" for _ in range(n)))
        return named(("div", "section", "aside", "ol"), ("comments", "comment", "discussion", "comment-list", "reply", "user-comments"), head + b)

    def share():
        return named(("div", "ul", "p"), ("share", "social", "related", "recommended"), listing(3))

    inside, outside = (advert, share, form, notice, sidebar, comments), (advert, sidebar, notice, form, share, comments, menu)

    def block():
        k = rng.random()
        if k < 0.66:
            return f"<p data-main>{inline(prose())}" + pick("</p>", "</p>", "</p>", "")
        if k < 0.76:
            return f"<{(h := pick('h2', 'h3', 'h4'))} data-main>{sentence(2, 7)}</{h}>"
        if k < 0.83:
            return "<{0}>{1}</{0}>".format(pick("ul", "ol"), "".join(f"<li data-main>{sentence()}</li>" for _ in range(int(rng.integers(2, 6)))))
        if k < 0.88:
            return pick(f"<blockquote data-main>{prose(1, 4)}</blockquote>", f"<blockquote><p data-main>{prose(1, 4)}</p></blockquote>")
        if k < 0.91:
            return f"<pre data-main>{' '.join(words(8))}</pre>"
        if k < 0.94:
            return f"<figure data-main><img src=a><figcaption data-main>{sentence()}</figcaption></figure>"
        if k < 0.97:
            return "<table>" + "".join(f"<tr><td data-main>{words(1)[0]}</td><td data-main>{sentence(1, 5)}</td></tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>"
        return f"<div data-main>{inline(prose())}</div>"

    body = [block() for _ in range(int(rng.integers(1, 4 if brief else 14)))]
    title = f"<h1 data-main>{sentence(2, 9)}</h1>"
    title = pick(title, title, "", f"<header>{title}</header>", f"<header>{title}<p data-main>{sentence(2, 8)}</p></header>", f"{title}<p data-main><b>{sentence(2, 9)}<br>")
    if chance(0.2):
        body = [f"<{(t := pick('section', 'div'))}>{x}{block()}</{t}>" for x in body[:6]]
    for _ in range(int(rng.integers(0, 2))):
        body.insert(int(rng.integers(len(body) + 1)), pick(*inside)())
    core = title + "".join(body) + (comments() if chance(0.12) else "") + (f"<footer>{sentence(2, 6)}</footer>" if chance(0.08) else "")
    core = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main">{}</div>', '<div class="post">{}</div>',
                '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>', '<div id="story"><div>{}</div></div>', "<div>{}</div>", "<section>{}</section>", '<div role="main">{}</div>',
                '<div class="wrap"><article class="post">{}</article></div>').format(core)
    head = [header()] * chance(0.6) + [menu()] * chance(0.8)
    before = [pick(*outside)() for _ in range(int(rng.integers(0, 3)))]
    after = [pick(*outside)() for _ in range(int(rng.integers(0, 4)))] + [comments()] * chance(0.3)
    page = "".join(head + before) + core + "".join(after) + (footer() if chance(0.85) else "")
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>{page}</body></html>"


def embedded(page: str, rng: np.random.Generator) -> str:
    """A training page with elements of ``EMBEDDED`` in and between its paragraphs, some of them never closed."""
    word = lambda: "".join("etaoinshrdlu"[c] for c in rng.integers(0, 12, int(rng.integers(2, 8))))
    some = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))

    def inside(main):
        kind = int(rng.integers(9))
        mark = " data-main" if main else ""
        if kind < 3:
            return f"<button>{some(1, 4)}" + ("</button>" if rng.random() < 0.7 else "")
        if kind == 3:
            return "<select>" + "".join(f"<option>{word()}" for _ in range(int(rng.integers(2, 6)))) + ("</select>" if rng.random() < 0.8 else "")
        if kind == 4:
            return f"<svg><g><path/><text>{some(1, 3)}</text></g>" + ("</svg>" if rng.random() < 0.8 else "")
        if kind < 7:
            return f"<math{mark}><mi>{word()}</mi><mo>=</mo><mn>{int(rng.integers(100))}</mn></math>"
        t = ("object", "canvas", "noscript", "audio", "video")[int(rng.integers(5))]
        return f"<{t}{mark}>{some(2, 12)}</{t}>"

    def put(m):
        if rng.random() > 0.15:
            return m.group()
        w = m.group(3).split(" ")
        w.insert(int(rng.integers(len(w) + 1)), inside("data-main" in m.group(2)))
        return m.group(1) + " ".join(w) + m.group(4)

    page = re.sub(r"(<p(?=[ >])([^>]*)>)([^<]*)(</p>|(?=<p))", put, page)
    return re.sub(r"</p>(?=<)", lambda m: "</p>" + (f"<button>{some(1, 3)}</button>" if rng.random() < 0.03 else ""), page)


_trained: dict[tuple, Trees] = {}


def learn(pages: int = 500, seed: int = 11) -> Trees:
    """Trees trained on ``pages`` made pages, and a quarter more with embedded elements; kept for the process."""
    if (pages, seed) not in _trained:
        rng, more = np.random.default_rng(seed), np.random.default_rng(seed + 1)
        made = [Page(training_page(rng)) for _ in range(pages)]
        made += [Page(embedded(training_page(more), more)) for _ in range(pages // 4)]
        y, use = [], []
        for p in made:
            good = list(p.marked)
            for i in range(len(good) - 1, 0, -1):
                good[p.parent[i]] |= good[i]
            y += good
            use += [False, *[good[q] for q in p.parent[1:]]]  # nodes below a kept one
        x = np.array(use)
        _trained[pages, seed] = Trees(features(made)[x], np.array(y, float)[x])
    return _trained[pages, seed]


def extract_texts(texts: list[str | None], trees: Trees, chunk: int = 256) -> list[str]:
    out = []
    for i in range(0, len(texts), chunk):
        pages = [Page(t or "") for t in texts[i:i + chunk]]
        odds, at = trees.log_odds(features(pages)), 0
        for p in pages:
            out.append(decode(p, odds[at:at + len(p.tag)]))
            at += len(p.tag)
    return out


def extract(pages: DataFrame, source: str = "html", trees: Trees | None = None, out: str = "text") -> DataFrame:
    """``pages`` without ``source``, with the main text in ``out`` (empty if none) and its code points in n_chars.

    Null pages are empty. Character references are decoded, white space inside a block is one space, blocks are joined by an empty line.
    A page without block markup is one block. Existing columns named like the new ones are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or learn())
    rest = [c for c in pages.columns if c not in (source, out, "n_chars")]

    def run(b):
        text = extract_texts(b.column(len(rest)).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*rest, out, "n_chars"])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*rest).schema)
    return arrow_map(pages.select(*rest, F.col(source)), run, f"{ddl}`{out}` string, n_chars long")
