"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Every block element (and inline ones with a class or id) is a node with
features of its tag, its attribute tokens and those of its ancestors, the text
and link density of its subtree, its depth and its siblings. Gradient-boosted
trees give the probability that a node belongs to the article; they are fitted
on TRAINING_PAGES pages made by `training_page`, a generator whose article is
known, so the fit has a fixed size and doesn't depend on the pages to extract.
Decoding picks the most probable labelling in which a kept node has a kept
parent: one sum up the tree and one choice down.

Null, empty and markup-only pages give an empty text. Unclosed elements end as
HTML says (a p at the next block, others with their parent); a page cut off in
the middle is read as far as it goes.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 250
TREES = 30
DEPTH = 4
RATE = 0.25
BINS = 24
#: Pages whose nodes are scored at once.
BATCH = 200

_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select".split())
_DROPPED = frozenset("head script style noscript template iframe svg select textarea title button option object canvas".split())
_SCOPE = frozenset("table td th caption button html body object".split())
_SELF_NESTED = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Attribute tokens by what they tell.
_HINTS = [
    "article content post main entry story text body prose",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination tabs toc",
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense",
    "sidebar aside widget related recommended rail trending popular",
    "footer copyright legal colophon bottom",
    "comment comments disqus reply replies responses respond discussion",
    "cookie cookies consent notice alert popup modal overlay gdpr warning",
    "share social follow newsletter subscribe signup login search form",
    "header masthead topbar logo branding",
]
_HINT = {w: k for k, line in enumerate(_HINTS) for w in line.split()}
_TAGS = [{"article", "main"}, {"nav", "menu"}, {"aside"}, {"header"}, {"footer"}, {"form", "fieldset", "input"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"div", "section"}, {"table", "tr", "td", "th"}, {"html", "body"}]
_TAG = {t: k for k, group in enumerate(_TAGS) for t in group}


class Page:
    """Nodes of a page in document order, and its text as (node, text) with None where a block begins or ends."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hints, self.hidden, self.n_tags, self.links = ["html"], [-1], [0], [False], [1], [0]
        self.flow: list[tuple[int, str] | None] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        at, in_link = 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(stack[-1][1], source[at : m.start()], in_link)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if any(t not in _INLINE for t, _ in stack[k:]):
                            self.flow.append(None)
                        in_link = 0 if name == "a" else in_link
                        del stack[k:]
                        break
                continue
            if name == "br":
                self._text(stack[-1][1], " ", in_link)
            if name in ("html", "body") or name in _VOID:
                if name == "hr":
                    self.flow.append(None)
                continue
            if name not in _INLINE:
                self._close_p(stack)
                self._close_peer(stack, name)
                in_link = 0
                self.flow.append(None)
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m[3])} if m[3].strip("/ ") else {}
            node = stack[-1][1]
            self.n_tags[node] += 1
            if name == "a":
                in_link = 1
            if name not in _INLINE or "class" in attrs or "id" in attrs or "hidden" in attrs:
                node = self._node(name, node, attrs)
            if name in _RAW and name != "noscript":
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if not m[3].endswith("/"):
                stack.append((name, node))
        if at < len(source):
            rest = source[at:]
            cut = rest.rfind("<")
            self._text(stack[-1][1], rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:] + "x") else rest[:cut], in_link)

    def _text(self, node: int, raw: str, in_link: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.flow.append((node, text))
        if in_link:
            self.links[node] += len(text)

    def _node(self, name: str, parent: int, attrs: dict) -> int:
        hints = 0
        for a in ("class", "id", "role", "aria-label"):
            for w in re.split(r"[^a-z]+", attrs[a].lower()) if attrs.get(a) else ():
                if w in _HINT:
                    hints |= 1 << _HINT[w]
        self.tag.append(name)
        self.parent.append(parent)
        self.hints.append(hints)
        self.hidden.append(name in _DROPPED or "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", ""))
        self.n_tags.append(1)
        self.links.append(0)
        return len(self.tag) - 1

    @staticmethod
    def _close_p(stack: list) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p":
                del stack[k:]
                return
            if stack[k][0] in _SCOPE:
                return

    @staticmethod
    def _close_peer(stack: list, name: str) -> None:
        if name in _SELF_NESTED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    return
                if stack[k][0] in _SELF_NESTED[name]:
                    return

    def features(self) -> np.ndarray:
        n, n_hints, n_tag = len(self.tag), len(_HINTS), len(_TAGS)
        parent = self.parent
        own, marks = [0] * n, [0] * n
        for x in self.flow:
            if x:
                own[x[0]] += len(x[1])
                marks[x[0]] += sum(map(x[1].count, ".,!?"))
        text, links, tags, punct, depth, kids, index, up, up_tag = own[:], self.links[:], self.n_tags[:], marks, [0] * n, [0] * n, [0] * n, self.hints[:], [0] * n
        for v in range(n):
            k = _TAG.get(self.tag[v], -1)
            up_tag[v] = 1 << k if k >= 0 else 0
            if (p := parent[v]) >= 0:
                depth[v], index[v], kids[p] = depth[p] + 1, kids[p], kids[p] + 1
                up[v] |= up[p]
                up_tag[v] |= up_tag[p]
        for v in range(n - 1, 0, -1):
            p = parent[v]
            text[p] += text[v]
            links[p] += links[v]
            tags[p] += tags[v]
            punct[p] += punct[v]
        out = np.zeros((n, 9 + 2 * n_hints + 2 * n_tag), np.float32)
        par = np.maximum(np.array(parent), 0)
        t = np.array(text, np.float32)
        out[:, 0], out[:, 1], out[:, 2] = depth, np.log1p(t), np.log1p(np.array(own))
        out[:, 3] = np.array(links) / np.maximum(t, 1)
        out[:, 4] = t / np.array(tags)
        out[:, 5], out[:, 6] = index, np.array(kids)[par]
        out[:, 7], out[:, 8] = t / np.maximum(t[par], 1), np.array(punct) / np.maximum(t, 1)
        for base, bits, width in ((9, self.hints, n_hints), (9 + n_hints, up, n_hints), (9 + 2 * n_hints, [1 << _TAG[x] if x in _TAG else 0 for x in self.tag], n_tag), (9 + 2 * n_hints + n_tag, up_tag, n_tag)):
            out[:, base : base + width] = np.array(bits)[:, None] >> np.arange(width) & 1
        return out

    def decode(self, p: np.ndarray) -> list[bool]:
        """The most probable labels in which a kept node has a kept parent; hidden nodes are dropped."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
        for v in range(len(keep) - 1, 0, -1):
            if self.hidden[v]:
                keep[v] = -1e9
            q = self.parent[v]
            keep[q] += max(keep[v], drop[v])
            drop[q] += drop[v]
        out = [keep[0] > drop[0]]
        for v in range(1, len(keep)):
            out.append(out[self.parent[v]] and keep[v] > drop[v])
        return out

    def text(self, kept: list[bool]) -> str:
        blocks, now = [], []
        for x in [*self.flow, None]:
            if x is None:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif kept[x[0]]:
                now.append(x[1])
        return "\n".join(blocks)


class Boosted:
    """Gradient-boosted trees for a binary label, with splits on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree: dict[int, tuple] = {}
            leaf = np.ones(len(y), np.int64)
            for level in range(DEPTH + 1):
                for node in range(1 << level, 2 << level):
                    at = np.flatnonzero(leaf == node)
                    if len(at):
                        tree[node] = self._grow(binned[at], (y - p)[at], (p * (1 - p))[at], level == DEPTH)
                        if len(tree[node]) == 2:
                            leaf[at] = 2 * node + (binned[at, tree[node][0]] > tree[node][1])
            self.trees.append(self._table(tree))
            score += RATE * self._walk(binned, self.trees[-1])

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, last: bool) -> tuple:
        total_g, total_h = g.sum(), h.sum()
        best, split = 1e-3, None
        if not last and len(g) >= 20:
            for f in range(x.shape[1]):
                cg, ch = (np.cumsum(np.bincount(x[:, f], z, BINS)) for z in (g, h))
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = gain[k], (f, k)
        return split or (total_g / (total_h + 1),)

    @staticmethod
    def _table(tree: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, k, v = np.full(2 << DEPTH, -1), np.zeros(2 << DEPTH, np.int64), np.zeros(2 << DEPTH)
        for node, t in tree.items():
            if len(t) == 2:
                f[node], k[node] = t
            else:
                v[node] = t[0]
        return f, k, v

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _walk(binned: np.ndarray, table: tuple) -> np.ndarray:
        f, k, v = table
        node, rows = np.ones(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            inner = f[node] >= 0
            node = np.where(inner, 2 * node + (binned[rows, np.maximum(f[node], 0)] > k[node]), node)
        return v[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return 1 / (1 + np.exp(-self.base - RATE * sum(self._walk(binned, t) for t in self.trees)))


def training_page(rng: np.random.Generator) -> str:
    """A page whose article's texts begin with the mark \x01 and all other texts don't."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick("ka", "lo", "mi", "ter", "an", "ou", "se", "ri", "den", "st") for _ in range(int(rng.integers(1, 5))))
    say = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))) + pick(".", ".", "?", "")
    maybe = lambda p, s: s if rng.random() < p else ""
    links = lambda n: "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(n))
    few = lambda a, b: int(rng.integers(a, b))
    junk = lambda: pick(
        f'<div class="{pick("ad", "ads", "advert", "sponsored banner", "promo")}">{say(3, 40)}</div>', f'<div class="{pick("share", "social-links", "newsletter")}"><p>{say(2, 15)}</p></div>',
        f'<aside class="{pick("related", "sidebar", "")}"><h3>{say(1, 4)}</h3><ul>{links(few(2, 6))}</ul></aside>', f"<form><p>{say(3, 12)}</p><input type=text><button>{say(1, 2)}</button></form>", f'<nav><ol>{links(few(2, 5))}</ol></nav>',
    )
    # paragraphs may be as short as a word, stay open, and begin with an unclosed bold
    para = lambda: pick(f"<p>\x01{say(8, 90)}</p>", f"<p>\x01{say(1, 8)}</p>", f"<p><b>\x01{say(3, 40)}<br>", f"<p>\x01{say(8, 60)}<a href=x>\x01{say(1, 3)}</a></p>", f"<p>\x01{say(5, 60)}")
    body = []
    for _ in range(few(1, 16)):
        body.append(para())
        if rng.random() < 0.12:
            body.append(pick(f"<ul><li>\x01{say(3, 20)}</li><li>\x01{say(3, 20)}</li></ul>", f"<h2>\x01{say(2, 7)}</h2>", f"<blockquote>\x01{say(8, 30)}</blockquote>", f"<table><tr><td>\x01{say(1, 5)}</td><td>\x01{say(1, 5)}</td></tr></table>", junk()))
    inner = maybe(0.8, f"<h1>\x01{say(3, 12)}</h1>") + "".join(body)
    article = pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="{pick("content", "post-body", "entry-content", "story", "article-text")}">{inner}</div>', f'<div id="main"><div class="{pick("c1", "inner", "wrap")}">{inner}</div></div>')
    comments = maybe(0.35, f'<{(t := pick("div", "section"))} class="{pick("comments", "comment-list", "replies")}">' + "".join(f'<div class="{pick("comment", "reply")}"><p>{say(4, 50)}</p></div>' for _ in range(few(1, 6))) + f"</{t}>")
    if rng.random() < 0.3:
        article = article[: article.rfind("</")] + comments + article[article.rfind("</") :]
        comments = ""
    top = maybe(0.3, f'<div class="{pick("cookie-notice", "consent", "alert")}"><p>{say(5, 30)}</p></div>') + maybe(0.4, f'<header><div class="logo">{say(1, 3)}</div><p>{say(2, 9)}</p></header>') + maybe(0.8, pick(f"<nav><ul>{links(few(3, 9))}</ul></nav>", f'<div class="menu"><ul>{links(few(3, 9))}</ul></div>')) + maybe(0.5, junk())
    side = maybe(0.35, pick(f"<aside><p>{say(5, 40)}</p><ul>{links(few(2, 7))}</ul></aside>", f'<div class="sidebar"><h3>{say(1, 4)}</h3><p>{say(5, 40)}</p></div>'))
    end = maybe(0.3, junk()) + maybe(0.85, pick(f"<footer>{say(3, 20)}</footer>", f"<footer><p>{say(3, 20)}</p><ul>{links(few(1, 5))}</ul></footer>", f'<div class="footer">{say(3, 20)}</div>'))
    middle = pick(side + article, article + side) + comments
    if rng.random() < 0.3:
        middle = f'<div class="{pick("wrapper", "container", "row")}">{middle}</div>'
    return f"<html><head><title>{say(2, 8)}</title></head><body>{top}{middle}{end}</body></html>"


@functools.cache
def model(pages: int = TRAINING_PAGES, seed: int = 7) -> Boosted:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        label = [False] * len(page.tag)
        for x in page.flow:
            if x and "\x01" in x[1]:
                v = x[0]
                while v >= 0 and not label[v]:
                    label[v], v = True, page.parent[v]
        page.flow = [x and (x[0], x[1].replace("\x01", "")) for x in page.flow]
        xs.append(page.features())
        ys.append(np.array(label, float))
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_texts(sources: list[str | None], fitted: Boosted) -> list[str]:
    out = []
    for a in range(0, len(sources), BATCH):
        pages = [Page(s or "") for s in sources[a : a + BATCH]]
        x = [p.features() for p in pages]
        prob = np.split(fitted.predict(np.concatenate(x)), np.cumsum([len(m) for m in x])[:-1])
        out += [p.text(p.decode(q)) for p, q in zip(pages, prob)]
    return out


def _extract(fitted: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some = batch.slice(a, BATCH)
                texts = main_texts(some.column("html").to_pylist(), fitted)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(model()), "page_id long, url string, text string, n_chars long")
