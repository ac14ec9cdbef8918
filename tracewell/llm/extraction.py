"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements.  Every node gets features of its
own and of its place: tag, words in its attributes and in those of its
ancestors, depth, text and link density of its subtree, share of the page's and
its parent's text, statistics of its siblings.  Boosted trees give each node the
log-odds that it belongs to the article.  The decoder then finds the best
consistent choice by dynamic programming: a dropped node drops all that is
below it, a kept one has only kept ancestors.

There are no labelled pages.  The trees are trained on layouts that are laid out
from the paragraphs of a bounded sample of pages: the article and the menus,
headers, notices, adverts, forms, side columns, comments and footers around it
are known there, and are written in many ways.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices
from tracewell.llm.trees import Boosted

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# fixed values of HTML
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("iframe script style svg template textarea title".split())
CODE = frozenset({"script", "style"})
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
        frozenset({"p"}),
    ),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "tbody": frozenset({"tr", "td", "th", "p", "thead", "tbody"}), "tfoot": frozenset({"tr", "td", "th", "p", "thead", "tbody"}),
}
FENCES = frozenset({"ul", "ol", "dl", "table", "select", "menu"})
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|data-y|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# groups of attribute words and of tags
WORDS = {
    "content": "content article main post entry story body text maincontent articlebody page copy prose",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs tab links skip",
    "head": "header head masthead banner logo topbar branding hero",
    "foot": "footer foot colophon bottom copyright legal",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more column complementary",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay message warning paywall subscribe newsletter signup toast",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner dfp adsense outbrain taboola partner",
    "form": "form search login contact poll survey input register",
    "comment": "comment comments reply replies discussion disqus respond thread feedback reader readers guestbook",
    "share": "share sharing social follow tweet facebook tools print byline tags meta",
    "hidden": "hidden none invisible offscreen",
}
GROUPS = {
    "content": "article main", "menu": "nav menu", "head": "header", "foot": "footer", "side": "aside", "form": "form fieldset select button label option legend",
    "list": "ul ol li dl dt dd", "heading": "h1 h2 h3 h4 h5 h6", "paragraph": "p blockquote pre", "table": "table tbody thead tr td th caption", "box": "div section",
    "figure": "figure figcaption", "dialog": "dialog details summary address",
}
OF_WORD: dict[str, int] = {}
for _i, _v in enumerate(WORDS.values()):
    for _w in _v.split():
        OF_WORD[_w] = OF_WORD.get(_w, 0) | 1 << _i
OF_TAG = {t: i for i, v in enumerate(GROUPS.values()) for t in v.split()}
FEATURES = 3 * len(WORDS) + 2 * len(GROUPS) - len(WORDS) + 16


class Page:
    """Block elements in page order (parents before children) and the runs of text that lie directly in them."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs, self.mark = ["#page"], [-1], [0], [""]
        self.runs: list[tuple[int, str, int]] = []  # node, text, letters inside links
        stack, names, piece, links, in_link, at, end = [0], ["#page"], [], 0, False, 0, len(source)
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal links
            if piece:
                text = " ".join(entities.unescape("".join(piece)).split()) if "&" in (joined := "".join(piece)) else " ".join(joined.split())
                if text:
                    self.runs.append((stack[-1], text, min(links, len(text))))
                piece.clear()
            links = 0

        while at < end:
            m = TOKEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                piece.append(text)
                links += len(text) if in_link else 0
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if name in SKIPPED:
                if not m[1] and not m[3].endswith("/") and name not in unclosed:
                    # its text isn't part of the page; without an end tag only the tag is skipped, but code runs to the end of the page
                    if stop := re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at):
                        at = stop.end()
                    elif name in CODE:
                        at = end
                    else:
                        unclosed.add(name)
            elif name == "br":
                piece.append(" ")
            elif name == "a":
                in_link = not m[1]
            elif name in BLOCKS:
                flush()
                in_link = False
                if m[1]:
                    if name in names:
                        k = len(names) - 1 - names[::-1].index(name)
                        if k:
                            del names[k:], stack[k:]
                    continue
                shut = CLOSES.get(name, frozenset())
                while len(names) > 1 and shut:
                    if names[-1] in shut:
                        names.pop(), stack.pop()
                    elif names[-1] in FENCES or not any(x in shut for x in names[1:]):
                        break
                    else:  # a paragraph or item stays open only across its own blocks
                        k = max(i for i, x in enumerate(names) if x in shut)
                        if any(x in FENCES or x not in ("p", *shut) for x in names[k + 1 :]):
                            break
                        del names[k:], stack[k:]
                if name in ("html", "body") and name in names:
                    continue
                bits, mark = self._words(m[3])
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.attrs.append(bits)
                self.mark.append(mark)
                if name not in VOID and not m[3].endswith("/"):
                    stack.append(len(self.tag) - 1)
                    names.append(name)
        flush()

    @staticmethod
    def _words(attributes: str) -> tuple[int, str]:
        bits, mark = 0, ""
        if attributes and ("=" in attributes or "hidden" in attributes):
            for m in ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-y":
                    mark = value
                elif m[1].lower() == "hidden":
                    bits |= OF_WORD["hidden"]
                else:
                    for w in PIECE.findall(value):
                        bits |= OF_WORD.get(w.lower(), 0)
        return bits, mark

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, links, ends, runs = (np.zeros(n) for _ in range(4))
        for node, text, linked in self.runs:
            own[node] += len(text)
            links[node] += linked
            ends[node] += text.count(". ") + text.endswith((".", "!", "?", "…", "”"))
            runs[node] += 1
        text, link, stops, parts, size = own.copy(), links.copy(), ends.copy(), runs.copy(), np.ones(n)
        depth, attrs, above, tags = np.zeros(n), np.array(self.attrs), np.zeros(n, np.int64), np.array([OF_TAG.get(t, -1) for t in self.tag])
        over = np.zeros(n, np.int64)
        order, alike = np.zeros(n), np.zeros(n)
        count: dict[tuple[int, int], int] = {}
        kids = np.zeros(n)
        for v in range(1, n):
            p = parent[v]
            depth[v] = depth[p] + 1
            above[v] = above[p] | attrs[p]
            over[v] = over[p] | (1 << int(tags[p]) if tags[p] >= 0 else 0)
            order[v] = kids[p]
            kids[p] += 1
            count[p, tags[v]] = count.get((p, tags[v]), 0) + 1
        for v in range(n - 1, 0, -1):
            p = parent[v]
            for a in (text, link, stops, parts, size):
                a[p] += a[v]
            alike[v] = count[p, tags[v]]
        up = np.maximum(parent, 0)
        whole, before = max(1.0, text[0]), np.concatenate([[0], np.cumsum(own)])[:-1]
        bit = lambda x, k: (x[:, None] >> np.arange(k)) & 1
        plain = np.stack([
            depth, np.log1p(own), np.log1p(text), link / np.maximum(1, text), text / size, stops / np.maximum(1, text / 100), np.log1p(size), text / whole,
            text / np.maximum(1, text[up]), order, np.maximum(0, kids[up] - 1), alike / np.maximum(1, kids[up]), before / whole, text / np.maximum(1, parts),
            link[up] / np.maximum(1, text[up]), np.log1p(text[up]),
        ], 1)
        return np.concatenate([bit(attrs, len(WORDS)), bit(above, len(WORDS)), bit(np.where(tags >= 0, 1 << np.maximum(tags, 0), 0), len(GROUPS)), bit(over, len(GROUPS)), plain], 1)

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The consistent choice with the highest sum of log-odds, each weighed by the text directly in the node."""
        n = len(self.tag)
        own = np.zeros(n)
        for node, text, _ in self.runs:
            own[node] += len(text)
        gain = np.clip(odds, -6, 6) * (own + 0.1)
        keep, drop = gain.copy(), -gain
        for v in range(n - 1, 0, -1):  # children come after parents
            p = self.parent[v]
            keep[p] += max(keep[v], drop[v])
            drop[p] += drop[v]
        chosen = np.zeros(n, bool)
        chosen[0] = keep[0] >= drop[0]
        for v in range(1, n):
            chosen[v] = chosen[self.parent[v]] and keep[v] > drop[v]
        return chosen

    def truth(self) -> np.ndarray:
        """Labels of a training layout: inherited marks; what stands above the article counts as kept."""
        n = len(self.tag)
        y = np.full(n, -1)
        for v in range(1, n):
            y[v] = int(self.mark[v]) if self.mark[v] else y[self.parent[v]]
        for v in range(n - 1, 0, -1):
            if y[v] == 1 and y[self.parent[v]] == -1:
                y[self.parent[v]] = 1
        return np.maximum(y, 0)


def layout(r: np.random.Generator, texts: list[str]) -> str:
    """A page laid out at random around ``texts``; data-y marks what is article (1) and what isn't (0)."""
    pick = lambda *xs: xs[r.integers(len(xs))]
    some = lambda: texts[r.integers(len(texts))]
    esc = entities.escape

    def short(k: int = 6) -> str:
        return " ".join(some().split()[: int(r.integers(1, k + 1))])

    def classed(*names: str) -> str:
        name = pick(*names)
        return pick(f' class="{name}"', f' id="{name}"', f' class="{pick("block", "c1", "row", "x")} {name}"', f' class="{name}-{pick("wrap", "box", "inner", "list")}"')

    def box(tag: str, inner: str, *names: str, y: str = ' data-y="0"') -> str:
        t = pick(tag, "div", "div", "section") if tag != "div" else "div"
        # a plain box must say what it is, an element of its own kind needn't
        return f"<{t}{classed(*names) if t in ('div', 'section') or r.random() < 0.5 else ''}{y}>{inner}</{t}>"

    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{esc(short(3))}</a></li>' for i in range(k)) + "</ul>"
    lines = lambda lo, hi: "".join(f"<p>{esc(some())}</p>" for _ in range(int(r.integers(lo, hi))))
    nav = lambda: box("nav", links(int(r.integers(3, 12))), "nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination")
    head = lambda: box("header", f"{pick('<h1>', '<div>', '<p>')}{esc(short())}" + pick("", nav()), "header", "masthead", "site-header", "top-banner")
    foot = lambda: box("footer", pick("", f"<p>&copy; {esc(short())}</p>", links(4)) + esc(some()), "footer", "site-footer", "colophon")
    side = lambda: box("aside", pick(f"<h3>{esc(short())}</h3>", "") + pick(links(6), lines(1, 4), esc(some())), "sidebar", "widget", "related", "trending", "right-rail")
    ad = lambda: box("div", pick(esc(some()), f"<p>{esc(some())}</p>", f'<a href="x">{esc(some())}</a>'), "ad", "ads", "advert", "advertisement", "sponsored", "promo")
    note = lambda: box(pick("div", "dialog"), pick(esc(some()), f"<p>{esc(some())}</p>") + pick("", "<button>OK</button>"), "cookie-notice", "notice", "alert", "consent-banner", "newsletter", "popup")
    form = lambda: f'<form{pick("", classed("search", "login", "contact"))} data-y="0"><label>{esc(short())}</label><input><p>{esc(short())}</p><button>{esc(short(2))}</button></form>'
    share = lambda: box("div", links(3), "share", "social", "tags")
    talk = lambda: box("section", pick("<h3>Comments</h3>", "") + pick(lines(1, 6), "".join(f"<div{classed('comment', 'reply')}><b>{esc(short(2))}</b><p>{esc(some())}</p></div>" for _ in range(int(r.integers(1, 5)))), f"<ol><li>{esc(some())}</li><li><p>{esc(some())}</p></li></ol>"), "comments", "comment-list", "discussion", "reader-comments", "replies")

    def body() -> str:
        kinds = ["<p>%s</p>"] * 8 + ["<p><b>%s<br>", "<p>%s", "<h2>%s</h2>", "<blockquote>%s</blockquote>", "<ul><li>%s</li><li>%s</li></ul>", "<pre>%s</pre>", "<div>%s</div>", "<table><tr><td>%s</td><td>%s</td></tr></table>", "<figure><img><figcaption>%s</figcaption></figure>"]
        out = ""
        for _ in range(int(r.integers(1, 12))):
            form_ = pick(*kinds)
            out += form_.replace("%s", esc(short(8)) if form_[:3] in ("<h2", "<fi") else esc(some()), 1).replace("%s", esc(some()))
            if r.random() < 0.06:
                out += pick(ad, share, note, side, form)()
        return out

    title = f"<h1>{esc(short(10))}</h1>"
    inner = pick(title, f"<header>{title}</header>", "", title) + body()
    if r.random() < 0.3:
        inner = f"<div{classed('content', 'entry-content', 'post-body', 'text')}>{inner}</div>"
    kind = pick("article", "article", "main", "div", "section")
    name = classed("content", "article", "post", "story", "main-content", "entry") if kind in ("div", "section") else pick("", classed("content", "post"))
    article = f'<{kind}{name} data-y="1">{inner}{pick("", "", share(), talk())}</{kind}>'
    parts = [x() for x, p in ((head, 0.6), (nav, 0.7), (note, 0.4), (ad, 0.5)) if r.random() < p] + [article]
    tail = [x() for x, p in ((side, 0.5), (talk, 0.4), (form, 0.3), (ad, 0.2), (foot, 0.8)) if r.random() < p]
    if r.random() < 0.2:
        parts = [side(), *parts]
    page = "".join(parts + tail)
    if r.random() < 0.3:
        page = f"<div{classed('wrapper', 'container', 'page', 'site')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{esc(short())}</title></head><body>{page}</body></html>"


FILLER = "Every report names the place where it was written. The second part follows later, with tables and notes. Nobody had asked for more than that."


def train(texts: list[str], pages: int = 500, seed: int = 5) -> Boosted:
    """Boosted trees from ``pages`` random layouts filled with ``texts``."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or FILLER.split(". ")
    made = [Page(layout(r, texts)) for _ in range(pages)]
    x, y = np.concatenate([p.features() for p in made]), np.concatenate([p.truth() for p in made])
    return Boosted().fit(x, y)


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = 200, each: int = 20) -> Boosted:
    """Train on layouts filled with the texts of a bounded sample: ``each`` runs of ``sample`` pages, chosen by hash."""
    source = pages.select(F.coalesce(F.col(html), F.lit("")).alias("html"), F.xxhash64(F.col(page_id), F.lit(3)).alias("h"), F.col(page_id).alias("id"))
    chosen = source.select("h", "id", "html").orderBy("h", "id").limit(sample)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            runs = [[t for _, t, _ in Page(x).runs][:: max(1, len(x) // 20_000)][:each] for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(runs, pa.list_(pa.string()))], ["h", "runs"])

    rows = chosen.mapInArrow(kernel, "h long, runs array<string>").collect()
    return train(sorted({t for r in rows for t in r["runs"]}))


def main_text(sources: list[str], model: Boosted) -> list[str]:
    """The main text of each page: kept blocks in page order, joined by one space."""
    pages = [Page(x) for x in sources]
    odds = model.decide(np.concatenate([p.features() for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        chosen = p.kept(odds[at : at + len(p.tag)])
        at += len(p.tag)
        out.append(" ".join(t for node, t, _ in p.runs if chosen[node]))
    return out


def extract(pages: DataFrame, model: Boosted, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row for every row of ``pages``.

    A null or empty page, or one without an article, has the empty text.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 21):
            texts = main_text(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return source.mapInArrow(kernel, f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long")
