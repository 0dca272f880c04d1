"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks, runs of text that no block element interrupts, in page order. Each
block is described by features of its ancestors (tags, words of their classes and ids) and of its text.
A linear-chain conditional random field with the labels boilerplate and main is trained, in numpy, on
labelled pages that `labelled_pages` writes by rule in many layouts (a bounded, documented number), and
decoded by Viterbi. What scripts, styles and the head hold is not text and gives no blocks.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, on_workers

# Fixed values of HTML: elements that break lines, are empty, hold no text, or end when one like them begins.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSE_P = BLOCK - {"button", "label", "option", "select", "legend", "summary", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset("article aside body div footer header main nav section table td th ul ol form blockquote".split())

#: A tag ends before the next "<" outside quotes, and nothing is tried twice, so that no page takes more than linear time.
TOKEN = re.compile(r"<!--(?:.*?-->|.*+)|<[!?][^<>]*+>|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: Labelled pages that the field is trained on.
PAGES = 600


class Block:
    """A leaf block: its text, how much of it is linked, the nearest block element, and all elements and class words around it."""

    __slots__ = ("text", "linked", "own", "inside", "words")

    def __init__(self, text: str, linked: int, own: str, inside: frozenset[str], words: frozenset[str]):
        self.text, self.linked, self.own, self.inside, self.words = text, linked, own, inside, words


_NOWHERE = ("", "none", frozenset(), frozenset())


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, references decoded, white space made single; tags may be left open or closed twice.

    Of class words only those in known are kept, if that is given. An open element holds what is around
    it, so that depth costs nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, frozenset[str], frozenset[str]]] = []
    open_: dict[str, int] = {}
    text: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = SPACE.sub(" ", "".join(text)).strip()
            if t:
                out.append(Block(t, min(linked, len(t)), *(stack[-1] if stack else _NOWHERE)[1:]))
            text.clear()
            linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        t = html.unescape(raw) if "&" in raw else raw
        text.append(t)
        if open_.get("a"):
            linked += len(t)

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x[0]] -= 1
        del stack[k:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            if m[0] == "<":
                put("<")
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            if open_.get(name):
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if name in BLOCK or not any(x[0] in SCOPE for x in stack[k:]):
                    close(k)
            elif name == "p":
                flush()
            continue
        alone = m[3].rstrip().endswith("/")
        if name in RAW:
            if name in BLOCK:
                flush()
            end = None if alone else re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else at if alone else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            for ends in ((ENDS.get(name) or ()), (("p",) if name in CLOSE_P else ())):
                if not any(open_.get(x) for x in ends):
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in SCOPE and stack[i][0] not in ("td", "th") or stack[i][0] in ("ul", "ol", "table"):
                        break
        if name in EMPTY or alone and name not in BLOCK:
            continue
        _, own, inside, words = stack[-1] if stack else _NOWHERE
        more = frozenset(w.lower() for x in NAMES.finditer(m[3]) for w in PART.findall(x[1] or x[2] or x[3] or "")) if "=" in m[3] else frozenset()
        more = (more if known is None else more & known) - words
        if name in BLOCK:
            own, inside = name, inside if name in inside else inside | {name}
        stack.append((name, own, inside, words | more if more else words))
        open_[name] = open_.get(name, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    n, out = len(found), []
    for i, b in enumerate(found):
        size, words = len(b.text), b.text.count(" ") + 1
        f = ["bias", f"tag {b.own}", f"words {min(6, words.bit_length())}", f"linked {min(3, 4 * b.linked // max(1, size))}", f"end {b.text[-1] in '.!?…:'}", f"at {'first' if i < 0.1 * n else 'last' if i >= 0.9 * n else 'inner'}", f"commas {min(2, b.text.count(','))}"]
        f += [f"in {t}" for t in b.inside]
        f += [f"word {w}" for w in b.words]
        if not b.inside & {"nav", "aside", "footer", "header", "form", "menu", "button"}:
            f.append("in no frame")
        if "©" in b.text or "(c)" in b.text[:4].lower():
            f.append("copyright")
        out.append(f)
    return out


class Field:
    """weights[feature]: for (boilerplate, main); move[a, b]: from label a to label b."""

    def __init__(self, names: list[str]):
        self.at = {x: i for i, x in enumerate(names)}
        self.words = frozenset(x.removeprefix("word ") for x in names if x.startswith("word "))
        self.weights, self.move = np.zeros((len(names), 2)), np.zeros((2, 2))

    def index(self, f: list[list[str]]) -> list[list[int]]:
        get = self.at.get
        return [[i for x in b if (i := get(x)) is not None] for b in f]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 2) -> None:
        """Gradient of the log likelihood by forward-backward, one page at a time, with AdaGrad."""
        seen, moved, r = np.full(self.weights.shape, 1e-2), np.full((2, 2), 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for k in r.permutation(len(pages)):
                f, y = pages[k]
                n = len(f)
                if not n:
                    continue
                e = np.array([self.weights[i].sum(0) for i in f])
                a, b = np.zeros((n, 2)), np.zeros((n, 2))
                a[0] = e[0]
                for t in range(1, n):
                    a[t] = e[t] + np.logaddexp(a[t - 1, 0] + self.move[0], a[t - 1, 1] + self.move[1])
                for t in range(n - 2, -1, -1):
                    x = self.move + e[t + 1] + b[t + 1]
                    b[t] = np.logaddexp(x[:, 0], x[:, 1])
                z = np.logaddexp(*a[-1])
                d = -np.exp(a + b - z)
                d[np.arange(n), y] += 1
                m = np.zeros((2, 2))
                for t in range(1, n):
                    m -= np.exp(a[t - 1][:, None] + self.move + e[t] + b[t] - z)
                    m[y[t - 1], y[t]] += 1
                g = np.zeros_like(self.weights)
                for t in range(n):
                    g[f[t]] += d[t]
                rows = np.unique(np.concatenate([np.array(x) for x in f]))
                step = g[rows] - decay * self.weights[rows]
                seen[rows] += step**2
                self.weights[rows] += rate * step / np.sqrt(seen[rows])
                moved += m**2
                self.move += rate * m / np.sqrt(moved)

    def decode(self, f: list[list[int]]) -> list[int]:
        """Viterbi: the likeliest labels as a whole."""
        if not f:
            return []
        w, ((m00, m01), (m10, m11)), back = self.table, self.move.tolist(), []
        s0 = s1 = None
        for x in f:
            e0, e1 = sum([w[i][0] for i in x]), sum([w[i][1] for i in x])
            if s0 is None:
                s0, s1 = e0, e1
                continue
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
        y = [int(s1 > s0)]
        for b in reversed(back):
            y.append(b[y[-1]])
        return y[::-1]

    @property
    def table(self) -> list[list[float]]:
        if getattr(self, "_table", None) is None:
            self._table = self.weights.tolist()
        return self._table


def labelled_pages(n: int, seed: int = 4) -> list[tuple[str, set[str]]]:
    """n (html, texts of the main blocks) by rule: layouts with and without semantic elements, and what surrounds articles."""
    r = random.Random(seed)
    syllables = "ba ko mi lu ten dar vos pri sel gon fa ni ro tal ur eb ösk ña ct ly".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    count = [0]

    def say(a: int, b: int, stop: str = ".") -> str:
        count[0] += 1
        return " ".join([word().capitalize(), *(word() + r.choice(("", "", "", ",")) for _ in range(r.randint(a, b))), f"{word()}{count[0]}"]) + stop

    out = []
    for _ in range(n):
        main: set[str] = set()

        def keep(t: str, main: set[str] = main) -> str:
            main.add(t)
            return t

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{word()}">{say(0, 2, "")}</a></li>' for _ in range(k))

        def framed(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, str]:
            tag, name = r.choice(tags), r.choice(names)
            if tag in ("nav", "aside", "footer", "header", "form") and r.random() < 0.5:
                return f"<{tag}>", f"</{tag}>"
            return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">', f"</{tag}>"

        def frame(kind: str) -> str:
            if kind == "menu":
                a, b = framed(("nav", "div", "ul", "header"), ("menu", "nav", "navbar", "main-menu", "topnav", "breadcrumbs", "navigation", "site-nav"))
                return f"{a}<ul>{links(r.randint(2, 7))}</ul>{b}"
            if kind == "header":
                a, b = framed(("header", "div"), ("header", "site-header", "masthead", "top-bar", "branding"))
                return f"{a}<div>{say(1, 4, '')}</div>{r.choice(('', f'<p>{say(2, 8)}</p>'))}{b}"
            if kind == "footer":
                a, b = framed(("footer", "footer", "div"), ("footer", "site-footer", "copyright", "legal", "bottom"))
                mark = r.choice(("&copy; ", "(c) ", "Copyright ", "&#169; 20", "", "<p>"))
                return f"{a}{mark}{word()}{r.choice(('', ' &middot; ', ' | ', ', ', ' - '))}{say(2, 12)}{r.choice(('', f'<p>{say(3, 15)}</p>', f'<ul>{links(3)}</ul>'))}{b}"
            if kind == "sidebar":
                a, b = framed(("aside", "aside", "div", "section"), ("sidebar", "widget", "related", "recommended", "more-stories", "popular", "side-column", "trending"))
                return f"{a}<h{r.choice('234')}>{say(0, 3, '')}</h3>{r.choice((f'<p>{say(5, 40)}</p>', f'<ul>{links(4)}</ul>', f'<div>{say(3, 20)}</div>'))}{b}"
            if kind == "advert":
                a, b = framed(("div", "div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adbox"))
                return f"{a}{r.choice(('', '<p>'))}{say(3, 30)}{b}"
            if kind == "notice":
                a, b = framed(("div", "div", "section", "aside"), ("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "paywall"))
                return f"{a}<p>{say(5, 30)}</p>{r.choice(('', f'<button>{say(0, 1, '')}</button>'))}{b}"
            if kind == "form":
                return f'<form action="/{word()}"><label>{say(0, 3, "")}</label><input name="q"><select><option>{say(0, 1, "")}<option>{say(0, 1, "")}</select>{r.choice(("", f"<p>{say(3, 15)}</p>"))}<button>{say(0, 1, "")}</button></form>'
            if kind == "share":
                a, b = framed(("div", "ul", "section"), ("share", "social", "share-buttons", "tags", "pagination", "author-bio", "meta"))
                return f"{a}{links(3)}{b}"
            a, b = framed(("section", "div", "div", "ol"), ("comments", "comment-list", "discussion", "responses", "disqus", "replies", "user-comments"))
            one = lambda: r.choice((f'<article class="comment"><p>{say(3, 30)}</p></article>', f'<div class="comment"><span>{word()}</span><p>{say(3, 30)}</p><p>{say(3, 30)}</p></div>', f'<li class="comment"><p>{say(3, 40)}</p></li>', f"<p>{say(3, 30)}</p>"))
            return f"{a}{r.choice(('', f'<h3>{say(0, 2, '')}</h3>'))}{''.join(one() for _ in range(r.randint(1, 4)))}{b}"

        def part() -> str:
            kind = r.random()
            if kind < 0.62:
                end = r.choice(("</p>", "</p>", "</p>", ""))
                first = r.random()
                t = keep(say(0, r.choice((1, 6, 30, 90)), r.choice((".", ".", ".", "", "!"))))
                if first < 0.85:
                    # inline elements, some of which are never closed
                    tag = r.choice(("", "", "b", "i", "em", "strong", "span", "a href=/x", "small", "font"))
                    t = f"<{tag}>{t}" + r.choice((f"</{tag.split()[0]}>", "")) if tag and not (tag[0] == "a" and not end) else t
                    return f"<p>{t}{r.choice(('', '', '<br>', '<br/>'))}{end}"
                return f'<p class="{r.choice(("text", "lead", "intro", "para"))}">{t}{end}'
            if kind < 0.72:
                return f"<h{(k := r.choice('234'))}>{keep(say(0, 8, ''))}</h{k}>"
            if kind < 0.8:
                return "<ul>" + "".join(f"<li>{keep(say(1, 15))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
            if kind < 0.86:
                return f"<blockquote><p>{keep(say(4, 30))}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{keep(say(4, 30))}</blockquote>"
            if kind < 0.9:
                return f"<table><tr><td>{keep(say(0, 3, ''))}</td><td>{keep(say(0, 3, ''))}</td></tr></table>"
            if kind < 0.93:
                return f"<pre>{keep(say(2, 12))}</pre>"
            if kind < 0.97:
                return f"<div>{keep(say(8, 60))}</div>"
            return f"<figure><img src=x><figcaption>{keep(say(2, 12))}</figcaption></figure>"

        kinds = ["menu", "header", "sidebar", "advert", "notice", "form", "share"]
        before, after = r.sample(kinds, r.randint(1, 4)), r.sample(["sidebar", "advert", "notice", "form", "comments", "comments", "share"], r.randint(0, 4))
        title = f"<h1>{keep(say(1, 10, r.choice(('', '.'))))}</h1>" if r.random() < 0.8 else ""
        body = [part() for _ in range(r.randint(1, 14))]
        if r.random() < 0.35:  # something foreign within the article
            body.insert(r.randint(0, len(body)), frame(r.choice(("advert", "sidebar", "notice", "share", "form"))))
        a, b = r.choice((("<article>", "</article>"),) * 5 + (("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<div class="post-content">', "</div>"), ('<section class="entry-content">', "</section>"), ('<div class="story">', "</div>"), ('<div id="main"><div class="text">', "</div></div>"), ("<div>", "</div>"), ("", "")))
        inner = title + "".join(body)
        if "comments" in after and r.random() < 0.3 and b:
            after.remove("comments")
            inner += frame("comments")
        wrap = r.choice(("", "", '<div class="wrapper">', '<div id="page"><div class="container">'))
        style = r.choice(("", f"<style>.{word()}{{color:#{r.randint(100, 999)}}}</style>", f'<script>var {word()}="</div>";</script>'))
        page = f"<!DOCTYPE html><html><head><title>{word()}</title>{style}</head><body>{wrap}{''.join(map(frame, before))}<!-- {word()} -->{a}{inner}{b}{''.join(map(frame, after))}{frame('footer') if r.random() < 0.85 else ''}"
        out.append((page + r.choice(("", "</body></html>")), main))
    return out


@lru_cache(maxsize=1)
def trained_field() -> Field:
    pages = [(b := blocks(p), [int(x.text in main) for x in b]) for p, main in labelled_pages(PAGES)]
    described = [features(b) for b, _ in pages]
    count: dict[str, int] = {}
    for f in described:
        for x in {x for b in f for x in b}:
            count[x] = count.get(x, 0) + 1
    field = Field(sorted(x for x, n in count.items() if n >= 3))
    field.fit([(field.index(f), y) for f, (_, y) in zip(described, pages, strict=True)])
    return field


def main_text(page: str, field: Field) -> str:
    found = blocks(page, field.words)
    return "\n".join([b.text for b, y in zip(found, field.decode(field.index(features(found))), strict=True) if y])


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text (main blocks joined by newlines, empty if none) and n_chars; one row per row of df, where it is read.

    Null and empty pages have an empty text; texts without any tag are one block. Repeated rows and null
    ids give a row each. Of df's columns only the three named ones are read.
    """
    field = trained_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py() or "", field) for t in b.column(2)]
            yield batch(OUT, b.column(0), b.column(1), texts, [len(t) for t in texts])

    on_workers(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
