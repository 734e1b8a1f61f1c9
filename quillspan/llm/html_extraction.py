"""Operator 8, HTML extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is parsed into its block-level elements. Each is described by what its subtree holds (text,
links, tags, punctuation, paragraphs, density), its attribute tokens and those above it, its depth and
its siblings. Two boosted models say how likely an element is main text as a whole and how likely it is
clutter as a whole; else it is mixed. Decoding finds the most likely labelling in which nothing
below main text is mixed and everything below clutter is clutter, so that ancestors and descendants
do not contradict each other. Text of main and mixed elements that is not in clutter is kept, block by block.

The models are fitted once a process, on pages that `made_page` writes with known labels: `PAGES` of
them, from a fixed seed.

Defined results: null and empty pages give the empty text; tags that are never closed end with their
parent, those whose content is no text at the next block too, the head at what only the body may hold, scripts,
styles and comments with the page; what never opens is ignored; a tag without an end is text; a page without any
element is one block; scripts, styles, templates and the head never count. Parsing takes time linear in the page.
Repeated rows are extracted alike. Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import only

PAGES, SEED = 700, 11
TREES, LEVELS, RATE, BINS = 40, 4, 0.25, 32

#: Kinds of tags; an element of a kind opens a block. Tags of no kind are inline.
KINDS = {"html body": 1, "main article": 2, "section": 3, "div center td th tr tbody thead table caption": 4, "p": 5, "h1 h2 h3 h4 h5 h6": 6, "ul ol dl menu": 7, "li dt dd": 8, "nav": 9, "aside": 10, "footer": 11, "header hgroup": 12, "form fieldset button select option textarea label dialog": 13, "blockquote pre": 14, "figure figcaption details summary address hr": 15}
KIND = {tag: k for tags, k in KINDS.items() for tag in tags.split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, and those of them that hold no tags.
RAW = set("head template noscript svg title iframe textarea select object video audio canvas".split())
PLAIN = {"title", "iframe", "textarea", "noscript"}
#: What the head may hold.
HEAD = set("base link meta title style script noscript template head html".split())
#: What a start tag ends, if it is open in the same list, table or block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = ("ul", "ol", "dl", "table", "body", "article", "section", "div", "aside", "nav", "main")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
CLOSE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in PLAIN | {"script", "style"}}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
#: Attribute tokens that speak for the main text and for kinds of clutter.
FOR = set("article articlebody content main post entry story text body maincontent prose hentry blog page detail".split())
AGAINST = [set(x.split()) for x in ("nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs toolbar", "ad ads advert advertisement adsense sponsor sponsored promo promotion banner outbrain taboola", "comment comments reply replies respondent disqus discussion reviews", "footer foot copyright legal colophon credits", "sidebar aside widget widgets related recommended more popular trending tags share social sharing follow", "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup login search form", "header masthead top logo branding site")]
FEATURES = 34


def tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at a place; quotes count after an equals sign if they are closed."""
    i = at
    while m := STOP.search(source, i):
        i = m.end()
        if m[0] == ">":
            return m.start()
        if m.start() < last[m[0]]:
            k = m.start() - 1
            while source[k].isspace():
                k -= 1
            if source[k] == "=":
                i = source.index(m[0], i) + 1
    return source.find(">", at)


#: A start or end tag: where it begins and ends, its name, whether it is an end tag, its attributes, and for a
#: start tag of RAW whether its content is skipped already.
Token = tuple[int, int, str, bool, str, bool]


def tokens_of(source: str) -> Iterator[Token]:
    """Tags in order, in time linear in the page; comments, scripts and styles come as tags without a name."""
    at, last = 0, {c: source.rfind(c) for c in ">\"'"}
    while (i := source.find("<", at)) >= 0:
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(source)
            yield i, at, "", False, "", False
        elif i > last[">"]:
            return
        elif source.startswith("<![CDATA[", i):
            at = i + 9
            yield i, at, "", False, "", False
        elif source[i + 1] in "!?":
            at = source.index(">", i) + 1
            yield i, at, "", False, "", False
        elif m := NAME.match(source, i):
            end, name = tag_end(source, m.end(), last), m[2].lower()
            attributes, at = source[m.end() : end], end + 1
            inside = not m[1] and not attributes.endswith("/")
            if inside and name in ("script", "style"):
                close = CLOSE[name].search(source, at)
                while close and not close[1]:
                    close = CLOSE[name].search(source, close.end())
                at = tag_end(source, close.end(), last) + 1 if close else len(source)
                yield i, at or len(source), "", False, "", False
                at = at or len(source)
                continue
            if inside and name in PLAIN and (close := CLOSE[name].search(source, at)) and close[1]:
                at = tag_end(source, close.end(), last) + 1 or len(source)
                yield i, at, name, False, attributes, True
                continue
            yield i, at, name, bool(m[1]), attributes, not m[1] and not inside
        else:
            at = i + 1


class Page:
    """Block-level elements in order of their start; blocks of text with the element that each belongs to."""

    def __init__(self, source: str | None):
        self.parent, self.kind, self.tokens, self.tag = [-1], [0], [()], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters within links
        self.inputs = [0]
        source = source or ""
        tokens = list(tokens_of(source))
        closed: set[int] = set()  # tokens of RAW whose end tag comes
        waiting: dict[str, list[int]] = {}
        for n, (_, _, tag, ends, _, skipped) in enumerate(tokens):
            if tag in RAW and not skipped:
                if not ends:
                    waiting.setdefault(tag, []).append(n)
                elif waiting.get(tag):
                    closed.add(waiting[tag].pop())
        # what is open: names, the element of each, and whether it hides its text (1: it ends early, 2: with its end tag)
        names, element, hides = [""], [0], [0]
        where: dict[str, list[int]] = {}
        hidden, bounds = [], []  # places of those that hide, and of those that hide to their end tag
        part: list[str] = []
        linked = link = 0

        def flush() -> None:
            nonlocal part, linked
            if part:
                text = " ".join(html.unescape("".join(part)).split())
                if text:
                    self.blocks.append((element[-1], text, min(linked, len(text))))
                part, linked = [], 0

        def push(tag: str, e: int, hide: int = 0) -> None:
            where.setdefault(tag, []).append(len(names))
            if hide:
                hidden.append(len(names))
            if hide == 2:
                bounds.append(len(names))
            names.append(tag)
            element.append(e)
            hides.append(hide)

        def cut(k: int) -> None:
            """Closes all from place k."""
            if not hidden or hidden[0] >= k:
                flush()
            while len(names) > k:
                where[names.pop()].pop()
                element.pop()
                if h := hides.pop():
                    hidden.pop()
                    if h == 2:
                        bounds.pop()

        def place(*tags: str) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        end = 0
        for n, (start, after, tag, ends, attributes, skipped) in enumerate([*tokens, (len(source), len(source), "", False, "", False)]):
            text, end = source[end:start], after
            if hidden and names[-1] == "head" and hides[-1] == 1 and text.strip():
                cut(len(names) - 1)  # the body begins
            if not hidden and text:
                part.append(text)
                linked += len(text) if link else 0
            if not tag:
                continue
            if hidden and where.get("head") and not ends and tag not in HEAD:
                cut(place("head"))
            kind = KIND.get(tag)
            if ends:
                if where.get(tag):
                    if kind is not None:
                        link = 0
                    if tag in RAW:
                        text_so_far, part = part, []  # the text around what hides is one block
                        cut(place(tag))
                        part = text_so_far
                    else:
                        cut(place(tag))
                elif kind is not None and not hidden:
                    flush()
                elif tag == "a":
                    link = max(0, link - 1)
                continue
            if tag in RAW:
                if not hidden:
                    self.inputs[element[-1]] += tag in ("textarea", "select")
                    part.append(" ")
                if not skipped:
                    push(tag, element[-1], 2 if n in closed else 1)
                continue
            if kind is None:
                if not hidden:
                    if tag == "a":
                        link += 1
                    elif tag in VOID:
                        part.append(" ")
                        self.inputs[element[-1]] += tag == "input"
                continue
            bound = bounds[-1] if bounds else 0
            option = tag == "option" and place("select") > bound
            if not option:
                if (k := bisect_right(hidden, bound)) < len(hidden):
                    cut(hidden[k])  # what is never closed ends at the next block
                if (k := place("p")) > bound and tag != "button":
                    cut(k)
            if tag in ENDS and (k := place(*ENDS[tag])) > max(bound, place(*SCOPE)):
                cut(k)
            if hidden:
                if tag not in VOID:
                    push(tag, element[-1])
                continue
            flush()
            link = 0
            self.parent.append(element[-1])
            self.kind.append(kind)
            self.tag.append(tag)
            self.inputs.append(0)
            self.tokens.append(tuple(t for a in ATTRIBUTE.finditer(attributes) for t in SPLIT.split((a[1] or a[2] or a[3] or "").lower()) if t) if "=" in attributes else ())
            if tag not in VOID:
                push(tag, len(self.parent) - 1)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        kind = np.array(self.kind)
        x = np.zeros((n, FEATURES), np.float32)
        total = np.zeros((n, 8))  # characters, linked characters, marks, digits, blocks, paragraphs, elements, headings
        longest = np.zeros(n)
        for e, text, linked in self.blocks:
            t = total[e]
            t[0] += len(text)
            t[1] += linked
            t[2] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            t[3] += sum(map(text.count, "0123456789"))
            t[4] += 1
            longest[e] = max(longest[e], len(text))
        total[:, 5], total[:, 6], total[:, 7] = kind == 5, 1, kind == 6
        own = total[:, 0].copy()
        inputs = np.array(self.inputs, float)
        children, same, depth = np.zeros(n), np.zeros(n), np.zeros(n)
        index = np.zeros(n)
        of_kind: dict[tuple[int, int], int] = {}
        above = np.zeros((n, 8))
        mine = np.zeros((n, 8))
        for e in range(1, n):
            p = self.parent[e]
            depth[e] = depth[p] + 1
            index[e] = children[p]
            children[p] += 1
            key = (p, self.kind[e])
            of_kind[key] = of_kind.get(key, 0) + 1
            for t in self.tokens[e]:
                mine[e, 0] += t in FOR
                for k, words in enumerate(AGAINST):
                    mine[e, k + 1] += t in words
            above[e] = above[p] + mine[p]
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            total[p] += total[e]
            longest[p] = max(longest[p], longest[e])
            inputs[p] += inputs[e]
        for e in range(1, n):
            same[e] = of_kind[(self.parent[e], self.kind[e])]
        chars = np.maximum(total[:, 0], 1)
        up = np.maximum(parent, 0)
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = kind, kind[up], depth, index
        x[:, 4], x[:, 5], x[:, 6] = children[up], same, children
        x[:, 7], x[:, 8], x[:, 9] = np.log1p(total[:, 0]), total[:, 1] / chars, np.log1p(total[:, 0] / total[:, 6])
        x[:, 10], x[:, 11], x[:, 12] = total[:, 2] / chars, total[:, 3] / chars, np.log1p(total[:, 0] / np.maximum(total[:, 4], 1))
        x[:, 13], x[:, 14], x[:, 15] = total[:, 5], total[:, 7], np.log1p(longest)
        x[:, 16], x[:, 17] = total[:, 0] / max(total[0, 0], 1), total[:, 0] / np.maximum(total[up, 0], 1)
        x[:, 18], x[:, 19] = inputs, np.log1p(own)
        x[:, 20] = np.log1p((total[up, 0] - total[:, 0]) / np.maximum(children[up] - 1, 1))
        x[:, 21] = np.isin(kind[up], (9, 10, 11, 13))
        x[:, 22] = total[up, 1] / np.maximum(total[up, 0], 1)
        x[:, 23] = index / np.maximum(children[up], 1)
        x[:, 24:32] = mine + 0
        x[:, 32], x[:, 33] = above[:, 0], above[:, 1:].sum(axis=1)
        return x

    def text(self, clutter: np.ndarray) -> str:
        return "\n\n".join(text for e, text, _ in self.blocks if not clutter[e])


class Boosted:
    """Logistic gradient boosting with trees of fixed depth over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.binned(x)
        self.base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        margin = np.full(len(y), self.base)
        self.split, self.leaf = [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), int)
            split = np.zeros((2**LEVELS - 1, 2), int)
            split[:, 1] = BINS
            for level in range(LEVELS):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-6)
                for f in range(x.shape[1]):
                    k = node * BINS + binned[:, f]
                    gs = np.bincount(k, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    hs = np.bincount(k, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                    gain[(hs < 1) | (ha - hs < 1)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    split[first : first + width][better] = np.column_stack([np.full(width, f), at])[better]
                s = split[first + node]
                node = node * 2 + (binned[np.arange(len(y)), s[:, 0]] > s[:, 1])
            leaf = RATE * np.bincount(node, g, 2**LEVELS) / (np.bincount(node, h, 2**LEVELS) + 1)
            margin += leaf[node]
            self.split.append(split)
            self.leaf.append(leaf)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)]).astype(np.int16)

    def log_odds(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.base)
        rows = np.arange(len(binned))
        for split, leaf in zip(self.split, self.leaf, strict=True):
            node = np.zeros(len(binned), int)
            for level in range(LEVELS):
                s = split[2**level - 1 + node]
                node = node * 2 + (binned[rows, s[:, 0]] > s[:, 1])
            out += leaf[node]
        return out


MIXED, MAIN, CLUTTER = 0, 1, 2


def decode(parent: list[int], main: np.ndarray, clutter: np.ndarray) -> np.ndarray:
    """The best consistent label of each element, from the log-odds of both models."""
    a, b = -np.logaddexp(0, -main), -np.logaddexp(0, -clutter)
    not_a, not_b = -np.logaddexp(0, main), -np.logaddexp(0, clutter)
    mixed, whole, gone = (not_a + not_b).tolist(), (a + not_b).tolist(), (not_a + b).tolist()
    n = len(parent)
    for e in range(n - 1, 0, -1):
        p = parent[e]
        mixed[p] += max(mixed[e], whole[e], gone[e])
        whole[p] += max(whole[e], gone[e])
        gone[p] += gone[e]
    label = np.zeros(n, int)
    for e in range(1, n):
        up = label[parent[e]]
        if up == CLUTTER or gone[e] >= whole[e] and (up == MAIN or gone[e] >= mixed[e]):
            label[e] = CLUTTER
        else:
            label[e] = MAIN if up == MAIN or whole[e] >= mixed[e] else MIXED
    return label


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and, for each block-level element in order, whether it is main text ('1'), clutter ('0') or mixed ('m')."""
    labels: list[str] = []
    words = ["".join(rng.choice(("th", "an", "er", "on", "de", "la", "ei", "st", "ou", "ing", "qu", "sch", "ción", "é")) for _ in range(rng.randint(1, 4))) for _ in range(120)]

    def say(low: int, high: int) -> str:
        n = rng.randint(low, high)
        out = [rng.choice(words) + rng.choice(("", "", "", "", "", ",", ".")) for _ in range(n)]
        if rng.random() < 0.1:
            out = [w.upper() + rng.choice(("!!", " |", "###")) for w in out]
        return " ".join(out).capitalize() + rng.choice((".", ".", "", " &amp; co."))

    def el(tag: str, inside, label: str, attr: str = "") -> str:
        labels.append(label)
        body = inside() if callable(inside) else inside
        close = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{' ' + attr if attr else ''}>{body}{close}"

    def cls(*names: str) -> str:
        return rng.choice((f'class="{rng.choice(names)}"', f'class="{rng.choice(names)} {rng.choice(words)}"', f'id="{rng.choice(names)}"', f'class="{rng.choice(words)}-{rng.choice(names)}"'))

    def links(n: int) -> str:
        return el("ul", lambda: "".join(el("li", f'<a href="/{rng.choice(words)}">{say(1, 3)}</a>', "0") for _ in range(n)), "0")

    def clutter() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            return el("nav", lambda: links(rng.randint(2, 9)), "0", rng.choice(("", cls("menu", "nav"))))
        if kind == 1:
            return el("div", say(3, 40), "0", cls("ad", "advert", "ads", "sponsored", "promo", "banner"))
        if kind == 2:
            return el(rng.choice(("aside", "div")), lambda: el("h3", say(1, 4), "0") + rng.choice((lambda: links(rng.randint(2, 6)), lambda: el("p", say(8, 60), "0")))(), "0", cls("sidebar", "widget", "related", "popular"))
        if kind == 3:
            return el("div", lambda: el("p", say(6, 40), "0") + el("button", "OK", "0"), "0", cls("cookie", "notice", "consent", "alert", "newsletter"))
        if kind == 4:
            return el("form", lambda: el("label", say(1, 4), "0") + '<input name="q">' + el("button", say(1, 2), "0"), "0", rng.choice(("", cls("search", "login", "signup"))))
        if kind in (5, 6):
            n = rng.randint(1, 5)
            return el(rng.choice(("section", "div")), lambda: el("h3", say(1, 3), "0") + "".join(el("div", lambda: el("p", say(4, 70), "0"), "0", cls("comment", "reply")) for _ in range(n)), "0", cls("comments", "disqus", "replies"))
        if kind == 7:
            return el("div", lambda: links(rng.randint(2, 5)), "0", cls("share", "social", "tags", "breadcrumb", "pagination"))
        if kind == 8:
            return el("header", lambda: el("h2", say(1, 4), "0") + (links(3) if rng.random() < 0.5 else ""), "0", rng.choice(("", cls("site", "masthead", "top"))))
        if kind in (9, 10):
            return el("footer", f"&copy; {say(2, 40)}" if rng.random() < 0.7 else lambda: el("p", say(3, 30), "0") + links(2), "0", rng.choice(("", cls("footer", "legal"))))
        return el("div", "".join(f'<a href="#">{say(1, 4)}</a> ' for _ in range(rng.randint(2, 8))), "0", rng.choice(("", cls("menu", "toolbar", "more"))))

    def piece() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return el("ul", lambda: "".join(el("li", say(3, 25), "1") for _ in range(rng.randint(2, 5))), "1")
        if kind == 1:
            return el("blockquote", lambda: el("p", say(8, 40), "1"), "1")
        if kind == 2:
            return el("h2", say(1, 6), "1")
        text = say(1, 12) if rng.random() < 0.3 else say(15, 160)
        return el("p", rng.choice((text, text, f"<b>{text}<br>", f'{text} <a href="/x">{say(1, 3)}</a> {say(2, 20)}', f"<em>{text}</em>")), "1")

    inner = rng.random() < 0.35

    def article() -> str:
        out = [el("h1", say(1, 12), "1")] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 1, 2, 4, 8, 16))):
            out.append(piece())
            if inner and rng.random() < 0.3:
                out.append(clutter())
        return "".join(out)

    mark = "m" if inner else "1"
    tag = rng.choice(("article", "article", "article", "main", "div", "section"))
    attr = cls("content", "post", "entry", "article", "main", "story") if tag in ("div", "section") or rng.random() < 0.3 else ""

    def body() -> str:
        before = "".join(clutter() for _ in range(rng.randint(0, 4)))
        middle = el("div", lambda: el(tag, article, mark, attr) + (clutter() if rng.random() < 0.5 else ""), "m", rng.choice(("", cls("wrap", "page", "row")))) if rng.random() < 0.3 else el(tag, article, mark, attr)
        return before + middle + "".join(clutter() for _ in range(rng.randint(0, 4)))

    page = el("html", lambda: "<head><title>t</title><style>p{}</style></head>" + el("body", body, "m"), "m")
    return "<!DOCTYPE html>" + page, labels


@lru_cache(maxsize=1)
def models() -> tuple[Boosted, Boosted]:
    rng = random.Random(SEED)
    xs, marks = [], []
    while len(xs) < PAGES:
        source, labels = made_page(rng)
        page = Page(source)
        if len(page.parent) == len(labels) + 1:
            xs.append(page.features()[1:])
            marks += labels
    x, m = np.concatenate(xs), np.array(marks)
    weight = np.ones(len(m))
    return Boosted().fit(x, (m == "1").astype(float), weight), Boosted().fit(x, (m == "0").astype(float), weight)


def extract_all(sources: list[str | None], fitted: tuple[Boosted, Boosted]) -> list[str]:
    """The main texts of pages, which share the models' passes."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    binned = fitted[0].binned(np.concatenate([p.features() for p in pages]))
    main, clutter = (m.log_odds(binned) for m in fitted)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        out.append(p.text(decode(p.parent, main[at : at + n], clutter[at : at + n]) == CLUTTER))
        at += n
    return out


def extract(pages: DataFrame, batch: int = 256) -> DataFrame:
    """(page_id, url, text) of pages(page_id, url, html)."""
    shipped = pages.sparkSession.sparkContext.broadcast(models())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(extract_all(part.column("html").to_pylist(), shipped.value), pa.string())], ["page_id", "url", "text"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
