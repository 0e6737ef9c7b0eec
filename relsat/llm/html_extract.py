"""Operator 5, HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in page order, each with the path of open elements (tags, roles,
class and id words) and text features. A two-state chain, main text or not, is trained by
likelihood on labelled pages that this module writes itself from a grammar of page parts, and
decoded by Viterbi. The blocks of state "main" are joined by single spaces.

Null or empty html, and pages without main text, give the empty text. Comments, scripts,
styles, head and tags are no text; a tag cut off at the page's end is dropped. A quote that is
never closed ends the meaning of quotes for the tags after it. Elements may be nested to any
depth, and pages and blocks of any length are read whole, in time that grows with their length.
Repeated rows are extracted one by one; extra columns are not read. An empty table gives an
empty result. Of equally likely readings of a page, the one with fewer main blocks is taken
from the end backwards.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relsat.llm.common import slices, table

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
#: The rest of a tag; a ``>`` inside quotes does not end it. Possessive, so a failure costs one pass.
REST = re.compile(r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
LONG_NUMBER = re.compile(r"&#(?:0*+([0-9]{9,}+)|[xX]0*+([0-9a-fA-F]{9,}+));?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SILENT = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "math", "canvas", "audio", "video", "textarea"}
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|<body(?=[\s/>])" if t == "head" else rf"</{t}(?=[\s/>])", re.I) for t in SILENT}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Opening one of these closes an open one of the named kinds, up to the bounds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "figure", "main", "hr")}
BOUNDS = {"div", "section", "article", "aside", "nav", "header", "footer", "main", "body", "table", "ul", "ol", "form", "blockquote", "figure"}
SECTIONS = {f"in {t}" for t in ("article", "main", "nav", "aside", "footer", "header", "form", "section")}
HINTS = ("cookie", "copyright", "©", "all rights", "subscribe", "newsletter", "advert", "sponsor", "log in", "sign up", "search", "privacy", "comment", "reply", "share", "read more", "menu", "http")


class Element(NamedTuple):
    """An open element. ``names`` holds the features of it and of all elements around it; an
    element that adds none shares the set of the one around it."""

    tag: str
    up: str
    names: frozenset[str]


class Block(NamedTuple):
    """A leaf block: its element (None outside of any), text, share in links, inline tags."""

    element: Element | None
    text: str
    linked: float
    inline: int


class Open:
    """The open elements. Counts by tag, for the page and since each bound, tell whether a walk
    finds what it looks for; it then removes all that it has passed, so a page costs linear time."""

    def __init__(self, known: Container[str] | None) -> None:
        self.known, self.path, self.tags, self.scopes = known, [], Counter(), [Counter()]

    def push(self, tag: str, words: list[str]) -> None:
        top = self.path[-1] if self.path else None
        names = top.names if top else frozenset()
        more = {x for x in (f"in {tag}", *(f"word {w}" for w in words)) if x not in names and (self.known is None or x in self.known or x in SECTIONS)}
        self.path.append(Element(tag, top.tag if top else "none", names | more if more else names))
        self.tags[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in BOUNDS:
            self.scopes.append(Counter())

    def pop(self) -> str:
        tag = self.path.pop().tag
        if tag in BOUNDS:
            self.scopes.pop()
        self.tags[tag] -= 1
        self.scopes[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> bool:
        if not self.tags[tag]:
            return False
        while self.pop() != tag:
            pass
        return True

    def implied_end(self, tag: str) -> None:
        """What the opening of ``tag`` closes: the innermost element of the kinds that it ends."""
        kinds = CLOSES.get(tag, ())
        if any(self.scopes[-1][k] for k in kinds):
            while self.pop() not in kinds:
                pass


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in one forward pass. Feature names of elements that are not
    ``known`` (all by default) are left out."""
    out: list[Block] = []
    path = Open(known)
    held: list[str] = []
    links = chars = linked = inline = 0
    at, last, quotes = 0, page.rfind(">"), True

    def text(piece: str) -> None:
        nonlocal chars, linked
        if piece:
            held.append(piece)
            chars += len(piece)
            linked += len(piece) * (links > 0)

    def flush() -> None:
        nonlocal chars, linked, inline
        if held and (t := " ".join(decoded("".join(held)).split())):
            out.append(Block(path.path[-1] if path.path else None, t, linked / max(1, chars), inline))
        held.clear()
        chars = linked = inline = 0

    while (lt := page.find("<", at)) >= 0:
        text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt) or page.startswith("<![CDATA[", lt):
            close = "-->" if page.startswith("<!--", lt) else "]]>"
            end = lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else page.find(close, lt + 4)
            at = len(page) if end < 0 else page.find(">", end) + 1
            continue
        if not (after in ("!", "?", "/") or after.isascii() and after.isalpha()):
            if not after:  # the page ends here
                at = len(page)
                break
            text("<")
            at = lt + 1
            continue
        if lt > last:  # no tag ends any more: the last one was cut off, the others are text
            at = page.rfind("<")
            text(page[lt:at])
            after = page[at + 1 : at + 2]
            if not after or after in "!?/" or after.isascii() and after.isalpha():
                at = len(page)
            break
        name = NAME.match(page, lt + 1 + (after == "/"))
        if not name:
            at = page.find(">", lt) + 1
            continue
        rest = REST.match(page, name.end()) if quotes else None
        if rest:
            body, at = rest[1], rest.end()
        else:  # a quote that is never closed: from here on, quotes do not count
            quotes = False
            at = page.find(">", name.end()) + 1
            body = page[name.end() : at - 1]
        tag = name[0].lower()
        if after == "/":
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            flush()
            if path.end(tag):
                links = 0
            continue
        if tag in SILENT:
            if not body.endswith("/") or tag in ("script", "style", "textarea"):
                end = ENDS[tag].search(page, at)
                if not end:
                    at = len(page)
                elif end[0][1] != "/":  # a body without the head's end
                    at = end.start()
                else:
                    at = page.find(">", end.end()) + 1 or len(page)
            continue
        if tag in INLINE:
            links += tag == "a"
            inline += 1
            continue
        flush()
        if tag in VOID:
            continue
        path.implied_end(tag)
        words = []
        for a in ATTRIBUTE.finditer(body):
            value = a[2] or a[3] or a[4] or ""
            words += [w.lower() for w in WORD.findall(value)] + [v.lower() for v in value.split()]
        if not body.endswith("/"):
            path.push(tag, words)
    text(page[at:])
    flush()
    return out


def decoded(text: str) -> str:
    """Character references as characters; numbers beyond all characters are U+FFFD."""
    return unescape(LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def block_features(bs: list[Block]) -> list[list[str]]:
    """Feature names of each block, from its whole text."""
    n = len(bs)
    leaf = [b.element.tag if b.element else "none" for b in bs]
    out = []
    for k, (e, t, linked, inline) in enumerate(bs):
        low, length = t.lower(), min(9, len(t).bit_length())
        names = e.names if e else frozenset()
        f = ["one", f"leaf {leaf[k]}", f"up {e.up if e else 'none'}", f"long {length}", f"leaf {leaf[k]} long {length}", f"linked {int(linked * 4)}", f"inline {min(3, inline)}"]
        f.append("sectioned" if names & SECTIONS else "body only")
        f.append(f"ends {t[-1] in '.!?…:;'}")
        f.append(f"stops {min(4, sum(t.count(c) for c in '.!?'))}")
        f.append(f"commas {min(3, t.count(','))}")
        f.append(f"before {leaf[k - 1] if k else 'start'}")
        f.append(f"after {leaf[k + 1] if k + 1 < n else 'end'}")
        f.append(f"place {min(4, 5 * k // n)}")
        f += [f"says {h} {'short' if length < 8 else 'long'}" for h in HINTS if h in low]
        out.append([*f, *sorted(names)])
    return out


def marginals(s: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a chain with scores ``s`` (block, state): the logarithm of the sum over all readings,
    each block's state probabilities, and the expected number of each transition."""
    n = len(s)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[0] = s[0] + first
    for i in range(1, n):
        alpha[i] = s[i] + np.logaddexp(alpha[i - 1, 0] + t[0], alpha[i - 1, 1] + t[1])
    beta[-1] = last
    for i in range(n - 2, -1, -1):
        v = s[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(t[:, 0] + v[0], t[:, 1] + v[1])
    z = np.logaddexp(*(alpha[-1] + last))
    pair = np.exp(alpha[:-1, :, None] + t + (s + beta)[1:, None, :] - z).sum(0)
    return float(z), np.exp(alpha + beta - z), pair


class Chain:
    """Two states; weights of features, transitions, first and last state."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.t, self.first, self.last = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-5) -> "Chain":
        seen: dict[str, int] = {}
        for fs, _ in pages:
            for f in fs:
                for x in f:
                    seen[x] = seen.get(x, 0) + 1
        self.index = {x: k for k, x in enumerate(sorted(x for x, c in seen.items() if c >= 3))}
        self.w = np.zeros((len(self.index), 2))
        g2 = [np.full_like(a, 1e-6) for a in (self.w, self.t, self.first, self.last)]
        known = [([np.array([self.index[x] for x in f if x in self.index]) for f in fs], np.array(ys)) for fs, ys in pages if fs]
        order = list(range(len(known)))
        rng = random.Random(5)

        def step(a: np.ndarray, g: np.ndarray, acc: np.ndarray, at: object = ...) -> None:
            acc[at] += g * g
            a[at] += rate * (g - decay * a[at]) / np.sqrt(acc[at])

        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                fs, ys = known[k]
                s = np.array([self.w[f].sum(0) for f in fs])
                _, p, pair = marginals(s, self.t, self.first, self.last)
                hot = np.eye(2)[ys]
                true = np.zeros((2, 2))
                np.add.at(true, (ys[:-1], ys[1:]), 1)
                step(self.t, true - pair, g2[1])
                step(self.first, hot[0] - p[0], g2[2])
                step(self.last, hot[-1] - p[-1], g2[3])
                for f, d in zip(fs, hot - p):
                    step(self.w, d, g2[0], f)
        return self

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not features:
            return []
        get = self.index.get
        s = [self.w[[k for k in map(get, f) if k is not None]].sum(0).tolist() for f in features]
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = s[0][0] + float(self.first[0]), s[0][1] + float(self.first[1])
        back = []
        for x, y in s[1:]:
            back.append((int(b + t10 > a + t00), int(b + t11 > a + t01)))
            a, b = x + max(a + t00, b + t10), y + max(a + t01, b + t11)
        k = int(b + float(self.last[1]) > a + float(self.last[0]))
        out = [k]
        for p in reversed(back):
            k = p[k]
            out.append(k)
        return out[::-1]


#: Syllables of the invented words of training pages, and names that sites give to their parts.
SYLLABLES = ("an ti ser mo el qu or ist be ka lo ra ne sú vi té ü på ßen dom ri gal ch st y ou").split()
MAIN_NAMES = "content post entry article article-body story main-content post-content entry-content text page-content body-text mw-body markdown-body prose".split()
PART_NAMES = {
    "menu": "menu navbar navigation topnav nav-list breadcrumbs toc site-nav tabs pagination",
    "head": "header site-header masthead banner top-bar logo branding hero-brand",
    "foot": "footer site-footer bottom copyright colophon legal footer-links",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot sponsor-box adsense",
    "note": "cookie cookie-notice consent gdpr notice notification alert popup modal newsletter paywall",
    "side": "sidebar side widget related rail recommended trending more-stories tag-cloud social-links",
    "talk": "comments comment-list discussion responses replies reader-comments user-comments disqus thread",
    "meta": "byline meta author date share post-info tags breadcrumb",
}
#: What boilerplate says; running text may say it too.
PHRASES = ("We use cookies.", "Subscribe to our newsletter", "All rights reserved.", "Log in", "Read more", "Share this", "Privacy policy", "Advertisement", "Sign up for free", "Search", "Reply", "Leave a comment", "Copyright", "Terms of use", "https://example.com/x")


class _Site:
    """Writes one labelled page: a layout drawn at random, with the texts of its main blocks."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.main, self.serial = rng, set(), 0
        self.layout = rng.choice(["semantic", "semantic", "semantic", "divs", "divs", "table", "plain"])
        self.ending = rng.choice(["close", "close", "close", "mixed", "open"])  # of p, li, td
        self.broken = rng.random() < 0.25  # inline tags that are never closed

    def words(self, lo: int, hi: int, end: str = "") -> str:
        rng = self.rng
        self.serial += 1
        w = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        for k in range(4, len(w), rng.randint(5, 12)):
            w[k] += rng.choice([",", ".", ".", "!", "?"])
        if rng.random() < 0.08:
            w.insert(rng.randint(0, len(w)), rng.choice(["&", "<", "%", "***", "#", "1999", "§"]))
        w.insert(rng.randint(0, len(w)), f"x{self.serial}")  # every text is unlike the others
        return (" ".join(w).capitalize() if rng.random() < 0.9 else " ".join(w)) + end

    def html(self, text: str) -> str:
        """The text with its characters escaped, some words in inline tags, and odd white space."""
        rng = self.rng
        w = [x.replace("&", "&amp;").replace("<", rng.choice(["&lt;", "&#60;"])) for x in text.split(" ")]
        for _ in range(rng.choice([0, 0, 0, 1, 2]) if len(w) > 5 else 0):
            a = rng.randrange(len(w) - 1)
            z = min(len(w) - 1, a + rng.randint(0, 3))
            tag = rng.choice(["b", "em", "i", "strong", "a href=/l", "code", "span class=x"])
            w[a], w[z] = f"<{tag}>{w[a]}", f"{w[z]}</{tag.split()[0]}>"
        return rng.choice([" ", " ", " ", "\n"]).join(w)

    def m(self, lo: int, hi: int, end: str = "") -> str:
        """A main block's text."""
        t = self.words(lo, hi, end if self.rng.random() < 0.7 else "")
        if self.rng.random() < 0.06:
            t = f"{t} {self.rng.choice(PHRASES)} {self.words(1, 9)}"
        self.main.add(" ".join(t.split()))
        return self.html(t)

    def end(self, tag: str) -> str:
        return "" if self.ending == "open" or self.ending == "mixed" and self.rng.random() < 0.4 else f"</{tag}>"

    def attr(self, kind: str, least: float = 0.0) -> str:
        """A class or id of a part; now and then none, unless ``least``."""
        rng = self.rng
        if rng.random() >= max(least, 0.85):
            return ""
        name = rng.choice(PART_NAMES[kind].split())
        return rng.choice([f' class="{name}"', f' id="{name}"', f" class='box {name}'", f' class="{name} c-{rng.randint(1, 9)}"', f" class={name}", f' style="x:y" class="{name}"'])

    def part(self, kind: str, tag: str, body: str) -> str:
        """A boilerplate part, in the element of its kind or in a named division."""
        own = tag if self.layout == "semantic" or self.rng.random() < 0.3 else "div"
        name = self.attr(kind, 1.0 if own == "div" else 0.0)
        if self.layout == "table" and self.rng.random() < 0.5:
            return f"<table{name}><tr><td>{body}{self.end('td')}</table>"
        return f"<{own}{name}>{body}</{own}>"

    def say(self, lo: int, hi: int) -> str:
        t = self.html(self.words(lo, hi, self.rng.choice(["", "."])))
        return f"{self.rng.choice(PHRASES)} {t}" if self.rng.random() < 0.35 else t

    def links(self, n: int) -> str:
        one = [f'<a href="/{k}">{self.html(self.words(1, 3))}</a>' for k in range(n)]
        return self.rng.choice(["<ul>" + "".join(f"<li>{x}{self.end('li')}" for x in one) + "</ul>", self.rng.choice([" ", " | ", " &raquo; ", ", "]).join(one)])

    def nav(self) -> str:
        return self.part("menu", "nav", self.links(self.rng.randint(2, 9)))

    def header(self) -> str:
        body = self.rng.choice([f"<a href=/>{self.say(1, 3)}</a>", f"<h1>{self.say(1, 4)}</h1><p>{self.say(3, 8)}{self.end('p')}", f"<h2>{self.say(1, 3)}</h2>", f"<img src=l><p>{self.say(1, 6)}</p>"])
        return self.part("head", "header", body + self.rng.choice(["", self.nav()]))

    def footer(self) -> str:
        mark = self.rng.choice(["&copy; ", "Copyright ", "", "&#169; 2020 "])
        body = self.rng.choice([f"{mark}{self.say(2, 6)} &middot; {self.say(2, 14)}", f"<p>{mark}{self.say(4, 20)}{self.end('p')}{self.links(3)}", f"{mark}{self.say(2, 8)}. All rights reserved.", f"{self.nav()}<p>{self.say(2, 8)}{self.end('p')}"])
        return self.part("foot", "footer", body)

    def ad(self) -> str:
        before = f"<!-- {self.words(1, 3)} -->" if self.rng.random() < 0.4 else ""
        body = self.rng.choice([self.say(2, 25), f"<p>{self.say(3, 30)}{self.end('p')}", f"<a href=/buy>{self.say(2, 9)}</a>", f"<img src=a><b>{self.say(1, 4)}</b> {self.say(3, 12)}"])
        name = self.attr("ad", 1.0)
        return before + self.rng.choice([f"<div{name}>{body}</div>", f"<div{name}>{body}</div>", f"<aside{name}>{body}</aside>", f"<section{name}><div>{body}</div></section>"])

    def notice(self) -> str:
        body = f"<p>{self.say(6, 30)}{self.end('p')}"
        return f"<div{self.attr('note', 1.0)}{self.rng.choice(['', ' role=dialog'])}>{body}{self.rng.choice(['', f'<button>{self.say(1, 2)}</button>'])}</div>"

    def form(self) -> str:
        body = f"<label>{self.say(1, 4)}</label><input name=q>" + self.rng.choice(["", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"])
        return f"<form action=/s{self.rng.choice(['', ' class=search', ' id=login', ' class=signup'])}>{body}{self.rng.choice(['', f'<p>{self.say(3, 14)}</p>'])}<button>{self.say(1, 2)}</button></form>"

    def sidebar(self) -> str:
        return self.part("side", "aside", f"<h3>{self.say(1, 4)}</h3>{self.links(self.rng.randint(2, 6))}" + self.rng.choice(["", f"<p>{self.say(4, 40)}{self.end('p')}"]))

    def comments(self) -> str:
        rng, one = self.rng, []
        for _ in range(rng.randint(1, 6)):
            who, what = self.html(self.words(1, 2)), self.say(4, 70)
            one.append(rng.choice([f'<div class="comment"><p class="author">{who}</p><p>{what}{self.end("p")}</div>', f'<article class="comment"><h4>{who}</h4><p>{what}</p></article>', f"<li><b>{who}</b>: {what}{self.end('li')}", f"<p>{what}{self.end('p')}", f"<div><span>{who}</span> {what}</div>"]))
        tag = rng.choice(["section", "div", "ol", "ul"])
        head = f"<h2>{self.say(1, 3)}</h2>" if tag in ("section", "div") else ""
        return f"<{tag}{self.attr('talk', 1.0)}>{head}{''.join(one)}{self.form() if rng.random() < 0.3 else ''}</{tag}>"

    def article(self) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.85:
            h = f"<{(t := rng.choice(['h1', 'h1', 'h1', 'h2']))}>{self.m(2, 14)}</{t}>"
            parts.append(f"<header>{h}</header>" if rng.random() < 0.15 else h)
        if rng.random() < 0.2:
            parts.append(f"<p{self.attr('meta', 1.0)}>{self.say(2, 6)}</p>")
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.62:
                open_, end = rng.choice([("", ""), ("", ""), ("<b>", rng.choice(["</b>", ""]) if self.broken else "</b>")]) if rng.random() < 0.3 else ("", "")
                parts.append(f"<p>{open_}{self.m(1, 120, '.')}{end}{rng.choice(['', '', '<br>'])}{self.end('p')}")
            elif r < 0.72:
                parts.append(f"<h2>{self.m(1, 8)}</h2><p>{self.m(10, 80, '.')}{self.end('p')}")
            elif r < 0.78:
                parts.append("<ul>" + "".join(f"<li>{self.m(2, 20)}{self.end('li')}" for _ in range(3)) + "</ul>")
            elif r < 0.82:
                parts.append(f"<blockquote>{self.m(6, 40, '.')}</blockquote>")
            elif r < 0.86:
                parts.append(f"<div>{self.m(8, 80, '.')}</div>")
            elif r < 0.88:
                parts.append(f"<pre>{self.m(3, 20)}</pre>")
            elif r < 0.90:
                parts.append(f"<table><tr><td>{self.m(1, 4)}{self.end('td')}<td>{self.m(1, 4)}{self.end('td')}</table>")
            elif r < 0.91:
                self.main.add(t := rng.choice(PHRASES))  # what is written like boilerplate, alone in running text
                parts.append(f"<p>{t}{self.end('p')}")
            elif r < 0.93:
                parts.append(self.ad())
            elif r < 0.96:
                parts.append(rng.choice([self.form, self.notice, self.sidebar])())
            else:
                parts.append(f"<figure><img src=x><figcaption>{self.m(3, 14, '.')}</figcaption></figure>")
        body = "".join(parts) + (self.comments() if rng.random() < 0.1 else "")
        if self.layout == "plain":
            return body
        if self.layout == "semantic":
            return rng.choice([f"<article{rng.choice(['', '', ' class=post', ' id=story'])}>{body}</article>", f"<main>{rng.choice(['<article>', ''])}{body}</main>", f"<main><article>{body}</article></main>"])
        name = f'<div {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}">{body}</div>'
        if self.layout == "table":
            return f"<table><tr><td>{self.links(3)}{self.end('td')}<td>{name}{self.end('td')}</table>" if rng.random() < 0.5 else f"<table><tr><td>{name}</table>"
        return rng.choice([name, f"<div class=wrap><div class=inner>{name}</div></div>", f"<section>{name}</section>"])

    def page(self) -> str:
        rng = self.rng
        maybe = lambda f, p: f() if rng.random() < p else ""
        head = f"<title>{self.html(self.words(2, 9))}</title>" + rng.choice(["", "<meta charset=utf-8>", f"<style>.{rng.choice(MAIN_NAMES)} {{ color: red }}</style>"]) + rng.choice(["", f"<script>if (a < b) document.write('<div>{self.words(1, 3)}</div>')</script>"])
        body = maybe(self.notice, 0.25) + maybe(self.header, 0.4) + maybe(self.nav, 0.7) + maybe(self.form, 0.15) + maybe(self.ad, 0.4) + maybe(self.sidebar, 0.2)
        body += self.article() + maybe(self.ad, 0.2) + maybe(self.comments, 0.35) + maybe(self.sidebar, 0.3) + maybe(self.form, 0.2) + maybe(self.notice, 0.15) + maybe(self.footer, 0.8)
        html = rng.choice([f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>", f"<html><head>{head}</head><body class=home>{body}", f"<head>{head}<body>{body}"])
        return html[: rng.randint(len(html) // 3, len(html))] if rng.random() < 0.15 else html  # some are cut off


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A labelled page: html and the texts of its main blocks."""
    site = _Site(rng)
    return site.page(), site.main


def labels_of(bs: list[Block], main: set[str]) -> list[int]:
    """1 for main blocks; the last block of a page that was cut off is the beginning of one."""
    return [int(b.text in main or (k == len(bs) - 1 and len(b.text) > 3 and any(x.startswith(b.text) for x in main))) for k, b in enumerate(bs)]


@lru_cache(maxsize=2)
def trained(pages: int = 800, seed: int = 11) -> Chain:
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        page, main = training_page(rng)
        bs = blocks(page)
        data.append((block_features(bs), labels_of(bs, main)))
    return Chain().train(data)


def main_text(page: str | None, chain: Chain) -> str:
    bs = blocks(page or "", chain.index)
    return " ".join(b.text for b, y in zip(bs, chain.decode(block_features(bs))) if y)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chain: Chain | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row. The model, which training
    pages of this module fix, is broadcast: some hundred weights."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "h", 4_000_000):
                texts = [main_text(h.as_py(), shared.value) for h in part.column("h")]
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    shape = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(page_id).alias("i"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h")).mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
