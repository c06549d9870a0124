"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

Each block element gets the probability that it belongs to the article. The decoder then chooses for all nodes at once the likeliest
labelling in which every path from the root is outside, then inside, then cut away: a node below a cut one is never chosen, and what
is inside is one region with holes. The trees are fitted on pages that a generator writes with known labels.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gbt

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title noscript template iframe svg math canvas object audio video select option textarea button datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SCOPE = frozenset("html table td th caption template".split())
#: A start tag closes an open element of these, unless one of the second list stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TAG_GROUPS = ["article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6 hgroup", "ul ol menu dl", "li dt dd", "blockquote pre", "table thead tbody tfoot tr td th caption", "figure figcaption", "nav", "header", "footer", "aside", "form fieldset legend search", "body html"]
#: Tokens of class, id, role and similar attributes.
TOKEN_GROUPS = [
    "article content contents post entry main story body text maincontent articlebody prose page-content blogpost",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toc pagination pager topnav sitenav links",
    "header head masthead topbar banner logo hero branding top",
    "footer foot bottom copyright legal colophon contentinfo imprint",
    "sidebar side aside rail widget widgets complementary column secondary",
    "cookie cookies consent notice notices alert gdpr privacy popup modal overlay dialog toast warning",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adslot banner dfp commercial",
    "form search login signin signup subscribe subscription newsletter register contact feedback poll",
    "comment comments reply replies respond disqus discussion commentlist thread responses reader",
    "share sharing social related recommended recommendations more teaser trending popular also tags byline meta author",
]
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TOKEN: dict[str, int] = {}
for _i, _g in enumerate(TOKEN_GROUPS):
    for _t in _g.split():
        _TOKEN[_t] = _TOKEN.get(_t, 0) | 1 << _i
#: Elements that mark all below them.
_OVER = ["article", "main", "nav", "header", "footer", "aside", "form"]
_TOKENS_OF = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
#: Comments, declarations and tags. A quote opens a value only where a value begins; inside an unquoted value it is a character like any other.
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:!|\?|/(?![A-Za-z]))[^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_NAME}(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+({_VALUE})?+)?+", re.S)
_NAMING = ("class", "id", "role", "aria-label", "itemprop", "data-component")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "iframe")}


def attributes_of(source: str) -> tuple[dict[str, str], bool]:
    """The attributes in the rest of a tag, the first of equal names, and whether the tag ends with a slash of its own."""
    found: dict[str, str] = {}
    end = 0
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        found.setdefault(m[1].lower(), value)
        end = m.end()
    return found, "/" in source[end:]


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(attributes.get("style", "")) is not None


class Stack:
    """Open elements, each with the node that its text belongs to (-1: dropped). The innermost element of a tag is found without a walk, so that deep pages take time in proportion to their length."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}

    @property
    def owner(self) -> int:
        return self.open[-1][1]

    def push(self, tag: str, owner: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, owner))

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0, the root's, if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, what: Iterable[str], stop: Iterable[str]) -> None:
        """Close the innermost element of what, and all inside it, unless one of stop stands further in."""
        at = self.innermost(what)
        if at and at >= self.innermost(stop):
            while len(self.open) > at:
                self.places[self.open.pop()[0]].pop()


class Page:
    """Block elements of a page in page order and its pieces of text: (node, block number, text)."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["html", "body"]  # a page without a body tag has a body
        self.parent: list[int] = [-1, 0]
        self.tokens: list[int] = [0, 0]
        self.pieces: list[tuple[int, int, str]] = []
        self.links: list[bool] = []
        self.share: list[float] = []  # set by features()
        self.parse(source)

    def parse(self, source: str) -> None:
        stack = Stack()
        stack.push("body", 1)
        block, at, end = 0, 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            text = source[at : m.start() if m else end]
            owner = stack.owner
            if text and owner >= 0:
                self.pieces.append((owner, block, html.unescape(text) if "&" in text else text))
                self.links.append(bool(stack.places.get("a")))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in ("html", "body"):  # what comes after their ends still belongs to the body
                block += 1
                if tag == "body" and not m[1]:
                    stack.close(("head",), ())
                    self.enter_body(attributes_of(m[3])[0] if m[3] else {})
                continue
            if m[1]:
                if tag in BLOCK:
                    block += 1
                stack.close((tag,), () if tag in SCOPE else SCOPE)
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br" and owner >= 0:
                    self.pieces.append((owner, block, " "))
                    self.links.append(False)
                continue
            if tag in VOID:
                block += tag == "hr"
                continue
            if tag in _RAW_END:
                close = _RAW_END[tag].search(source, at)
                at = close.end() if close else end
                continue
            attributes, ended = attributes_of(m[3]) if m[3] else ({}, False)
            if tag in BLOCK:
                block += 1
                stack.close(("p",), SCOPE)
                if stack.open[-1][0] == "head":
                    stack.close(("head",), ())
            if tag in CLOSES:
                stack.close(*CLOSES[tag])
            owner = stack.owner
            if tag in DROPPED or owner < 0 or hidden(attributes):
                owner = -1
            elif tag in BLOCK:
                self.tag.append(tag)
                self.parent.append(owner)
                self.tokens.append(self.named(attributes))
                owner = len(self.tag) - 1
            if not ended or tag in BLOCK:
                stack.push(tag, owner)

    def enter_body(self, attributes: dict[str, str]) -> None:
        self.tokens[1] |= Page.named(attributes)

    @staticmethod
    def named(attributes: dict[str, str]) -> int:
        bits = 0
        for name in _NAMING:
            if value := attributes.get(name):
                for t in _TOKENS_OF.findall(value):
                    bits |= _TOKEN.get(t.lower(), 0)
        return bits

    def features(self) -> np.ndarray:
        """One row per node; row 0 is the root. A node that only wraps one other counts neither as depth nor as a tag, so that deeper wrapping changes nothing. Sets share, the part of a decision that a node has."""
        n, parent = len(self.tag), self.parent
        chars, linked, marks, pieces = ([0] * n for _ in range(4))
        first, so_far, opened, blank = [0] * n, 0, 0, [True] * n
        for (node, _, text), link in zip(self.pieces, self.links, strict=True):
            while opened <= node:
                first[opened] = so_far
                opened += 1
            size = len(text)
            chars[node] += size
            so_far += size
            if link:
                linked[node] += size
            marks[node] += text.count(".") + text.count(",")
            pieces[node] += size > 1
            blank[node] = blank[node] and text.isspace()
        first[opened:] = [so_far] * (n - opened)
        own = chars[:]
        group = [_TAG.get(t, 3) for t in self.tag]
        paragraphs = [c if g == 4 else 0 for c, g in zip(chars, group, strict=True)]
        kids, only = [0] * n, [0] * n
        for i in range(1, n):
            kids[parent[i]] += 1
            only[parent[i]] = i
        wraps = [i > 0 and kids[i] == 1 and blank[i] for i in range(n)]
        tags = [0 if w else 1 for w in wraps]
        for i in range(n - 1, 0, -1):  # children stand after their parents
            p = parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            pieces[p] += pieces[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
        tags = [max(t, 1) for t in tags]
        above, over = self.tokens[:], [0] * n
        flags = [1 << _OVER.index(t) if t in _OVER else 0 for t in self.tag]
        depth, place, seen = [0] * n, [0] * n, [0] * n
        same: dict[tuple[int, int], int] = {}
        chain = [1] * n  # wrappers in a row, so far
        for i in range(1, n):
            p = parent[i]
            above[i] |= above[p]
            over[i] = over[p] | flags[i]
            depth[i] = depth[p] + (not wraps[p])
            place[i] = seen[p]
            seen[p] += 1
            same[p, group[i]] = same.get((p, group[i]), 0) + 1
            if wraps[i] and wraps[p]:
                chain[i] = chain[p] + 1
        for i in range(n - 1, 0, -1):
            if wraps[i] and wraps[only[i]]:
                chain[i] = chain[only[i]]
        self.share = [1 / c for c in chain]
        before, after, last = [-1] * n, [-1] * n, [-1] * n
        for i in range(1, n):
            q = last[parent[i]]
            if q >= 0:
                before[i], after[q] = q, i
            last[parent[i]] = i
        long_p = [0] * n  # children that are paragraphs of some length
        for i in range(1, n):
            long_p[parent[i]] += group[i] == 4 and chars[i] > 60
        alike = [1.0] + [same[parent[i], group[i]] / seen[parent[i]] for i in range(1, n)]
        up = np.maximum(np.array(parent), 0)
        chars, linked, marks, pieces, own, tags, paragraphs, first, kids, place = (np.array(a, float) for a in (chars, linked, marks, pieces, own, tags, paragraphs, first, kids, place))
        group, tokens, above, over = np.array(group), np.array(self.tokens), np.array(above), np.array(over)
        total = max(so_far, 1)
        whole = np.array([1 << 20 if t in ("article", "main") else 0 for t in self.tag]) | np.array(self.tokens) & 1
        for i in range(1, n):
            whole[i] |= whole[parent[i]]
        sure = own[whole > 0].sum() / total  # of the page's text, what lies in elements that are named as content
        above[1:] = above[up[1:]]
        link_share = linked / np.maximum(chars, 1)
        before, after, long_p = np.array(before), np.array(after), np.array(long_p, float)
        beside = lambda at, values: np.where(at >= 0, values[np.maximum(at, 0)], -1)
        rest = np.maximum(chars[up] - chars - own[up], 0)
        dense = chars / np.maximum(tags, 1) * (1 - link_share)
        columns = [
            group, np.log1p(depth), kids, place, np.where(kids[up] > 0, place / np.maximum(kids[up], 1), 0), np.array(alike),
            np.log1p(chars), link_share, np.log1p(tags), chars / tags, paragraphs / np.maximum(chars, 1), chars / np.maximum(pieces, 1),
            marks / np.maximum(chars, 1), chars / total, first / total, (first + chars) / total, own / np.maximum(chars, 1), link_share[up], np.log1p(chars[up]), chars / np.maximum(chars[up], 1),
            # siblings: what stands before and after, how dense their text is, and how much of it there is
            beside(before, group), beside(after, group), beside(before, np.log1p(chars)), beside(after, np.log1p(chars)), beside(before, link_share), beside(after, link_share),
            beside(before, np.log1p(dense)), beside(after, np.log1p(dense)), np.log1p(rest / np.maximum(kids[up] - 1, 1)), np.log1p(long_p), np.log1p(long_p[up]), np.log1p(own), own[up] / total, np.full(n, sure), np.full(n, np.log1p(total)), dense / max(float(dense.max()), 1.0),
            *[(tokens >> k & 1) for k in range(len(TOKEN_GROUPS))], *[(above >> k & 1) for k in range(len(TOKEN_GROUPS))], *[(over >> k & 1) for k in range(len(_OVER))],
            *[group == k for k in range(len(TAG_GROUPS))],
        ]
        return np.stack([np.asarray(c, float) for c in columns], 1)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Whether each node is inside: the labelling of greatest likelihood whose paths are outside, inside, cut, in this order, each part possibly empty."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        share = np.array(self.share or [1.0] * len(p))
        yes, no = (np.log(p) * share).tolist(), (np.log(1 - p) * share).tolist()
        n = len(yes)
        out, inside, gone = no[:], yes[:], no[:]  # of the whole subtree if its top is outside, inside or cut
        for i in range(n - 1, 0, -1):
            q = self.parent[i]
            out[q] += max(out[i], inside[i])
            inside[q] += max(inside[i], gone[i])
            gone[q] += gone[i]
        state = [0] * n
        for i in range(1, n):
            s = state[self.parent[i]]
            state[i] = 2 if s == 2 else (1 if inside[i] >= gone[i] else 2) if s == 1 else (1 if inside[i] > out[i] else 0)
        return np.array(state) == 1

    def text(self, inside: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if inside[node]:
                blocks.setdefault(block, []).append(text)
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


# ---- pages with known labels ----------------------------------------------------------------------------------------------------


class Writer:
    """Writes one random page; each block element carries the attribute data-y: 1 inside the article, 0 elsewhere."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        letters = "aeiou", "bcdfglmnprstvwh"
        self.words = ["".join(self.r.choice(letters[k % 2]) for k in range(self.r.randint(2, 9))) for _ in range(300)]

    def say(self, low: int, high: int) -> str:
        words = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        for k in range(len(words)):
            if self.r.random() < 0.08:
                words[k] += self.r.choice(",.")
        return " ".join(words).capitalize() + self.r.choice([".", ".", ""])

    def tag(self, name: str, y: int, inner: str, tokens: str = "", open_p: bool = False) -> str:
        kind = self.r.choice(["class", "class", "id", "role" if tokens else "class"])
        attribute = f' {kind}="{tokens}"' if tokens else ""
        made = f"<{name} data-y={y}{attribute}>{inner}" + ("" if open_p and name in ("p", "li") else f"</{name}>")
        if name in ("li", "td", "tr", "legend", "figcaption") or self.r.random() > 0.04:
            return made
        times = self.r.choice([1, 1, 2, 3, 8])
        return f"<div data-y={y}>" * times + made + "</div>" * times

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.say(low, high)}</a>'

    def pick(self, group: int) -> str:
        words = TOKEN_GROUPS[group].split()
        return self.r.choice(["", self.r.choice(words), self.r.choice(words), f"{self.r.choice(self.words)}-{self.r.choice(words)}", self.r.choice(self.words)])

    def list(self, y: int, item: str = "li") -> str:
        return self.tag("ul", y, "".join(self.tag(item, y, self.link(), open_p=self.r.random() < 0.1) for _ in range(self.r.randint(2, 9))))

    def paragraphs(self, y: int, low: int, high: int, short: int = 3, long: int = 90) -> str:
        return "".join(self.tag("p", y, self.inline(short, long), open_p=self.r.random() < 0.15) for _ in range(self.r.randint(low, high)))

    def inline(self, low: int, high: int) -> str:
        text = self.say(low, high)
        if self.r.random() < 0.15:
            text = f"<b>{text}" + ("</b>" if self.r.random() < 0.5 else "<br>")
        if self.r.random() < 0.15:
            text += f" {self.link()} {self.say(2, 12)}"
        return text

    def junk(self, kind: int) -> str:
        r = self.r
        if kind == 1:
            return self.tag(r.choice(["nav", "nav", "div", "ul"]), 0, r.choice([self.list(0), self.list(0) + self.list(0), " ".join(self.link() for _ in range(r.randint(3, 9)))]), self.pick(1))
        if kind == 2:
            return self.tag(r.choice(["header", "header", "div"]), 0, r.choice([self.tag("div", 0, self.say(1, 5)), self.tag("h1", 0, self.link()), self.list(0), self.say(2, 8) + self.junk(1)]), self.pick(2))
        if kind == 3:
            return self.tag(r.choice(["footer", "footer", "div"]), 0, r.choice(["&copy; " + self.say(2, 12), self.list(0) + self.tag("p", 0, self.say(3, 25)), self.tag("p", 0, self.say(5, 30))]), self.pick(3))
        if kind == 4:
            inner = "".join(self.tag("div", 0, self.tag(r.choice(["h2", "h3"]), 0, self.say(1, 3)) + r.choice([self.list(0), self.tag("p", 0, self.say(5, 30))])) for _ in range(r.randint(1, 3)))
            return self.tag(r.choice(["aside", "aside", "div"]), 0, r.choice([inner, self.say(3, 25), self.tag("p", 0, self.say(3, 25))]), self.pick(4))
        if kind == 5:
            return self.tag(r.choice(["div", "section", "aside"]), 0, r.choice([self.say(5, 30), self.tag("p", 0, self.say(5, 30)), self.tag("p", 0, self.say(5, 30)) + "<button>OK</button>"]), self.strong(5))
        if kind == 6:
            return self.tag(r.choice(["div", "div", "aside", "section"]), 0, r.choice([self.say(2, 25), self.tag("p", 0, self.say(3, 25)), self.link(2, 9), self.tag("div", 0, self.link(2, 9))]), self.strong(6))
        if kind == 7:
            return self.tag(r.choice(["form", "form", "div"]), 0, r.choice([f"<label>{self.say(1, 4)}</label><input name=q><button>Go</button>", self.tag("p", 0, self.say(3, 15)) + "<input><button>Send</button>", self.tag("fieldset", 0, self.tag("legend", 0, self.say(1, 3)) + self.tag("p", 0, self.say(2, 8)) + "<input>")]), self.strong(7))
        if kind == 8:
            one = lambda: self.tag(r.choice(["div", "li", "article"]), 0, r.choice([self.tag("p", 0, self.say(3, 40)), self.tag("div", 0, self.say(1, 3)) + self.tag("p", 0, self.say(3, 40)), self.say(3, 40)]), self.pick(8))
            return self.tag(r.choice(["section", "div", "div", "ol"]), 0, (self.tag("h3", 0, "Comments") if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 6))), self.strong(8))
        return self.tag(r.choice(["div", "section", "ul"]), 0, r.choice([self.list(0), self.tag("h3", 0, self.say(1, 3)) + self.list(0), " ".join(self.link(1, 2) for _ in range(r.randint(2, 5)))]), self.strong(9))

    def strong(self, group: int) -> str:
        word = self.r.choice(TOKEN_GROUPS[group].split())
        return self.r.choice([word, word, f"{self.r.choice(self.words)}-{word}", f"{word}-{self.r.choice(self.words)}", f"{word} {self.r.choice(self.words)}"])

    def parts(self, plain: bool = False) -> list[str]:
        """The article's blocks. plain: as of an article that nothing names, which has paragraphs of some length."""
        r, parts = self.r, []
        if r.random() < (0.6 if plain else 0.8):
            h = self.tag("h1", 1, self.say(2, 14))
            parts.append(self.tag("header", 1, h) if r.random() < 0.1 and not plain else h)
        for _ in range(r.choice([2, 3, 5, 9]) if plain else r.choice([1, 1, 2, 3, 5, 9, 14])):
            kind = r.random()
            if plain and kind < 0.75:
                parts.append(self.paragraphs(1, 1, 3, 12, r.choice([25, 40, 90, 200])))
            elif kind < 0.62:
                parts.append(self.paragraphs(1, 1, 3, 1, r.choice([6, 30, 90, 200])))
            elif kind < 0.7:
                parts.append(self.tag(r.choice(["h2", "h3"]), 1, self.say(1, 8)))
            elif kind < 0.76:
                parts.append(self.tag(r.choice(["ul", "ol"]), 1, "".join(self.tag("li", 1, self.inline(1, 25), open_p=r.random() < 0.2) for _ in range(r.randint(2, 6)))))
            elif kind < 0.8:
                parts.append(self.tag("blockquote", 1, r.choice([self.say(5, 40), self.paragraphs(1, 1, 2)])))
            elif kind < 0.83:
                parts.append(self.tag("figure", 1, "<img src=x>" + self.tag("figcaption", 1, self.say(2, 15))))
            elif kind < 0.86:
                rows = "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.say(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 5)))
                parts.append(self.tag("table", 1, rows))
            elif kind < 0.88:
                parts.append(self.tag("pre", 1, self.say(3, 30)))
            elif kind < 0.93:
                parts.append(self.tag(r.choice(["div", "section"]), 1, r.choice([self.paragraphs(1, 1, 3), self.say(8, 80)]), r.choice(["", self.r.choice(self.words)])))
            else:
                parts.append(self.junk(r.choice([4, 5, 6, 6, 7, 9])))
        if r.random() < 0.25:
            parts.append(self.junk(r.choice([8, 9, 7])))
        return parts

    def article(self) -> str:
        r = self.r
        wrap = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        token = self.pick(0) if wrap in ("article", "main") else r.choice(TOKEN_GROUPS[0].split())
        return self.tag(wrap, 1, "".join(self.parts()), token)

    def unnamed(self) -> tuple[str, int]:
        """An article in no element that says so, and whether it is the body's own text."""
        r, kind = self.r, self.r.random()
        if kind < 0.3:
            return "<div data-y=1>" + "".join(self.parts(True)) + "</div>", 0
        if kind < 0.55:
            return "".join(self.parts(True)), 0
        if kind < 0.7:
            side = f"<td data-y=0>{r.choice([self.list(0), self.junk(1), self.junk(4)])}</td>" if r.random() < 0.6 else ""
            cell = f"<td data-y=1>{''.join(self.parts(True))}</td>"
            return "<table data-y=0><tbody data-y=0><tr data-y=0>" + r.choice([side + cell, cell + side]) + "</tr></tbody></table>", 0
        if kind < 0.8:
            return "".join(f"<{t} data-y=1>" + "".join(self.parts(True)) + f"</{t}>" for t in [r.choice(["section", "div"])] * r.randint(2, 4)), 0
        if kind < 0.9:
            text = [self.say(15, 90) for _ in range(r.randint(1, 5))]
            return r.choice(["<br>", "<br><br>", " "]).join(text), 1
        # texts in blocks of their own that aren't paragraphs
        return "<div data-y=1>" + "".join(f"<div data-y=1>{self.inline(12, 60)}</div>" for _ in range(r.randint(2, 6))) + "</div>", 0

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.35
        few = r.random() < 0.4 if plain else False  # as on pages that have hardly anything else
        before = [self.junk(k) for k in (2, 1, 5, 6, 7, 4) if r.random() < ((0.6 if k in (1, 2) else 0.25) * (0.5 if few else 1))]
        after = [self.junk(k) for k in (8, 9, 4, 6, 3, 5) if r.random() < ((0.7 if k == 3 else 0.3) * (0.3 if few else 1))]
        own = 0
        if plain:
            middle, own = self.unnamed()
        else:
            middle = self.article()
            if r.random() < 0.08:
                middle += self.tag("article", 1, "".join(self.parts()), self.pick(0))
        if r.random() < 0.3 and not own:
            beside = self.junk(4) if r.random() < 0.5 else ""
            middle = self.tag(r.choice(["main", "div", "div"]) if not plain else "div", 0, (beside if r.random() < 0.5 else "") + middle + beside, r.choice(["", "wrapper", "container", "page", "row"]))
        body = "".join(before) + middle + "".join(after)
        if r.random() < 0.2 and not own:
            body = self.tag("div", 0, body, r.choice(["wrapper", "page", "site", "container", ""]))
        if r.random() < 0.1 and not own:
            body = f'<form data-y=0 id="{r.choice(["aspnetForm", "form1", "mainForm", self.r.choice(self.words)])}">{body}</form>'
        tail = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.say(2, 8)}</title><style>p{{margin:0}}</style></head><body data-y={own}>{body}{tail}"


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page by Writer."""
    ys: list[int] = [0, 0]
    page = Page.__new__(Page)

    def enter_body(attributes: dict[str, str]) -> None:
        ys[1] = int(attributes.get("data-y", "0"))

    def named(attributes: dict[str, str]) -> int:
        ys.append(int(attributes.get("data-y", "0")))
        return Page.named(attributes)

    page.named, page.enter_body = named, enter_body  # type: ignore[method-assign]
    page.__init__(source)  # type: ignore[misc]
    return page.features(), np.array(ys)


@lru_cache(maxsize=2)
def fit(pages: int = 1500, seed: int = 7) -> gbt.Trees:
    """Trees fitted on so many written pages."""
    both = [labelled(Writer(seed * 100_003 + k).page()) for k in range(pages)]
    return gbt.fit(np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both]).astype(float), trees=60, depth=6, rate=0.2, bins=32)


def main_texts(sources: list[str], model: gbt.Trees) -> list[str]:
    parsed = [Page(s) for s in sources]
    rows = [p.features() for p in parsed]
    scores = model.probability(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, x in zip(parsed, rows, strict=True):
        out.append(p.text(p.decode(scores[at : at + len(x)])))
        at += len(x)
    return out


def extract(pages: DataFrame, model: gbt.Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages; n_chars counts code points.

    A null html is empty, and so is the text of a page without an article. A null page_id or url stays null. Repeated rows give repeated
    rows, an empty table none; other columns of pages, whatever their names, are left alone. Pages may be of any length and depth: time
    grows with a page's length, and wrapping in further elements, however many, doesn't change its text. Markup is read as HTML's
    tokeniser states have it; a tag or comment that never ends reaches to the end of the page.
    """
    trees = model or fit()
    src = common.pick(pages, "page_id", "url", "html")
    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 2):
                for s in range(0, b.num_rows, 256):
                    part = b.slice(s, 256)
                    got = main_texts([x or "" for x in part.column(2).to_pylist()], trees)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
