"""Main text of web pages by a linear-chain conditional random field.

A page is parsed into leaf blocks, runs of inline content between block-level
tags, each with its open ancestors. The field labels every block as main text
or not, from features of ancestor tags, class words and the text, and from
its neighbours' labels; Viterbi decoding picks the likeliest labelling of the
page. It is trained on labelled pages that ``labelled_pages`` lays out in many
ways.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: HTML elements without content, with raw content, and those that separate blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that may stand in a head; the start of any other ends it, and an unclosed title.
IN_HEAD = frozenset("html head title base link meta style script noscript template".split())
#: Elements whose start ends an open element of the same kinds, unless one of BOUNDS stands between.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - frozenset("body button caption frameset head html legend optgroup option tbody td tfoot th thead title tr".split())
BOUNDS = frozenset("table ul ol dl select div article section body td".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?/])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+")
#: Most class words of one element that are features.
NAMES = 16


class Path:
    """An open element and, through ``parent``, those around it.

    ``fresh`` are the buckets of tags and class words that no element around
    has; ``top`` those of the innermost block elements. ``worth`` is the sum
    of their weights under the field that last asked.
    """

    __slots__ = ("parent", "fresh", "solid", "heading", "hidden", "worth")

    def __init__(self, parent: Path | None, tag: str, names: str, fresh: tuple[int, ...]):
        self.parent, self.fresh, self.worth = parent, fresh, None
        solid = parent.solid if parent else ()
        self.solid = ((tag, names), *solid[:2]) if tag in BLOCK else solid
        self.heading = tag == "h1" or bool(parent and parent.heading)
        self.hidden = tag in ("head", "title") or bool(parent and parent.hidden)

    def features(self) -> tuple[int, ...]:
        found, at = [*_top(self.solid)], self
        while at:
            found += at.fresh
            at = at.parent
        return tuple(found)


@dataclass
class Block:
    """A leaf block: its text, the characters of it within links, and its innermost open element."""

    text: str
    linked: int
    path: Path | None


@lru_cache(maxsize=4096)
def _names(attributes: str) -> str:
    found = dict.fromkeys(p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[1]))
    return " ".join(list(found)[:NAMES])


class _Stack:
    """The open elements. Every operation takes constant time for each element opened or closed."""

    def __init__(self):
        self.open: list[tuple[str, Path, tuple[int, ...]]] = []
        self._at: dict[str, list[int]] = {}
        self._bounds: list[int] = []
        self._held: dict[int, int] = {}

    def path(self) -> Path | None:
        return self.open[-1][1] if self.open else None

    def many(self, tag: str) -> int:
        return len(self._at.get(tag, ()))

    def last(self, tags) -> int:
        """Place of the innermost of these tags, or -1."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def bound(self) -> int:
        return self._bounds[-1] if self._bounds else -1

    def push(self, tag: str, names: str) -> None:
        keys = _own(tag, names)
        fresh = tuple(k for k in keys if not self._held.get(k))
        for k in fresh:
            self._held[k] = 1
        if tag in BOUNDS:
            self._bounds.append(len(self.open))
        self._at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, Path(self.path(), tag, names, fresh), fresh))

    def cut(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        while len(self.open) > place:
            tag, _, fresh = self.open.pop()
            self._at[tag].pop()
            if tag in BOUNDS:
                self._bounds.pop()
            for k in fresh:
                self._held[k] = 0

    def leave_head(self) -> None:
        for tag in ("head", "title"):
            if self._at.get(tag):
                self.cut(self._at[tag][0])


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks with text, in page order; markup in any state is accepted, in linear time.

    Character references are decoded and white space becomes one space. A
    ``<`` that opens no markup, or none that ends, is text; an unclosed
    comment reaches to the end, as does an unclosed script. Once a tag's
    quotes don't close, quotes no longer hide the ends of later tags.
    """
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    last, quotes, cdata = html.rfind(">"), True, True

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if stack.many("a"):
                linked += len(piece)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            found = " ".join(unescape("".join(parts)).split())
            path = stack.path()
            if found and not (path and path.hidden):
                out.append(Block(found, linked, path))
            parts, linked = [], 0

    at, size = 0, len(html)
    while at < size:
        m = _OPEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        start = m.start()
        if m[3]:
            text(html[at:start])
            end = html.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        if start > last:  # nothing ends after here; only a comment could still hide text
            comment = html.find("<!--", start)
            text(html[at : comment if comment >= 0 else size])
            break
        text(html[at:start])
        if m[4] and cdata:
            end = html.find("]]>", m.end())
            if end >= 0:
                text(html[m.end() : end])
                at = end + 3
                continue
            cdata = False
        if m[2] is None:
            at = html.find(">", m.end()) + 1
            continue
        name, rest = m[2].lower(), None
        if quotes:
            rest = _REST.match(html, m.end())
            quotes = rest is not None
        at = rest.end() if rest else html.find(">", m.end()) + 1
        attributes = html[m.end() : at]
        if m[1]:
            if name in BLOCK:
                flush()
            place = stack.last((name,))
            if place >= 0:
                stack.cut(place)
            continue
        if name in RAW and not (name == "svg" and attributes.endswith("/>")):
            end = _closing(name).search(html, at)
            at = size if end is None else html.find(">", end.end()) + 1 or size
            continue
        if name in BLOCK:
            flush()
        if name not in IN_HEAD:
            stack.leave_head()
        if name in BLOCK:
            closed = ENDS.get(name, set()) | ({"p"} if name in ENDS_P else set())
            place = stack.last(closed)
            if place >= 0 and place >= stack.bound():
                stack.cut(place)
        if name == "br":
            text(" ")
        if name not in VOID:
            stack.push(name, _names(attributes))
    flush()
    return out


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


BUCKETS = 1 << 15


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@lru_cache(maxsize=20_000)
def _own(tag: str, names: str) -> tuple[int, ...]:
    """Buckets of an element anywhere around a block."""
    return tuple(dict.fromkeys([_bucket(f"in:{tag}"), *(_bucket(f"name:{w}") for w in names.split())]))


@lru_cache(maxsize=20_000)
def _top(solid: tuple[tuple[str, str], ...]) -> tuple[int, ...]:
    """Buckets of the innermost block elements, from the inside out."""
    found = {f"up{k}:{tag}" for k, (tag, _) in enumerate(solid)} | {f"near:{w}" for _, names in solid[:2] for w in names.split()}
    return tuple(sorted({_bucket(f) for f in found}))


def features(page: list[Block]) -> list[tuple[int, ...]]:
    """Buckets of each block's own features, without those of its path."""
    out, heading = [], False
    for i, b in enumerate(page):
        words = b.text.split()
        n, chars = len(words), len(b.text)
        density = round(4 * min(1.0, b.linked / max(chars, 1)))
        heading = heading or bool(b.path and b.path.heading)
        found = [
            f"words:{min(n, 4) if n < 5 else 3 + n.bit_length()}", f"links:{density}", f"end:{b.text[-1] if not b.text[-1].isalnum() else 'a'}",
            f"stops:{min(sum(w[-1] in '.!?' for w in words), 3)}", f"after:{heading}", f"rank:{min(i, 3)}", f"left:{min(len(page) - 1 - i, 3)}",
            f"long:{n > 12}&{density == 0}",
        ]
        if n <= 14:
            found += [f"word:{w.strip('.,:;!?()').lower()}" for w in words]
        out.append(tuple({_bucket(f) for f in found}))
    return out


def whole_features(page: list[Block]) -> list[tuple[int, ...]]:
    """Buckets of each block's own features and of its path."""
    return [(*(b.path.features() if b.path else ()), *own) for b, own in zip(page, features(page), strict=True)]


@dataclass
class Field:
    """Weights of a two-label chain: ``emit`` by bucket and label, ``move`` by label pair, ``start``."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def _worth(self, path: Path | None) -> tuple[float, float]:
        """The weights of a path's features; each element's are summed once."""
        todo = []
        while path and (path.worth is None or path.worth[0] is not self):
            todo.append(path)
            path = path.parent
        w0, w1 = path.worth[1:] if path else (0.0, 0.0)
        for p in reversed(todo):
            if p.fresh:
                a, b = self.emit[list(p.fresh)].sum(0).tolist()
                w0, w1 = w0 + a, w1 + b
            p.worth = (self, w0, w1)
        return w0, w1

    def label(self, page: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        around = []
        for b in page:
            w0, w1 = self._worth(b.path)
            a0, a1 = self.emit[list(_top(b.path.solid))].sum(0).tolist() if b.path and b.path.solid else (0.0, 0.0)
            around.append((w0 + a0, w1 + a1))
        return self.decode(features(page), around)

    def decode(self, found: list[tuple[int, ...]], around: list[tuple[float, float]] | None = None) -> list[int]:
        """The likeliest labels by Viterbi; on a tie, label 0. ``around`` is added to the weights of the features."""
        if not found:
            return []
        emit = self.emit
        best, back = None, []
        (m00, m01), (m10, m11) = self.move.tolist()
        for i, keys in enumerate(found):
            e0, e1 = emit[list(keys)].sum(0).tolist()
            if around:
                e0, e1 = e0 + around[i][0], e1 + around[i][1]
            if best is None:
                best = (self.start[0] + e0, self.start[1] + e1)
                continue
            a0, b0, a1, b1 = best[0] + m00, best[1] + m10, best[0] + m01, best[1] + m11
            back.append((int(b0 > a0), int(b1 > a1)))
            best = (max(a0, b0) + e0, max(a1, b1) + e1)
        label = int(best[1] > best[0])
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 150, rate: float = 0.1, shrink: float = 1e-4) -> Field:
    """Maximise the likelihood of the labels, by forward-backward over all pages at once."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Field()
    longest, count = max(len(f) for f, _ in pages), len(pages)
    slot, keys = [], []
    there, gold = np.zeros((longest, count), bool), np.zeros((longest, count), int)
    for j, (found, labels) in enumerate(pages):
        for i, (own, label) in enumerate(zip(found, labels, strict=True)):
            keys += own
            slot += [i * count + j] * len(own)
            there[i, j], gold[i, j] = True, label
    keys, slot = np.array(keys), np.array(slot)
    used, column = np.unique(keys, return_inverse=True)
    emit, move, start = np.zeros((len(used), 2)), np.zeros((2, 2)), np.zeros(2)
    lengths, every = there.sum(0), np.arange(count)
    hot = np.eye(2)[gold] * there[..., None]
    gold_move = np.einsum("tna,tnb->ab", hot[:-1], hot[1:]) if longest > 1 else np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move, start)]
    for r in range(1, rounds + 1):
        e = np.stack([np.bincount(slot, emit[column, k], longest * count) for k in (0, 1)], -1).reshape(longest, count, 2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, longest):
            alpha[t] = np.where(there[t][:, None], np.logaddexp(alpha[t - 1][:, :1] + move[0], alpha[t - 1][:, 1:] + move[1]) + e[t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[t + 1] + e[t + 1]
            new = np.stack([np.logaddexp(ahead[:, 0] + move[k, 0], ahead[:, 1] + move[k, 1]) for k in (0, 1)], -1)
            beta[t] = np.where(there[t + 1][:, None], new, 0)
        total = np.logaddexp(*alpha[lengths - 1, every].T)
        p = np.exp(alpha + beta - total[None, :, None]) * there[..., None]
        pair = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]) * there[1:, :, None, None]
        d = (p - hot).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(column, d[slot, k], len(used)) for k in (0, 1)], -1) / count + shrink * emit,
            (pair.sum((0, 1)) - gold_move) / count + shrink * move,
            (p[0] - hot[0]).sum(0) / count + shrink * start,
        ]
        for x, g, s in zip((emit, move, start), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= rate * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-8)
    out = Field(move=move, start=start)
    out.emit[used] = emit
    return out


#: Words that pages of the web use for what is and is not their main text.
_MAIN = "content main post entry story article body text page".split()
_SIDE = {
    "nav": "menu nav navigation navbar topnav breadcrumb breadcrumbs links skip".split(),
    "header": "header masthead top branding logo banner site".split(),
    "footer": "footer bottom copyright legal colophon site".split(),
    "aside": "sidebar aside related widget recommended rail trending popular".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie notice consent banner alert popup gdpr newsletter modal".split(),
    "form": "form search login subscribe signup newsletter contact".split(),
    "comments": "comments comment discussion replies responses disqus thread".split(),
    "share": "share social tags meta byline toolbar".split(),
}
_SAID = {
    "nav": "home about contact news archive login products services blog help".split(),
    "header": "welcome search sign in the official site of".split(),
    "footer": "© copyright all rights reserved privacy policy terms imprint contact".split(),
    "aside": "related most read popular latest see also recommended more".split(),
    "ad": "advertisement sponsored buy now offer sale discount click here".split(),
    "notice": "cookies we use accept consent privacy agree subscribe newsletter".split(),
    "form": "name email password search submit send subscribe comment".split(),
    "comments": "reply comments says wrote ago report like great thanks".split(),
    "share": "share tweet facebook print email tags posted by".split(),
}


class _Layout:
    """Lays out one labelled page; ``parts`` holds html, ``gold`` whether each block is main text."""

    def __init__(self, seed: int):
        self.r, self.parts, self.gold = random.Random(seed), [], []
        self.letters = self.r.sample(["er", "an", "th", "ou", "le", "ción", "ung", "ti", "re", "on", "es", "ä", "é", "st", "ba", "mi", "lo"], 11)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + self.r.choice(["."] * 8 + ["!", "?", " %%%", ""]) for _ in range(self.r.randint(low, high)))

    def put(self, tag: str, text: str, main: bool, names: str = "", close: bool = True) -> None:
        self.parts.append(f"<{tag}{names}>{text}" + (f"</{tag}>" if close else ""))
        self.gold.append(main)

    def named(self, options: list[str], chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        word = r.choice(options)
        if r.random() < 0.3:
            word += r.choice(["-", "_", " "]) + r.choice(["wrap", "box", "inner", "area", *options])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def links(self, kind: str, low: int, high: int) -> None:
        self.parts.append("<ul>")
        for _ in range(self.r.randint(low, high)):
            own = self.r.choice(_SAID[kind]) if self.r.random() < 0.3 else self.words(1, 3)
            self.put("li", f'<a href="/{own}">{own}</a>', False, close=self.r.random() < 0.8)
        self.parts.append("</ul>")

    def side(self, kind: str) -> None:
        r = self.r
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.75 else r.choice(["div", "div", "section"])
        names = self.named(_SIDE[kind], 0.4 if tag == kind else 1.0)
        said = lambda: " ".join(r.sample(_SAID[kind], r.randint(1, 3)))
        style = r.random()
        if kind in ("nav", "share") or (kind in ("aside", "header", "footer") and style < 0.4):
            self.parts.append(f"<{tag}{names}>")
            if r.random() < 0.3:
                self.put(r.choice(["h2", "h3", "p"]), said(), False)
            self.links(kind, 2, 8)
        elif kind == "comments":
            self.parts.append(f"<{tag}{names}>")
            self.put("h3", said(), False)
            for _ in range(r.randint(1, 5)):
                self.parts.append(f'<div{self.named(["comment", "reply", "message"])}>')
                if r.random() < 0.5:
                    self.put("p", self.words(1, 2) + " " + said(), False)
                self.put("p", self.sentences(1, 4), False)
                self.parts.append("</div>")
        elif kind == "form":
            self.parts.append(f"<{tag}{names}>")
            self.put("p", said(), False)
            self.parts.append('<input name="q">')
            self.put("button", said(), False)
        elif style < 0.7:
            self.parts.append(f"<{tag}{names}>")
            self.parts.append(self.sentences(1, 3) if r.random() < 0.7 else said() + " " + self.words(2, 9))
            self.gold.append(False)
        else:
            self.parts.append(f"<{tag}{names}>")
            for _ in range(r.randint(1, 3)):
                self.put(r.choice(["p", "p", "h3", "div"]), said() + " " + self.sentences(0, 2), False)
        self.parts.append(f"</{tag}>")

    def main(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        names = self.named(_MAIN, 0.9 if tag in ("div", "section") else 0.3)
        self.parts.append(f"<{tag}{names}>")
        if r.random() < 0.75:
            self.put("h1", self.words(1, 10) + r.choice(["", ".", " &amp; " + self.words(1, 2)]), True)
        if r.random() < 0.12:
            self.side("share")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.08:
                self.put(r.choice(["h2", "h3"]), self.words(1, 6), True)
            elif kind < 0.12:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.put("li", self.words(1, 12), True)
                self.parts.append("</ul>")
            elif kind < 0.15:
                self.put("blockquote", self.sentences(1, 3), True)
            elif kind < 0.18:
                self.side(r.choice(["ad", "aside", "share"]))
            elif kind < 0.3:
                self.put("p", "<b>" + self.sentences(1, 4) + "<br>", True, close=False)
            else:
                words = self.sentences(1, 8)
                if r.random() < 0.2:
                    words += f' <a href="#">{self.words(1, 3)}</a> ' + self.words(1, 4) + "."
                self.put("p", words, True, close=r.random() < 0.9)
        self.parts.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.parts.append(f'<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        bare = r.random() < 0.2
        for kind, chance in () if bare else (("notice", 0.25), ("header", 0.4), ("nav", 0.8), ("form", 0.2), ("ad", 0.45), ("aside", 0.15)):
            if r.random() < chance:
                self.side(kind)
        if r.random() < 0.97:
            self.main()
        for kind, chance in () if bare else (("share", 0.15), ("comments", 0.3), ("aside", 0.3), ("form", 0.2), ("ad", 0.25), ("nav", 0.1), ("notice", 0.15), ("footer", 0.85)):
            if r.random() < chance:
                self.side(kind)
        self.parts.append("</body></html>")
        return "".join(self.parts), [int(g) for g in self.gold]


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Pages with a label for each of their leaf blocks, 1 for main text."""
    return [_Layout(seed * 1_000_003 + i).page() for i in range(count)]


#: Labelled pages that the production field is trained on.
TRAINING_PAGES = 1200


def train(count: int = TRAINING_PAGES, seed: int = 1) -> Field:
    """A field trained on ``count`` labelled pages."""
    pages = []
    for html, gold in labelled_pages(count, seed):
        page = blocks(html)
        if len(page) == len(gold):
            pages.append((whole_features(page), gold))
    return fit(pages)


def main_text(html: str, model: Field) -> str:
    """The page's main blocks, one a line; empty if there are none."""
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, model.label(page), strict=True) if label)


def extract(pages: DataFrame, model: Field, key: str | list[str] = "page_id", html: str = "html") -> DataFrame:
    """``*key, text`` of each page's whole html, a row for each row, repeated or not.

    Null or empty html, and pages without main text, give the empty text; very
    long and malformed pages take linear time; an empty table gives no rows;
    other columns, whatever their names, play no part.
    """
    return map_texts(pages, "text string", lambda: lambda page: (main_text(page, model),), key, html)
