"""Markup as tokens and as a stack of open elements, and table functions over pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of HTML: elements without content; with content that is neither markup nor shown; with text only.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style iframe noembed noframes".split())
PLAIN = frozenset("title textarea".split())
#: Fixed values of HTML: elements before which an open paragraph ends, and the parts of a table.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
CELLS = frozenset("table td th caption".split())
#: What else ends where an element opens: (elements it ends, elements that the search doesn't leave).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", *CELLS}), "dt": ({"dt", "dd"}, {"dl", *CELLS}), "dd": ({"dt", "dd"}, {"dl", *CELLS}),
    "option": ({"option"}, {"select", "datalist"}), "a": ({"a"}, CELLS), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^ \t\n\f\r/>]*)|([!?/]))")
_BEFORE = re.compile(r"[ \t\n\f\r/]*")
_ATTRIBUTE = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(\"|'|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*)?)?")
_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I) for name in (*HIDDEN, *PLAIN)}
_HARD_SPACE = re.compile(r"&(?:nbsp;?|#0*160;?|#[xX]0*[aA]0;?)")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*;?))")


def decoded(text: str, closed: bool = False) -> str:
    """All named and numeric references of a text; those to a no-break space become a space. With `closed`,
    a reference without its semicolon stays as it stands, as XML says."""
    if "&" not in text:
        return text
    if not closed:
        return unescape(_HARD_SPACE.sub(" ", text))

    def one(m: re.Match) -> str:
        known = m[0][1] == "#" or m[0][1:] in html5
        return " " if _HARD_SPACE.fullmatch(m[0]) else unescape(m[0]) if known else m[0]

    return _CLOSED.sub(one, text)


def _value(text: str) -> str:
    """References of an attribute's value: a name counts as a whole only, so `?a=1&copy=2` stays."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        name, after = m[1], text[m.end() : m.end() + 1]
        return m[0] if name and (name not in html5 or not name.endswith(";") and after == "=") else unescape(m[0])

    return _REFERENCE.sub(one, text)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from a place within a tag (the first of a name counts), and the place after the tag; -1 if
    the page ends within it."""
    found: dict[str, str] = {}
    while True:
        at = _BEFORE.match(html, at).end()
        if at >= len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(html, at)
        at, value = m.end(), m[2] or ""
        if value in ("'", '"'):
            end = html.find(value, at)
            if end < 0:
                return found, -1
            value, at = html[at:end], end + 1
        found.setdefault(m[1].lower(), _value(value))


def tokens(html: str, closed: bool = False) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text), ("open", name, attributes) and ("close", name) of a page, in one pass.

    Comments, declarations and what HIDDEN elements hold give nothing; a tag, comment or quote that the page
    doesn't end reaches to its end, as HTML says. For `closed` see `decoded`.
    """
    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            yield "text", decoded(html[at:stop], closed), None
        if not m:
            return
        at = m.end()
        if m[1]:
            if html.startswith((">", "->"), at):
                at = html.index(">", at) + 1
                continue
            ends = [k + n for x, n in (("-->", 3), ("--!>", 4)) if (k := html.find(x, at)) >= 0]
            at = min(ends, default=len(html))
        elif m[4]:
            at = html.find(">", at) + 1 or len(html)
        else:
            attributes, at = _attributes(html, at)
            if at < 0:
                return
            name = m[3].lower()
            if m[2]:
                yield "close", name, None
                continue
            yield "open", name, attributes
            if name in _END:
                end = _END[name].search(html, at)
                stop = end.start() if end else len(html)
                if name in PLAIN and stop > at:
                    yield "text", decoded(html[at:stop], closed), None
                at = stop


_SPACE = re.compile(r"[ \t\r\n]+")


def spaced(parts: list[str]) -> str:
    """Pieces of text with a space where markup stood, white space collapsed."""
    return _SPACE.sub(" ", " ".join(parts)).strip(" ")


def text_of(html: str, closed: bool = False) -> str:
    """A page's text in reading order."""
    return spaced([t for kind, t, _ in tokens(html, closed) if kind == "text"])


def elements(html: str, tags: frozenset[str] | None = None, closed: bool = False) -> list[tuple[int, int | None, int, str, dict[str, str], str]]:
    """(ord, parent, depth, tag, attributes, text) of the elements of some tags (None: all), in page order.

    `parent` is the ord of the nearest such element around it and `depth` their number. A stack of open
    elements gives each end tag to the innermost open element of its name; end tags without one are left
    out, elements without an end tag end with what holds them or where ENDS says. Tables aren't left by end
    tags within their cells. The text of an element includes that of the elements in it.
    """
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, ord or -1, pieces of text before it
    live: Counter[str] = Counter()
    chosen: list[int] = []
    out: list[list] = []

    def end(k: int) -> None:
        while len(stack) > k:
            name, own, begin = stack.pop()
            live[name] -= 1
            if own >= 0:
                chosen.pop()
                out[own][5] = spaced(parts[begin:])

    def last(names, stops) -> int:
        """Place of the innermost open element of some names, -1 if there is none this side of `stops`."""
        if any(live[x] for x in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in stops:
                    break
        return -1

    for kind, value, attributes in tokens(html, closed):
        if kind == "text":
            parts.append(value)
        elif kind == "close":
            k = last((value,), () if value == "table" else ("table",) if value in TABLE else CELLS)
            if k >= 0:
                end(k)
        else:
            for names, stops in ((({"p"}, {"button", *CELLS}),) if value in BLOCKS else ()) + ((ENDS[value],) if value in ENDS else ()):
                k = last(names, stops)
                if k >= 0:
                    end(k)
            own = -1
            if tags is None or value in tags:
                own = len(out)
                out.append([own, chosen[-1] if chosen else None, len(chosen), value, attributes, ""])
            if value not in VOID:
                stack.append((value, own, len(parts)))
                live[value] += 1
                if own >= 0:
                    chosen.append(own)
    end(0)
    return [tuple(x) for x in out]


def element_rows(tags: list[str] | None, closed: bool = False):
    """A table function: html -> the rows of `elements`; a null page has none."""
    wanted = None if tags is None else frozenset(t.lower() for t in tags)

    @F.udtf(returnType="ord int, parent int, depth int, tag string, attributes map<string,string>, text string")
    class Elements:
        def eval(self, html: str):
            yield from elements(html or "", wanted, closed)

    return Elements


def feature_rows(features: dict[str, tuple[tuple[str, ...], str | None]]):
    """A table function: html -> (feature, n) of the start tags that features name, with n > 0."""
    by_tag: dict[str, list[tuple[str, str | None]]] = {}
    for feature, (tags, attribute) in features.items():
        for tag in tags:
            by_tag.setdefault(tag, []).append((feature, attribute))

    @F.udtf(returnType="feature string, n long")
    class Features:
        def eval(self, html: str):
            found = Counter(
                feature for kind, tag, attributes in tokens(html or "") if kind == "open"
                for feature, attribute in by_tag.get(tag, ()) if attribute is None or attribute in attributes
            )
            yield from found.items()

    return Features


def page_text(html: Column, closed: bool = False) -> Column:
    """`text_of` for a column; null stays null."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda t: None if t is None else text_of(t, closed))

    return run(html)
