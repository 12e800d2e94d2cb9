"""Operator 5: main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block; what can't be article text (scripts, menus, forms,
adverts, comments, hidden parts) leaves empty lines, structure alone leaves none. The lengths of the lines
are summed over a sliding window. The text surges where a window's sum rises above a threshold and dives
where the sum falls to nothing; what stands between is kept whole, short lines too, and so is what shares
a container with the longest range. Where a page names its articles, the longest one stays and each other
one in which the text surges, stands in two lines or more that aren't links, or ends a sentence (a teaser of
a title doesn't); of these, and of a main part that is named, any text is a surge.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = frozenset("head title nav menu aside footer form button select option textarea label fieldset legend dialog".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or id that mark what isn't the article: anywhere, or only where no word of OWN stands beside.
NEVER = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion comment comments disqus respond reply replies sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar skip".split()
)
BESIDE = frozenset("header footer masthead top bottom widget meta tools".split())
OWN = frozenset("article content post entry story main body text".split())
#: Words that may stand beside one of NEVER in a name; another one makes the name a subject's, as in comments-on-law.
PARTS = frozenset(
    "area author bar block box button buttons col container count facebook form group head heading icon icons inner item items leaderboard left link links list outer overlay page panel posts primary rail rectangle right row secondary section site slot sticky thread title twitter unit wrap wrapper".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|audio|video)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Line:
    text: str
    length: int
    linked: int
    scope: tuple[int, int]
    node: int


IN_NAMES = NEVER | BESIDE | OWN | PARTS


def words_of(name: str) -> set[str]:
    """The words of a class or id, without numbers."""
    return set(re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def excluded(name: str, attrs: str, in_scope: bool) -> bool:
    """Whether an element can't hold article text."""
    if name in NO_TEXT or name == "header" and not in_scope:
        return True
    if not attrs or attrs.isspace():
        return False
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in NO_ROLE:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if name in ("body", "html", "article", "main") and not re.search("comment", own.get("class", "") + own.get("id", ""), re.I):
        return False
    names = [words_of(x) for x in f"{own.get('class', '')} {own.get('id', '')}".split()]
    said = set().union(*names)
    return any(x & NEVER and x <= IN_NAMES for x in names) or bool(said & BESIDE and not said & OWN)


@dataclass
class Stripper:
    """Turns a page into lines."""

    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    stack: list[tuple[str, bool]] = field(default_factory=list)
    skip: int = 0
    links: int = 0
    article: int = 0
    articles: int = 0
    main: int = 0
    #: Elements by number in the order of their starts (0 is the page): name, parent, last number within.
    names: list[str] = field(default_factory=lambda: ["html"])
    up: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    open_: list[int] = field(default_factory=lambda: [0])

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        scope = (self.articles if self.article else 0, 1 if self.main else 0)
        if text or self.skip:
            self.lines.append(Line(text, len(text), self.linked, scope, self.open_[-1]))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.skip:
            t = unescape(raw) if "&" in raw else raw
            self.parts.append(t)
            if self.links:
                self.linked += len(t.strip())

    def pop(self) -> None:
        name, skipped = self.stack.pop()
        self.last[self.open_.pop()] = len(self.up) - 1
        self.skip -= skipped
        self.links -= name == "a"
        self.article -= name == "article"
        self.main -= name == "main"

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self.flush()
            names = [n for n, _ in self.stack[-6:]]
            implied = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ("p",))
            for other in implied:
                if other in names and not (set(names[len(names) - names[::-1].index(other) :]) & BLOCK):
                    while self.stack[-1][0] != other:
                        self.pop()
                    self.pop()
                    break
        elif name == "br":
            self.text(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            return
        skipped = excluded(name, attrs, bool(self.article or self.main))
        self.stack.append((name, skipped))
        self.names.append(name)
        self.up.append(self.open_[-1])
        self.last.append(0)
        self.open_.append(len(self.up) - 1)
        self.skip += skipped
        self.links += name == "a"
        self.main += name == "main"
        if name == "article":
            self.article += 1
            self.articles += self.article == 1

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if any(n == name for n, _ in self.stack):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def run(self, html: str) -> list[Line]:
        at = 0
        for m in TOKEN.finditer(html):
            self.text(html[at : m.start()])
            at = m.end()
            if name := m["name"]:
                (self.close(name.lower()) if m["end"] else self.open(name.lower(), m["attrs"]))
        self.text(html[at:])
        self.flush()
        for node in self.open_:
            self.last[node] = len(self.up) - 1
        return self.lines

    def beside(self, own: list[int], others: list[int]) -> set[int]:
        """Those of the elements `others` that share the container of `own`: the least element around `own`
        that holds one of the others too. Of the body itself, only its direct children count."""
        low, high = min(own), max(own)
        at = low
        while self.names[at] not in ("body", "html"):
            if self.last[at] >= high and (found := {x for x in others if at <= x <= self.last[at]}):
                return found
            at = self.up[at]
        return {x for x in others if at in (x, self.up[x])} if any(at in (x, self.up[x]) for x in own) else set()


def surges(lengths: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """Line ranges from a surge to its dive."""
    n, sums, total = len(lengths), [], sum(lengths[:window])
    for i in range(n):
        sums.append(total)
        total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    out, i = [], 0
    while i < n:
        if lengths[i] and sums[i] > threshold:
            j = i
            while j < n and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def own_text(lines: list[Line], window: int, threshold: int) -> bool:
    """Whether an article is one beside the page's longest."""
    said = [x.text for x in lines if x.length and 2 * x.linked <= x.length]
    return len(said) > 1 or any(t.endswith((".", "!", "?", "\u3002")) for t in said) or bool(surges([x.length for x in lines], window, threshold))


def extract(html: str, window: int = 3, threshold: int = 80) -> str:
    """The main text of a page, one line for each block."""
    stripper = Stripper()
    lines = stripper.run(html)
    best: dict[int, int] = {}
    for x in lines:
        if x.scope[0]:
            best[x.scope[0]] = best.get(x.scope[0], 0) + x.length
    if best and any(best.values()):
        most = max(best, key=lambda k: (best[k], -k))
        of: dict[int, list[Line]] = {k: [] for k in best}
        for x in lines:
            if x.scope[0]:
                of[x.scope[0]].append(x)
        stay = {k for k in best if k == most or own_text(of[k], window, threshold)}
        kept = [x for x in lines if x.scope[0] in stay]
        found = surges([x.length for x in kept], max(window, len(kept)), 0)
    elif any(x.scope[1] and x.length for x in lines):
        kept = [x for x in lines if x.scope[1]]
        found = surges([x.length for x in kept], max(window, len(kept)), 0)
    else:
        kept = lines
        lengths = [x.length if 2 * x.linked <= x.length else 0 for x in kept]
        found = surges(lengths, window, threshold) or surges(lengths, window, 0)
        if found:
            a, b = max(found, key=lambda r: sum(lengths[r[0] : r[1]]))
            inside = {i for r in found for i in range(*r)}
            rest = [i for i, n in enumerate(lengths) if n and not a <= i < b]
            near = stripper.beside([x.node for x, n in zip(kept[a:b], lengths[a:b], strict=True) if n], [kept[i].node for i in rest])
            inside.update(i for i in rest if kept[i].node in near)
            found = [(i, i + 1) for i in sorted(inside)]
    return "\n".join(x.text for a, b in found for x in kept[a:b] if x.text)


def main_text(pages: DataFrame, window: int = 3, threshold: int = 80) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars.

    window: lines of the sliding window. threshold: characters of a window above which text surges, where
    a page names no article. A null or empty page has an empty text; rows are independent, so repeated
    rows repeat; an empty table gives an empty one; further columns are ignored. Pages of any length are
    read whole.
    """

    def run(ids: list, urls: list, pages_: list) -> list:
        text = [extract((h or b"").decode("utf-8", "replace"), window, threshold) for h in pages_]
        return [ids, [u and u.decode("utf-8", "replace") for u in urls], text, [len(t) for t in text]]

    return map_columns(
        pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long",
        pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]),
    )
