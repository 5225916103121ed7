"""Main text of HTML pages by line-block distribution.

A page is cut into *lines*: one for each run of text between block-level tags. A line weighs as many characters as it has outside links, times a
factor for where it stands: more inside an element marked as an article (``article``, ``main`` or their ARIA role), much less inside one whose class, id or
role names an advert, notice, menu, sidebar or comments, a bit less where such a word is only part of a name (``ad-hoc``). Markup that is no
text of the page (scripts, styles, forms, navigation, footers, asides, hidden parts) is left out before.

Lines of equal standing (the same article, the same factor) form a sequence. Along each, weights are summed over a sliding window; a *surge* is where the sum leaves
zero, the *dive* after it where it has fallen to zero again, which takes a window's length of lines that weigh nothing, such as a list of links. What lies
between is a run, as strong as its highest sum. Kept are the runs that reach a share of the strongest run of the page and, where no article is marked,
a number of characters; and the runs beside them under the same parent. So marks and names never decide by themselves: an article of short teasers, one that calls
itself a comment or a promotion, falls below the share of the real one, and a story inside a box with an unlucky name is still the strongest.

White space inside a line becomes one space, lines are joined by one space. Character references are decoded as HTML5 does. Null and
empty pages give the empty text.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Lines in the window.
WINDOW = 3
#: A surge reaches this many characters a window, where no article is marked.
SURGE = 80
#: Of the strongest run, a further one must have this share.
SHARE = 0.2
#: A line is links if they have more than this share of it.
LINK_SHARE = 0.5
#: Factors of a line's weight: in a marked article, under a name that is all boilerplate, under one that holds such a word among others.
MARKED, NAMED, HINTED = 3.0, 0.005, 0.2
#: Text under a name that is all boilerplate needs so many times the characters to be taken for an article all the same.
MISNAMED = 10

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Nothing in them is main text.
BOILER = frozenset(
    "script style textarea title xmp iframe noembed noframes plaintext head nav header footer aside form template noscript dialog menu button select "
    "object svg canvas audio video map datalist fieldset".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary svg table "
    "tbody td template textarea tfoot th thead title tr ul video".split()
)
MAIN = frozenset("article main".split())
#: A paragraph ends where one of them begins, and each of them at the next of its kind.
CLOSES_P = BLOCK - frozenset("br button option".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select", "datalist"}}

#: Words of a class, id or role that name boilerplate,
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside complementary header masthead footer contentinfo cookie cookies consent gdpr alert notice notices newsletter subscribe signup login search teaser teasers "
    "comment comments disqus reply replies respond discussion share sharing social related recommended widget widgets popup modal toolbar pagination pager skip copyright".split()
)
#: and words that say nothing beside them: ``ad-box`` is an advert, ``ad-hoc`` need not be.
NEUTRAL = frozenset(
    "a an the of and box list lists item items area section block unit slot container wrap wrapper inner outer bar bars links link buttons button icons form thread posts post "
    "top bottom left right main site page global primary secondary text body title count group row col column js id no".split()
)
#: Of an article's own parts these words speak of its head.
HEAD_WORDS = frozenset("header masthead banner".split())
#: Their names list what the whole page has.
WHOLE = frozenset("html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _name_factor(value: str, inside: bool, hints: bool) -> float:
    """What the names in a class, id or role make of a line's weight."""
    out = 1.0
    for name in value.lower().split():
        words = set(_WORDS.findall(name))
        bad = words & BAD_WORDS
        if not bad or inside and bad <= HEAD_WORDS:
            continue
        if words - BAD_WORDS <= NEUTRAL:
            return NAMED
        if hints:
            out = HINTED
    return out


def _standing(attrs: str, name_of: str, inside: bool) -> tuple[float, bool]:
    """(factor, marked as an article) of an element by its attributes; a factor of 0 is hidden."""
    factor, marked = 1.0, False
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        value = a or b or c
        if name in ("class", "id", "role") and name_of not in WHOLE:
            if name == "role" and value.lower() in ("main", "article"):
                marked = True
            elif not (name == "id" and name_of in HEADINGS):  # ids of headings repeat their words
                factor = min(factor, _name_factor(value, inside, not inside))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value.lower()):
            factor = 0.0
    return factor, marked


class Line(NamedTuple):
    text: str
    linked: int  # characters in links, without white space
    factor: float  # 0: no text of the page
    article: int  # number of the nearest marked article, 0 without
    parent: int  # number of the block it stands in

    def weight(self) -> float:
        chars = len(self.text) - self.text.count(" ")
        return 0.0 if self.linked > LINK_SHARE * chars else self.factor * (len(self.text) - self.linked)


class _Open(NamedTuple):
    name: str
    factor: float  # of this element and all above it
    article: int
    block: int


class _Cutter:
    """Cuts one page into lines, in one pass; every look for an open element goes straight to its place."""

    def __init__(self):
        self.out: list[Line] = []
        self.parts: list[str] = []
        self.linked = self.links = self.numbers = 0
        self.stack: list[_Open] = [_Open("", 1.0, 0, 0)]
        self.places: dict[str, list[int]] = {}  # of the open elements of a name
        self.blocks: list[int] = []  # places of open blocks

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.out.append(Line(text, self.linked, top.factor, top.article, top.block))
            self.parts.clear()
        self.linked = 0

    def text(self, s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            self.parts.append(s)
            if self.links:
                self.linked += len("".join(s.split()))

    def last(self, names) -> int:
        """The place of the innermost open element of these names, 0 without."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, to: int) -> None:
        """End the open elements from this place on."""
        stack = self.stack
        if self.blocks and self.blocks[-1] >= to or any(stack[i].factor != stack[i - 1].factor for i in range(to, len(stack))):
            self.flush()
        while len(stack) > to:
            name = stack.pop().name
            self.places[name].pop()
            self.links -= name == "a"
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.flush()
        if at := self.last((name,)):
            self.close(at)
        elif name in BLOCK:
            self.flush()

    def begin(self, name: str, attrs: str) -> None:
        if name in CLOSES_P and (at := self.last(("p",))) and at >= (self.blocks[-1] if self.blocks else 0):
            self.close(at)
        if name in SAME_ENDS:
            while (at := self.last(SAME_ENDS[name])) and at > self.last(SCOPE[name]):
                self.close(at)
        if name in BLOCK:
            self.flush()
        if name in VOID:
            return
        above = self.stack[-1]
        factor, marked = _standing(attrs, name, above.article > 0) if attrs.strip() else (1.0, False)
        # the header of an article is part of it
        if name in BOILER and not (name == "header" and above.article):
            factor = 0.0
        article = above.article
        if (marked or name in MAIN) and min(factor, above.factor) >= HINTED:
            self.numbers += 1
            article, factor = self.numbers, factor if article else MARKED * factor
        if factor != 1.0 and name not in BLOCK:
            self.flush()
        block = above.block
        if name in BLOCK and name not in ("p", "li", "br", "button", *HEADINGS):
            self.numbers += 1
            block = self.numbers
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(_Open(name, above.factor * factor if factor != NAMED else min(above.factor, 1.0) * NAMED, article, block))
        self.links += name == "a"


def lines(page: str) -> list[Line]:
    """The lines of a page, those of its markup's hidden parts too (their factor is 0)."""
    cut = _Cutter()
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            cut.text(page[at:])
            break
        cut.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            cut.end(name)
            continue
        cut.begin(name, m[3])
        if name in RAW:
            end = _ENDS[name].search(page, at)
            cut.text(page[at : end.start() if end else n] if name in ("title", "textarea") else "")
            at = end.start() if end else n
    cut.flush()
    return cut.out


def runs(weight: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(surge, dive, strength) of the runs of a sequence: from its first line with weight to behind its last, by sums over a sliding window."""
    out: list[tuple[int, int, float]] = []
    begun = last = -1
    strength = 0.0
    for i in range(len(weight) + window):
        held = weight[max(0, i - window + 1) : i + 1]  # the window that ends here
        if any(held):
            if begun < 0:
                begun = i
            if weight[i] if i < len(weight) else 0:
                last = i
            strength = max(strength, sum(held))
        elif begun >= 0:
            out.append((begun, last + 1, strength))
            begun, strength = -1, 0.0
    return out


def main_text(page: str | None) -> str:
    """The text between the surges and dives of a page."""
    if not page:
        return ""
    found = [x for x in lines(page) if x.factor]
    sequences: dict[tuple[int, float], list[int]] = {}
    for i, x in enumerate(found):
        sequences.setdefault((x.article, x.factor), []).append(i)
    all_runs = [([at[k] for k in range(a, b)], strength) for at in sequences.values() for a, b, strength in runs([found[i].weight() for i in at])]
    top = max((s for _, s in all_runs), default=0.0)
    keep: set[int] = set()
    beside: set[tuple[int, float, int]] = set()
    for places, strength in all_runs:
        first = found[places[0]]
        floor = 0.0 if first.article else min(SURGE, top) if first.factor == 1.0 else SURGE * first.factor * (MISNAMED if first.factor <= NAMED else 1)
        if strength >= max(floor, SHARE * top):
            keep.update(places)
            beside.update((found[i].article, found[i].factor, found[i].parent) for i in places)
    for places, _ in all_runs:
        if not keep.issuperset(places) and all((found[i].article, found[i].factor, found[i].parent) in beside for i in places):
            keep.update(places)
    return " ".join(found[i].text for i in sorted(keep))


def extract(df: DataFrame, keep: dict[str, Column] | None = None, html_col: str = "html") -> DataFrame:
    """Columns ``keep`` of every page with ``text`` and ``n_chars`` (code points). A narrow map: no shuffle; repeated rows stay."""
    keep = keep or {"page_id": F.col("page_id"), "url": F.col("url")}
    rows = df.select(*(c.alias(n) for n, c in keep.items()), F.col(html_col).cast("string").alias("__html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars bigint"

    def start():
        def batch(*cols):
            texts = [main_text(p) for p in cols[-1]]
            return [*cols[:-1], texts, list(map(len, texts))]

        return batch

    return map_rows(rows, ddl, start)
