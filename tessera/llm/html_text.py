"""Main text of HTML pages: parser events, a text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A page is fed to the standard library's parser in pieces. Its events cut the page into lines, one for each block. A line
counts the characters of running text (outside links and outside page furniture such as navigation, forms and adverts)
and its tags; the ratio of the two is smoothed over the neighbouring lines with a Gaussian kernel, and two-means
clustering of the smoothed ratios (of their logarithms) gives the threshold. Lines lie in regions, which end at furniture
and at the edge of an article; a region with a line over the threshold is content, and its lines of text are kept, so
that a short paragraph between long ones stays, and so are lines elsewhere in the very block that holds one over the
threshold, so that adverts between paragraphs part nothing. Lines of links alone count only in such a block. If an article
or main element holds most of the text that runs on, only its lines count.

What is furniture by a name or as a form is weighed: what holds the page itself, or under a name that may mean other things
holds text that runs on, is read again as any other element; so is an element of navigation that was never closed.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import bounded

PIECES = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")

#: Characters that the parser gets at a time.
FEED = 1 << 16
SIGMA, RADIUS = 1.0, 2
#: Markup that the page ends in before it is complete; not text.
UNFINISHED = re.compile(r"<[A-Za-z/!?]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text nobody reads on the page.
MUTE = frozenset("script style template noscript head title iframe object svg canvas math audio video datalist".split())
FURNITURE = frozenset("nav footer aside dialog menu button select textarea fieldset label option".split())
#: Furniture outside an article only: inside it they hold its own title.
OUTSIDE = frozenset("header hgroup".split())
LANDMARK = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: Blocks that hold other blocks; lines with the same one are siblings.
CONTAINERS = frozenset("body div section article main form fieldset details td th aside center dialog".split())
NAVIGATION = frozenset("nav menu".split())
#: Blocks that do not stand in navigation but in its lists.
TEXT_BLOCKS = frozenset("div section p h1 h2 h3 table blockquote pre main article".split())
#: What a start tag of the key closes if it is open and unclosed.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody tfoot thead select datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations comment comments disqus "
    "respond replies widget toolbar pagination pager masthead login signup search topbar banner skip hidden".split()
)
#: Of these names, those that also name content; with other parts than LAYOUT beside them they do ("search-rescue").
WEAK = frozenset("menu hidden search skip social share sharing topbar toolbar pager pagination login signup promo promotion".split())
LAYOUT = frozenset("bar box main top left right bottom site page wrapper wrap container block list item items link links inner outer area panel primary secondary global mobile desktop sub mega form icon icons button buttons btn area section content to only text field results the 1 2 3".split())
#: Characters of running text with which an element of a weak name is no furniture.
SOME = 120
NAMES_OUTSIDE = frozenset("header copyright legal tags meta".split())
#: Parts of a name that tell a state or a layout of an element rather than what it is: "no-sidebar", "comments-closed", "js-skip".
STATES = frozenset("no not non has have with without is are js can show shows hide hides enable enabled disable disabled open opened closed on off active inactive layout template supports support".split())
#: A named element that holds the whole text of a page is not furniture if it holds so much text, or a heading or an article.
MUCH = 400


class Line:
    __slots__ = ("chars", "furniture", "holder", "landmark", "linked", "parts", "tags", "within")

    def __init__(self, landmark: int, furniture: bool, within: tuple[int, ...], holder: int = 0):
        self.parts: list[str] = []
        self.tags, self.chars, self.linked, self.landmark, self.furniture, self.within, self.holder = 0, 0, 0, landmark, furniture, within, holder


def tells_furniture(name: str, names: frozenset[str]) -> str:
    """Whether a class or id names furniture: one of its parts does, and none tells that it is a state. "weak" if the parts that do may mean other things; empty if not."""
    parts = [x.lower() for x in PIECES.split(name) if x]
    found = [x for x in parts if x in names]
    if not found or not STATES.isdisjoint(parts):
        return ""
    if not WEAK.issuperset(found):
        return "strong"
    return "weak" if all(x in names or x in LAYOUT for x in parts) else ""


class Lines(HTMLParser):
    """The page as lines. Only the open elements and the lines themselves are held.

    Elements that are furniture by name alone, forms and navigation are numbered; those whose number is in excused are taken as any other.
    Of navigation only what was never closed is excused, and only from where a block of text begins outside its lists.
    """

    def __init__(self, excused: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # element, whether it mutes, whether it is furniture, whether it is numbered, its block
        self.blocks, self.weak, self.unclosed, self.numbers = 0, set(), set(), []
        self.opened: dict[str, int] = {}
        self.mute = self.furniture = self.landmarks = self.named = 0
        self.excused, self.within, self.titled = excused, (), set()
        self.lines: list[Line] = []
        self.line = Line(0, False, ())

    def cut(self) -> None:
        if self.line.parts or self.line.tags:
            self.lines.append(self.line)
        holder = next((x[4] for x in reversed(self.open) if x[4]), 0)
        self.line = Line(self.landmarks, self.furniture > 0, self.within, holder)

    def drop(self, to: int, own: bool = False) -> None:
        """Closes all elements from one on; own: that one by its own end tag."""
        for i, (tag, mute, furniture, named, _) in enumerate(self.open[to:]):
            if named and tag in NAVIGATION and not (own and i == 0):
                self.unclosed.add(self.within[-1])
            self.opened[tag] -= 1
            self.mute -= mute
            self.furniture -= furniture
            self.landmarks -= tag in LANDMARK
            self.within = self.within[: len(self.within) - named]
        del self.open[to:], self.numbers[to:]

    def last(self, tag: str) -> int:
        return next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)

    def is_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE or tag in OUTSIDE and not self.landmarks:
            return True
        if tag in ("html", "body", "main") or not attrs:
            return False
        said = dict(attrs)
        if "hidden" in said or (said.get("aria-hidden") or "").lower() == "true" or (said.get("role") or "").lower() in ROLES:
            return True
        if "none" in (style := (said.get("style") or "").lower().replace(" ", "")) and "display:none" in style:
            return True
        return False

    def is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether it is furniture by class or id, or as a form."""
        if tag in ("html", "body", "main") or not attrs:
            return tag == "form"
        said = dict(attrs)
        told = {tells_furniture(x, NAMES) or ("" if self.landmarks else tells_furniture(x, NAMES_OUTSIDE)) for x in f"{said.get('class') or ''} {said.get('id') or ''}".split()} - {""}
        if told == {"weak"} and tag != "form":
            self.weak.add(self.named)
        return tag == "form" or bool(told)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.line.tags += 1
            if tag == "br":
                self.handle_data("\n")
            elif tag == "hr":
                self.cut()
            return
        if tag in LANDMARK and self.furniture and not self.landmarks:  # furniture that was never closed ends here
            self.drop(next((i for i, x in enumerate(self.open) if x[2] and x[0] not in ("div", "section", "aside", "form", "dialog")), len(self.open)))
        if tag in BLOCK and self.opened.get("p"):
            self.drop(self.last("p"))
        for old in CLOSES.get(tag, ()):
            if self.opened.get(old):
                at = self.last(old)
                if not any(x[0] in HOLDERS for x in self.open[at:]):
                    self.drop(at)
        if tag in TEXT_BLOCKS and self.furniture and self.excused:  # the text goes on behind navigation that was never closed
            at = next((i for i, x in enumerate(self.open) if x[3] and x[0] in NAVIGATION and self.numbers[i] in self.excused), len(self.open))
            if not any(x[0] in HOLDERS for x in self.open[at:]):
                self.drop(at)
        mute, furniture = tag in MUTE, self.is_furniture(tag, attrs)
        named = not mute and (tag in NAVIGATION or not furniture and self.is_named(tag, attrs))
        if named and tag in NAVIGATION:
            self.within = (*self.within, self.named)
            self.named += 1
        elif named:
            self.within = (*self.within, self.named)
            furniture = self.named not in self.excused
            self.named += 1
        if tag in LANDMARK or tag in ("h1", "h2"):
            self.titled.update(self.within)
        self.blocks += tag in CONTAINERS
        self.open.append((tag, mute, furniture, named, self.blocks if tag in CONTAINERS else 0))
        self.numbers.append(self.within[-1] if named else -1)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.mute += mute
        self.furniture += furniture
        self.landmarks += tag in LANDMARK
        if tag in BLOCK or furniture or tag == "body":
            self.cut()
        elif tag in ("td", "th"):
            self.handle_data(" ")
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash has no effect
        if tag in ("svg", "math", "path", "use", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if not self.opened.get(tag):
            return
        at = self.last(tag)
        furniture = self.furniture
        self.drop(at, own=True)
        if tag in BLOCK or furniture != self.furniture:
            self.cut()

    def handle_data(self, data: str) -> None:
        if self.mute:
            return
        self.line.parts.append(data)
        n = len(data)
        self.line.chars += n
        if self.opened.get("a"):
            self.line.linked += n


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - radius), min(len(values), i + radius + 1)
        used = kernel[a - i + radius : b - i + radius]
        out.append(sum(v * k for v, k in zip(values[a:b], used, strict=True)) / sum(used))
    return out


def threshold(values: list[float]) -> float:
    """Half way between the two means that split the values best from a start at the extremes."""
    low, high = min(values), max(values)
    for _ in range(50):
        at = (low + high) / 2
        under, over = [v for v in values if v < at], [v for v in values if v >= at]
        new = (sum(under) / len(under) if under else low, sum(over) / len(over) if over else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def parsed(html: str, excused: frozenset[int] = frozenset()) -> Lines:
    parser = Lines(excused)
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    if UNFINISHED.match(parser.rawdata):
        parser.rawdata = ""
    parser.close()
    parser.cut()
    return parser


def running_of(line: Line) -> float:
    """The characters of a line outside links."""
    return len(" ".join("".join(line.parts).split())) * (1 - line.linked / max(line.chars, 1))


def content_of(lines: list[Line]) -> str:
    rows = []  # (text, running text, ratio, in an article, region, furniture, holder)
    region, before = 0, None
    for line in lines:
        text = " ".join("".join(line.parts).split())
        if not text and not line.furniture:
            continue
        edge = (line.furniture, line.landmark > 0)
        region += before is not None and edge != before
        before = edge
        running = 0.0 if line.furniture or not text else len(text) * (1 - line.linked / max(line.chars, 1))
        rows.append((text, running, running / max(1, line.tags), edge[1], region, line.furniture, line.holder))
    if not any(r[1] for r in rows):  # nothing but links: those in an article
        return "\n\n".join(r[0] for r in rows if r[0] and r[3] and not r[5])
    values = [math.log1p(v) for v in smooth([r[2] for r in rows])]
    least = threshold(values)
    over = [r for r, v in zip(rows, values, strict=True) if v >= least and r[1] and not r[5]]
    regions, holders = {r[4] for r in over}, {r[6] for r in over if not r[3]}
    article = sum(r[1] for r in rows if r[3])
    outside = sum(r[1] for r in over if not r[3])
    if article and article >= outside:
        regions, holders = set(), set()
    kept = [r for r in rows if r[0] and not r[5] and (r[3] and article or not r[3] and (r[6] in holders or r[4] in regions and r[1]))]
    return "\n\n".join(r[0] for r in kept)


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by an empty line; empty for null, empty or text-free pages.

    A page whose text lies wholly in elements that are furniture by their names is read again with the outermost of them
    taken as any other element, and so on inwards, as long as the element holds most of the text and looks like a page.
    """
    if not html:
        return ""
    page = parsed(html)
    page.drop(0)
    held: dict[int, float] = {}
    for line in page.lines:
        if line.within and (n := running_of(line)):
            for i in line.within:
                held[i] = held.get(i, 0.0) + n
    excused = frozenset(i for i, n in held.items() if i in page.unclosed and n >= SOME or i in page.weak and n >= SOME)
    if excused:
        page = parsed(html, excused)
    text = content_of(page.lines)
    if text or not page.named:
        return text
    most = sum(running_of(line) for line in page.lines if line.within) / 2
    chain = sorted(i for i, n in held.items() if n > most and (n >= MUCH or i in page.titled) and i not in excused)
    # each further element can only add text, so the least number of them that gives any is found by halving
    low, high = 1, len(chain)
    while low <= high:
        n = (low + high) // 2
        if found := content_of(parsed(html, excused.union(chain[:n])).lines):
            text, high = found, n - 1
        else:
            low = n + 1
    return text


def main_text_of(html: str = "html") -> Column:
    """The main text of a column of pages; null pages count as empty."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return run.asNondeterministic()(F.coalesce(F.col(html), F.lit("")))  # else filters on it are pushed below and evaluate it again


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the column text (in place of any of that name): the main text of html.

    One narrow pass; each page is parsed whole, however long. Null and empty pages give the empty text, pages that repeat give
    equal texts, an empty table gives an empty one, and other columns stay as they are. Lines of equal ratio are all in or out.
    """
    return bounded(pages).withColumn(text, main_text_of(html))
