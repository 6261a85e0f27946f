"""Main text of web pages from streaming parser events.

The standard library's parser feeds one pass that cuts a page into lines, one for each block, and counts the tags of
each. Text-to-tag ratios along the lines are smoothed by a Gaussian, a two-cluster threshold tells content from
furniture, and the smallest element that holds most of the content lines is the region; its lines and the content lines
outside it, each with the headings right before it, are the text. Names that speak of furniture (menus, notices,
comments, ...) weigh on a line's ratio: such a line, inside the region or not, is text only if it is dense even so. A first
clustering without these weights says which class and id names to believe: not those that all of a page's content has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fernsieve.llm.common import map_batches, table

#: Elements whose text is not shown as a part of the page or is no prose, elements that are furniture, that break lines, that end by themselves, that a region can be.
UNSEEN = frozenset("script style noscript template button select option textarea label iframe object svg canvas head title audio video map".split())
FURNISHING = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main section div td body html".split())
#: An open one of these ends where one of its like, or what holds it, begins or ends.
IMPLIED = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"])}
#: Whole words of class, id and role attributes that mark furniture.
FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adv|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
SIGMA, RADIUS = 1.0, 2
MOST_OF_CONTENT = 0.9
#: What the ratio of a line of furniture is multiplied by, and content lines that a name must hold not to be believed.
LIGHT, STORY = 0.03, 2


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    path: tuple[int, ...] = ()
    furniture: bool = False  # by its element
    named: bool = False  # by a class, an id or a role
    heading: bool = False


class Lines(HTMLParser):
    """Collects lines and the elements that they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, str]] = []  # tag, number of the region or -1, what holds from here on: "u"nseen, "f"urniture, "n"amed
        self.lines: list[Line] = []
        self.now = Line()
        self.regions: list[str] = []

    def cut(self) -> None:
        words = "".join(self.now.text).split()
        if words:
            self.now.text = [" ".join(words)]
            self.lines.append(self.now)
            self.now = Line()
        else:
            self.now = Line(tags=self.now.tags)  # tags without text weigh on the line that follows

    def place(self) -> None:
        if not self.now.text:
            self.now.path = tuple(n for _, n, _ in self.stack if n >= 0)
            holds = self.stack[-1][2] if self.stack else ""
            self.now.heading = any(t in HEADINGS for t, _, _ in self.stack)
            self.now.furniture = "f" in holds and not (self.now.heading and self.in_headline())
            self.now.named = "n" in holds

    def in_headline(self) -> bool:
        """In a header of an article, and in no other furniture: its headline."""
        tags = [t for t, _, _ in self.stack if t in FURNISHING or t in ("article", "main")]
        return tags[-1:] == ["header"] and len(tags) > 1 and all(t in ("article", "main") for t in tags[:-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[k][0]
            if tag in IMPLIED.get(open_tag, ()):
                self.leave(k)
                break
            if open_tag in BLOCKS and not (open_tag in IMPLIED and tag in IMPLIED[open_tag]):
                break
        if tag in BLOCKS:
            self.cut()
        self.now.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        holds = self.stack[-1][2] if self.stack else ""
        named = any(v and k in ("class", "id", "role") and FURNITURE.search(v) for k, v in attrs) and tag not in ("body", "html", "article", "main")
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        region = -1
        if tag in REGIONS:
            region = len(self.regions)
            self.regions.append(tag)
        more = "u" * (hidden or tag in UNSEEN) + "f" * (tag in FURNISHING) + "n" * named
        self.stack.append((tag, region, holds + "".join(c for c in more if c not in holds)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.now.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.leave(k)
                return
            if self.stack[k][0] in ("article", "main", "nav", "aside", "footer", "header", "td") and tag not in BLOCKS:
                return  # an inline end without a start in this part

    def leave(self, k: int) -> None:
        """Close what is open from place ``k`` on."""
        if any(t in BLOCKS for t, _, _ in self.stack[k:]):
            self.cut()
        del self.stack[k:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What starts with ``<![`` ends at the next ``>``, whatever it holds."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        if self.stack and "u" in self.stack[-1][2]:
            return
        self.place()
        self.now.text.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    padded = np.pad(ratios, RADIUS, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(ratios: np.ndarray) -> float:
    """Between the means of two clusters of logarithms, found by moving the means."""
    x = np.log1p(ratios)
    low, high = x.min(), x.max()
    for _ in range(30):
        cut = (low + high) / 2
        a, b = x[x <= cut], x[x > cut]
        new = (a.mean() if len(a) else low, b.mean() if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def clustered(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines are content by their smoothed ratios, and the threshold; all of them where no two ratios differ."""
    smooth = smoothed(ratios)
    if smooth.max() > smooth.min():
        cut = threshold(smooth)
        return smooth > cut, cut
    return np.ones(len(ratios), bool), float(smooth.min())


def main_text(html: str | None) -> str:
    """Blocks of the content region, each with single spaces, joined by newlines; of null or empty html ""."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = parser.lines
    size = np.array([len(x.text[0]) for x in lines], float)
    plain = size / np.array([max(1, x.tags) for x in lines])
    shown = np.array([not x.furniture for x in lines], bool)
    named = np.array([x.named for x in lines], bool)
    if (named & shown).any():  # and so some line is shown
        dense = shown.copy()
        dense[shown] = clustered(plain[shown])[0]
        if named[dense].all() and dense.sum() >= STORY:
            named[:] = False  # the page's own element bears such a name
    light = named | ~shown
    if light.all():
        return ""
    weighted = np.where(light, LIGHT * plain, plain)
    content = ~light
    content[~light], cut = clustered(plain[~light])
    content |= light & (weighted > cut)
    # the smallest element that holds most of the content lines is the region, whatever its name
    held: dict[int, float] = {}
    for x, n, c in zip(lines, size, content):
        for region in set(x.path) if c else ():
            held[region] = held.get(region, 0.0) + n
    enough = MOST_OF_CONTENT * size[content].sum()
    region = max((r for r in held if held[r] >= enough), default=-1)
    # outside of it, and in furniture, a line must be dense by itself, not just stand beside dense ones
    keep = [not f and (region == -1 or region in x.path) or bool(c and r > cut) for x, f, c, r in zip(lines, light, content, weighted)]
    for k in range(len(lines) - 2, -1, -1):
        keep[k] = keep[k] or lines[k].heading and not light[k] and keep[k + 1]
    kept = [x for x, k in zip(lines, keep) if k]
    return "\n".join(x.text[0] for x in kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages(page_id, url, html)``.

    A page without text gives an empty text, and malformed markup is read as browsers do or passed over. Each row is read alone: repeated rows get equal results, an empty table
    an empty one; other columns are not read.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_batches(pages.select("page_id", "url", "html"), work, "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
