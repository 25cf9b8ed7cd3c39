"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block element starts a new line, an inline one
does not. A line's mass is its length away from links; text in menus, page
headers, footers, sidebars, notices, adverts, forms and reader comments leaves
a line without mass, scripts, styles and comments of the markup leave none. The
mass is summed over windows of ``WINDOW`` lines. A surge is where the sum
leaves zero, a dive where it falls back to it, and the lines of mass between
them, with all that stands among them, are a section: a line or two without
mass do not part it, a menu does.

What is kept is decided by the heights of the windowed sums: sections that
reach ``LEAST_PEAK`` of the page's highest, and what stands in the same element
as one of these. Markup settles what lengths cannot: blank lines part what is
within ``article`` or ``main`` from what is not, and if a section within such
an element reaches ``LEAST_PEAK``, those outside do not count.

Cases: a null or empty page gives an empty text; a page without markup is its
text; a page of links alone has no text; pages cut off in the middle are read
to their end; pages of any length and depth are read whole; repeated rows give
repeated rows; further columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

WINDOW = 3
#: The least share of the page's highest windowed sum, and the most of a section's text outside an article that may be links.
LEAST_PEAK, MOST_LINKS = 0.3, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are kept on the stack: all others have no text of their own kind.
HOLDS = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul".split())
ALWAYS = frozenset("aside button dialog fieldset footer form head menu nav".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id names.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus flash footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion register related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def kind_of(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(whether an element is no part of the article, whether it holds comments)."""
    if tag in ("html", "body"):
        return False, False
    names, off = set(), False
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names.update(SPLIT.split(CAMEL.sub("-", value).lower()))
            elif name == "role":
                off |= value.lower() in ROLES
            elif name == "hidden":
                off = True
            elif name == "aria-hidden":
                off |= value.lower() == "true"
            else:
                off |= re.sub(r"\s", "", value.lower()).find("display:none") >= 0
    talk = bool(names & COMMENTS)
    if tag in MAIN:
        return talk, talk
    if inside and "header" in (names & WORDS or {tag}) and names & WORDS <= {"header", "byline"}:
        return off, talk
    return off or tag in ALWAYS or tag == "header" or bool(names & WORDS), talk


@dataclass
class Line:
    text: str = ""
    linked: int = 0  # characters within links
    article: int = 0  # the outermost article element around it, 0 for none
    box: int = 0  # the innermost element around it that holds blocks

    @property
    def mass(self) -> int:
        return len(self.text) if self.article else len(self.text) - self.linked


BLANK = Line()


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; those that are no part of an article are blank, and blank ones part articles from the rest."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # tag, off, article, comments, box; what is within an element that is off is off too
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link, boxes = 0, 0, 0
    off, article, talk, box = False, 0, False, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(BLANK if off else Line(text, min(linked, len(text)), article, box))
            buffer.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            buffer.append(text)
            if in_link:
                linked += len(text)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            buffer.append("\n")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag not in HOLDS:
            continue
        in_link = 0
        was = article
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
        elif not rest.endswith("/"):
            own_off, own_talk = kind_of(tag, rest, bool(article))
            main = tag in MAIN and not own_off
            # An article ends whatever was left open before it, but not the comments it may be part of.
            if main and not talk:
                while stack and stack[-1][1]:
                    pop()
            boxes += 1
            _, above_off, above, above_talk, _ = stack[-1] if stack else ("", False, 0, False, 0)
            stack.append((tag, own_off or above_off, above or (boxes if main and not above_off else 0), own_talk or above_talk, boxes))
            opened[tag] += 1
        _, off, article, talk, box = stack[-1] if stack else ("", False, 0, False, 0)
        if article != was:
            out.extend([BLANK] * WINDOW)
    if at < len(page):
        buffer.append(html.unescape(page[at:]))
    flush()
    return out


def sections(mass: np.ndarray) -> list[tuple[int, int, int]]:
    """(first line, line after the last, highest windowed sum) from each surge to the next dive."""
    if not len(mass):
        return []
    total = np.concatenate([[0], np.cumsum(mass)])
    sums = total[np.minimum(np.arange(len(mass)) + WINDOW, len(mass))] - total[:-1]
    on = np.concatenate([[False], sums > 0, [False]])
    change = np.flatnonzero(on[1:] != on[:-1])
    out = []
    for surge, dive in zip(change[::2].tolist(), change[1::2].tolist()):
        heavy = np.flatnonzero(mass[surge:dive])
        out.append((surge + int(heavy[0]), surge + int(heavy[-1]) + 1, int(sums[surge:dive].max())))
    return out


def main_text(page: str | None) -> str:
    """The article's lines joined by a space."""
    if not page:
        return ""
    lines = lines_of(page)
    found = sections(np.array([x.mass for x in lines], np.int64))
    alone = [s for s in found if lines[s[0]].article or 2 * sum(x.linked for x in lines[s[0] : s[1]]) <= 2 * MOST_LINKS * sum(len(x.text) for x in lines[s[0] : s[1]])]
    high = [s for s in alone if s[2] >= LEAST_PEAK * max(x[2] for x in alone)]
    articles = {lines[s[0]].article for s in high} - {0}
    if articles:
        kept = [s for s in found if lines[s[0]].article in articles]
    else:
        # The elements that hold lines of high sections hold what belongs to them.
        boxes = {x.box for s in high for x in lines[s[0] : s[1]] if x.text}
        kept = [s for s in found if s in high or all(x.box in boxes for x in lines[s[0] : s[1]] if x.text)]
    return " ".join(x.text for a, b, _ in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages, [id_col, url_col, html_col], run, "page_id long, url string, text string, n_chars long")
