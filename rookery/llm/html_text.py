"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import sliced

#: Elements whose content is never text of the page. Fixed values.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "math", "object", "canvas")
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav header footer aside form menu dialog select button fieldset figcaption head".split()) - {"figcaption"}
#: Words of class, id or role that mark such content.
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead toolbar share social "
    "related recommended comment comments disqus reply replies newsletter subscribe subscription signup login popup modal "
    "overlay pagination pager widget search contentinfo complementary".split()
)
#: Parts of a name that only say that something is held: comment-list is comments, entry-header isn't a header.
HOLDERS = frozenset("list section area wrapper wrap box block container item items group thread body content inner outer bar links panel holder row entries".split())
#: Elements that are text themselves. A name like those of AROUND_NAMES on one is evidence, but for NEVER_TEXT the windows decide.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
NEVER_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr notice notices "
    "breadcrumb breadcrumbs comment comments disqus reply replies newsletter subscribe subscription signup login popup modal overlay pagination pager promo promotion".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: How a line of prose ends.
PROSE_END = re.compile(r"[.!?\u2026:;][\"'\u2019\u201d\u00bb)\]]*$")
#: Elements inside a line; every other tag ends one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of one of the latter closes an open one of the former.
CLOSED_BY = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 article section nav header footer aside form pre blockquote main hr address fieldset".split()), "li": frozenset(["li"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split())}

#: Attributes up to the end of a tag. A quote opens a value only right behind "="; inside a value without quotes it is a letter.
_ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+|[^>=])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>]|\Z)(?:/>|" + _ATTRS + r"(?:(?<=[\s\"']/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
SPLIT_NAME = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
#: Lines of a block, and characters of a surge: more than a line of a menu or notice has, less than a paragraph.
WINDOW, SURGE = 3, 80


class Line(NamedTuple):
    """doubtful: inside an element whose name only contains a mark as a part; linked: characters inside links;
    title: it opens the page's or article's h1; heading: it opens a heading."""

    text: str
    article: bool
    around: bool
    doubtful: bool
    linked: int
    title: bool
    heading: bool = False


def _mark(tag: str, attrs: str) -> str:
    """What makes an element surround an article: tag, form, hidden, name, doubtful or nothing.

    A name marks as a whole, or if each of its parts does (cookie-banner) or only says that something is held (comment-list);
    entry-header or with-sidebar are doubtful, and so is a paragraph or heading by a name that text may have, like search.
    """
    if tag in AROUND:
        return "form" if tag == "form" else "tag"
    if not attrs:
        return ""
    if HIDDEN.search(attrs):
        return "hidden"
    found = ""
    for m in NAMES.findall(attrs):
        for token in "".join(m).lower().split():
            parts = [x for x in SPLIT_NAME.split(token) if x]
            known = AROUND_NAMES.intersection(parts)
            if known and (known | HOLDERS).issuperset(parts) and (tag not in TEXT_BLOCKS or known & NEVER_TEXT):
                return "name"
            if known:
                found = "doubtful"
    return found


class Surroundings:
    """Elements around an article, each numbered behind those that hold it; 0 is the page."""

    def __init__(self):
        self.marks, self.outer, self.released = ["page"], [0], {0}
        self.lead: tuple[bool, int] | None = None

    def add(self, mark: str, outer: int) -> int:
        self.marks.append(mark)
        self.outer.append(outer)
        return len(self.marks) - 1

    def frame(self, tag: str, at: int) -> None:
        """Notes the first main, else the first article that only forms and named elements hold."""
        if self.lead and (self.lead[0] or tag != "main"):
            return
        k = at
        while k and tag != "main" and self.marks[k] in ("form", "name"):
            k = self.outer[k]
        if tag == "main" or not k:
            self.lead = (tag == "main", at)

    def release_lead(self) -> None:
        k = self.lead[1] if self.lead else 0
        while k:
            self.released.add(k)
            k = self.outer[k]

    def release_most(self, own: list[int], total: int) -> None:
        """Forms and named elements that hold more than half of the text count no more; own is the text right in each."""
        held = list(own)
        for k in range(len(held) - 1, 0, -1):
            held[self.outer[k]] += held[k]
            if self.marks[k] in ("form", "name") and 2 * held[k] > total:
                self.released.add(k)

    def covered(self) -> list[bool]:
        out = [False]
        for k in range(1, len(self.marks)):
            out.append(k not in self.released or out[self.outer[k]])
        return out


def lines_of(page: str) -> list[Line]:
    """Lines of a page stripped of markup."""
    out: list[tuple[str, bool, int, bool, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number among surroundings, adds to article, adds to doubtful
    held_open: Counter[str] = Counter()
    rings = Surroundings()
    around = article = doubtful = 0
    linked: Counter[int] = Counter()
    link: list[tuple[int, int]] | None = None  # lines and characters of the open link
    title = heading = -1

    def add_text(piece: str) -> None:
        held.append(piece)
        if link is not None and not held_open["h1"]:
            link.append((len(out), len(SPACE.sub(" ", entities.unescape(piece)).strip())))

    def end_line() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append((text, article > 0, around, doubtful > 0, title == len(out), heading == len(out)))
            held.clear()

    def end_link(whole: bool) -> None:
        """A link without an end holds the rest of its line."""
        nonlocal link
        for k, n in link or ():
            if whole or k == link[0][0]:
                linked[k] += n
        link = None

    def pop() -> None:
        nonlocal around, article, doubtful
        tag, a, b, c = stack.pop()
        held_open[tag] -= 1
        around = rings.outer[a] if a else around
        article -= b
        doubtful -= c

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() not in ("svg", "math"):
                end_line()
            continue
        if tag not in INLINE:
            end_line()
        if m["end"]:
            if tag == "a":
                end_link(True)
            if held_open[tag]:
                while stack[-1][0] != tag:
                    if stack[-1][1]:
                        end_line()
                    pop()
                if stack[-1][1]:
                    end_line()
                pop()
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        attrs = m["attrs"] or ""
        if tag in VOID or SELF_CLOSED.search(attrs):
            continue
        inside = tag in ("article", "main")
        mark = "" if tag in ("body", "html", "article", "main") or (tag == "header" and article) else _mark(tag, attrs)
        if inside:
            rings.frame(tag, around)
        elif tag == "a":
            end_link(False)
            link = [] if "href" in attrs.lower() else None
        elif tag in HEADINGS:
            heading = len(out)
            title = heading if tag == "h1" else title
        is_around = mark not in ("", "doubtful")
        if is_around and tag in INLINE and not around:
            end_line()
        if is_around:
            around = rings.add(mark, around)
        stack.append((tag, around if is_around else 0, inside, mark == "doubtful"))
        held_open[tag] += 1
        article += inside
        doubtful += mark == "doubtful"
    add_text(page[at:])
    end_line()
    end_link(False)

    rings.release_lead()
    covered = rings.covered()
    # Where what isn't covered has no block of text, in the article or, without one, on the page, an element that holds most of it isn't around it.
    framed = any(a for _, a, *_ in out)
    own, free = [0] * len(covered), []
    for k, (text, a, o, *_) in enumerate(out):
        if a or not framed:
            own[o] += max(0, len(text) - linked[k])
            free.append(0 if covered[o] else max(0, len(text) - linked[k]))
    if max(_blocks(free, WINDOW), default=0) < SURGE:
        rings.release_most(own, sum(own))
        covered = rings.covered()
    return [Line(text, a, covered[o], d, min(linked[k], len(text)), t, h) for k, (text, a, o, d, t, h) in enumerate(out)]


def _blocks(size: list[int], window: int) -> list[int]:
    return [sum(size[k : k + window]) for k in range(len(size))]


def _sizes(lines: list[Line], surge: int) -> list[int]:
    """Characters of each line outside links; none around an article or in lines of links, a surge in a title."""
    return [0 if x.around or 2 * x.linked > len(x.text) else max(surge, len(x.text)) if x.title and not x.linked and surge > 1 else len(x.text) - x.linked for x in lines]


def dense(lines: list[Line], window: int, surge: int) -> list[bool]:
    """Whether each line stands between a surge and a dive.

    A stretch starts at the first line of its first surging block that is a heading, prose or a surge's worth by itself, if there is one; short
    lines right behind its last block stay as long as they are prose.
    """
    size = _sizes(lines, surge)
    blocks = _blocks(size, window)
    limit = max(1, min(surge, (max(blocks, default=0) + 1) // 2))
    out, first, last = [False] * len(size), -1, 0

    def opens(k: int) -> bool:
        return bool(size[k]) and (lines[k].heading or size[k] >= limit or bool(PROSE_END.search(lines[k].text)))

    def close() -> None:
        sized = [k for k in range(first, last) if size[k]] if first >= 0 else []
        if sized:
            end = sized[-1] + 1
            while end < len(size) and size[end] and PROSE_END.search(lines[end].text):
                end += 1
            start = next((k for k in range(sized[0], min(first + window, len(size))) if opens(k)), sized[0])
            out[start:end] = [True] * (end - start)

    for k, block in enumerate(blocks):
        if block >= limit:
            first, last = k if first < 0 else first, min(k + window, len(size))
        elif not block:
            close()
            first = -1
    close()
    return out


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points, of an article element or, without one, of the page.

    A line's length is its text outside links; lines around an article and lines of links have
    none. A block is the sum over window lines from a line on. A surge is a block of surge
    characters or more (half the page's largest block, if that is less); a dive is a block of
    nothing. The lines from the first surging block before a dive to the end of the last are
    kept, but for lines around an article. Inside an article element its own short lines stay beyond a dive, too; what has no length, and
    lines of doubtful elements, have to be between surge and dive. A title of plain text is a surge by itself.
    """
    framed = any(x.article and not x.around for x in lines)
    rows = [x for x in lines if x.article or not framed]
    own = [framed and not x.doubtful and n > 0 for x, n in zip(rows, _sizes(rows, surge), strict=True)]
    return [x.text for x, d, o in zip(rows, dense(rows, window, surge), own, strict=True) if not x.around and (d or o)]


def extract(page: str | None) -> tuple[str, int]:
    kept = main_lines(lines_of(page)) if page else []
    return " ".join(kept), len(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of the article, n_chars (code points) and n_blocks of every page.

    Null and empty pages have an empty text. Cut pages are read as far as they go; open elements
    end with the page. Repeated rows are read each for itself; an empty table gives an empty
    result; extra columns are ignored.
    """

    def run(batches):
        for b in sliced(batches, "html"):
            found = [extract(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    d = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long")
