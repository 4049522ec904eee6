"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Boilerplate (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) is told by element, role, or class or id name, whole or a word of it, and is left out; a form or a named
block that holds most of the page's text is no boilerplate after all. Of the other lines:

1. A line weighs its text; one that is nothing but links, in a list or several of them, weighs nothing.
2. The sums of the weights over windows of `WINDOW` lines are the line-block distribution. Its threshold is half of the length
   that the page's typical line has (half of all text stands in longer ones), at most `MOST_THRESHOLD`. Lines of a window above
   the threshold are dense, unless they are short themselves; the distribution surges at the first one and dives after the last.
3. The article's home is the article or main element with most of the dense text, else the deepest element with nearly all of it.
4. Of a home that is an element of its own all lines are kept, but for menus at its ends, and headings right before it; of a page
   without such an element the lines from surge to dive, and beyond these the lines of the same parent that are no menu.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import modest_batches, pieces, table

#: Lines of a window, and the greatest threshold of its sum, in characters.
WINDOW, MOST_THRESHOLD = 3, 80
#: Shares of the dense text that make an element the article's home: any, a main and an article element; times the text outside
#: boilerplate that a form or named block must hold to be no boilerplate.
HOME_SHARE, MAIN_SHARE, ARTICLE_SHARE, OVERRULED = 0.85, 0.5, 0.6, 4

# Fixed names of HTML: elements that begin and end a block, elements without content, and elements whose text isn't shown.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas title noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("li dt dd td th option".split())
#: Blocks that hold one line of their parent, and those that a block of the same name ends.
LINES = HEADINGS | LISTS | frozenset("p pre tr blockquote figcaption caption summary legend".split())
ENDED_BY_SIBLINGS = frozenset("p li dt dd option tr td th".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button select".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments comment-list comment-body commentlist comments-area comments-list comments-section comment-section comment-thread respond reply replies disqus disqus_thread discussion".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle adbox ad-banner ad-block ad-box ad-container ad-slot ad-top ad-unit ad-wrapper sponsor sponsored promo promoted promotion banner "
    "cookie cookies cookie-banner cookie-bar cookie-consent cookie-message cookie-notice consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation main-nav hd ft nav-menu nav-links site-nav top-nav menu main-menu site-menu submenu breadcrumb breadcrumbs header site-header masthead topbar top-bar footer site-footer page-footer "
    "sidebar side-bar left-sidebar right-sidebar aside widget widgets related related-articles related-links related-posts recommended recommendations share share-buttons share-links sharing social social-links social-share "
    "follow follow-us newsletter newsletter-signup subscribe subscription signup sign-up login comment-form copyright pagination pager skip skip-link skip-to-content toc hidden sr-only screen-reader-text visually-hidden".split()
)
#: Words that tell boilerplate as a part of a name, between hyphens or underscores; wrappers of whole pages have such names as
#: well, so a block that holds most of the text is none.
BOILERPLATE_PARTS = frozenset("comment comments reply replies disqus cookie cookies gdpr consent sponsor sponsored advert adverts advertisement promo banner newsletter footer sidebar breadcrumb breadcrumbs navbar popup modal".split())
_PARTS = re.compile(r"[-_]+")
PAGE, CONTENT = frozenset(("", "html", "body")), frozenset(("article", "main"))

# inside a start tag quotes pair up as far as they can; possessive repeats keep broken markup linear
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


class Line:
    """A block's text: characters outside links and in them, links, the element that it is a line of, and the tag around it."""

    __slots__ = ("text", "own", "linked", "home", "tag", "menu")

    def __init__(self, text: str, own: int, linked: int, home: int, tag: str, menu: bool):
        self.text, self.own, self.linked, self.home, self.tag, self.menu = text, own, linked, home, tag, menu


class Page:
    """The lines of a page, and of each block element its name, its parent and whether it is boilerplate: 2 surely, 1 maybe."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.names, self.parents, self.flags = [""], [-1], [0]
        self.homes, self.listed = [0], [False]  # the element that its text is a line of, and whether that line is in a list
        self._read(page)

    def _read(self, page: str) -> None:
        open_blocks, counts = [0], {}  # elements by number; how many of each name are open
        inline: list[tuple[int, str]] = []  # open inline boilerplate: depth in blocks, name
        parts: list[str] = []
        own = linked = links = at = content = 0
        in_link, letters, linked_here = False, False, set()

        def end_block() -> None:
            nonlocal own, linked, letters
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    e = open_blocks[-1]
                    menu = bool(linked_here) and not letters and (self.listed[e] or len(linked_here) > 1)
                    self.lines.append(Line(text, own, linked, self.homes[e], self.names[e], menu))
                parts.clear()
            own = linked = 0
            letters = False
            linked_here.clear()

        def close(depth: int) -> None:
            nonlocal in_link, content
            while len(open_blocks) > depth:
                name = self.names[open_blocks.pop()]
                counts[name] -= 1
                content -= name in CONTENT
                in_link = False  # with the block that it began in
            while inline and inline[-1][0] > depth:
                inline.pop()

        def add(text: str) -> None:
            nonlocal own, linked, letters
            if not text or inline:
                return
            parts.append(text)
            size = len(text) - text.count(" ")
            if in_link:
                linked += size
                if not text.isspace():
                    linked_here.add(links)
            else:
                own += size
                letters = letters or any(map(str.isalnum, html.unescape(text)))

        for token in _TOKEN.finditer(page):
            if token.start() < at:  # inside an element whose text isn't shown
                continue
            add(page[at : token.start()])
            at = token.end()
            name = token[2]
            if not name:
                continue
            name = name.lower()
            if token[1]:
                if name in BLOCK:
                    end_block()
                    if counts.get(name):
                        depth = len(open_blocks) - 1
                        while self.names[open_blocks[depth]] != name:
                            depth -= 1
                        close(depth)
                elif name == "a":
                    in_link = False
                if inline and inline[-1] == (len(open_blocks), name):
                    inline.pop()
                continue
            if name in BLOCK:
                end_block()
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                continue
            if name in VOID:
                continue
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(token[3])} if token[3] else {}
            if name not in BLOCK:
                if token[3].endswith("/"):
                    continue
                if name == "a":
                    in_link = "href" in attributes  # others are anchors
                    links += in_link
                if inline and inline[-1] == (len(open_blocks), name) or _flag(name, attributes, content > 0):
                    inline.append((len(open_blocks), name))
                continue
            top = self.names[open_blocks[-1]]
            if top == "p" or top == name and name in ENDED_BY_SIBLINGS:
                close(len(open_blocks) - 1)
            if name in ("li", "dt", "dd", "td", "th", "tr") and self.names[open_blocks[-1]] == name:
                close(len(open_blocks) - 1)
            up = open_blocks[-1]
            open_blocks.append(len(self.names))
            self.names.append(name)
            self.parents.append(up)
            self.flags.append(2 if self.flags[up] == 2 else _flag(name, attributes, content > 0))
            self.homes.append(self.homes[up] if name in LINES else open_blocks[-1])
            self.listed.append(name in LISTS or name in LINES and self.listed[up])
            counts[name] = counts.get(name, 0) + 1
            content += name in CONTENT
        add(page[at:])
        end_block()

    def weight(self, line: Line) -> int:
        return 0 if line.menu else line.own + line.linked

    def kept(self) -> list[Line]:
        """The lines outside boilerplate."""
        maybe = [False] * len(self.names)
        for e in range(1, len(self.names)):
            maybe[e] = self.flags[e] == 1 or maybe[self.parents[e]]
        totals, outside = [0] * len(self.names), 0
        for line in self.lines:
            if self.flags[line.home] < 2:
                totals[line.home] += self.weight(line)
                outside += 0 if maybe[line.home] else self.weight(line)
        for e in range(len(self.names) - 1, 0, -1):
            totals[self.parents[e]] += totals[e]
        # a block that holds most of the text is none; with its flag gone, those inside it stand for themselves
        gone = [f == 2 or f == 1 and t <= OVERRULED * outside for f, t in zip(self.flags, totals)]
        for e in range(1, len(self.names)):
            gone[e] = gone[e] or gone[self.parents[e]]
        return [line for line in self.lines if not gone[line.home]]


def _flag(name: str, attributes: dict[str, str], in_content: bool) -> int:
    """2: surely boilerplate, 1: so it seems, 0: not."""
    if name in ("html", "body"):
        return 0
    if "hidden" in attributes and attributes["hidden"].lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return 2
    if name in BOILERPLATE and not (name == "header" and in_content):
        return 2
    names = set(attributes.get("class", "").lower().split()) | {attributes.get("id", "").lower()}
    if not COMMENTS.isdisjoint(names):
        return 2
    if name in CONTENT:
        return 0
    if name in ("form", "fieldset") or attributes.get("role", "").lower() in BOILERPLATE_ROLES:
        return 1
    if not BOILERPLATE_NAMES.isdisjoint(names - {"header"} if in_content else names):
        return 1
    return int(any(not BOILERPLATE_PARTS.isdisjoint(_PARTS.split(n)) for n in names if "-" in n or "_" in n))


def dense_lines(weights: list[int]) -> list[int]:
    """The lines of the windows whose sum exceeds the page's threshold, but for lines shorter than half of that."""
    total, seen, typical = sum(weights), 0, 0
    for w in sorted(weights, reverse=True):
        typical, seen = w, seen + w
        if 2 * seen >= total:
            break
    threshold = min(typical / 2, MOST_THRESHOLD)
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    return [i for i, w in enumerate(weights) if w and 2 * w >= threshold and max(sums[max(i - WINDOW + 1, 0) : i + 1]) > threshold]


def main_text(page: str) -> str:
    """The article of one page; empty if it has no text outside boilerplate."""
    read = Page(page)
    lines = read.kept()
    weights = [read.weight(line) for line in lines]
    dense = dense_lines(weights)
    if not dense:
        return ""
    held = [0] * len(read.names)
    for i in dense:
        held[lines[i].home] += weights[i]
    for e in range(len(held) - 1, 0, -1):
        held[read.parents[e]] += held[e]
    home = max(e for e, h in enumerate(held) if h >= HOME_SHARE * held[0])  # they hold each other, the deepest is the last
    for name, share in (("main", MAIN_SHARE), ("article", ARTICLE_SHARE)):
        home = next((e for e, h in enumerate(held) if read.names[e] == name and h >= share * held[0]), home)
    inside = [False] * len(held)
    for e in range(home, len(held)):
        inside[e] = e == home or inside[read.parents[e]]
    own = [i for i, line in enumerate(lines) if inside[line.home]]
    if read.names[home] in PAGE:
        parents, core = {lines[i].home for i in dense}, set(dense)
        near = [i for i in own if i in core or lines[i].home in parents and not lines[i].menu and not _COPYRIGHT.match(lines[i].text)]
    elif read.names[home] == "article":
        near = own
    else:
        near = [i for i in own if not lines[i].menu]
    first, last = near[0], near[-1]
    while first and lines[first - 1].tag in HEADINGS and not inside[lines[first - 1].home]:
        first -= 1
    return " ".join(line.text for i, line in enumerate(lines[first : last + 1], first) if inside[line.home] or i < near[0])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points); a row for each row.

    Null, empty or all-boilerplate html gives an empty text. Broken markup is read as far as it goes, in time linear in the page.
    Pages are worked on one by one; other columns of `pages` are not read.
    """
    modest_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
