"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one for each block element, and the lines' letters are summed
over a sliding window: the distribution surges where the article begins and dives where it ends. How
low a dive is follows from the page: a share of its average lines' sum. What elements,
classes and links say of a line is evidence: it makes its letters weigh next to nothing, so that
menus and footers are dives, and it is void where it would speak of most of the page. Boxes such as
adverts and forms in the midst of an article neither widen a gap nor are text.
Stretches that go on behind a gap in the same container, or behind a menu with about as much text, are one.
Of all stretches between a surge and a dive the one with the most text is the article; an article
element is but a hint: its letters count twice, and its border ends a stretch.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas textarea select button title".split())
#: A tag's name, and what may stand in a tag: quotes shield what ends it.
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
INSIDE = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*+>""")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never the article, and words of a class, id or role that say so.
APART = frozenset("nav header footer aside form menu dialog".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert warning newsletter subscribe subscription signup login sidebar rail aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs toc header masthead topbar footer foot copyright legal colophon comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations pagination pager search form toolbar".split()
)
#: Words beside them that say nothing.
PLAIN = frozenset(
    "a b bar block body bottom box center col column columns container content the entry fixed form global group inner item items js layout left line link links list lower main mobile module outer page panel post posts primary right row section secondary site slot sticky top text title unit upper wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Elements and words of what ends an article: only the dive keeps it out.
ENDING = frozenset("footer foot copyright legal colophon".split())
#: Elements of APART, and words, that part what stands before from what stands after them; others are boxes.
PARTING = frozenset("nav header footer menu navbar navigation menus masthead topbar foot copyright legal colophon".split())
#: Elements whose class or id is no evidence: prose stands in them.
PROSE = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th tr tbody".split())
#: Elements that hold an article or a part of a page.
CONTAINERS = frozenset("article div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: A notice of rights, which stands in no article element.
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b).{0,200}\Z", re.I)
SPACE = re.compile(r"\s+")
#: Lines that a window spans.
WINDOW = 3
#: What a letter inside an article element weighs when stretches are compared.
ARTICLE = 2
#: What all letters of a line weigh at most that evidence speaks against: less than one letter.
SLIGHT = 0.3
#: A dive: a window's sum under this share of that of the page's average lines, but at least what slight lines sum to.
DIVE = 0.05
#: Evidence is void of a region with more than this share of the page's letters.
MOST = 0.5
#: What the smaller of two stretches about a menu must have of the larger's text to be its second part.
PART = 0.25


def named(token: str, inside: int) -> bool:
    """Whether a class or id says that its element stands apart: `ad-slot-top` does; `has-sidebar` and
    `search-engines-explained`, of whose words most are others, don't."""
    parts = [p for p in re.split(r"[^a-z]+", token) if p]
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return False
    known = [p for p in parts if p in WORDS]
    others = [p for p in parts if p not in WORDS and p not in PLAIN]
    return len(known) > len(others) and any(not (inside and p in ("header", "alert", "form", "search")) for p in known)


def apart(name: str, attributes: str, inside: int = 0) -> str:
    """What says that an element stands apart from the article: its name, or a word of its attributes;
    empty if nothing does.

    `inside`: the number of the article it is in, if any; an article's own header is part of it.
    """
    if name in APART:
        return "" if inside and name == "header" else name
    if not attributes or name in ("html", "body", "main", "article"):
        return ""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "hidden"
        if key in ("class", "id") and name not in PROSE:
            for token in value.split():
                if named(token, inside):
                    return next((w for w in re.split(r"[^a-z]+", token) if w in PARTING), token)
    return ""


def parsed(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, name, whether it closes, attributes): each run of text with the tag behind it; no name
    at the end. Comments, declarations and hidden elements are gone.

    One pass: what is looked for in vain once is not looked for again, so that broken markup takes
    no longer than other.
    """
    at = start = 0  # where to look on, and where the run of text begins
    sure = -1  # the last > that was found
    shields = True
    text: list[str] = []
    while True:
        at = page.find("<", at)
        sign = page[at + 1 : at + 2] if at >= 0 else ""
        if at >= 0 and not (sign in ("!", "?", "/") or sign.isascii() and sign.isalpha()):
            at += 1
            continue
        if at >= 0 and sure < at:
            sure = page.find(">", at)
        if at < 0 or sure < 0:
            text.append(page[start : at if at >= 0 else len(page)])
            break
        stop = sure
        if sign in ("!", "?"):
            for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(begin, at):
                    found = page.find(end, at + len(begin))
                    stop = len(page) if found < 0 else found + len(end) - 1
            text += page[start:at], " "
            at = start = stop + 1
            continue
        tag = NAME.match(page, at)
        if not tag:  # such as </>, or a sign before blanks
            at += 1
            continue
        name, close = tag[2].lower(), bool(tag[1])
        inner = INSIDE.match(page, tag.end()) if shields and not close else None
        if inner:
            stop = inner.end() - 1
        elif not close:
            shields = False  # some quote never closes: none counts from here on
        text.append(page[start:at])
        attributes = page[tag.end() : stop]
        at = start = stop + 1
        if name in HIDDEN and not close:
            if not (name in ("svg", "math") and attributes.endswith("/")):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = start = end.end() if end else len(page)
            text.append(" ")
            continue
        yield "".join(text), name, close, attributes
        text.clear()
    yield "".join(text), "", False, ""


class Line(NamedTuple):
    text: str
    linked: bool  # most of it is links
    rights: bool  # a notice of rights
    regions: tuple[int, ...]  # open elements that stand apart, outermost first
    inside: int  # number of the article element, or 0
    container: int


def lines(page: str) -> tuple[list[Line], list[str]]:
    """A page's lines, and what made each region stand apart."""
    out: list[Line] = []
    nest, opened, count = [("", 0)], Counter(), 0  # the open containers
    text: list[str] = []
    linked = anchor = inside = articles = article_depth = 0
    why: list[str] = []
    shut: list[list] = []  # open regions: name, how often it is open inside, number

    def end() -> None:
        nonlocal linked
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            out.append(Line(joined, linked * 2 > len(joined), bool(RIGHTS.match(joined)), tuple(r[2] for r in shut), inside, nest[-1][1]))
        linked = 0

    for piece, name, close, attributes in parsed(page):
        text.append(piece)
        if anchor:
            linked += len(piece)
        if name in BLOCKS:
            end()
        elif name == "br":
            text.append(" ")
        elif name == "a":
            anchor = 0 if close else 1
        if name in CONTAINERS and not close:
            count += 1
            opened[name] += 1
            nest.append((name, count))
        while name in CONTAINERS and close and opened[name]:
            opened[nest[-1][0]] -= 1
            if nest.pop()[0] == name:
                break
        if not name or name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in ("article", "main") and not close:
            while shut and shut[-1][0] not in ("aside", "form", "article", "main"):
                shut.pop()  # it was never closed: the article doesn't belong to it
        if not close and len(shut) < NESTED and (reason := apart(name, attributes, inside)):
            end()
            shut.append([name, 1, len(why)])
            why.append(reason)
        elif (at := next((k for k in range(len(shut) - 1, -1, -1) if shut[k][0] == name), -1)) >= 0:
            shut[at][1] += -1 if close else 1
            if not shut[at][1]:
                del shut[at:]
        if name == "article":
            if not close:
                if not inside:
                    articles += 1
                    inside = articles
                article_depth += 1
            elif inside:
                article_depth -= 1
                if article_depth <= 0:
                    inside = article_depth = 0
    end()
    return out, why


#: Regions inside one another that are told apart.
NESTED = 8


def surges(weights: np.ndarray, window: int = WINDOW, least: float = 0) -> list[tuple[int, int]]:
    """Stretches of lines between a surge of the sums over sliding windows above `least` and a dive to it;
    a stretch ends with its last line of any weight."""
    sums = np.convolve(weights, np.ones(window))[: len(weights)]
    live = np.concatenate([[False], sums > least, [False]])
    turns = np.flatnonzero(live[1:] != live[:-1])
    out = []
    for a, b in turns.reshape(-1, 2):
        # The window that surges may begin with lines below the threshold that are part of it.
        a = max(a - window + 1, out[-1][1] if out else 0)
        full = a + np.flatnonzero(weights[a:b])
        out.append((int(full[0]), int(full[-1]) + 1))
    return out


def evidence(found: list[Line], why: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a line is in a box, in a menu or the like, links alone, whether it says what ends an article)."""
    letters = np.array([len(x.text) for x in found])
    held = np.bincount([r for x in found for r in x.regions], [len(x.text) for x in found for _ in x.regions], minlength=len(why))
    reason = [next((why[r] for r in x.regions if held[r] <= MOST * letters.sum()), "") for x in found]
    ends = np.array([r in ENDING for r in reason], bool)
    parts = np.array([r in PARTING for r in reason], bool)
    boxes = np.array([bool(r) for r in reason], bool) & ~parts
    links = np.array([x.linked and not x.inside for x in found], bool)
    rights = np.array([x.rights and not x.inside for x in found], bool)
    return boxes & ~ends, parts & ~ends, links, rights | ends


def chosen(found: list[Line], menus: np.ndarray, slight: np.ndarray) -> tuple[int, int]:
    """The stretch of lines that is the article; (0, 0) if there is none."""
    letters = np.array([len(x.text) for x in found], float)
    weights = np.where(slight, SLIGHT * np.minimum(letters, 100) / 100, letters)
    if not (weights >= 1).any():
        return 0, 0
    least = max(SLIGHT * WINDOW, DIVE * WINDOW * float(weights[weights >= 1].mean()))
    marked, container = (np.array([x[k] for x in found], np.int64) for k in (4, 5))
    stretches: list[tuple[int, int]] = []
    for a, b in surges(weights, least=least):
        # The border of an article element is one of stretches too.
        turns = a + 1 + np.flatnonzero(np.diff(marked[a:b] > 0))
        for p, q in zip([a, *turns], [*turns, b]):
            full = p + np.flatnonzero(weights[p:q] >= 1)  # a stretch begins and ends with text
            if not len(full):
                continue
            whole, p, q = p == a, int(full[0]), int(full[-1]) + 1
            if stretches and whole:
                first, last = stretches[-1][0], stretches[-1][1] - 1
                together = container[last] == container[p] or marked[last] == marked[p] > 0
                sizes = sorted((weights[first : last + 1].sum(), weights[p:q].sum()))
                beside = slight[last + 1 : p].all() and menus[last + 1 : p].any() and sizes[0] >= PART * sizes[1]
                if (marked[last] > 0) == (marked[p] > 0) and (together or beside):
                    stretches[-1] = first, q
                    continue
            stretches.append((p, q))
    worth = weights * np.where(marked > 0, ARTICLE, 1)
    a, b = max(stretches, key=lambda s: (worth[s[0] : s[1]].sum(), -s[0]))
    # Short lines at its ends that go on in the same container are below no dive.
    alike = lambda k, of: 0 <= k < len(found) and weights[k] >= 1 and container[k] == container[of] and marked[k] == marked[of]
    while alike(a - 1, a):
        a -= 1
    while alike(b, b - 1):
        b += 1
    return a, b


def main_text(page: str | None) -> str:
    """The article's lines, joined by line feeds; empty if there are none."""
    if not page:
        return ""
    found, why = lines(page)
    if not found:
        return ""
    boxes, menus, links, ends = evidence(found, why)
    # Links part stretches like menus, boxes don't widen the gap that they stand in.
    keep = np.flatnonzero(~boxes)
    found, menus, links, ends = [found[k] for k in keep], menus[keep], links[keep], ends[keep]
    a, b = chosen(found, menus, menus | links | ends)
    return "\n".join(found[k].text for k in range(a, b) if not (menus[k] or links[k]))


def extracted(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each input row: the main text and its code points.

    A null or empty page has the empty text, as has a page without any text outside menus and
    the like. Character references are decoded, white space inside a block is one blank, blocks
    are joined in page order by one line feed. Repeated rows, null ids and null addresses stay;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
