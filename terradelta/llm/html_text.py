"""HTML extraction by line-block distribution.

Markup is stripped to lines, one a block element.  Lines are of three sides: within an
article or main element, within one whose class, id or role names clutter, and the rest;
the innermost such element counts.  A line weighs as much as its text out of links, times
its side's factor in ``SIDES``; menus, headers, footers, sidebars, dialogs, forms, scripts
and styles by tag weigh nothing and have no lines.  Sums over a sliding window of
``block`` lines of one side give the distribution, which decides on every page: a run
of lines of one side surges where a sum rises to the threshold, which is ``threshold``
or ``SHARE`` of the page's highest sum, whichever is more, and is kept whole.  It dives
where ``block`` lines in a row have no weight on its side; up to there short lines on
either side are kept with it.  On a page where nothing surges the run of the highest
sum is kept.

Defined cases: null or empty html, or a page with no main text, gives an empty text;
markup that never closes ends with the page; repeated pages are rows of their own;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of

#: Lines in a window, and characters that a window needs for a surge.
BLOCK = 3
THRESHOLD = 80
#: Share of the page's highest sum that a surge needs.
SHARE = 0.25
#: What a character counts in an element named as clutter, in none, in an article or main element.
SIDES = (0.125, 1.0, 2.0)
CLUTTER, PLAIN, ARTICLE = range(3)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object|math|canvas|head|button)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z!?][^<>]*>",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form header menu dialog".split())
MAIN = frozenset(["article", "main"])
#: Words in class, id or role of what often isn't main text; they only weigh.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer form header masthead "
    "menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond search share sharing sidebar skip social "
    "sponsor sponsored subscribe tags toolbar widget widgets".split()
)
MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def is_clutter(name: str, attrs: str) -> bool:
    if name in MAIN or name in ("body", "html") or not attrs:
        return False
    return any(not MARKS.isdisjoint(WORD.findall((a or b or c).lower())) for a, b, c in MARKED.findall(attrs))


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, length out of links, side) of every line; neighbouring elements that weigh nothing give one empty line."""
    out, pieces, linked = [], [], 0
    skip: list[str] = []  # open elements since, and with, the one that weighs nothing
    sides: list[list] = []  # [name, side, open elements of that name within] of elements that have a side
    link = 0
    at = 0

    def end_line():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                side = sides[-1][1] if sides else PLAIN
                out.append((text, len(text) if side == ARTICLE else max(0, len(text) - linked), side))
            pieces.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text and not skip:
            pieces.append(text)
            if link:
                linked += len(text.strip())

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        close = page[m.start() + 1] == "/"
        empty = name in VOID or m["attrs"].endswith("/")
        if skip:
            if name == skip[0]:
                if close:
                    skip.pop()
                elif not empty:
                    skip.append(name)
            if not skip and out and out[-1][0]:
                out.append(("", 0, PLAIN))
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if close else 1
            if close or empty or not is_clutter(name, m["attrs"]):
                if close and sides and sides[-1][0] == name:  # a marked inline element ends
                    end_line()
                    sides[-1][2] -= 1
                    if sides[-1][2] < 0:
                        sides.pop()
                elif not close and not empty and sides and sides[-1][0] == name:
                    sides[-1][2] += 1
                continue
        end_line()
        if name not in INLINE:
            link = 0
        if close:
            if name in MAIN and any(x[0] == name for x in sides):
                while sides[-1][0] != name:  # elements that never closed end with it
                    sides.pop()
            if sides and sides[-1][0] == name:
                sides[-1][2] -= 1
                if sides[-1][2] < 0:
                    sides.pop()
        elif not empty:
            if name in BOILERPLATE:
                skip.append(name)
            elif name in MAIN:
                sides.append([name, ARTICLE, 0])
            elif is_clutter(name, m["attrs"]):
                sides.append([name, CLUTTER, 0])
            elif sides and sides[-1][0] == name:
                sides[-1][2] += 1
    add(page[at:])
    end_line()
    return out


def surges(weights: list[float], sides: list[int], block: int = BLOCK, threshold: float = THRESHOLD, share: float = SHARE) -> list[int]:
    """The lines between surge and dive, by weight and side of every line."""
    runs = []  # (highest sum, lines)
    for side in sorted(set(sides)):
        own = [w if s == side else 0 for w, s in zip(weights, sides)]
        at = [i for i, w in enumerate(own) if w]
        first = 0
        for k, i in enumerate(at):
            if k + 1 < len(at) and at[k + 1] - i <= block:
                continue
            lines = range(at[first], i + 1)
            first = k + 1
            runs.append((max(sum(own[j : j + block]) for j in lines), [j for j in lines if sides[j] == side]))
    if not runs:
        return []
    peak = max(runs, key=lambda x: x[0])
    need = max(threshold, share * peak[0])
    return sorted(j for top, lines in runs if top >= need for j in lines) or peak[1]


def main_text(page: str | None) -> str:
    """The lines between surge and dive, joined by one space."""
    lines = lines_of(page or "")
    kept = surges([n * SIDES[side] for _, n, side in lines], [side for _, _, side in lines])
    return " ".join(lines[i][0] for i in kept if lines[i][0])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return with_columns_of(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
