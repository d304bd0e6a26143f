"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative by
weights learned from labelled pages: pages whose markup names the article itself. One
linear scan finds the run with the largest sum. Elements that by name or class are not
article text are read past, unless the article or most of the page stands in them; the
tags of an article element bound every run.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import pieces

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noscript|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(
    r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE
)
PART = re.compile(r"[a-z]+")

#: Elements that hold no article text.
ASIDE = frozenset(
    "head nav header footer aside form button select option label input dialog menu template"
    " svg canvas object audio video map noscript iframe".split()
)
#: Words of names in class, id or role of elements that hold no article text; a name counts
#: only if it has no other words ("cookie-notice", but not "has-sidebar").
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside"
    " complementary contentinfo widget cookie cookies consent gdpr notice notification alert"
    " popup modal overlay newsletter subscribe signup login search share sharing social related"
    " recommended comment comments disqus respond reply replies toolbar pagination".split()
)
#: The element that names the article; its tags are walls.
ARTICLE = ("article", "main")
WALLS = frozenset([*ARTICLE, "body", "html"])
#: Of the elements without article text, those that a page may be wrapped in.
WRAPPERS = frozenset(["form"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre"
    " section summary table tbody tfoot thead tr ul".split()
)
#: A start tag closes the nearest open element of the first set, up to one of the second.
ITEM_BOUNDS = (
    "ul ol menu dl table td th tr article aside blockquote body button details fieldset figure"
    " footer form header main nav section template"
)
IMPLIED = {
    name: (frozenset(closes.split()), frozenset(bounds.split()))
    for names, closes, bounds in (
        ("li", "li", ITEM_BOUNDS),
        ("dt dd", "dt dd", ITEM_BOUNDS),
        ("option optgroup", "option", "select datalist optgroup"),
        ("td th", "td th", "tr table template"),
        ("tr", "tr", "table tbody thead tfoot template"),
        ("tbody thead tfoot", "tbody thead tfoot tr", "table template"),
    )
    for name in names.split()
}
#: These close an open paragraph; it is never closed beyond one of the second set.
ENDS_P = BLOCKS - frozenset("body html caption tbody thead tfoot tr".split())
P_BOUNDS = frozenset("button caption html marquee object table td template th".split())
P_RULE = (frozenset(["p"]), P_BOUNDS)
#: All that the start tag of a name closes, and the rules for which an element counts.
CLOSES = {
    name: [P_RULE] * (name in ENDS_P) + [IMPLIED.get(name)] * (name in IMPLIED)
    for name in ENDS_P | IMPLIED.keys()
}
RULES = {P_RULE, *IMPLIED.values()}
COUNTS = {
    name: [rule for rule in RULES if name in rule[0] | rule[1]]
    for name in frozenset().union(*(ends | bounds for ends, bounds in RULES))
}
#: Inside a block these are white space.
GAPS = frozenset(("br", "td", "th", "wbr"))

WORD_SCORE = 1.0
UNSEEN_TAG = -0.2
LEAST_COST = 0.1
#: About this many labelled pages, chosen by a hash, are learned from.
LABELLED_PAGES = 2000
#: Tag names with the most occurrences that get a weight; others count as unseen.
TAG_NAMES = 2000


@dataclass
class Item:
    """One step of a page: a text, a tag, or a whole element that was read past."""

    tag: str = ""  # with a slash in front for an end tag; empty for text
    text: str = ""
    aside: bool = False
    article: int = 0  # number of the article element that it stands in
    words: int = 0


@dataclass
class Open:
    """An element whose end is not reached yet."""

    name: str
    start: int  # place of its tag among the steps
    aside: str = ""  # how it says that it holds no article text: by name or by class


def _aside(name: str, attrs: str) -> str:
    if name in ASIDE:
        return "name"
    if name in WALLS and name not in ARTICLE or not attrs:
        return ""
    for found in NAMED.finditer(attrs):
        value = (found[1] or found[2] or found[3] or "").lower()
        for parts in map(PART.findall, value.split()):
            if parts and ASIDE_WORDS.issuperset(parts):
                return "class"
    return ""


def _implied(open_tags: list[Open], places: list[int], ends: frozenset, name: str) -> int | None:
    """Height to which a start tag closes the open elements, if it closes any.

    ``places`` are the heights of the open elements that can end or bound it.
    """
    lowest = None
    for at in reversed(places):
        here = open_tags[at].name
        if here not in ends:
            break
        lowest = at
        if here != "tr" or name == "tr":
            break
    return lowest


Span = tuple[Open, int, int]


def _steps(page: str | None) -> tuple[list[Item], list[Span], list[Span]]:
    """All steps of a page, its asides and its articles, inner ones first, with their steps.

    End tags close the elements left open inside theirs; a start tag closes the items,
    cells and paragraphs that it ends by itself. An aside reaches from its start tag
    through its end tag, an article up to its end tag.
    """
    out: list[Item] = []
    open_tags: list[Open] = []
    names: Counter = Counter()
    places: dict = {rule: [] for rule in RULES}
    asides: list[Span] = []
    articles: list[Span] = []

    def close(height: int, end_tag: str = "") -> None:
        while len(open_tags) > height:
            ended = open_tags.pop()
            names[ended.name] -= 1
            for rule in COUNTS.get(ended.name, ()):
                places[rule].pop()
            if ended.name in ARTICLE:
                articles.append((ended, ended.start, len(out)))
            if end_tag and len(open_tags) == height:
                out.append(Item(tag=end_tag))
            if ended.aside:
                asides.append((ended, ended.start, len(out)))

    for found in TOKEN.finditer(page or ""):
        if found["text"] is not None:
            text = html.unescape(found["text"])
            out.append(Item(text=text, words=len(text.split())))
            continue
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if found["end"] or found["end2"]:
            if names[name]:
                at = len(open_tags) - 1
                while open_tags[at].name != name:
                    at -= 1
                close(at, f"/{name}")
            continue
        for ends, bounds in CLOSES.get(name, ()):
            height = _implied(open_tags, places[ends, bounds], ends, name)
            if height is not None:
                close(height)
        aside = _aside(name, attrs)
        empty = name in VOID or attrs.rstrip().endswith("/")
        out.append(Item(tag=name, aside=bool(aside) and empty))
        if not empty:
            open_tags.append(Open(name, len(out) - 1, aside))
            names[name] += 1
            for rule in COUNTS.get(name, ()):
                places[rule].append(len(open_tags) - 1)
    close(0)
    return out, asides, articles


def _read_past(steps: list[Item], asides: list[Span], articles: list[Span]) -> dict[int, int]:
    """Last-plus-one step, by first step, of the elements to read past.

    An aside stays if it holds a ``main``, or an article while none stands outside all
    asides, or, where it is one by class only, most of the page's words outside links. An
    article that is an aside itself counts only where it is the only one.
    """
    if not asides:
        return {}
    named = {a[1] for a in articles if a[0].name == "article" and not a[0].aside}
    if not named and len(articles) == 1:
        named = {articles[0][1]}
    mains = {a[1] for a in articles if a[0].name == "main"}
    covers = [0] * (len(steps) + 1)
    for _, first, last in asides:
        covers[first] += 1
        covers[last] -= 1
    # words outside links, and elements that hold the article, up to each step
    words, holds = [0], [0]
    linked = 0
    covered = list(accumulate(covers))
    if any(not covered[at] for at in named):
        named = set()
    for at, item in enumerate(steps):
        linked = max(0, linked + (item.tag == "a") - (item.tag == "/a"))
        words.append(words[-1] + (0 if linked else item.words))
        holds.append(holds[-1] + (at in named or at in mains))
    past: dict[int, int] = {}
    gone: list[tuple[int, int]] = []  # first step and words of what is read past so far
    for element, first, last in asides:
        lost = 0
        while gone and gone[-1][0] >= first:
            lost += gone.pop()[1]
        own = words[last] - words[first] - lost
        soft = element.aside == "class" or element.name in WRAPPERS
        if holds[last] == holds[first] and not (soft and 2 * own > words[-1]):
            past[first] = last
            lost += own
        if lost:
            gone.append((first, lost))
    return past


def items_of(page: str | None) -> list[Item]:
    """The steps of a page, each element that holds no article text as one step."""
    steps, asides, articles = _steps(page)
    past = _read_past(steps, asides, articles)
    ends = {first: last for _, first, last in articles}
    out: list[Item] = []
    inside: list[tuple[int, int]] = []  # ends and numbers of the articles around a step
    number, at = 0, 0
    while at < len(steps):
        item = steps[at]
        while inside and inside[-1][0] <= at:
            inside.pop()
        item.article = inside[-1][1] if inside else 0
        out.append(item)
        if at in past:
            item.aside = True
            at = past[at]
            continue
        if at in ends:
            number += 1
            inside.append((ends[at], number))
        at += 1
    return out


def tag_counts(page: str | None) -> Counter:
    """``(tag, inside)`` counts of a page with exactly one article element; else none."""
    items = items_of(page)
    numbers = {i.article for i in items if i.article}
    if len(numbers) != 1:
        return Counter()
    return Counter(
        (i.tag, bool(i.article))
        for i in items
        if i.tag and not i.aside and i.tag.lstrip("/") not in WALLS
    )


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last-plus-one step of the run with the largest positive sum; first of equals."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, span = total, (start, at + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, joined by blank lines; a run in an article takes all of it."""
    items = items_of(page)
    scores = [
        WORD_SCORE * i.words
        if not i.tag
        else -math.inf
        if i.tag.lstrip("/") in WALLS
        else UNSEEN_TAG
        if i.aside
        else weights.get(i.tag, UNSEEN_TAG)
        for i in items
    ]
    first, last = best_run(scores)
    inside = {i.article for i in items[first:last] if i.words}
    if len(inside) == 1 and (number := inside.pop()):
        kept = [i for i in items if i.article == number]
    else:
        kept = items[first:last]
    blocks, now = [], []
    for item in kept:
        name = item.tag.lstrip("/")
        if name in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif name in GAPS:
            now.append(" ")
        elif not name:
            now.append(item.text)
    blocks.append("".join(now))
    texts = (" ".join(b.split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def fit_tag_weights(
    pages: DataFrame,
    id_column: str = "page_id",
    html_column: str = "html",
    labelled_pages: int = LABELLED_PAGES,
) -> dict[str, float]:
    """Weight of each tag, never above ``-LEAST_COST``: log odds of standing inside an article.

    Learned from about ``labelled_pages`` pages, read whole, that a hash of the id
    chooses among those that hold an article tag.
    """
    known = pages.where(F.lower(F.col(html_column)).rlike("<(article|main)[ >]")).select(
        F.pmod(F.xxhash64(F.lit("pages"), id_column), F.lit(1 << 30)).alias("draw"),
        F.col(html_column).alias("html"),
    )
    share = min(1.0, labelled_pages / max(1, known.count()))
    drawn = known.where(F.col("draw") < int(share * (1 << 30))).select("html")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found: Counter = Counter()
            for page in batch.column(0).to_pylist():
                found.update(tag_counts(page))
            rows = [(tag, inside, n) for (tag, inside), n in found.items()]
            tags, inside, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tags, pa.string()), pa.array(inside, pa.bool_()), pa.array(n, pa.int64())],
                names=["tag", "inside", "n"],
            )

    counted = drawn.mapInArrow(of, "tag string, inside boolean, n long").groupBy("tag").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside"),
    )
    most = counted.orderBy(F.desc(F.col("inside") + F.col("outside")), "tag").limit(TAG_NAMES)
    return {
        r["tag"]: -max(LEAST_COST, math.log((r["outside"] + 1) / (r["inside"] + 1)))
        for r in most.collect()
    }


def extract_text(
    pages: DataFrame,
    weights: dict[str, float],
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per row: ``page_id, url, text, n_chars``; empty text for a page without words.

    A null or empty page has an empty text. Repeated rows give equal texts; null ids
    and urls stay null; an empty table gives no rows. Other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
    )
    return slim.mapInArrow(of, "page_id long, url string, text string, n_chars long")
