"""HTML extraction by tag-path ratios.

A page is cut into blocks, each with its path of tags and classes from the root.
Text length and punctuation are summed a path and divided by its number of
blocks; both ratios are smoothed over the blocks in page order, multiplied, and
the paths above a threshold (a share of the standard deviation) are content.

The article grows from the content paths: it begins with the innermost element
that holds nearly all of their weight (no list, table or quote), and takes in the
element around it as long as what that adds is on content paths or a heading. So a
lead or a title outside the innermost element belongs to it, and a menu or a list
of links does not. The text is all of its blocks in page order, headings and list
items as well, but for elements that are no article by tag, role, state (hidden) or
by a word of their class or id; an element that such a word names but that holds
most of the page's text is kept. Rows are independent, so pages are read in Arrow
batches and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HOLDS = 0.8
THRESHOLD = 0.5
SMOOTH = (1, 2, 1)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A class that says what an element around it has is no name of the element.
_ABOUT = re.compile(r"(?:^|\s)(?:has|no|with|without)-[^\s]*", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_LISTS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr td th blockquote figure p pre".split()) | _HEADINGS
MOST = 0.6
# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
#: An opening tag ends these elements if they are open within the nearest container.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote fieldset figure".split())
_SKIP_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id attributes of what is not the article. A name says so only as a whole:
#: it is made of these words and of the neutral ones, written apart or together.
_SKIP_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer form gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "teaser teasers toolbar topbar widget widgets".split()
)
_NEUTRAL_WORDS = (
    "a area bar bars block blocks bottom box boxes btn button buttons col column container content entry fixed global group head header inline inner item items js "
    "label left lg line link links list lists main md modal module nd no of outer overlay page panel panels post posts primary right row secondary section sections "
    "site slot slots sm sticky stories story sub text the top unit units up us view wrap wrapper xs articles news media icon icons now your latest level third"
).split()
_SKIPS = frozenset(_SKIP_WORDS)
_each = "|".join(sorted({*_SKIP_WORDS, *_NEUTRAL_WORDS}, key=lambda w: (-len(w), w)))
_NAMED = re.compile(rf"(?:(?:{_each}|[0-9]+)[^a-z0-9]*)+")
_ARTICLE_WORDS = frozenset("article content entry main post story body".split())
#: A line of rights at the end of a page, whatever element holds it.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)[^\n]{0,160}", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：]")
_WORDS = re.compile(r"[A-Za-z]+")


class _Node:
    __slots__ = ("tag", "path", "parent", "skip", "depth")

    def __init__(self, tag: str, key: str, parent: _Node | None, aside: str, paths: dict[tuple[int, str], int]):
        self.tag, self.parent = tag, parent
        self.path = paths.setdefault((parent.path, key), len(paths) + 1) if parent else 0  # equal paths, equal numbers
        self.depth = parent.depth + 1 if parent else 0
        #: The outermost element around that is no article, and whether only a word says so.
        self.skip = parent.skip if parent and parent.skip else (self, aside == "word") if aside else None


def _attributes(text: str | None) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(text)} if text else {}


@lru_cache(maxsize=4096)
def _is_aside_name(name: str) -> bool:
    """Whether a class or id names what is no article: ``cookie-bar``, ``commentlist``,
    ``siteFooter``, but not ``related-work`` or ``notice-period``."""
    apart = re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()
    if len(apart) > 80 or not _NAMED.fullmatch(apart):
        return False
    return any(w in _SKIPS or any(w.startswith(s) or w.endswith(s) for s in _SKIPS if len(s) > 2) for w in _WORDS.findall(apart))


def _aside(tag: str, attrs: dict[str, str], within_article: bool) -> str:
    """Why the element is no part of an article: by its tag, role or state
    ("kind"), or by a word of its class or id ("word"); empty if it may be."""
    if tag in _SKIP_TAGS or attrs.get("role", "").lower() in _SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attrs.get("style", "")):
        return "kind"
    if tag == "header":
        return "" if within_article else "kind"
    named = _ABOUT.sub(" ", attrs.get("class", "") + " " + attrs.get("id", ""))
    words = {w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named))}
    if "header" in words and tag not in ("h1", "h2", "h3") and not words & _ARTICLE_WORDS and not within_article:
        return "word"
    return "word" if tag not in ("html", "body", "article", "main") and any(_is_aside_name(name) for name in named.split()) else ""


def blocks(page: str) -> list[tuple[_Node, str]]:
    """Blocks of a page in order: the element that holds them and their text,
    decoded, white space as single spaces; blocks without text are left out."""
    paths: dict[tuple[int, str], int] = {}
    root = _Node("", "", None, "", paths)
    stack, found, parts = [root], [], []
    articles = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((next(n for n in reversed(stack) if n.tag not in _INLINE), text))

    def pop_to(i: int) -> None:
        nonlocal articles
        articles -= sum(n.tag in ("article", "main") for n in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if lt > at:
            parts.append(page[at:lt])
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[3] is None:
            if m[1]:
                parts.append(html.escape(m[1]))
            continue
        tag = m[3].lower()
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif not m[2]:
                if tag not in _VOID:
                    attrs = _attributes(m[4])
                    aside = _aside(tag, attrs, articles > 0) if attrs else ""
                    if aside:
                        flush()
                    stack.append(_Node(tag, tag, stack[-1], aside, paths))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if stack[i].skip and not stack[i].parent.skip:
                            flush()
                        del stack[i]
                        break
                    if stack[i].tag not in _INLINE:
                        break
            continue
        if tag in ("svg", "math") and m[4].endswith("/"):  # closed already, as in foreign elements
            continue
        if tag in _RAW and not m[2]:  # does not end a block
            end = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            at = n if end is None else end.start()
            if end is not None:
                gt = page.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag not in _SCOPES and stack[i].tag in _SCOPES:
                    break
            continue
        if tag in _VOID or m[4].endswith("/") and tag not in _SCOPES:
            continue
        if tag == "body" and stack[-1].tag == "head":
            pop_to(len(stack) - 1)
        closes = _CLOSES.get(tag, {"p"})
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closes:
                pop_to(i)
            elif stack[i].tag in _SCOPES:
                break
        while stack[-1].tag in _INLINE and not stack[-1].skip:  # unclosed formatting does not nest blocks
            stack.pop()
        attrs = _attributes(m[4])
        key = tag + ("." + ".".join(attrs["class"].split()) if attrs.get("class") else "")
        aside = _aside(tag, attrs, articles > 0)
        articles += tag in ("article", "main")
        stack.append(_Node(tag, key, stack[-1], aside, paths))
    flush()
    return found


def _smooth(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(w * padded[i + j] for j, w in enumerate(SMOOTH)) / sum(SMOOTH) for i in range(len(values))]


def path_scores(found: list[tuple[_Node, str]]) -> dict[int, float]:
    """Fused ratio of each tag path: smoothed text length times punctuation."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in found:
        length[node.path] += len(text)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        count[node.path] += 1
    long = _smooth([length[n.path] / count[n.path] for n, _ in found])
    dense = _smooth([(marks[n.path] + 0.1) / count[n.path] for n, _ in found])
    total = defaultdict(float)
    for (node, _), a, b in zip(found, long, dense, strict=True):
        total[node.path] += a * b
    return {p: v / count[p] for p, v in total.items()}


def extract(page: str | None) -> str:
    """The article of a page, one line a block; empty if there is none."""
    every = blocks(page or "")
    named: dict[int, int] = defaultdict(int)
    for node, text in every:
        if node.skip and node.skip[1]:
            named[id(node.skip[0])] += len(text)
    whole = sum(len(t) for _, t in every)
    kept = {k for k, n in named.items() if n >= MOST * whole}
    found = [(n, t) for n, t in every if not n.skip or id(n.skip[0]) in kept]
    while len(found) > 1 and _RIGHTS.fullmatch(found[-1][1]):
        found.pop()
    if not found:
        return ""
    scores = path_scores(found)
    values = list(scores.values())
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    content = {p for p, v in scores.items() if v >= THRESHOLD * spread} or set(scores)
    weight: dict[int, float] = defaultdict(float)  # of content paths, by element
    foreign: dict[int, int] = defaultdict(int)  # blocks that are neither content nor heading
    held: dict[int, int] = defaultdict(int)
    nodes: dict[int, _Node] = {}
    total = 0.0
    for node, text in found:
        on_path = node.path in content
        total += len(text) * on_path
        other = not on_path and node.tag not in _HEADINGS
        up = node
        while up is not None:
            k = id(up)
            weight[k] += len(text) * on_path
            foreign[k] += other
            held[k] += 1
            nodes[k] = up
            up = up.parent
    best = max((n for k, n in nodes.items() if weight[k] >= HOLDS * total and n.tag not in _INLINE and n.tag not in _LISTS), key=lambda n: n.depth)
    up = best.parent
    while up is not None:
        if up.tag in _LISTS or foreign[id(up)] == foreign[id(best)]:
            best = up
        elif held[id(up)] > held[id(best)]:
            break
        up = up.parent
    out = []
    for node, text in found:
        up = node
        while up is not None and up is not best:
            up = up.parent
        if up is best:
            out.append(text)
    return "\n".join(out)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = [extract(h) for h in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null page is an empty one, whose text is empty. Rows that repeat stay;
    other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
