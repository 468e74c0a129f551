"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself: text
inside menus, headers, footers, sidebars, notices, adverts, forms and comments (by tag, role
or class) and blocks dense in links are boilerplate; long blocks, and in an article blocks of
running text, with stop words or inside an article element are content; the rest is ambiguous.
On a page whose long blocks hold hardly a stop word of the four languages, stop words don't count: length and links decide.
The second pass gives an ambiguous block the label of its nearest decided neighbours: of both if they agree,
of the nearer one if not (as near: content in an article, boilerplate outside), of the article around it where that has no decided block.

Scripts, styles, the head, comments and markup never reach a block; character
references are decoded. White space inside a block becomes one space, blocks are
joined by one space in page order. Null and empty pages give an empty text; broken markup is read as
far as it goes (an unended tag at the end is markup; an unended script or the like takes the rest, other unended
elements nothing). Ends without a start are passed over. Repeated rows are read each; of a column ``text`` or ``n_chars``
that is carried, the name is kept and the operator's own gets another.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common

LONG, SHORT, LINKS, STOPS, KNOWN = 140, 50, 0.33, 0.12, 0.02

# HTML element names by role, words of class and id attributes that mark
# boilerplate, and the most common function words of four languages.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas textarea select head title audio video".split())
BOILER = frozenset("nav header footer aside form menu button dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead comment comments respond reply replies discussion disqus social share sharing related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager copyright legal disclaimer tags skip search".split())
CONTENT = frozenset("article post entry content main body story text".split())
STOPWORDS = frozenset("the of and to in a is that for it on with as was at by be this from are or an have not der die das und zu mit von ist den dem des ein eine auf für im nicht sich auch es le la les de et un une du que qui dans en pas pour sur par au avec el los las y se del que una por con para al lo su".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILER:
        return not (tag == "header" and in_article)
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return True
    words: set[str] = set()
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words.update(_SPLIT.split(value))
        elif name == "role" and value.strip() in ROLES or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(words & CUES) and not words & CONTENT


class _Block:
    __slots__ = ("article", "boiler", "heading", "linked", "parts", "text")

    def __init__(self, boiler: bool, article: int, heading: bool):
        self.boiler, self.article, self.heading, self.parts, self.linked, self.text = boiler, article, heading, [], 0, ""


def blocks(page: str) -> list[_Block]:
    """Blocks with text, in page order."""
    out: list[_Block] = []
    stack: list[tuple[str, bool, int]] = []  # element, boilerplate, number of the article around
    articles, in_link, at = 0, False, 0
    now = _Block(False, 0, False)
    open_tags: Counter[str] = Counter()
    never: set[str] = set()  # elements that have no end in the rest of the page

    def drop(k: int) -> None:
        for name, *_ in stack[k:]:
            open_tags[name] -= 1
        del stack[k:]

    def turn(tag: str) -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        boiler, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        now = _Block(boiler, article, tag in ("h1", "h2", "h3", "h4", "h5", "h6"))

    def add(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if in_link:
                now.linked += len(raw)

    while at < len(page):
        m = _TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        close, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not close and tag in UNSEEN:
            if not attributes.endswith("/") or tag in ("script", "style", "title"):
                end = None if tag in never else re.compile(rf"</{re.escape(tag)}\s*[^>]*>" if tag != "head" else r"</head\s*[^>]*>|(?=<body[\s>])", re.I).search(page, at)
                if not end:
                    never.add(tag)
                at = end.end() if end else len(page) if tag in RAW else at
            if tag in BLOCKS:
                turn(tag)
            continue
        if tag == "a":
            in_link = not close
            if close or not _boilerplate(tag, attributes, True):
                continue
        if close:
            if open_tags[tag]:
                drop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            if tag in BLOCKS:
                in_link = False
                turn("")
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                turn("")
            continue
        if tag in ("article", "main"):
            while stack and stack[-1][1]:  # menus and the like that were never closed
                drop(len(stack) - 1)
        while tag in ("p", "li", "option", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in ("p", tag):
            drop(len(stack) - 1)
        boiler, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        boiler = boiler or _boilerplate(tag, attributes, article > 0)
        if tag in ("article", "main") and not boiler:
            articles += 1
            article = articles
        if tag in BLOCKS or boiler and not (stack and stack[-1][1]):
            stack.append((tag, boiler, article))
            open_tags[tag] += 1
            in_link = in_link and tag not in BLOCKS
            turn(tag)
    turn("")
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def _stops(b: _Block) -> tuple[int, int]:
    """Stop words and words."""
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOPWORDS for w in words), len(words)


def told(found: list[_Block]) -> bool:
    """Whether stop words tell running text on this page: its long blocks hold enough of them to be in a language of the list."""
    counts = [_stops(b) for b in found if not b.boiler and len(b.text) >= LONG]
    return not counts or sum(s for s, _ in counts) >= KNOWN * sum(n for _, n in counts)


def verdict(b: _Block, told: bool = True) -> bool | None:
    """First pass: content, boilerplate, or None for ambiguous. told: whether stop words count, else length and links alone."""
    if b.boiler or b.linked > LINKS * sum(map(len, b.parts)):
        return False
    n = len(b.text)
    stops, words = _stops(b)
    stops = stops / words if told else STOPS
    if b.article:
        return True if n >= SHORT and (stops >= STOPS or n >= LONG) else None
    if n < SHORT or b.heading:
        return False if b.text.startswith("©") else None
    if stops >= STOPS:
        return True if n >= LONG else None
    return False


def labels(found: list[_Block]) -> list[bool]:
    """Both passes over a page's blocks."""
    known = told(found)
    first = [verdict(b, known) for b in found]
    before: list[int | None] = []
    for i in range(len(found)):
        before.append(i - 1 if i and first[i - 1] is not None else before[i - 1] if i else None)
    after: list[int | None] = [None] * len(found)
    for i in range(len(found) - 2, -1, -1):
        after[i] = i + 1 if first[i + 1] is not None else after[i + 1]
    out = []
    for i, (b, v) in enumerate(zip(found, first, strict=True)):
        if v is None:
            around = [j for j in (before[i], after[i]) if j is not None and (not b.article or found[j].article == b.article)]
            if not around:
                v = b.article > 0
            elif len({first[j] for j in around}) == 1:
                v = bool(first[around[0]])
            elif b.heading:
                v = bool(first[around[1]])
            else:
                v = bool(first[min(around, key=lambda j: (abs(j - i), bool(first[j]) != (b.article > 0)))])
        out.append(v)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """Columns ``carry`` of pages with text and n_chars (code points)."""
    raw, text, n_chars = common.unused(pages.select(*carry), "_raw", "text", "n_chars")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry).schema), f"{text} string, {n_chars} long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(x) for x in part.column(raw).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carry, text, n_chars])

    return pages.select(*carry, F.col(column).alias(raw)).mapInArrow(run, schema)


def op5_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])


QUERIES = {"op5_block_rules": op5_block_rules}
ORACLES: dict[str, str] = {}
